"""Queries for slowly changing dimensions (SD), star schema (ST) and Data Vault (DV)."""

from pyspark.sql import functions as F

from zonecraft.functions import hashing as H
from zonecraft.functions.exprs import money, ymd
from zonecraft.operators import dims as S
from zonecraft.operators import joins as J
from zonecraft.operators import rules as R
from zonecraft.operators import vault as V
from zonecraft.plans import catalog as cat
from zonecraft.plans.registry import query

ATTRS = ["c_name", "c_mktsegment", "c_acctbal"]

EX_SQL = """
existing AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS sk, '2020-01-01' AS effective_start,
  CASE WHEN c_nationkey = 5 THEN '2023-01-01' END AS effective_end, c_nationkey <> 5 AS is_current FROM customer)
"""


def existing(t):
    x = S.scd2_first(t.customer.select("c_custkey", *ATTRS, "c_nationkey"), ["c_custkey"], "2020-01-01")
    closed = F.col("c_nationkey") == 5
    return x.select("c_custkey", *ATTRS, "sk", "effective_start", F.when(closed, F.lit("2023-01-01").cast("date")).alias("effective_end"),
                    (~closed).alias("is_current"))


def plain(t):
    """Dimension without history: key, attributes, surrogate key."""
    return S.number_rows(t.customer.select("c_custkey", *ATTRS).withColumn("sk", F.lit(None).cast("long")), ["c_custkey"])


PLAIN_SQL = "dim AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS sk FROM customer)"
_NEW = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal, (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY c_custkey) AS sk FROM incoming WHERE c_custkey NOT IN (SELECT c_custkey FROM dim)"


def _bal(x):
    return x.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("sd_0", f"WITH {cat.INCOMING_SQL}, {PLAIN_SQL} SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, sk FROM (SELECT * FROM dim UNION ALL {_NEW})")
def sd_0(t):
    return _bal(S.scd0(cat.incoming(t), plain(t), ["c_custkey"]))


@query("sd_1", f"""WITH {cat.INCOMING_SQL}, {PLAIN_SQL} SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, sk FROM (
SELECT d.c_custkey, coalesce(i.c_name, d.c_name) AS c_name, coalesce(i.c_mktsegment, d.c_mktsegment) AS c_mktsegment, coalesce(i.c_acctbal, d.c_acctbal) AS c_acctbal, sk FROM dim d LEFT JOIN incoming i USING (c_custkey)
UNION ALL {_NEW})""")
def sd_1(t):
    return _bal(S.scd1(cat.incoming(t), plain(t), ["c_custkey"]))


def _scd2_sql(changed):
    return f"""WITH {cat.INCOMING_SQL}, {EX_SQL},
j AS (SELECT e.*, i.c_custkey AS ik, i.c_name AS i_name, i.c_mktsegment AS i_seg, i.c_acctbal AS i_bal, {changed} AS chg
  FROM (SELECT * FROM existing WHERE is_current) e LEFT JOIN incoming i ON i.c_custkey = e.c_custkey),
ins AS (SELECT ik AS c_custkey, i_name AS c_name, i_seg AS c_mktsegment, i_bal AS c_acctbal FROM j WHERE chg
  UNION ALL SELECT * FROM incoming WHERE c_custkey NOT IN (SELECT c_custkey FROM existing WHERE is_current)),
r AS (SELECT * FROM existing WHERE NOT is_current
 UNION ALL SELECT c_custkey, c_name, c_mktsegment, c_acctbal, sk, effective_start, CASE WHEN chg THEN '2024-06-01' ELSE effective_end END, NOT chg FROM j
 UNION ALL SELECT *, (SELECT max(sk) FROM existing) + row_number() OVER (ORDER BY c_custkey), '2024-06-01', NULL, TRUE FROM ins)
SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, sk, effective_start, effective_end, is_current FROM r"""


_CHG = "(i.c_custkey IS NOT NULL AND (i.c_mktsegment <> e.c_mktsegment OR i.c_acctbal <> e.c_acctbal))"


def _show2(x):
    return _bal(x).withColumns({"effective_start": ymd("effective_start"), "effective_end": ymd("effective_end")})


@query("sd_2", _scd2_sql(_CHG))
def sd_2(t):
    return _show2(S.versioned(cat.incoming(t), existing(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"], "2024-06-01", sk="sk"))


@query("sd_2_hashed", _scd2_sql(_CHG).replace(", sk, effective_start, effective_end, is_current FROM r", ", effective_start, effective_end, is_current FROM r"))
def sd_2_hashed(t):
    # surrogate keys from a hash: one join, no numbering pass; the key itself is left out of the comparison
    return _show2(S.versioned(cat.incoming(t), existing(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"], "2024-06-01", sk="sk", sk_mode="hash")).drop("sk")


@query("sd_2a", "SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS sk, '2020-01-01' AS effective_start, '9999-12-31' AS effective_end, TRUE AS is_current FROM supplier")
def sd_2a(t):
    x = S.scd2_first(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], "2020-01-01", open_end="9999-12-31")
    return x.withColumns({"effective_start": ymd("effective_start"), "effective_end": ymd("effective_end")})


@query("sd_3", f"""WITH {cat.INCOMING_SQL}, {PLAIN_SQL} SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, prev_seg AS prev_c_mktsegment, round(prev_bal, 2) AS prev_c_acctbal, sk FROM (
SELECT d.c_custkey, coalesce(i.c_mktsegment, d.c_mktsegment) AS c_mktsegment, coalesce(i.c_acctbal, d.c_acctbal) AS c_acctbal,
  CASE WHEN i.c_custkey IS NOT NULL THEN d.c_mktsegment END AS prev_seg, CASE WHEN i.c_custkey IS NOT NULL THEN d.c_acctbal END AS prev_bal, sk FROM dim d LEFT JOIN incoming i USING (c_custkey)
UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, NULL, NULL, sk FROM ({_NEW}))""")
def sd_3(t):
    x = S.scd3(cat.incoming(t), plain(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"])
    return _bal(x).withColumn("prev_c_acctbal", F.round("prev_c_acctbal", 2)).drop("c_name")


@query("sd_4", f"""WITH {cat.INCOMING_SQL} SELECT CASE WHEN c.c_custkey IS NULL THEN 'new' WHEN i.c_custkey IS NULL THEN 'absent' WHEN i.c_mktsegment = c.c_mktsegment AND i.c_acctbal = c.c_acctbal THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n
FROM customer c FULL JOIN incoming i ON c.c_custkey = i.c_custkey GROUP BY 1""")
def sd_4(t):
    return S.change_counts(cat.incoming(t), t.customer, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@query("sd_5", "SELECT p_partkey, md5(concat_ws('||', p_name, p_brand, CAST(p_size AS VARCHAR))) AS _hash_diff, '2024-01-01' AS _effective_from, TRUE AS _is_current FROM part")
def sd_5(t):
    x = S.hash_columns(t.part, ["p_name", "p_brand", "p_size"], "2024-01-01")
    return x.select("p_partkey", "_hash_diff", ymd("_effective_from").alias("_effective_from"), "_is_current")


_VERS = """v AS (SELECT o_custkey AS k, o_orderkey AS sk, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'P' THEN -1 ELSE 400 END AS e0, o_orderpriority = '1-URGENT' AS cur FROM orders),
w AS (SELECT k, sk, s, CASE WHEN cur THEN NULL ELSE e0 END AS e, cur FROM v)"""


def _versions(t):
    d = F.col("o_orderdate").cast("date")
    add = F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "P", -1).otherwise(400)
    cur = F.col("o_orderpriority") == "1-URGENT"
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("sk"), d.alias("effective_start"),
                           F.when(~cur, F.date_add(d, add)).alias("effective_end"), cur.alias("is_current"))


@query("sd_6", f"""WITH {_VERS}, o AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, e NULLS LAST, sk) AS nx FROM w),
c AS (SELECT 'unique_surrogate_keys' AS "check", (SELECT count(*) FROM (SELECT sk FROM w GROUP BY sk HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'valid_date_ranges', (SELECT count(*) FROM w WHERE e < s) UNION ALL SELECT 'single_current_per_key', (SELECT count(*) FROM (SELECT k FROM w WHERE cur GROUP BY k HAVING count(*) > 1))
UNION ALL SELECT 'no_overlap', (SELECT count(*) FROM o WHERE nx IS NOT NULL AND (e IS NULL OR e > nx)))
SELECT "check", violations, violations = 0 AS passed FROM c""")
def sd_6(t):
    return S.integrity(_versions(t), ["k"])


@query("sd_7", _scd2_sql("(i.c_custkey IS NOT NULL)"))
def sd_7(t):
    return _show2(S.versioned(cat.incoming(t), existing(t), ["c_custkey"], ["c_mktsegment", "c_acctbal"], "2024-06-01", sk="sk", only_changed=False))


# ---- star schema -----------------------------------------------------------------------------

@query("st_1", f"""WITH {PLAIN_SQL}, src AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS c_mktsegment FROM orders GROUP BY 1)
SELECT d.c_custkey, coalesce(s.c_mktsegment, d.c_mktsegment) AS c_mktsegment, sk FROM dim d LEFT JOIN src s USING (c_custkey)""")
def st_1(t):
    src = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderdate", "o_orderkey")
    return S.load_dimension(src, plain(t).select("c_custkey", "c_mktsegment", "sk"), ["c_custkey"], ["c_mktsegment"], 1, "2024-06-01",
                            order=[F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("st_2", "SELECT p_brand, p_type, 100 + row_number() OVER (ORDER BY md5(concat_ws('||', p_brand, p_type)), p_brand, p_type) AS sk FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def st_2(t):
    x = t.part.select("p_brand", "p_type").distinct().withColumn("sk", F.lit(None).cast("long"))
    return S.number_rows(x, ["p_brand", "p_type"], 100)


_FACT = """
cd AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS sk FROM customer), pd AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS sk, p_size FROM part),
fact AS (SELECT l_orderkey, l_linenumber, l_partkey AS part_id, l_suppkey AS supp_id, coalesce(c.sk, -1) AS customer_sk, coalesce(p.sk, -1) AS part_sk, l_quantity AS quantity, l_extendedprice AS amount
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT cd.* FROM cd JOIN customer USING (c_custkey) WHERE c_nationkey <> 5) c ON o_custkey = c.c_custkey
 LEFT JOIN (SELECT * FROM pd WHERE p_size > 3) p ON l_partkey = p.p_partkey)
"""


def fact(t):
    part = S.number_rows(t.part.select("p_partkey", "p_size").withColumn("sk", F.lit(None).cast("long")), ["p_partkey"])
    src = J.join_on(t.lineitem, t.orders.select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")]).withColumns(
        {"part_id": F.col("l_partkey"), "supp_id": F.col("l_suppkey")})
    return S.load_fact(src, [
        {"dimension": "customer", "table": existing(t), "join_key": "o_custkey", "dim_key": "c_custkey", "filter": "is_current"},
        {"dimension": "part", "table": part, "join_key": "l_partkey", "dim_key": "p_partkey", "filter": "p_size > 3"}],
        ["l_orderkey", "l_linenumber", "part_id", "supp_id"], {"quantity": "l_quantity", "amount": "l_extendedprice"}, "2024-06-01", "run1")


@query("st_3", f"WITH {_FACT} SELECT *, 'run1' AS _run_id FROM fact")
def st_3(t):
    return fact(t).drop("_execution_date", "_load_timestamp")


@query("st_4", f"WITH {_FACT} SELECT customer_sk, part_sk, count(*) AS n, round(sum(CAST(amount AS DECIMAL(28, 6))), 2)::DOUBLE AS amount FROM fact GROUP BY 1, 2")
def st_4(t):
    return fact(t).groupBy("customer_sk", "part_sk").agg(F.count(F.lit(1)).alias("n"), F.round(money("amount"), 2).alias("amount"))


@query("st_5", f"WITH {_FACT} SELECT 'customer_sk' AS dimension_key, count(*) FILTER (WHERE customer_sk = -1) AS late_rows, count(*) AS total_rows FROM fact UNION ALL SELECT 'part_sk', count(*) FILTER (WHERE part_sk = -1), count(*) FROM fact")
def st_5(t):
    return S.late_arrivals(fact(t), ["customer_sk", "part_sk"])


@query("st_6", """
WITH d AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS sk FROM supplier WHERE s_acctbal > 1000), m AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM d))
SELECT * FROM d UNION ALL SELECT l_suppkey, 'UNKNOWN', (SELECT max(sk) FROM d) + row_number() OVER (ORDER BY l_suppkey) FROM m""")
def st_6(t):
    d = S.number_rows(t.supplier.filter("s_acctbal > 1000").select("s_suppkey", "s_name", F.lit(None).cast("long").alias("sk")), ["s_suppkey"])
    return S.placeholders(d, t.lineitem, "s_suppkey", "l_suppkey", {"s_name": "UNKNOWN"})


def _dates(first, step):
    return f"SELECT CAST(unnest(generate_series(CAST({first} AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL {step})) AS DATE) AS d"


_DD = """SELECT '{g}' AS grain, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(weekofyear(d) AS INTEGER) AS week,
 CAST(day(d) AS INTEGER) AS day, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, monthname(d) AS month_name, dayofweek(d) IN (0, 6) AS is_weekend FROM ({s})"""


@query("st_7", _DD.format(g="DAY", s=_dates("(SELECT min(o_orderdate) FROM orders)", "1 DAY")) + " UNION ALL " + _DD.format(g="MONTH", s=_dates("(SELECT date_trunc('month', min(o_orderdate)) FROM orders)", "1 MONTH")))
def st_7(t):
    out = None
    for g in ("DAY", "MONTH"):
        x = S.date_dimension(t.spark, F.min("o_orderdate"), F.max("o_orderdate"), g, t.orders).drop("date").select(F.lit(g).alias("grain"), "*")
        out = x if out is None else out.unionByName(x)
    return out


@query("st_8", f"WITH {_FACT} SELECT customer_sk, count(*) AS n, round(sum(CAST(quantity AS DECIMAL(28, 6))), 2)::DOUBLE AS quantity, round(sum(CAST(amount AS DECIMAL(28, 6))), 2)::DOUBLE AS amount FROM fact GROUP BY 1")
def st_8(t):
    return fact(t).groupBy("customer_sk").agg(F.count(F.lit(1)).alias("n"), F.round(money("quantity"), 2).alias("quantity"), F.round(money("amount"), 2).alias("amount"))


@query("st_9", """SELECT 'grain' AS test, l_orderkey, l_linenumber, count(*) AS n, TRUE AS matches FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1
UNION ALL SELECT 'reconcile_l_extendedprice', NULL, NULL, NULL, abs((SELECT sum(l_extendedprice) FROM lineitem) - (SELECT sum(x) FROM (SELECT sum(l_extendedprice) AS x FROM lineitem GROUP BY l_suppkey, l_returnflag))) <= 0.01
UNION ALL SELECT 'reconcile_l_quantity', NULL, NULL, NULL, abs((SELECT sum(l_quantity) FROM lineitem) - (SELECT sum(x) FROM (SELECT sum(l_quantity) AS x FROM lineitem GROUP BY l_suppkey, l_returnflag))) <= 0.01""")
def st_9(t):
    g = S.grain_violations(t.lineitem, ["l_orderkey", "l_linenumber"]).select(F.lit("grain").alias("test"), "l_orderkey", "l_linenumber", "n", F.lit(True).alias("matches"))
    rolled = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(money("l_extendedprice").alias("l_extendedprice"), money("l_quantity").alias("l_quantity"))
    r = S.reconcile_sums(t.lineitem, rolled, ["l_extendedprice", "l_quantity"])
    return g.unionByName(r.select(F.concat(F.lit("reconcile_"), "measure").alias("test"), "matches"), allowMissingColumns=True)


@query("st_10", """
WITH a AS (SELECT c_custkey, c_name, (c_acctbal + 1000) / 150 AS age FROM customer WHERE c_mktsegment <> 'FURNITURE')
SELECT row_number() OVER (ORDER BY c_custkey) AS sk, c_custkey, c_name, round(age, 4) AS age, CASE WHEN age < 25 THEN 'Gen Z' WHEN age < 40 THEN 'Millennial' WHEN age < 55 THEN 'Gen X' ELSE 'Boomer' END AS generation,
 '2024-01-01' AS effective_from, '9999-12-31' AS effective_to, TRUE AS is_current FROM a""")
def st_10(t):
    x = S.dimension_view(t.customer.filter("c_mktsegment <> 'FURNITURE'"), "c_custkey", (F.col("c_acctbal") + 1000) / 150, "2024-01-01", ["c_name"])
    return x.withColumns({"age": F.round("age", 4), "effective_from": ymd("effective_from"), "effective_to": ymd("effective_to")})


@query("st_11", """
WITH w AS (SELECT c_custkey, c_name, n_name, r_name, md5(concat_ws('||', n_name, r_name)) AS nid, md5(r_name) AS rid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'dimension' AS level, CAST(c_custkey AS VARCHAR) AS id, c_name AS label, nid AS parent_id FROM w UNION ALL SELECT DISTINCT 'nation', nid, n_name, rid FROM w UNION ALL SELECT DISTINCT 'region', rid, r_name, NULL FROM w""")
def st_11(t):
    wide = J.multi_join(t.customer.select("c_custkey", "c_name", "c_nationkey"), [
        {"table": t.nation, "keys": [("c_nationkey", "n_nationkey")], "join_order": 1, "join_type": "inner"},
        {"table": t.region, "keys": [("n_regionkey", "r_regionkey")], "join_order": 2, "join_type": "inner"}]).select("c_custkey", "c_name", "n_name", "r_name")
    p = S.normalise(wide, "c_custkey", [("nation", ["n_name"]), ("region", ["r_name"])])
    d = p["dimension"].select(F.lit("dimension").alias("level"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"), F.col("nation_id").alias("parent_id"))
    n = p["nation"].select(F.lit("nation"), "nation_id", "n_name", "region_id")
    return d.union(n).union(p["region"].select(F.lit("region"), "region_id", "r_name", F.lit(None).cast("string")))


_OBT = "SELECT o_orderkey, o_orderdate, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _flat(t, orders):
    return S.flat_table(orders, [
        {"table": t.customer, "keys": [("o_custkey", "c_custkey")], "join_order": 1, "join_type": "inner"},
        {"table": t.nation, "keys": [("c_nationkey", "n_nationkey")], "join_order": 2, "join_type": "inner"},
        {"table": t.region, "keys": [("n_regionkey", "r_regionkey")], "join_order": 3, "join_type": "inner"}]).select(
        "o_orderkey", "o_orderdate", "c_name", "n_name", "r_name", "o_totalprice")


@query("st_12", f"""WITH f AS ({_OBT}), e AS (SELECT * FROM f WHERE o_orderdate < TIMESTAMP '1999-01-01')
SELECT 'append' AS mode, o_orderkey, c_name, r_name, round(o_totalprice, 2) AS price FROM (SELECT * FROM e UNION ALL SELECT * FROM f WHERE o_orderdate > (SELECT max(o_orderdate) FROM e))
UNION ALL SELECT 'merge', o_orderkey, c_name, r_name, round(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice * 2 ELSE o_totalprice END, 2) FROM f""")
def st_12(t):
    f = _flat(t, t.orders)
    e = f.filter("o_orderdate < timestamp_ntz'1999-01-01'")
    a = S.refresh_flat(e, f, "append", watermark="o_orderdate")
    m = S.refresh_flat(e, f.filter("o_orderdate >= timestamp_ntz'1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "merge", ["o_orderkey"])
    show = lambda x, n: x.select(F.lit(n).alias("mode"), "o_orderkey", "c_name", "r_name", F.round("o_totalprice", 2).alias("price"))
    return show(a, "append").unionByName(show(m, "merge"))


@query("st_13", "SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(CAST(c_acctbal AS DECIMAL(28, 6))), 2)::DOUBLE AS balance, 'gold' AS zone, TRUE AS _is_current FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def st_13(t):
    x = R.apply_rules(t.customer, [
        {"type": "filter", "config": {"condition": "c_acctbal > 0"}, "sequence_order": 1}, {"type": "cast", "config": {"column": "c_acctbal", "type": "decimal(28,6)"}, "sequence_order": 2},
        {"type": "aggregate", "sequence_order": 3, "config": {"group_by": ["c_mktsegment"], "aggregations": [
            {"column": "c_custkey", "function": "count", "alias": "customers"}, {"column": "c_acctbal", "function": "sum", "alias": "balance"}]}},
        {"type": "rename", "config": {"from": "c_mktsegment", "to": "segment"}, "sequence_order": 4}])
    x = R.zone_columns(x, "gold").drop("_gold_timestamp").withColumn("zone", F.lit("gold"))
    return x.withColumn("balance", F.round("balance", 2).cast("double"))


# ---- data vault ------------------------------------------------------------------------------

_VK = "sha256(concat_ws('|', {}))"


def vk(*cols):
    return "sha256(concat_ws('|', " + ", ".join(f"upper(trim(coalesce(CAST({c} AS VARCHAR), ''), ' '))" for c in cols) + "))"


@query("dv_1", f"""WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE ' ' || lower(c_mktsegment) END AS seg, c_name FROM customer)
SELECT c_custkey, md5(concat_ws('||', CAST(c_custkey AS VARCHAR), seg, c_name)) AS job, md5(concat_ws('|', CAST(c_custkey AS VARCHAR), upper(trim(seg, ' ')), upper(trim(c_name, ' ')))) AS registry, {vk('c_custkey', 'seg', 'c_name')} AS vault FROM s""")
def dv_1(t):
    seg = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(" "), F.lower("c_mktsegment")))
    cols = ["c_custkey", seg, "c_name"]
    return t.customer.select("c_custkey", *[H.hash_key(cols, r).alias(r) for r in ("job", "registry", "vault")])


@query("dv_2", "SELECT c_custkey, sha256(concat_ws('|', coalesce(c_mktsegment, ''), coalesce(CAST(c_acctbal AS VARCHAR), ''))) AS vault, md5(concat_ws('||', c_mktsegment, CAST(c_acctbal AS VARCHAR))) AS job FROM customer")
def dv_2(t):
    cols = ["c_mktsegment", "c_acctbal"]
    return t.customer.select("c_custkey", H.hash_diff(cols).alias("vault"), H.hash_diff(cols, "job").alias("job"))


@query("dv_3", f"""SELECT {vk('o_custkey')} AS hub_hash_key, o_custkey, 'orders' AS record_source FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)""")
def dv_3(t):
    old = V.hub(t.customer.filter("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey")), None, ["o_custkey"], "crm")
    return V.hub(t.orders, old, ["o_custkey"], "orders", "2024-01-01").drop("load_date")


_FPE = "substring(sha256(c_name), 1, length(c_name))"


@query("dv_4", f"SELECT {vk('k')} AS hub_hash_key, k AS c_name, 'crm' AS record_source FROM (SELECT DISTINCT {_FPE} AS k FROM customer)")
def dv_4(t):
    return V.private_hub(t.customer, None, ["c_name"], "crm").drop("load_date")


@query("dv_5", f"""SELECT {vk('l_partkey', 'l_suppkey')} AS link_hash_key, {vk('l_partkey')} AS hub_0_hash_key, {vk('l_suppkey')} AS hub_1_hash_key, l_partkey, l_suppkey, 'lineitem' AS record_source
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def dv_5(t):
    keys = ["l_partkey", "l_suppkey"]
    old = V.link(t.lineitem.filter("l_returnflag = 'A'"), None, keys, "old")
    return V.link(t.lineitem, old, keys, "lineitem").drop("load_date")


def _sat(t):
    c = t.customer
    x = c.select(H.hash_key(["c_custkey"]).alias("hub_hash_key"), "c_mktsegment", "c_acctbal", H.hash_diff(["c_mktsegment", "c_acctbal"]).alias("hash_diff"),
                 F.lit("2020-01-01").cast("timestamp").alias("load_date"),
                 F.when(F.col("c_nationkey") == 5, F.lit("2023-01-01").cast("timestamp")).alias("load_end_date"), F.lit("crm").alias("record_source"))
    return x


def _sat_in(t):
    return cat.incoming(t).select(H.hash_key(["c_custkey"]).alias("hub_hash_key"), "c_mktsegment", "c_acctbal")


_SAT_SQL = f"""{cat.INCOMING_SQL}, sat AS (SELECT {vk('c_custkey')} AS hub_hash_key, c_mktsegment, c_acctbal, '2020-01-01' AS ld, CASE WHEN c_nationkey = 5 THEN '2023-01-01' END AS le, 'crm' AS rs FROM customer),
inc AS (SELECT {vk('c_custkey')} AS hub_hash_key, c_mktsegment, c_acctbal FROM incoming),
j AS (SELECT s.*, i.hub_hash_key IS NOT NULL AND (i.c_mktsegment <> s.c_mktsegment OR i.c_acctbal <> s.c_acctbal) AS chg FROM sat s LEFT JOIN inc i ON s.hub_hash_key = i.hub_hash_key WHERE s.le IS NULL),
ins AS (SELECT * FROM inc WHERE hub_hash_key NOT IN (SELECT hub_hash_key FROM j) OR hub_hash_key IN (SELECT hub_hash_key FROM j WHERE chg))"""


def _show_sat(x):
    return x.select("hub_hash_key", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), ymd("load_date").alias("load_date"), ymd("load_end_date").alias("load_end_date"), "record_source")


@query("dv_6", f"""WITH {_SAT_SQL} SELECT hub_hash_key, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, ld AS load_date, le AS load_end_date, rs AS record_source FROM (
SELECT hub_hash_key, c_mktsegment, c_acctbal, ld, le, rs FROM sat WHERE le IS NOT NULL UNION ALL SELECT hub_hash_key, c_mktsegment, c_acctbal, ld, CASE WHEN chg THEN '2024-06-01' END, rs FROM j
UNION ALL SELECT *, '2024-06-01', NULL, 'feed' FROM ins)""")
def dv_6(t):
    return _show_sat(V.satellite(_sat_in(t), _sat(t), ["c_mktsegment", "c_acctbal"], "2024-06-01", "feed"))


@query("dv_7", f"""WITH {_SAT_SQL} SELECT hub_hash_key, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, '2024-06-01' AS load_date, NULL::VARCHAR AS load_end_date, 'feed' AS record_source FROM ins""")
def dv_7(t):
    return _show_sat(V.satellite_inserts(_sat_in(t), _sat(t), ["c_mktsegment", "c_acctbal"], "2024-06-01", "feed"))


@query("dv_8", """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, strftime(lead(o_orderdate) OVER w, '%Y-%m-%d') AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def dv_8(t):
    x = V.effectivity(t.orders, ["o_custkey"], "o_orderdate", F.date_trunc("day", "o_orderdate"), ["o_orderkey"])
    return x.select("o_orderkey", "o_custkey", ymd("o_orderdate").alias("valid_from"), ymd("valid_to").alias("valid_to"), "is_current")


@query("dv_9", f"""WITH h AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9000),
l AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders),
c AS (SELECT 'hub_uniqueness' AS "check", (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS violations
UNION ALL SELECT 'link_references', (SELECT count(*) FROM l WHERE o_custkey NOT IN (SELECT c_custkey FROM h))
UNION ALL SELECT 'satellite_uniqueness', 0 UNION ALL SELECT 'record_source_present', (SELECT count(*) FROM l)) SELECT "check", violations, violations = 0 AS passed FROM c""")
def dv_9(t):
    h = V.hub(t.customer.filter("c_acctbal > 0"), None, ["c_custkey"], "crm")
    h = h.unionByName(V.hub(t.customer.filter("c_acctbal > 9000"), None, ["c_custkey"], "crm"))
    links = V.link(t.orders, None, ["o_custkey", "o_orderkey"], "")
    return V.integrity(h, links, _sat(t), "hub_0_hash_key")


@query("dv_10", f"""WITH {cat.INCOMING_SQL} SELECT {vk('c_custkey')} AS hub_hash_key, sha256(c_mktsegment) AS c_mktsegment, round(c_acctbal, 2) AS c_acctbal, '2024-06-01' AS load_date, NULL::VARCHAR AS load_end_date, 'feed' AS record_source FROM incoming
UNION ALL SELECT {vk('c_custkey')}, c_mktsegment, round(c_acctbal, 2), '2020-01-01', CASE WHEN c_nationkey = 5 THEN '2023-01-01' WHEN c_custkey IN (SELECT c_custkey FROM incoming) THEN '2024-06-01' END, 'crm' FROM customer""")
def dv_10(t):
    return _show_sat(V.private_satellite(_sat_in(t), _sat(t), ["c_mktsegment", "c_acctbal"], {"c_mktsegment": "sha256"}, "2024-06-01", "feed"))
