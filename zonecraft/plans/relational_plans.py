"""Queries for projections and cleaning (PR), joins (JN), aggregations (AG), windows (WN),
sorting (SO), set operations (SE), scalar functions (FN) and reshaping (RS)."""

from pyspark.sql import functions as F

from zonecraft.functions import hashing as H
from zonecraft.functions.exprs import case_map, epoch, hms, json_valid, money, ymd
from zonecraft.operators import aggregate as A
from zonecraft.operators import drift as D
from zonecraft.operators import graph as G
from zonecraft.operators import joins as J
from zonecraft.operators import rules as R
from zonecraft.operators import window as W
from zonecraft.plans import catalog as cat
from zonecraft.plans.registry import query
from zonecraft.session import store
from zonecraft.streaming import state as S


def rule(kind, seq=0, **cfg):
    return {"type": kind, "sequence_order": seq, "config": cfg}


# ---- projections, filters, cleaning --------------------------------------------------------

@query("pr_1", """
SELECT o_orderkey AS order_id, o_custkey, lower(o_orderpriority) AS o_orderpriority, round(o_totalprice * 0.9, 4) AS net,
 CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size_class FROM orders WHERE o_orderstatus <> 'P'""")
def pr_1(t):
    x = R.apply_rules(t.orders, [
        rule("derive", 3, name="size_class", expression="CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END"),
        rule("filter", 1, condition="o_orderstatus <> 'P'"), rule("rename", 9, mapping={"o_orderkey": "order_id"}),
        rule("lowercase", 2, columns=["o_orderpriority"]), rule("expression", 4, column="net", expression="round(o_totalprice * 0.9, 4)"),
        {**rule("filter", 5, condition="false"), "is_active": False}])
    return x.select("order_id", "o_custkey", "o_orderpriority", "net", "size_class")


@query("pr_2", "SELECT c_custkey, c_name FROM customer")
def pr_2(t):
    return R.apply_rules(t.customer, [rule("select", columns=["c_custkey", "c_name"])])


@query("pr_3", "SELECT s_suppkey, s_nationkey FROM supplier")
def pr_3(t):
    return R.apply_rules(t.supplier, [rule("drop_columns", columns=["s_name", "s_acctbal", "not_there"])])


@query("pr_4", "SELECT n_nationkey AS id, n_name AS nation, n_regionkey AS region FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON c_nationkey = n_nationkey")
def pr_4(t):
    n = t.nation.join(t.customer.select("c_nationkey").distinct(), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return R.apply_rules(n, [rule("rename", 1, **{"from": "n_nationkey", "to": "id"}), rule("rename", 2, mapping={"n_name": "nation", "n_regionkey": "region"})])


_CODES = "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS code, CASE o_orderstatus WHEN 'F' THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"


def _codes(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("code"),
                           F.when(s == "F", "bad").otherwise(ymd("o_orderdate")).alias("day"))


@query("pr_5", f"SELECT o_orderkey, TRY_CAST(code AS BIGINT) AS code, strftime(TRY_CAST(day AS DATE), '%Y-%m-%d') AS day FROM ({_CODES})")
def pr_5(t):
    x = R.apply_rules(_codes(t), [rule("cast", 1, column="code", type="BIGINT"), rule("cast", 2, columns={"day": "date"})])
    return x.withColumn("day", ymd("day"))


@query("pr_5_rejects", f"""
SELECT o_orderkey, code, day, concat_ws(',', CASE WHEN TRY_CAST(code AS BIGINT) IS NULL THEN 'code' END, CASE WHEN TRY_CAST(day AS DATE) IS NULL THEN 'day' END) AS lost
FROM ({_CODES}) WHERE TRY_CAST(code AS BIGINT) IS NULL OR TRY_CAST(day AS DATE) IS NULL""")
def pr_5_rejects(t):
    _, bad = R.cast_declared(_codes(t), [{"name": "code", "type": "BIGINT"}, {"name": "day", "type": "DATE"}])
    return bad.select("o_orderkey", "code", "day", F.array_join("_lost", ",").alias("lost"))


@query("pr_6", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def pr_6(t):
    x = R.apply_rules(t.lineitem, [rule("derive", name="charge", expression="round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)")])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "charge")


@query("pr_7", "SELECT p_partkey, 'parts' AS origin, p_size * 2 AS twice FROM part")
def pr_7(t):
    x = R.apply_rules(t.part, [rule("add_column", 1, column="origin", value="parts"), rule("add_column", 2, column="twice", expression="p_size * 2")])
    return x.select("p_partkey", "origin", "twice")


@query("pr_8", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.05")
def pr_8(t):
    x = R.apply_rules(t.lineitem, [rule("filter", condition="l_shipdate >= timestamp_ntz'1998-01-01' AND l_discount BETWEEN 0.02 AND 0.05")])
    return x.select("l_orderkey", "l_linenumber", "l_partkey")


_HOLES = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg FROM customer"


def _holes(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"),
                             F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg"))


@query("pr_9", f"SELECT c_custkey, coalesce(bal, 0.0) AS bal, coalesce(seg, 'UNKNOWN') AS seg FROM ({_HOLES})")
def pr_9(t):
    return R.apply_rules(_holes(t), [rule("null_fill", 1, column="bal", value=0.0), rule("null_fill", 2, columns={"seg": "UNKNOWN"})])


@query("pr_10", f"SELECT 'any' AS how, c_custkey FROM ({_HOLES}) WHERE bal IS NOT NULL AND seg IS NOT NULL UNION ALL SELECT 'all', c_custkey FROM ({_HOLES}) WHERE bal IS NOT NULL OR seg IS NOT NULL")
def pr_10(t):
    a = R.apply_rules(_holes(t), [rule("null_drop", how="any", columns=["bal", "seg"])]).select(F.lit("any").alias("how"), "c_custkey")
    return a.union(R.apply_rules(_holes(t), [rule("null_drop", how="all", columns=["bal", "seg"])]).select(F.lit("all"), "c_custkey"))


@query("pr_11", f"SELECT c_custkey, coalesce(seg, CAST(bal AS VARCHAR), 'none') AS label FROM (SELECT c_custkey, round(bal, 0) AS bal, seg FROM ({_HOLES}))")
def pr_11(t):
    x = _holes(t).select("c_custkey", F.round("bal", 0).cast("string").alias("bal"), "seg", F.lit("none").alias("none"))
    return R.apply_rules(x, [rule("coalesce", columns=["seg", "bal", "none"], output_column="label")]).select("c_custkey", "label")


@query("pr_12", "SELECT doc_id, md5(trim(text, ' ')) AS t FROM documents")
def pr_12(t):
    return R.apply_rules(t.documents.select("doc_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text")), [rule("trim", columns=["text"])]).select("doc_id", F.md5("text").alias("t"))


@query("pr_13", "SELECT p_partkey, upper(p_name) AS p_name, lower(p_brand) AS p_brand FROM part")
def pr_13(t):
    x = R.apply_rules(t.part, [rule("uppercase", 1, columns=["p_name"]), rule("lowercase", 2, columns=["p_brand"])])
    return x.select("p_partkey", "p_name", "p_brand")


@query("pr_14", f"SELECT o_orderkey, strftime(try_strptime(day, '%Y-%m-%d'), '%d/%m/%Y') AS day FROM ({_CODES})")
def pr_14(t):
    return R.apply_rules(_codes(t), [rule("date_format", column="day", input_format="yyyy-MM-dd", output_format="dd/MM/yyyy")]).select("o_orderkey", "day")


@query("pr_15", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def pr_15(t):
    x = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd-MMM-yyyy").alias("day"))
    return R.apply_rules(x, [rule("standardize_date", column="day", input_format="dd-MMM-yyyy")]).withColumn("day", ymd("day"))


@query("pr_16", "SELECT conv_id, turn, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS h FROM conversations")
def pr_16(t):
    x = R.apply_rules(t.conversations, [rule("regex_replace", column="text", pattern="[0-9]+", replacement="#")])
    return x.select("conv_id", "turn", F.md5("text").alias("h"))


@query("pr_17", "SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name, repeat('x', length(c_mktsegment)) AS c_mktsegment FROM customer")
def pr_17(t):
    x = R.apply_rules(t.customer, [rule("mask", 1, column="c_name", keep_last=4), rule("mask", 2, column="c_mktsegment", keep_last=20, char="x")])
    return x.select("c_custkey", "c_name", "c_mktsegment")


@query("pr_18", "SELECT s_suppkey, md5(s_name) AS s_name, sha256(CAST(s_nationkey AS VARCHAR)) AS s_nationkey FROM supplier")
def pr_18(t):
    x = R.apply_rules(t.supplier, [rule("hash", 1, column="s_name", algorithm="md5"), rule("hash", 2, column="s_nationkey")])
    return x.select("s_suppkey", "s_name", "s_nationkey")


@query("pr_19", "SELECT doc_id, md5(nullif(trim(' ' || text || '  ', ' '), '')) AS text, nullif(CASE WHEN lang = 'de' THEN '' ELSE lang END, '') AS lang, ' keep ' AS _tag FROM documents")
def pr_19(t):
    x = t.documents.select("doc_id", F.concat(F.lit(" "), "text", F.lit("  ")).alias("text"),
                           F.when(F.col("lang") == "de", "  ").otherwise(F.col("lang")).alias("lang"), F.lit(" keep ").alias("_tag"))
    return R.clean(x).withColumn("text", F.md5("text"))


@query("pr_20", """
WITH r AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, day FROM r WHERE rn = 1""")
def pr_20(t):
    x = R.apply_rules(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), [rule("deduplicate", keys=["o_custkey"], order_by="o_orderdate")])
    return x.select("o_custkey", "o_orderkey", ymd("o_orderdate").alias("day"))


@query("pr_21", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def pr_21(t):
    return R.apply_rules(t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey"), [rule("distinct")])


@query("pr_22", "SELECT s_suppkey, '2024-02-07' AS reporting_date, 'run7' AS run_id, TRUE AS stamped, (SELECT count(*) FROM supplier) AS n_ids FROM supplier")
def pr_22(t):
    x = store(R.bronze_audit(t.supplier, "2024-02-07", "run7"))  # ids are made once
    n = x.agg(F.count_distinct(F.xxhash64("_record_uuid")).alias("n_ids"))
    return x.crossJoin(F.broadcast(n)).select("s_suppkey", ymd("_reporting_date").alias("reporting_date"), F.col("_run_id").alias("run_id"),  # one row
                                              F.col("_load_timestamp").isNotNull().alias("stamped"), "n_ids")


@query("pr_29", "SELECT 'orders' AS component, count(*) AS n_rows, count(*) FILTER (WHERE o_totalprice > 100000) AS n_kept FROM orders")
def pr_29(t):
    """The counts that a pipe of two components observes while its rows pass through, read without another job."""
    seen, before = R.counted(t.orders, "n_rows")
    kept, after = R.counted(R.where(seen, ("o_totalprice", "greater than", 100000)), "n_kept")
    kept.write.format("noop").mode("overwrite").save()
    return t.orders.sparkSession.createDataFrame([("orders", before.get["n_rows"], after.get["n_kept"])], "component string, n_rows bigint, n_kept bigint")


@query("pr_23", """
SELECT 'raw' AS zone, c_custkey, c_name, 'B9' AS tag FROM customer UNION ALL SELECT 'silver', c_custkey, trim(c_name, ' '), 'stamped' FROM customer
UNION ALL SELECT 'gold', c_custkey, c_name, 'true' FROM customer UNION ALL SELECT 'consumption', c_custkey, c_name, 'stamped' FROM customer""")
def pr_23(t):
    c = t.customer.select("c_custkey", "c_name")
    stamped = lambda n: F.when(F.col(n).isNotNull(), "stamped")
    parts = [("raw", R.zone_columns(c, "raw", "B9"), F.col("_batch_id")),
             ("silver", R.zone_columns(c.withColumn("c_name", F.concat("c_name", F.lit(" "))), "silver", schema=[{"name": "c_name", "type": "STRING"}]), stamped("_silver_timestamp")),
             ("gold", R.zone_columns(c, "gold"), F.col("_is_current").cast("string")),
             ("consumption", R.zone_columns(c, "consumption"), stamped("_consumption_timestamp"))]
    out = None
    for z, x, tag in parts:
        x = x.select(F.lit(z).alias("zone"), "c_custkey", "c_name", tag.alias("tag"))
        out = x if out is None else out.unionByName(x)
    return out


@query("pr_24", "SELECT l_orderkey, l_linenumber, l_partkey, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey)) AS business_key FROM lineitem")
def pr_24(t):
    x = R.apply_rules(t.lineitem, [rule("hash", columns=["l_orderkey", "l_linenumber", "l_partkey"], output_column="business_key", algorithm="md5")])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "business_key")


@query("pr_25", f"SELECT o_orderkey, TRY_CAST(code AS DOUBLE) AS num, strftime(try_strptime(day, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS ts FROM ({_CODES})")
def pr_25(t):
    return _codes(t).select("o_orderkey", F.col("code").try_cast("double").alias("num"), hms(F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))).alias("ts"))


@query("pr_26", "SELECT p_partkey FROM part WHERE p_name LIKE 'small%' AND p_name LIKE '%bolt%' AND p_size >= 5 AND p_brand IS NOT NULL AND p_type <> 'PROMO' AND p_brand NOT LIKE '%9'")
def pr_26(t):
    x = R.where(t.part, ("p_name", "starts with", "small"), ("p_name", "contains", "bolt"), ("p_size", "greater than or equal to", 5),
                ("p_brand", "is not null"), ("p_type", "not equal to", "PROMO"))
    return x.filter(~R.predicate("p_brand", "ends with", "9")).select("p_partkey")


@query("pr_27", """
SELECT CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'default' END AS output, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM orders GROUP BY 1""")
def pr_27(t):
    x = R.route(t.orders, [("large", "o_totalprice > 400000"), ("urgent", "o_orderpriority IN ('1-URGENT', '2-HIGH')")], name="output")
    return x.groupBy("output").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("pr_28", "SELECT doc_id, md5(text) AS bytes_md5, strlen(text) AS n_bytes FROM documents")
def pr_28(t):
    x = R.apply_rules(t.documents, [rule("encode", column="text", charset="UTF-8", output_column="raw")])
    return x.select("doc_id", F.md5("raw").alias("bytes_md5"), F.octet_length("raw").cast("long").alias("n_bytes"))


# ---- joins -----------------------------------------------------------------------------------

@query("jn_1", """
SELECT 'inner' AS kind, count(*) AS n, count(o_orderkey) AS n_right, count(c_custkey) AS n_left FROM customer JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'left', count(*), count(o_orderkey), count(c_custkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'right', count(*), count(o_orderkey), count(c_custkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'full', count(*), count(o_orderkey), count(c_custkey) FROM customer FULL JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'cross', count(*), count(n_nationkey), count(c_custkey) FROM customer CROSS JOIN nation""")
def jn_1(t):
    out = None
    for kind, right, key, keys in [*[(k, t.orders, "o_orderkey", [("c_custkey", "o_custkey")]) for k in ("inner", "left", "right", "full")], ("cross", t.nation, "n_nationkey", [])]:
        x = J.join_on(t.customer, right, keys, kind).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count(key).alias("n_right"), F.count("c_custkey").alias("n_left"))
        out = x if out is None else out.union(x)
    return out


@query("jn_2", """
SELECT o_orderkey, c_name, n_name, r_name FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS nk FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
LEFT JOIN nation ON nk IS NOT DISTINCT FROM n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)
 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def jn_2(t):
    cust = t.customer.withColumn("nk", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")))
    x = J.multi_join(t.orders, [
        {"join_order": 3, "table": t.region, "keys": [("n_regionkey", "r_regionkey")], "select": ["r_name"], "broadcast": True},
        {"join_order": 1, "table": cust, "keys": [("o_custkey", "c_custkey")], "select": ["c_name", "nk"]},
        {"join_order": 2, "table": t.nation, "keys": [("nk", "n_nationkey")], "null_safe": True, "broadcast": True},
        {"join_order": 4, "table": t.lineitem.filter("l_quantity > 49"), "keys": [("o_orderkey", "l_orderkey")], "join_type": "left_semi"},
        {"join_order": 5, "table": t.customer.filter("c_mktsegment = 'MACHINERY'"), "keys": [("o_custkey", "c_custkey")], "join_type": "left_anti"}])
    return x.select("o_orderkey", "c_name", "n_name", "r_name")


@query("jn_3", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def jn_3(t):
    return J.join_on(t.customer, t.orders.filter("o_totalprice > 450000"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey", "c_name")


@query("jn_4", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def jn_4(t):
    return J.join_on(t.part, t.lineitem.filter("l_quantity > 45"), [("p_partkey", "l_partkey")], "left_anti").select("p_partkey", "p_name")


@query("jn_5", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def jn_5(t):
    x = J.lookup(t.supplier, t.nation.filter("n_regionkey <> 2"), [("s_nationkey", "n_nationkey")], ["n_name"], "unknown")
    return x.select("s_suppkey", F.col("n_name").alias("nation"))


@query("jn_6", "SELECT o_orderkey, count(*) AS n, round(sum(CAST(l_extendedprice AS DECIMAL(28, 6))), 2)::DOUBLE AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def jn_6(t):
    # lines are combined per order before the join, so that no order is heavier than another
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(money("l_extendedprice"), 2).alias("amount"))
    return J.merge_join(t.orders.select("o_orderkey"), lines, [("o_orderkey", "l_orderkey")]).select("o_orderkey", "n", "amount")


_HD = "md5(concat_ws('||', c_mktsegment, CAST(c_acctbal AS VARCHAR)))"


@query("jn_7", f"""WITH {cat.INCOMING_SQL} SELECT i.c_custkey, i.c_mktsegment FROM (SELECT *, {_HD} AS h FROM incoming) i JOIN (SELECT *, {_HD} AS h FROM customer) c ON i.c_custkey = c.c_custkey WHERE i.h <> c.h""")
def jn_7(t):
    h = H.hash_diff(["c_mktsegment", "c_acctbal"], "job")
    return J.changed(t.customer.withColumn("h", h), cat.incoming(t).withColumn("h", h), ["c_custkey"], "h").select("c_custkey", "c_mktsegment")


@query("jn_8", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, CASE WHEN l_quantity > 40 THEN NULL ELSE l_suppkey END AS sk FROM lineitem)
WHERE sk IS NOT NULL AND sk NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)""")
def jn_8(t):
    li = t.lineitem.withColumn("sk", F.when(F.col("l_quantity") <= 40, F.col("l_suppkey")))
    return J.orphans(li, t.supplier.filter("s_acctbal > 3000"), "sk", "s_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("jn_9", """
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'
 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON TRUE""")
def jn_9(t):
    x = J.latest_child(t.customer, t.orders.filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return x.select("c_custkey", "o_orderkey", "o_totalprice")


@query("jn_10", """
SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_returned FROM orders""")
def jn_10(t):
    x = J.with_child_stats(t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.count(F.lit(1)).alias("n_lines"),
                           F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), zero=["n_lines", "n_returned"])
    return x.select("o_orderkey", "n_lines", "n_returned")


@query("jn_11", """
WITH v AS (SELECT o_custkey AS ck, o_orderdate AS d, max(o_orderkey) AS version FROM orders GROUP BY 1, 2),
w AS (SELECT *, lead(d) OVER (PARTITION BY ck ORDER BY d) AS e FROM v),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS ck, l_shipdate + INTERVAL 200 DAY AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w.version FROM f LEFT JOIN w ON f.ck = w.ck AND f.ts >= w.d AND (w.e IS NULL OR f.ts < w.e)""")
def jn_11(t):
    v = t.orders.groupBy(F.col("o_custkey").alias("ck"), F.col("o_orderdate").alias("d")).agg(F.max("o_orderkey").alias("version"))
    v = W.framed(v, ["ck"], ["d"], F.date_trunc("day", "d"), 0, 1, {"e": lambda w: F.lead("d").over(w)})
    f = J.join_on(t.lineitem, t.orders.select("o_orderkey", F.col("o_custkey").alias("ck")), [("l_orderkey", "o_orderkey")]).withColumn(
        "ts", F.expr("l_shipdate + INTERVAL 200 DAY"))
    x = J.as_of(f, v, ["ck"], "ts", "d", "e", ["version"], lambda c: F.date_trunc("day", c))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "version")


@query("jn_12", """WITH e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)
SELECT a.src AS start, a.dst AS node, 1 AS depth FROM e a WHERE a.src LIKE 'c%' UNION SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'c%'""")
def jn_12(t):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = G.edges_of(t.orders, tag("c", "o_custkey"), tag("o", "o_orderkey")).union(G.edges_of(t.lineitem, tag("o", "l_orderkey"), tag("p", "l_partkey")))
    return G.downstream(e, t.customer.select(tag("c", "c_custkey").alias("s")), 3)


@query("jn_13", "SELECT c_custkey, coalesce(m, c_custkey) AS master_id FROM customer LEFT JOIN (SELECT o_custkey AS s, min(o_orderkey) AS m FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = s")
def jn_13(t):
    x = t.orders.filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("m"))
    return J.cross_reference(t.customer, x, "c_custkey", "o_custkey", "m").select("c_custkey", "master_id")


@query("jn_14", """
WITH m AS (SELECT DISTINCT o_orderkey AS member_id, o_orderpriority AS group_type, l_suppkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT member_id, group_type, item, first_id, group_size FROM (SELECT *, min(member_id) OVER (PARTITION BY group_type, item) AS first_id, count(*) OVER (PARTITION BY group_type, item) AS group_size FROM m) WHERE group_size > 1""")
def jn_14(t):
    members = J.join_on(t.lineitem.select("l_orderkey", "l_suppkey").distinct(), t.orders, [("l_orderkey", "o_orderkey")])
    return J.overlap_groups(members, "l_orderkey", "o_orderpriority", "l_suppkey")


# ---- aggregations ----------------------------------------------------------------------------

@query("ag_1", """SELECT l_returnflag, l_linestatus, round(sum(CAST(l_quantity AS DECIMAL(28, 6))), 2)::DOUBLE AS sum_qty, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28, 6))), 2)::DOUBLE AS revenue,
 round(avg(l_discount), 6) AS avg_disc, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2""")
def ag_1(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(money("l_quantity"), 2).alias("sum_qty"), F.round(money(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("ag_2", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def ag_2(t):
    return R.apply_rules(t.lineitem, [rule("aggregate", group_by=["l_suppkey"], aggregations=[
        {"column": "l_partkey", "function": "count_distinct", "alias": "parts"}, {"column": "l_orderkey", "function": "count_distinct", "alias": "orders"}])])


@query("ag_3", """
WITH p AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_orderpriority, (rn - 1) // 500 AS part, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS members, count(*) AS n FROM p GROUP BY 1, 2""")
def ag_3(t):
    x = A.collect_chunks(t.orders, ["o_orderpriority"], "o_orderkey", ["o_orderdate", "o_orderkey"], F.date_trunc("day", "o_orderdate"), 500)
    return x.select("o_orderpriority", "part", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("members"), F.size("values").cast("long").alias("n"))


@query("ag_3_set", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def ag_3_set(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("ag_4", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1")
def ag_4(t):
    return R.apply_rules(t.orders, [rule("aggregate", group_by=["o_custkey"], aggregations=[
        {"column": "o_orderkey", "function": "first", "alias": "first_order", "order_by": ["o_orderdate", "o_orderkey"]},
        {"column": "o_totalprice", "function": "last", "alias": "last_price", "order_by": ["o_orderdate", "o_orderkey"]}])])


@query("ag_5", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(28, 6)) END), 2)::DOUBLE AS open_amount,
 count(*) FILTER (WHERE l_discount >= 0.05) AS discounted FROM lineitem GROUP BY 1""")
def ag_5(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.round(money(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))), 2).alias("open_amount"),
        F.count_if(F.col("l_discount") >= 0.05).alias("discounted"))


@query("ag_6", """
SELECT c_custkey, c_name, count(*) AS total_orders, round(sum(CAST(o_totalprice AS DECIMAL(28, 6))), 2)::DOUBLE AS total_revenue, strftime(min(o_orderdate), '%Y-%m-%d') AS first_order,
 strftime(max(o_orderdate), '%Y-%m-%d') AS last_order, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS shipped,
 count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY total_revenue DESC""")
def ag_6(t):
    s = A.order_summary(t.orders, "o_custkey", F.col("o_totalprice"), "o_orderdate", "o_orderstatus", {"completed": "F", "shipped": "O", "pending": "P"})
    x = s.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return (x.select("c_custkey", "c_name", "total_orders", "total_revenue", ymd("first_order").alias("first_order"), ymd("last_order").alias("last_order"),
                     "completed", "shipped", "pending").orderBy(F.desc("total_revenue")))


def _stats_sql(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{m}' AS metric, round(CAST({e} AS DOUBLE), 4) AS value FROM {table}"
        for c in cols for m, e in [("mean", f"avg({c})"), ("stddev", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("distinct", f"count(DISTINCT {c})")])


@query("ag_7", _stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]))
def ag_7(t):
    return D.numeric_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]).withColumn("value", F.round("value", 4))


@query("ag_8", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1, 2")
def ag_8(t):
    x = W.exact_quantile(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.5, "median_price")
    return x.withColumn("median_price", F.round("median_price", 4))


@query("ag_9", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ag_9(t):
    return A.repeated_groups(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("ag_10", """
SELECT concat_ws('+', CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' END, CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' END, CASE WHEN grouping(y) = 0 THEN 'y' END) AS grain,
 o_orderpriority, o_orderstatus, y, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(28, 6))), 2)::DOUBLE AS revenue
FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority, y), (y), ())""")
def ag_10(t):
    x = t.orders.withColumn("y", F.year("o_orderdate"))
    return A.rollup_facts(x, [["o_orderpriority", "o_orderstatus"], ["o_orderpriority", "y"], ["y"], []], F.count(F.lit(1)).alias("n"),
                          F.round(money("o_totalprice"), 2).alias("revenue"))


@query("ag_11", """
SELECT o_orderpriority, round(sum(CAST(o_totalprice AS DECIMAL(28, 6))), 2)::DOUBLE AS revenue, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def ag_11(t):
    # base grain (priority, customer): revenue may be summed again, customers must be counted there
    base = t.orders.groupBy("o_orderpriority", "o_custkey").agg(money("o_totalprice").alias("revenue"))
    x = A.reaggregate(base, ["o_orderpriority"], ["revenue"], [F.count("o_custkey").alias("customers")])
    return x.withColumn("revenue", F.round("revenue", 2))


@query("ag_12", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def ag_12(t):
    return t.events.groupBy("event_type", ymd("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("ag_13", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS score FROM lineitem GROUP BY 1")
def ag_13(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(A.weighted_mean("l_discount", "l_quantity"), 6).alias("score"))


@query("ag_14", "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def ag_14(t):
    x = W.exact_quantiles(t.events, ["event_type"], "value", {"p95": 0.95, "p99": 0.99})
    return x.select("event_type", F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"))


@query("ag_15", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1")
def ag_15(t):
    return A.share_of_total(t.events, ["event_type"])


# ---- windows ---------------------------------------------------------------------------------


def slot():
    """Bucket of an event time: fine enough that even a third of all events fall into small groups."""
    return F.date_trunc("minute", "ts")


@query("wn_1", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS row_num, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS rank,
 dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS dense_rank FROM orders""")
def wn_1(t):
    x = W.with_ranks(t.orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderdate"], F.date_trunc("day", "o_orderdate"))
    return x.select("o_orderkey", "row_num", "rank", "dense_rank")


@query("wn_2", """SELECT event_id, lag(value, 1) OVER w AS prev1, lag(value, 3) OVER w AS prev3, lead(event_type, 1) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def wn_2(t):
    x = W.framed(t.events, ["user_id"], ["ts", "event_id"], slot(), 3, 1, {
        "prev1": lambda w: F.lag("value", 1).over(w), "prev3": lambda w: F.lag("value", 3).over(w), "next_type": lambda w: F.lead("event_type", 1).over(w)})
    return x.select("event_id", "prev1", "prev3", "next_type")


@query("wn_3", """SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi, round(sum(CAST(value AS DECIMAL(28, 6))) OVER w, 2)::DOUBLE AS total
FROM events WINDOW w AS (PARTITION BY event_type)""")
def wn_3(t):
    x = W.with_group_stats(t.events, ["event_type"], F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"),
                           F.max("value").alias("hi"), F.round(money("value"), 2).alias("total"))
    return x.select("event_id", "mean", "n", "lo", "hi", "total")


@query("wn_4", """SELECT event_id, round(avg(value) OVER w, 6) AS mean5, max(value) OVER w AS max5 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def wn_4(t):
    x = W.framed(t.events, ["event_type"], ["ts", "event_id"], slot(), 2, 2, {
        "mean5": lambda w: F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6), "max5": lambda w: F.max("value").over(w.rowsBetween(-2, 2))}, block=64)
    return x.select("event_id", "mean5", "max5")


@query("wn_5", """SELECT event_id, round(sum(CAST(value AS DECIMAL(28, 6))) OVER w, 2)::DOUBLE AS total, count(*) OVER w AS n, max(value) OVER w AS top FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def wn_5(t):
    x = W.running(t.events, ["user_id"], ["ts", "event_id"], slot(), total=("sum", F.col("value").cast("decimal(28,6)")), n=("count", F.lit(1)), top=("max", "value"))
    return x.select("event_id", F.round("total", 2).cast("double").alias("total"), "n", "top")


@query("wn_6", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders")
def wn_6(t):
    return R.apply_rules(t.orders, [rule("window", function="row_number", partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"],
                                         bucket="date_trunc('day', o_orderdate)", output_column="nth")]).select("o_orderkey", "nth")


@query("wn_6_text", "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS price_rank FROM lineitem")
def wn_6_text(t):
    x = R.apply_rules(t.lineitem, [rule("window", name="price_rank", func="rank()", partition_by=["l_orderkey"], order_by=["l_extendedprice DESC"], bucket="-floor(l_extendedprice / 10)")])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.col("price_rank").cast("long").alias("price_rank"))


_DAILY = "SELECT event_type, date_trunc('day', ts) AS d, round(sum(CAST(value AS DECIMAL(28, 6))), 2)::DOUBLE AS v FROM events GROUP BY 1, 2"


def daily(t):
    return t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.round(money("value"), 2).alias("v"))


@query("wn_7", f"SELECT event_type, strftime(d, '%Y-%m-%d') AS day, v, round(100.0 * (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0), 4) AS pct FROM ({_DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY d)")
def wn_7(t):
    x = W.framed(daily(t), ["event_type"], ["d"], F.date_trunc("month", "d"), 1, 0, {"p": lambda w: F.lag("v").over(w)})
    return x.select("event_type", ymd("d").alias("day"), "v", F.round(100.0 * (F.col("v") - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0)), 4).alias("pct"))


@query("wn_8", f"SELECT event_type, strftime(d, '%Y-%m-%d') AS day, round(avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS ma7 FROM ({_DAILY})")
def wn_8(t):
    x = W.framed(daily(t), ["event_type"], ["d"], F.date_trunc("month", "d"), 6, 0, {"ma7": lambda w: F.round(F.avg("v").over(w.rowsBetween(-6, 0)), 4)})
    return x.select("event_type", ymd("d").alias("day"), "ma7")


@query("wn_9", "SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING), 6) AS baseline FROM events")
def wn_9(t):
    return D.with_baseline(t.events, ["event_type"], ["ts", "event_id"], slot(), "value").select("event_id", F.round("baseline", 6).alias("baseline"))


@query("wn_10", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, CASE WHEN count(*) OVER w >= 5 THEN round(regr_slope(value, i) OVER w, 6) END AS slope FROM p WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def wn_10(t):
    return D.with_baseline(t.events, ["event_type"], ["ts", "event_id"], slot(), "value").select("event_id", F.round("slope", 6).alias("slope"))


@query("wn_11", "SELECT event_id, round(epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6, 3) AS elapsed_s FROM events")
def wn_11(t):
    x = W.with_group_stats(t.events, ["user_id"], F.min("ts").alias("t0"))
    return x.select("event_id", F.round(epoch("ts") - epoch("t0"), 3).alias("elapsed_s"))


@query("wn_12", """
WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS streak FROM g""")
def wn_12(t):
    return S.success_streaks(t.events, ["user_id"], ["ts", "event_id"], slot(), F.col("event_type") != "error").select("event_id", "streak")


# ---- sorting, top-k --------------------------------------------------------------------------

@query("so_1", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def so_1(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("so_2", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS p FROM orders ORDER BY p NULLS LAST, o_orderkey")
def so_2(t):
    p = case_map(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3})
    return t.orders.select("o_orderkey", p.alias("p")).orderBy(F.asc_nulls_last("p"), "o_orderkey")


@query("so_3", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def so_3(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("so_4", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 905 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def so_4(t):
    return t.part.filter("p_retailprice > 905").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query("so_5", """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rk FROM lineitem) WHERE rk <= 3""")
def so_5(t):
    x = W.top_per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 3, "rk")
    return x.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("rk").cast("long").alias("rk"))


# ---- set operations --------------------------------------------------------------------------

@query("se_1", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_retailprice FROM part")
def se_1(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.part.select(F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("se_2", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def se_2(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey"))


@query("se_3", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def se_3(t):
    return t.part.select("p_partkey").subtract(t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 30").select("l_partkey"))


@query("se_4", cat.COLUMNS_SQL + """
SELECT 'added' AS side, dataset, column_name FROM (SELECT dataset, column_name FROM cols_new EXCEPT SELECT dataset, column_name FROM cols_old)
UNION ALL SELECT 'removed', dataset, column_name FROM (SELECT dataset, column_name FROM cols_old EXCEPT SELECT dataset, column_name FROM cols_new)
UNION ALL SELECT 'common', dataset, column_name FROM (SELECT dataset, column_name FROM cols_old INTERSECT SELECT dataset, column_name FROM cols_new)""")
def se_4(t):
    a, b = (x.select("dataset", "column_name") for x in (cat.columns_old(t), cat.columns_new(t)))
    tag = lambda n, x: x.select(F.lit(n).alias("side"), "dataset", "column_name")
    return tag("added", b.subtract(a)).union(tag("removed", a.subtract(b))).union(tag("common", a.intersect(b)))


# ---- scalar functions ------------------------------------------------------------------------

@query("fn_1", """
SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 3, 5) AS s, replace(c_name, '#', '-') AS r, c_name || '/' || c_mktsegment AS c,
 concat_ws('-', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS w, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS p, ltrim('  ' || c_name, ' ') AS lt, rtrim(c_name || '  ', ' ') AS rt, c_name LIKE '%1%' AS has1 FROM customer""")
def fn_1(t):
    n, m, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    return t.customer.select(
        "c_custkey", F.upper(n).alias("u"), F.lower(m).alias("l"), F.length(n).cast("long").alias("n"), F.substring(n, 3, 5).alias("s"), F.replace(n, F.lit("#"), F.lit("-")).alias("r"),
        F.concat(n, F.lit("/"), m).alias("c"), F.concat_ws("-", m, k).alias("w"), F.lpad(k, 4, "0").alias("p"), F.ltrim(F.concat(F.lit("  "), n)).alias("lt"),
        F.rtrim(F.concat(n, F.lit("  "))).alias("rt"), n.like("%1%").alias("has1"))


@query("fn_2", "SELECT page_id, regexp_matches(url, '^https') AS tls, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '//([^/]+)/', 1) AS host FROM pages")
def fn_2(t):
    return t.pages.select("page_id", F.col("url").rlike("^https").alias("tls"), F.regexp_replace("url", "[?#].*$", "").alias("bare"), F.regexp_extract("url", "//([^/]+)/", 1).alias("host"))


@query("fn_3", """SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS d, strftime(ts, '%H:%M') AS hm, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS dd, CAST(extract(hour FROM ts) AS INTEGER) AS h,
 CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS secs FROM events""")
def fn_3(t):
    ts = F.col("ts")
    return t.events.select("event_id", ymd(F.to_date(ts)).alias("d"), F.date_format(ts, "HH:mm").alias("hm"), F.year(ts).alias("y"), F.month(ts).alias("m"), F.day(ts).alias("dd"),
                           F.extract(F.lit("hour"), ts).cast("int").alias("h"), F.datediff(ts, F.lit("2024-01-01").cast("date")).alias("days"),
                           (F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).alias("secs"))


@query("fn_4", f"SELECT c_custkey, CASE WHEN bal > 5000 THEN 'rich' WHEN bal IS NULL THEN 'unknown' ELSE 'normal' END AS band, coalesce(seg, 'none') AS seg, nullif(seg, 'MACHINERY') AS other FROM ({_HOLES})")
def fn_4(t):
    return _holes(t).select("c_custkey", F.when(F.col("bal") > 5000, "rich").when(F.col("bal").isNull(), "unknown").otherwise("normal").alias("band"),
                            F.coalesce("seg", F.lit("none")).alias("seg"), F.nullif(F.col("seg"), F.lit("MACHINERY")).alias("other"))


@query("fn_5", f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, TRY_CAST(code AS INTEGER) AS i, TRY_CAST(code AS DOUBLE) AS d FROM ({_CODES})")
def fn_5(t):
    return _codes(t).select("o_orderkey", F.col("o_orderkey").cast("string").alias("s"), F.col("code").try_cast("int").alias("i"), F.col("code").try_cast("double").alias("d"))


@query("fn_6", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, substring(sha256(concat_ws('|', source, lang)), 1, 16) AS short_id FROM documents")
def fn_6(t):
    return t.documents.select("doc_id", F.md5("text").alias("m"), H.digest("text").alias("s"), H.short_id("source", "lang").alias("short_id"))


@query("fn_7", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS r, round(abs(l_discount - l_tax) / nullif(l_tax, 0), 4) AS chg, least(greatest(l_quantity, 10), 40) AS clamp,
 CAST(floor(l_extendedprice / 1000) AS BIGINT) AS f FROM lineitem""")
def fn_7(t):
    d = F.col("l_discount") - F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 1).alias("r"), F.round(F.abs(d) / F.nullif(F.col("l_tax"), F.lit(0.0)), 4).alias("chg"),
                             F.least(F.greatest("l_quantity", F.lit(10.0)), F.lit(40.0)).alias("clamp"), F.floor(F.col("l_extendedprice") / 1000).alias("f"))


@query("fn_8", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok, json_valid(substring(props, 2)) AS cut_ok,
 CAST(json_array_length('[' || props || ',' || props || ']') AS INTEGER) AS n, list_has_any([json_extract_string(props, '$.k'), event_type], ['7', 'error']) AS tagged FROM events""")
def fn_8(t):
    k = F.get_json_object("props", "$.k")
    twice = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    return t.events.select("event_id", k.cast("long").alias("k"), json_valid("props").alias("ok"), json_valid(F.expr("substring(props, 2)")).alias("cut_ok"),
                           F.json_array_length(twice).alias("n"), F.arrays_overlap(F.array(k, "event_type"), F.array(F.lit("7"), F.lit("error"))).alias("tagged"))


_WORDS = ["the", "was", "on", "ist", "la"]


@query("fn_9", f"""
WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS words FROM documents)
SELECT doc_id, len(words) AS n_words, len(list_filter({_WORDS}, lambda x: list_contains(words, x))) AS hits, list_has_any(words, ['der', 'die']) AS german FROM w""")
def fn_9(t):
    w = F.split(F.lower("text"), " ", -1)
    return (t.documents.select("doc_id", w.alias("words"))
            .select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(F.filter(F.array(*[F.lit(x) for x in _WORDS]), lambda x: F.array_contains("words", x))).cast("long").alias("hits"),
                    F.arrays_overlap("words", F.array(F.lit("der"), F.lit("die"))).alias("german")))


@query("fn_10", """
WITH a AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE) - INTERVAL 9000 DAY, DATE '2024-01-01') / 365 AS age FROM orders)
SELECT o_orderkey, CAST(floor(age) AS INTEGER) AS age, CASE WHEN age < 25 THEN 'Gen Z' WHEN age < 40 THEN 'Millennial' WHEN age < 55 THEN 'Gen X' ELSE 'Boomer' END AS generation FROM a""")
def fn_10(t):
    from zonecraft.operators.dims import generation
    age = F.datediff(F.lit("2024-01-01").cast("date"), F.date_sub("o_orderdate", 9000)) / 365
    return t.orders.select("o_orderkey", F.floor(age).cast("int").alias("age"), generation(age).alias("generation"))


@query("fn_11", cat.COLUMNS_SQL + "SELECT dataset, column_name, CASE data_type WHEN 'int' THEN 'integer' WHEN 'varchar' THEN 'string' ELSE data_type END AS normal FROM cols_old")
def fn_11(t):
    return cat.columns_old(t).select("dataset", "column_name", D.normal_type("data_type").alias("normal"))


@query("fn_12", "SELECT l_orderkey, l_linenumber, l_partkey, round(p_retailprice * l_quantity, 4) AS revenue, round(p_retailprice * l_quantity * (1 - l_discount), 4) AS discounted FROM lineitem JOIN part ON l_partkey = p_partkey")
def fn_12(t):
    r = F.col("p_retailprice") * F.col("l_quantity")
    return J.join_on(t.lineitem, t.part.select("p_partkey", "p_retailprice"), [("l_partkey", "p_partkey")]).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(r, 4).alias("revenue"), F.round(r * (1 - F.col("l_discount")), 4).alias("discounted"))


# ---- reshape ---------------------------------------------------------------------------------

@query("rs_1", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS "A", count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS "N", count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS "R" FROM lineitem GROUP BY 1""")
def rs_1(t):
    x = R.apply_rules(t.lineitem, [rule("pivot", group_by=["l_suppkey"], column="l_returnflag", values=["A", "N", "R"], aggregations=[{"column": "l_orderkey", "function": "count", "alias": "n"}])])
    return x.na.fill(0)


@query("rs_2", "SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS amount FROM lineitem")
def rs_2(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return R.apply_rules(x, [rule("unpivot", ids=["l_orderkey", "l_linenumber", "l_partkey"], columns=["l_quantity", "l_discount", "l_tax"], name_column="measure", value_column="amount")])


@query("rs_3", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS s_k, unnest([event_type, upper(event_type)]) AS tags FROM events")
def rs_3(t):
    x = t.events.select("event_id", F.from_json("props", "k bigint").alias("s"), F.array("event_type", F.upper("event_type")).alias("tags"))
    return R.apply_rules(x, [rule("flatten", explode=["tags"])])
