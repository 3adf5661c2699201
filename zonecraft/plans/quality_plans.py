"""Queries for data quality (DQ)."""

from pyspark.sql import functions as F

from zonecraft.operators import quality as Q
from zonecraft.plans import catalog as cat
from zonecraft.plans.registry import query

_ROW = """SELECT '{id}' AS rule_id, CAST({n} AS BIGINT) AS element_count, CAST({u} AS BIGINT) AS unexpected_count,
 round(CASE WHEN {n} > 0 THEN 100.0 * {u} / {n} ELSE 0.0 END, 6) AS unexpected_percent, CAST({o} AS DOUBLE) AS observed,
 {ok} AS success FROM {src}"""


def row(id, src, n="0", u="0", o="NULL", ok="TRUE"):
    return _ROW.format(id=id, src=src, n=n, u=u, o=o, ok=ok)


def checked(id, src, considered, bad, allowed=0.0):
    n, u = f"count(*) FILTER (WHERE {considered})", f"count(*) FILTER (WHERE ({considered}) AND ({bad}))"
    return row(id, src, n, u, ok=f"({u}) * 100.0 <= ({n}) * {allowed} + 1e-6")


def both(*parts):
    return " UNION ALL ".join(parts)


def show(res):
    return res.select("rule_id", "element_count", "unexpected_count", F.round("unexpected_percent", 6).alias("unexpected_percent"),
                      F.round("observed", 4).alias("observed"), "success")


def rule(id, kind, column=None, **kw):
    return {"rule_id": id, "rule_type": kind, **({"column": column} if column else {}), **kw}


NULLABLE = "(SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS maybe, CASE WHEN o_totalprice < 40000 THEN NULL ELSE o_orderpriority END AS prio FROM orders)"


def nullable(t):
    return t.orders.withColumns({
        "maybe": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
        "prio": F.when(F.col("o_totalprice") >= 40000, F.col("o_orderpriority"))})


@query("dq_1", both(row("a", "(SELECT 1 FROM orders LIMIT 1)"), row("b", "(SELECT 1 FROM orders LIMIT 1)", ok="FALSE")))
def dq_1(t):
    return show(Q.run_suite(t.orders, [rule("a", "column_exists", "o_orderkey"), rule("b", "column_exists", "nope")]))


@query("dq_2", row("a", "(SELECT 1 FROM orders LIMIT 1)", o="6"))
def dq_2(t):
    return show(Q.run_suite(t.orders, [rule("a", "column_count", value=6)]))


@query("dq_3", both(row("a", "(SELECT 1 FROM orders LIMIT 1)", o="1", ok="FALSE"), row("b", "(SELECT 1 FROM orders LIMIT 1)")))
def dq_3(t):
    return show(Q.run_suite(t.orders, [
        rule("a", "columns_match", columns=["o_orderkey", "nope"]),
        rule("b", "columns_ordered", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])]))


@query("dq_4", both(checked("a", NULLABLE, "TRUE", "maybe IS NULL", 50.0), checked("b", NULLABLE, "TRUE", "maybe IS NULL"),
                    checked("c", NULLABLE, "TRUE", "o_custkey IS NULL")))
def dq_4(t):
    return show(Q.run_suite(nullable(t), [rule("a", "not_null", "maybe", mostly=0.5), rule("b", "completeness", "maybe"),
                                          rule("c", "not_null", "o_custkey")]))


@query("dq_5", both(checked("a", NULLABLE, "TRUE", "maybe IS NULL", 40.0), checked("b", NULLABLE, "TRUE", "maybe IS NULL", 10.0)))
def dq_5(t):
    return show(Q.run_suite(nullable(t), [rule("a", "null_rate", "maybe", max=0.4), rule("b", "null_rate", "maybe", max=0.1)]))


def _uniq(cols, src="lineitem"):
    return f"(SELECT count(*) AS c FROM {src} GROUP BY {cols})"


_U = dict(n="sum(c)", u="coalesce(sum(c) FILTER (WHERE c > 1), 0)", o="sum(c - 1)", ok="count(*) FILTER (WHERE c > 1) = 0")


@query("dq_6", both(row("a", _uniq("o_orderkey", "orders"), **_U), row("b", _uniq("o_custkey", "orders"), **_U)))
def dq_6(t):
    return show(Q.run_suite(t.orders, [rule("a", "unique", "o_orderkey"), rule("b", "unique", "o_custkey")]))


@query("dq_7", both(row("a", _uniq("l_orderkey, l_linenumber"), **_U), row("b", _uniq("l_orderkey, l_linenumber, l_partkey"), **_U)))
def dq_7(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "compound_unique", columns=["l_orderkey", "l_linenumber"]),
                                         rule("b", "compound_unique", columns=["l_orderkey", "l_linenumber", "l_partkey"])]))


@query("dq_8", both(checked("pk_not_null_prio", NULLABLE, "TRUE", "prio IS NULL"), checked("pk_not_null_o_custkey", NULLABLE, "TRUE", "o_custkey IS NULL"),
                    row("pk_unique", f"(SELECT count(*) AS c, prio IS NULL OR o_custkey IS NULL AS nul FROM {NULLABLE} GROUP BY prio, o_custkey)",
                        n="sum(c)", u="coalesce(sum(c) FILTER (WHERE c > 1 OR nul), 0)", o="sum(c - 1)", ok="count(*) FILTER (WHERE c > 1 OR nul) = 0")))
def dq_8(t):
    return show(Q.run_suite(nullable(t), Q.primary_key_rules(["prio", "o_custkey"])))


@query("dq_9", both(checked("a", "lineitem", "l_quantity IS NOT NULL", "l_quantity < 2 OR l_quantity > 45", 12.0),
                    checked("b", "lineitem", "l_discount IS NOT NULL", "l_discount < 0"),
                    checked("c", NULLABLE, "maybe IS NOT NULL", "maybe > 300000"),
                    checked("d", "orders", "o_orderdate IS NOT NULL", "o_orderdate > TIMESTAMP '2001-01-01'")))
def dq_9(t):
    a = Q.run_suite(t.lineitem, [rule("a", "range", "l_quantity", min=2, max=45, max_fail_pct=12.0), rule("b", "between", "l_discount", min=0)])
    import datetime
    b = Q.run_suite(nullable(t), [rule("c", "range", "maybe", max_value=300000),
                                  rule("d", "date_range", "o_orderdate", max=datetime.datetime(2001, 1, 1))])
    return show(a.unionByName(b))


@query("dq_10", both(checked("a", NULLABLE, "prio IS NOT NULL", "prio NOT IN ('1-URGENT', '2-HIGH')"),
                     checked("b", NULLABLE, "TRUE", "prio IS NULL OR prio NOT IN ('1-URGENT', '2-HIGH')"),
                     checked("c", "orders", "o_orderstatus IS NOT NULL", "o_orderstatus NOT IN ('F', 'O', 'P')")))
def dq_10(t):
    v = ["1-URGENT", "2-HIGH"]
    return show(Q.run_suite(nullable(t), [rule("a", "in_set", "prio", values=v), rule("b", "in_set", "prio", values=v, null_policy="fail"),
                                          rule("c", "in_set", "o_orderstatus", values=["F", "O", "P"])]))


@query("dq_11", checked("a", "lineitem", "l_returnflag IS NOT NULL", "l_returnflag IN ('R')", 40.0))
def dq_11(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "not_in_set", "l_returnflag", values=["R"], mostly=0.6)]))


@query("dq_12", both(checked("a", "customer", "c_name IS NOT NULL", "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"),
                     checked("b", "pages", "url IS NOT NULL", "NOT regexp_matches(url, '^https://')")))
def dq_12(t):
    a = Q.run_suite(t.customer, [rule("a", "regex", "c_name", pattern="^Customer#[0-9]{9}$")])
    return show(a.unionByName(Q.run_suite(t.pages, [rule("b", "regex", "url", pattern="^https://")])))


@query("dq_13", checked("a", "documents", "text IS NOT NULL", "length(text) < 100 OR length(text) > 5000", 30.0))
def dq_13(t):
    return show(Q.run_suite(t.documents, [rule("a", "length", "text", min=100, max=5000, max_fail_pct=30.0)]))


_MIXED = "(SELECT CASE WHEN l_returnflag = 'R' THEN 'x' || CAST(l_partkey AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS v, CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%d/%m/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem)"


def _mixed(t):
    p, d = F.col("l_partkey").cast("string"), F.col("l_shipdate")
    return t.lineitem.select(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("x"), p)).otherwise(p).alias("v"),
                             F.when(F.col("l_linestatus") == "O", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("d"))


@query("dq_14", checked("a", _MIXED, "v IS NOT NULL", "TRY_CAST(v AS BIGINT) IS NULL"))
def dq_14(t):
    return show(Q.run_suite(_mixed(t), [rule("a", "column_type", "v", type="bigint")]))


@query("dq_15", checked("a", _MIXED, "d IS NOT NULL", "try_strptime(d, '%Y-%m-%d') IS NULL", 60.0))
def dq_15(t):
    return show(Q.run_suite(_mixed(t), [rule("a", "date_format", "d", format="yyyy-MM-dd", max_fail_pct=60.0)]))


@query("dq_16", both(row("a", "lineitem", n="count(*)", o="count(*)", ok="count(*) BETWEEN 1 AND 100000000"), row("b", "lineitem", n="count(*)", o="count(*)", ok="count(*) >= 1000000000000")))
def dq_16(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "row_count", min=1, max=100_000_000), rule("b", "row_count", min=10 ** 12)]))


@query("dq_17", both(row("a", "events", n="count(ts)", ok="max(ts) >= TIMESTAMP '2024-01-25'"),
                     row("b", "events", n="count(value)", o="max(value)", ok="max(value) <= 10")))
def dq_17(t):
    import datetime
    return show(Q.run_suite(t.events, [rule("a", "freshness", "ts", min=datetime.datetime(2024, 1, 25)), rule("b", "freshness", "value", max=10)]))


@query("dq_18", both(row("a", "lineitem", n="count(l_quantity)", o="round(avg(l_quantity), 4)", ok="avg(l_quantity) BETWEEN 20 AND 30"),
                     row("b", "lineitem", n="count(l_tax)", o="round(avg(l_tax), 4)", ok="avg(l_tax) >= 1")))
def dq_18(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "mean", "l_quantity", min=20, max=30), rule("b", "mean", "l_tax", min=1)]))


@query("dq_19", row("a", "lineitem", n="count(l_quantity)", o="round(stddev_samp(l_quantity), 4)", ok="stddev_samp(l_quantity) <= 20"))
def dq_19(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "stdev", "l_quantity", max=20)]))


@query("dq_20", row("a", "lineitem", n="count(l_extendedprice)", o="round(median(l_extendedprice), 4)", ok="median(l_extendedprice) BETWEEN 1000 AND 100000"))
def dq_20(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "median", "l_extendedprice", min=1000, max=100000)]))


@query("dq_21", both(
    row("a", "(SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)", n="count(*)",
        u="count(*) FILTER (WHERE value <= p)", ok="count(*) FILTER (WHERE value <= p) = 0"),
    row("b", "(SELECT event_id, lag(event_id) OVER (ORDER BY ts, event_id) AS p FROM events)", n="count(*)",
        u="count(*) FILTER (WHERE event_id <= p)", ok="count(*) FILTER (WHERE event_id <= p) = 0")))
def dq_21(t):
    slot = "date_trunc('minute', ts)"
    return show(Q.run_suite(t.events, [
        rule("a", "increasing", "value", order_by=["ts", "event_id"], partition_by=["user_id"], bucket=slot),
        rule("b", "increasing", "event_id", order_by=["ts", "event_id"], bucket=slot)]))


@query("dq_22", both(row("a", "(SELECT DISTINCT o_orderpriority AS v FROM orders)", n="count(*)", u="count(*) FILTER (WHERE v NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))",
                         o="count(*)", ok="count(*) FILTER (WHERE v NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) = 0"),
                     row("b", "(SELECT DISTINCT o_orderstatus AS v FROM orders)", n="count(*)", o="count(*)")))
def dq_22(t):
    return show(Q.run_suite(t.orders, [rule("a", "distinct_count", "o_orderpriority", values=["1-URGENT", "2-HIGH", "3-MEDIUM"]),
                                       rule("b", "distinct_count", "o_orderstatus", values=["F", "O", "P"])]))


@query("dq_23", both(checked("a", "lineitem", "TRUE", "NOT (l_extendedprice > l_quantity)"), checked("b", "lineitem", "TRUE", "NOT (l_discount >= l_tax)", 50.0),
                     checked("c", "lineitem", "TRUE", "NOT (l_discount <> l_tax)")))
def dq_23(t):
    return show(Q.run_suite(t.lineitem, [
        rule("a", "column_pair_comparison", "l_extendedprice", other="l_quantity"),
        rule("b", "column_pair_comparison", "l_discount", other="l_tax", op=">=", max_fail_pct=50.0),
        rule("c", "column_pair_comparison", "l_discount", other="l_tax", op="!=")]))


@query("dq_24", checked("a", "lineitem", "TRUE", "(l_returnflag, l_linestatus) NOT IN (('A', 'F'), ('N', 'O'))", 70.0))
def dq_24(t):
    return show(Q.run_suite(t.lineitem, [rule("a", "pair_in_set", "l_returnflag", other="l_linestatus", values=[("A", "F"), ("N", "O")], max_fail_pct=70.0)]))


@query("dq_25", checked("a", NULLABLE, "o_orderstatus = 'F'", "prio IS NULL", 5.0))
def dq_25(t):
    return show(Q.run_suite(nullable(t), [rule("a", "conditional_not_null", "prio", when="o_orderstatus = 'F'", max_fail_pct=5.0)]))


@query("dq_26", both(checked("a", "lineitem", "TRUE", "NOT (l_extendedprice * (1 - l_discount) > 1000)"), checked("b", NULLABLE, "TRUE", "NOT coalesce(maybe > 0, FALSE)", 40.0)))
def dq_26(t):
    a = Q.run_suite(t.lineitem, [rule("a", "custom_sql", condition="l_extendedprice * (1 - l_discount) > 1000")])
    return show(a.unionByName(Q.run_suite(nullable(t), [rule("b", "sql", condition="maybe > 0", max_fail_pct=40.0)])))


@query("dq_27", both(
    row("a", "orders LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey", n="count(o_custkey)",
        u="count(*) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NULL)", ok="count(*) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NULL) * 100.0 <= count(o_custkey) * 20.0"),
    checked("b", "lineitem", "l_returnflag IS NOT NULL", "l_returnflag NOT IN ('A', 'R')")))
def dq_27(t):
    a = Q.run_suite(t.orders, [rule("a", "reference", "o_custkey", table="good", ref_column="c_custkey", max_fail_pct=20.0)],
                    {"good": t.customer.filter("c_acctbal >= 0")})
    return show(a.unionByName(Q.run_suite(t.lineitem, [rule("b", "in_set", "l_returnflag", values=["A", "R"])])))


SUITE = [
    rule("q", "between", "l_quantity", min=5, max=48, weight=2),
    rule("f", "in_set", "l_returnflag", values=["A", "N"], severity="WARNING"),
    rule("d", "sql", condition="l_discount <= 0.08", weight=1),
    rule("k", "compound_unique", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], weight=3),
    rule("n", "not_null", "l_shipdate"),
    rule("r", "row_count", min=1),
    rule("z", "freshness", "l_tax", max=0.5, severity="WARNING"),
]

# rule_id, expectation, n, u, success, severity, weight as SQL rows over the whole table
RES_SQL = """
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 48) AS q, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS f,
  count(*) FILTER (WHERE l_discount > 0.08) AS d, count(*) FILTER (WHERE l_shipdate IS NULL) AS nn, max(l_tax) AS mt FROM lineitem),
k AS (SELECT coalesce(sum(c) FILTER (WHERE c > 1), 0) AS u FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
res AS (SELECT 'q' AS rule_id, 'validity' AS dim, n AS element_count, q AS unexpected_count, q = 0 AS success, 'ERROR' AS severity, 2.0 AS weight FROM s
 UNION ALL SELECT 'f', 'validity', n, f, f = 0, 'WARNING', 1.0 FROM s UNION ALL SELECT 'd', 'validity', n, d, d = 0, 'ERROR', 1.0 FROM s
 UNION ALL SELECT 'k', 'uniqueness', n, u, u = 0, 'ERROR', 3.0 FROM s, k UNION ALL SELECT 'n', 'completeness', n, nn, nn = 0, 'ERROR', 1.0 FROM s
 UNION ALL SELECT 'r', 'consistency', n, 0, n >= 1, 'ERROR', 1.0 FROM s UNION ALL SELECT 'z', 'freshness', n, 0, mt <= 0.5, 'WARNING', 1.0 FROM s),
pct AS (SELECT *, CASE WHEN element_count > 0 THEN 100.0 * unexpected_count / element_count ELSE 0.0 END AS p FROM res)
"""


def suite(t):
    return Q.run_suite(t.lineitem, SUITE)


_FAILS = "list_filter([CASE WHEN l_quantity < 5 OR l_quantity > 48 THEN 'q' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'f' END, CASE WHEN l_discount > 0.08 THEN 'd' END, CASE WHEN l_shipdate IS NULL THEN 'n' END], lambda x: x IS NOT NULL)"
_ROWRULES = [r for r in SUITE if r["rule_type"] in Q.ROW_RULES]


@query("dq_28", f"""
WITH x AS (SELECT *, unnest({_FAILS}) AS rule_id FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM x)
SELECT rule_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE rn <= 10""")
def dq_28(t):
    x = Q.failing_samples(t.lineitem, _ROWRULES, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return x.select("rule_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("dq_29", "WITH " + RES_SQL + """
SELECT count(*) FILTER (WHERE NOT success AND severity <> 'WARNING') AS blocking_failures, count(*) FILTER (WHERE NOT success AND severity = 'WARNING') AS warning_failures,
 CASE WHEN count(*) FILTER (WHERE NOT success) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM res""")
def dq_29(t):
    return Q.verdict(suite(t), fail_on_warning=True)


@query("dq_30", "WITH " + RES_SQL + "SELECT round(100.0 * count(*) FILTER (WHERE success) / count(*), 4) AS score FROM res")
def dq_30(t):
    return Q.plain_score(suite(t)).select(F.round("score", 4).alias("score"))


@query("dq_31", "WITH " + RES_SQL + "SELECT round(100 * sum(weight * CASE WHEN success THEN 1.0 ELSE greatest(0.0, 1 - p / 100) END) / sum(weight), 2) AS score FROM pct")
def dq_31(t):
    return Q.weighted_score(suite(t))


@query("dq_32", "WITH " + RES_SQL + """, d AS (SELECT dim, avg(CASE WHEN element_count = 0 THEN CASE WHEN success THEN 1.0 ELSE 0.0 END ELSE 1 - p / 100 END) AS s FROM pct GROUP BY dim),
w AS (SELECT coalesce(max(s) FILTER (WHERE dim = 'completeness'), 1) AS completeness, coalesce(max(s) FILTER (WHERE dim = 'uniqueness'), 1) AS uniqueness,
 coalesce(max(s) FILTER (WHERE dim = 'validity'), 1) AS validity, coalesce(max(s) FILTER (WHERE dim = 'consistency'), 1) AS consistency, coalesce(max(s) FILTER (WHERE dim = 'freshness'), 1) AS freshness FROM d),
o AS (SELECT *, 0.25 * completeness + 0.2 * uniqueness + 0.25 * validity + 0.15 * consistency + 0.15 * freshness AS overall FROM w)
SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, round(validity, 4) AS validity, round(consistency, 4) AS consistency,
 round(freshness, 4) AS freshness, round(overall, 4) AS overall, CASE WHEN overall >= 0.95 THEN 'A' WHEN overall >= 0.85 THEN 'B' WHEN overall >= 0.75 THEN 'C' WHEN overall >= 0.65 THEN 'D' ELSE 'F' END AS grade FROM o""")
def dq_32(t):
    return Q.dimension_scores(suite(t)).select(*[F.round(c, 4).alias(c) for c in [*Q.DIMENSIONS, "overall"]], "grade")


_SCHEMA = [{"name": "o_orderkey", "type": "bigint", "nullable": False}, {"name": "o_totalprice", "type": "double"},
           {"name": "prio", "type": "string", "nullable": False}]


@query("dq_33", "WITH z AS (" + both(
    *[row(f"raw.exists_{c}", "(SELECT 1 FROM orders LIMIT 1)") for c in ("o_orderkey", "o_totalprice", "prio")],
    row("raw.column_count", "(SELECT 1 FROM orders LIMIT 1)", o="8", ok="FALSE"), row("raw.columns_match", "(SELECT 1 FROM orders LIMIT 1)", o="0"),
    row("raw.row_count", "orders", n="count(*)", o="count(*)", ok="count(*) >= 1"),
    *[p for z in ("silver", "gold") for p in (
        *[row(f"{z}.exists_{c}", "(SELECT 1 FROM orders LIMIT 1)") for c in ("o_orderkey", "o_totalprice", "prio")],
        checked(f"{z}.type_o_orderkey", NULLABLE, "o_orderkey IS NOT NULL", "FALSE"), checked(f"{z}.type_o_totalprice", NULLABLE, "o_totalprice IS NOT NULL", "FALSE"),
        checked(f"{z}.type_prio", NULLABLE, "prio IS NOT NULL", "FALSE"),
        checked(f"{z}.required_o_orderkey", NULLABLE, "TRUE", "o_orderkey IS NULL"), checked(f"{z}.required_prio", NULLABLE, "TRUE", "prio IS NULL"))],
    checked("gold.price", NULLABLE, "o_totalprice IS NOT NULL", "o_totalprice < 1000")) + ") SELECT * FROM z")
def dq_33(t):
    out = None
    for z in ("raw", "silver", "gold"):
        x = Q.run_suite(nullable(t), Q.zone_suite(z, _SCHEMA, [rule("price", "range", "o_totalprice", min=1000)]))
        x = show(x).withColumn("rule_id", F.concat(F.lit(z + "."), "rule_id"))
        out = x if out is None else out.unionByName(x)
    return out


_KINDS = ["not_null", "unique", "range", "regex", "in_set", "Referential", "row_count", "custom_sql", "freshness", "no_such_rule"]


@query("dq_34", f"""WITH r AS (SELECT p_partkey AS rule_id, ({_KINDS})[p_partkey % 10 + 1] AS rule_type FROM part)
SELECT rule_id, rule_type, CASE lower(rule_type) WHEN 'not_null' THEN 'expect_column_values_to_not_be_null' WHEN 'unique' THEN 'expect_column_values_to_be_unique' WHEN 'range' THEN 'expect_column_values_to_be_between'
 WHEN 'regex' THEN 'expect_column_values_to_match_regex' WHEN 'in_set' THEN 'expect_column_values_to_be_in_set' WHEN 'referential' THEN 'expect_column_pair_values_to_be_in_set' WHEN 'row_count' THEN 'expect_table_row_count_to_be_between'
 WHEN 'custom_sql' THEN 'expect_column_values_to_match_sql_condition' WHEN 'freshness' THEN 'expect_column_max_to_be_between' END AS expectation FROM r""")
def dq_34(t):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    r = t.part.select(F.col("p_partkey").alias("rule_id"), F.element_at(kinds, (F.col("p_partkey") % 10 + 1).cast("int")).alias("rule_type"))
    return r.withColumn("expectation", Q.expectation_of("rule_type"))


@query("dq_35", "WITH " + RES_SQL + f""", bad AS (SELECT DISTINCT rule_id, CASE rule_id WHEN 'q' THEN CAST(l_quantity AS VARCHAR) WHEN 'f' THEN l_returnflag END AS v
  FROM (SELECT *, unnest({_FAILS}) AS rule_id FROM lineitem) WHERE rule_id IN ('q', 'f')),
rk AS (SELECT rule_id, v, row_number() OVER (PARTITION BY rule_id ORDER BY v) AS rn FROM bad),
li AS (SELECT rule_id, '[' || string_agg('"' || v || '"', ',' ORDER BY v) || ']' AS j FROM rk WHERE rn <= 20 GROUP BY rule_id)
SELECT 'F1' AS feed_id, 'gold' AS zone_level, rule_id, CASE WHEN success THEN 'PASS' ELSE 'FAIL' END AS result, CAST(element_count AS BIGINT) AS element_count,
 CAST(unexpected_count AS BIGINT) AS error_count, round(CASE WHEN element_count > 0 THEN unexpected_count / element_count ELSE 0 END, 6) AS error_rate, coalesce(j, '[]') AS partial_unexpected_list
FROM res LEFT JOIN li USING (rule_id)""")
def dq_35(t):
    x = Q.with_partial_lists(Q.result_table(suite(t), "F1", "R1", "gold", "lineitem"), t.lineitem, SUITE)
    return x.select("feed_id", "zone_level", "rule_id", "result", "element_count", "error_count", "error_rate", "partial_unexpected_list")


@query("dq_35_summary", "WITH " + RES_SQL + """
SELECT count(*) AS total_expectations, count(*) FILTER (WHERE success) AS successful_expectations, count(*) FILTER (WHERE NOT success) AS unsuccessful_expectations,
 CAST(sum(unexpected_count) AS BIGINT) AS error_count, CAST(max(element_count) AS BIGINT) AS records_validated,
 round(100.0 * count(*) FILTER (WHERE success) / count(*), 2) AS quality_score, bool_and(success) AS success FROM res""")
def dq_35_summary(t):
    return Q.summary_table(Q.result_table(suite(t), "F1", "R1", "gold", "lineitem")).drop("feed_id", "run_id", "zone_level", "data_asset_name")


@query("dq_36", "WITH " + cat.EXEC_SQL + """,
w AS (SELECT c_custkey AS feed_id, z.zone FROM customer CROSS JOIN (SELECT DISTINCT zone FROM ex) z),
l AS (SELECT feed_id, zone, arg_max(status, (started_at, status)) AS s FROM ex GROUP BY 1, 2)
SELECT w.feed_id, w.zone, CASE WHEN s IS NULL OR s = 'SUCCESS' THEN 'pass' ELSE 'fail' END AS branch FROM w LEFT JOIN l ON w.feed_id = l.feed_id AND w.zone = l.zone""")
def dq_36(t):
    ex = cat.executions(t).select("feed_id", "zone", "status", F.col("started_at").alias("validated_at"))
    wanted = t.customer.select(F.col("c_custkey").alias("feed_id"), F.explode(F.array(*[F.lit(z) for z in ("bronze", "silver", "gold")])).alias("zone"))
    return Q.branch_status(ex, wanted, ["feed_id", "zone"]).select("feed_id", "zone", "branch")


@query("dq_37", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 5 OR l_quantity > 48 OR l_returnflag NOT IN ('A', 'N') OR l_discount > 0.08 OR l_shipdate IS NULL
 THEN 'rejected' ELSE 'valid' END AS side FROM lineitem""")
def dq_37(t):
    good, bad = Q.split_rejected(t.lineitem, _ROWRULES)
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return good.select(*cols, F.lit("valid").alias("side")).unionByName(bad.select(*cols, F.lit("rejected").alias("side")))


@query("dq_38", """
WITH l AS (SELECT 'raw' AS layer, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'bronze', count(*) FROM lineitem WHERE l_quantity > 1
 UNION ALL SELECT 'silver', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT 'gold', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice < 0)
SELECT layer, n_rows, CASE WHEN n_rows > 0 AND NOT (layer = 'silver' AND n_rows > (SELECT n_rows FROM l WHERE layer = 'bronze')) THEN 'PASS' ELSE 'FAIL' END AS status FROM l""")
def dq_38(t):
    return Q.layer_check({"raw": t.lineitem, "bronze": t.lineitem.filter("l_quantity > 1"),
                          "silver": t.lineitem.select("l_orderkey", "l_linenumber").distinct(),
                          "gold": t.orders.filter("o_totalprice < 0").select("o_custkey").distinct()})


@query("dq_39", """
WITH c AS (SELECT p_brand, CASE p_type WHEN 'PROMO' THEN 'SCD2' WHEN 'SMALL' THEN 'DATA_VAULT' WHEN 'LARGE' THEN 'DATA_VAULT' ELSE 'STANDARD' END AS ct, CASE WHEN p_type = 'SMALL' THEN 'hub' ELSE 'satellite' END AS vt,
  p_type, count(*) FILTER (WHERE p_size > 40) AS n FROM part GROUP BY p_brand, p_type)
SELECT p_brand AS feed, ct AS contract_type, p_type, CASE WHEN n > 0 THEN '' WHEN ct = 'SCD2' THEN 'business_keys missing' WHEN ct = 'DATA_VAULT' THEN vt || '_columns missing' ELSE '' END AS violations,
 n > 0 OR ct = 'STANDARD' AS is_valid FROM c""")
def dq_39(t):
    keys = F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("p_size") > 40, F.col("p_size").cast("string")))))
    vault = F.col("p_type").isin("SMALL", "LARGE")
    # column lists of at most ten size codes per dataset
    c = (t.part.select("p_brand", "p_type", F.col("p_size")).distinct().groupBy("p_brand", "p_type").agg(keys.alias("cols"))
         .select(F.col("p_brand").alias("feed"), "p_type",
                 F.when(F.col("p_type") == "PROMO", "SCD2").when(vault, "DATA_VAULT").otherwise("STANDARD").alias("contract_type"),
                 F.when(F.col("p_type") == "SMALL", "hub").otherwise("satellite").alias("vault_type"),
                 F.col("cols").alias("business_keys"), F.col("cols").alias("hub_columns"), F.col("cols").alias("satellite_columns")))
    return Q.contract_check(c).select("feed", "p_type", "contract_type", F.array_join("violations", ",").alias("violations"), "is_valid")
