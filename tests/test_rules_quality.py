"""Rule chains, quality suites, schemas and profiles on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from zonecraft.operators import drift as D
from zonecraft.operators import quality as Q
from zonecraft.operators import rules as R


def test_names_and_edge_values(spark):
    df = spark.createDataFrame([("  JOHN  ",), ("john",), (None,), ("",), ("O'Brien",), ("Ünïcødé",), ("x" * 10_000,)], "v string")
    out = R.apply_rules(df, [{"type": "trim", "sequence_order": 1, "config": {"columns": ["v"]}}, {"type": "uppercase", "sequence_order": 2, "config": {"columns": ["v"]}}])
    assert {r[0] for r in out.collect()} == {"JOHN", None, "", "O'BRIEN", "ÜNÏCØDÉ", "X" * 10_000}
    assert {r[0] for r in R.clean(df).collect()} >= {"JOHN", "john", None} and "" not in {r[0] for r in R.clean(df).collect()}


@pytest.mark.parametrize("text,fmt", [("2024-01-15", "yyyy-MM-dd"), ("01/15/2024", "MM/dd/yyyy"), ("15-Jan-2024", "dd-MMM-yyyy")])
def test_dates(spark, text, fmt):
    df = spark.createDataFrame([(text,), (None,), ("nonsense",)], "d string")
    out = R.apply_rules(df, [{"type": "standardize_date", "config": {"column": "d", "input_format": fmt}}])
    assert [r[0] for r in out.collect()] == [datetime.date(2024, 1, 15), None, None]


def test_chain_order_unknown_inactive_and_custom(spark):
    @R.register_rule("twice_of")
    def twice(df, cfg):
        return df.withColumn("y", F.col(cfg["column"]) * 2)

    df = spark.createDataFrame([(1,)], "x int")
    with pytest.warns(UserWarning, match="unknown rule type nope"):
        out = R.apply_rules(df, [{"type": "nope"}, {"type": "twice_of", "sequence_order": 2, "config": {"column": "x"}},
                                 {"transform_type": "expression", "sequence_order": 1, "config": {"column": "x", "expression": "x + 4"}},
                                 {"type": "filter", "is_active": False, "config": {"condition": "false"}}])
    assert rows(out) == [(5, 10)]


def test_masks(spark):
    df = spark.createDataFrame([("1234567",), ("123",), (None,)], "v string")
    out = R.apply_rules(df, [{"type": "mask", "config": {"column": "v", "keep_last": 4}}])
    assert [r[0] for r in out.collect()] == ["***4567", "***", None]


def test_conditional_split_covers_every_row(spark):
    df = spark.range(20)
    parts = R.split(df, [("small", "id < 5"), ("even", "id % 2 = 0")])
    assert {k: v.count() for k, v in parts.items()} == {"small": 5, "even": 7, "default": 8}


def test_counted(spark):
    df, seen = R.counted(spark.range(7))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7}


def run(df, *rules, **kw):
    return {r.rule_id: r for r in Q.run_suite(df, list(rules), **kw).collect()}


def test_nulls_ranges_and_sets(spark):
    df = spark.createDataFrame([(1, "a", 750), (2, None, 850), (3, "c", 200), (4, "d", 900), (5, None, None), (6, "a", 0)], "id int, s string, score int")
    r = run(df, {"rule_id": "nn", "rule_type": "not_null", "column": "s"}, {"rule_id": "rg", "rule_type": "range", "column": "score", "min": 300, "max": 850},
            {"rule_id": "zero", "rule_type": "range", "column": "score", "min": 0}, {"rule_id": "zmax", "rule_type": "range", "column": "score", "max_value": 0},
            {"rule_id": "set", "rule_type": "in_set", "column": "s", "values": ["a", "c"]},
            {"rule_id": "setf", "rule_type": "in_set", "column": "s", "values": ["a", "c"], "null_policy": "fail"},
            {"rule_id": "ok", "rule_type": "not_null", "column": "s", "mostly": 0.6})
    assert round(r["nn"].unexpected_percent, 2) == 33.33 and not r["nn"].success and r["ok"].success
    assert (r["rg"].element_count, r["rg"].unexpected_count) == (5, 3)       # NULL is not in the denominator
    assert r["zero"].success and r["zmax"].unexpected_count == 4              # a bound of zero counts
    assert (r["set"].element_count, r["set"].unexpected_count, r["setf"].unexpected_count) == (4, 1, 3)


def test_uniqueness_reports_both_counts(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "id int")
    r = run(df, {"rule_id": "u", "rule_type": "unique", "column": "id"}, *Q.primary_key_rules(["id"]))
    assert (r["u"].element_count, r["u"].unexpected_count, r["u"].observed) == (4, 3, 2.0)
    assert r["pk_unique"].unexpected_count == 5 and r["pk_unique"].weight == 2.0 and r["pk_not_null_id"].unexpected_count == 2


def test_references_and_conditions(spark):
    customers = spark.createDataFrame([(1,), (2,)], "cid int")
    orders = spark.createDataFrame([(101, 1, "x"), (102, 2, None), (103, 99, "x"), (104, None, None)], "oid int, cid int, note string")
    r = run(orders, {"rule_id": "fk", "rule_type": "reference", "column": "cid", "table": "c", "ref_column": "cid"},
            {"rule_id": "if", "rule_type": "conditional_not_null", "column": "note", "when": "cid = 2"}, refs={"c": customers})
    assert (r["fk"].element_count, r["fk"].unexpected_count) == (3, 1) and r["if"].unexpected_count == 1


def test_row_rules_share_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    res = Q.run_suite(df, [{"rule_type": "range", "column": "l_quantity", "min": 1}, {"rule_type": "in_set", "column": "l_returnflag", "values": ["A"]},
                           {"rule_type": "regex", "column": "l_linestatus", "pattern": "^[OF]$"}, {"rule_type": "row_count", "min": 1}, {"rule_type": "mean", "column": "l_tax", "max": 1},
                           {"rule_type": "freshness", "column": "l_tax", "max": 1}, {"rule_type": "column_exists", "column": "l_tax"}])
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and len(res.collect()) == 7


def test_unknown_rules_are_skipped(spark):
    with pytest.warns(UserWarning, match="unknown rule type odd"):
        assert Q.run_suite(spark.range(1), [{"rule_type": "odd"}, {"rule_type": "row_count", "min": 1}]).count() == 1
    assert Q.EXPECTATIONS["completeness"] == Q.EXPECTATIONS["not_null"]


def test_empty_table_and_partial_credit(spark):
    e = spark.createDataFrame([], "id int")
    r = run(e, {"rule_id": "n", "rule_type": "not_null", "column": "id"}, {"rule_id": "c", "rule_type": "row_count", "min": 1})
    assert r["n"].success and r["n"].unexpected_percent == 0 and not r["c"].success
    df = spark.createDataFrame([(1,), (None,)], "id int")
    s = Q.run_suite(df, [{"rule_type": "not_null", "column": "id", "weight": 1}, {"rule_type": "row_count", "min": 1, "weight": 3}])
    assert Q.weighted_score(s).first().score == 87.5 and Q.plain_score(s).first().score == 50.0


def test_contracts(spark):
    df = spark.createDataFrame([("SCD2", [], None, None, None), ("SCD2", ["k"], None, None, None), ("DATA_VAULT", None, "hub", None, None), ("STANDARD", None, None, None, None)],
                               "contract_type string, business_keys array<string>, vault_type string, hub_columns array<string>, satellite_columns array<string>")
    assert [r.is_valid for r in Q.contract_check(df).collect()] == [False, True, False, True]


def cols(spark, **types):
    return spark.createDataFrame([("d", k, t, True) for k, t in types.items()], "dataset string, column_name string, data_type string, nullable boolean")


def test_schema_diff_and_policies(spark):
    d = D.schema_diff(cols(spark, a="int", b="varchar(10)", c="double", _x="int"), cols(spark, a="integer", b="string", c="string", n="int"))
    assert {r.column_name: r.change for r in d.collect()} == {"a": "none", "b": "none", "c": "type_changed", "_x": "removed", "n": "added"}
    got = {p: D.evolution_verdict(d, p).first() for p in ("STRICT", "ADDITIVE", "FLEXIBLE")}
    assert [(got[p].errors, got[p].warnings, got[p].is_valid) for p in ("STRICT", "ADDITIVE", "FLEXIBLE")] == [(2, 0, False), (1, 1, False), (0, 2, True)]
    only_new = D.schema_diff(cols(spark, a="int"), cols(spark, a="int", b="int"))
    assert D.evolution_verdict(only_new).first().is_valid and D.healing(only_new).first().healed


@pytest.mark.parametrize("text,want", [
    ("java.lang.OutOfMemoryError: Java heap", "out_of_memory"), ("pod OOMKilled", "out_of_memory"), ("org.apache.spark.sql.AnalysisException: x", "schema_mismatch"),
    ("Access Denied for bucket", "permission_denied"), ("celery soft_time_limit hit", "timeout"), ("Connection refused", "source_unavailable"), ("all fine", "unknown")])
def test_failure_classes(spark, text, want):
    assert spark.range(1).select(D.failure_class(F.lit(text))).first()[0] == want


def test_decimals_take_part_in_drift(spark):
    df = spark.createDataFrame([(1,)], "a int").select(F.lit("1.5").cast("decimal(10,2)").alias("d"), F.lit(1).cast("smallint").alias("s"), F.lit("x").alias("t"))
    assert D.numeric_columns(df) == ["d", "s"]


def test_profile_of_schema_table(spark):
    t = D.schema_table(spark.createDataFrame([(1, "a")], "i int, s string"), "ds")
    assert rows(t) == [("ds", "i", "int", True), ("ds", "s", "string", True)]


def test_stored_profiles_merge(spark):
    """Profiles of parts, stored and merged, against one profile of all rows; no row is copied per column."""
    import random

    from zonecraft.operators import drift as D
    r = random.Random(12)
    data = [(f"d{i % 7}", r.choice([None, *range(900)]), r.choice([None, 1e9 + r.random()]), r.choice([None, "a", "b", "ü"]), None) for i in range(6000)]
    df = spark.createDataFrame(data, "day string, a int, `b.x` double, c string, nothing string")
    cols = ["a", "b.x", "c", "nothing"]
    parts = D.part_profiles(df, cols, by=["day"])
    assert parts.count() == 7
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Scan") == 1
    merged, whole = ({x.column_name: x for x in D.profile_of(p).collect()} for p in (parts, D.part_profiles(df, cols)))
    assert merged == whole and list(merged) == cols
    exact = {x.column_name: x for x in D.profile(df.select("day", "a", "c", "nothing"), exact=True).collect()}
    for c in ("a", "c", "nothing"):
        assert abs(merged[c].distinct_count - exact[c].distinct_count) <= 0.03 * exact[c].distinct_count
        assert [merged[c][k] for k in ("row_count", "non_null", "null_count", "null_pct", "min_value", "max_value", "data_type")] == [exact[c][k] for k in ("row_count", "non_null", "null_count", "null_pct", "min_value", "max_value", "data_type")]
    stats = {(x.column_name, x.metric): x.value for x in D.stats_of(parts).collect()}
    want = {(x.column_name, x.metric): x.value for x in D.numeric_stats(df.withColumnRenamed("b.x", "b"), ["a", "b"]).collect()}
    for (c, m), v in want.items():
        assert stats["b.x" if c == "b" else c, m] == pytest.approx(v, rel=0.03 if m == "distinct" else 1e-6)
    assert D.profile(df.filter("false"), ["a"]).collect()[0].row_count == 0 and D.profile(df.filter("false"), ["a"], exact=True).collect()[0].distinct_count == 0


def test_window_rules_without_a_bucket(spark):
    """Text and function forms against plain windows, with ties."""
    import random

    from pyspark.sql import functions as F

    from zonecraft.operators import rules as R
    r = random.Random(13)
    df = spark.createDataFrame([(i, r.choice(["a", "a", "b", None]), r.randint(0, 9), r.choice([None, 1, 2, 3])) for i in range(200)], "id int, k string, t int, v int")
    for func in ("rank()", "dense_rank()", "row_number()", "sum(v)", "count(v)", "max(v)", "avg(v)", "lag(v, 2)", "ntile(3)"):
        order = ["t DESC", "id"] if func.startswith(("row", "lag", "nt")) else ["t DESC"]
        want = df.withColumn("x", F.expr(f"{func} OVER (PARTITION BY k ORDER BY {', '.join(order)})"))
        got = R.apply_rules(df, [{"type": "window", "config": {"name": "x", "func": func, "partition_by": ["k"], "order_by": order}}])
        assert got.columns == want.columns and sorted((a.id, a.x) for a in got.collect()) == sorted((a.id, a.x) for a in want.collect()), func


def test_lists_of_the_aggregate_rule_come_in_parts(spark):
    from zonecraft.operators import rules as R
    df = spark.createDataFrame([("a", i % 25, i) for i in range(50)] + [("b", None, 1), (None, 7, 2)], "k string, v int, w int")
    cfg = {"group_by": ["k"], "chunk_size": 10, "aggregations": [{"column": "v", "function": "collect_list", "alias": "all"}, {"column": "v", "function": "collect_set", "alias": "set"}, {"column": "w", "function": "max", "alias": "m"}]}
    got = {(x.k, x.part): (x["all"], x["set"], x.m) for x in R.apply_rules(df, [{"type": "aggregate", "config": cfg}]).collect()}
    values = sorted(i % 25 for i in range(50))
    assert got == {**{("a", p): (values[10 * p:10 * p + 10], list(range(10 * p, min(10 * p + 10, 25))), 49) for p in range(5)}, ("b", 0): ([], [], 1), (None, 0): ([7], [7], 2)}
