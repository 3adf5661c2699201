"""Rule-driven data quality.

A suite is a list of rule dicts.  All row-level and table-level rules of a suite are compiled
into one aggregation over the data; only rules that need a grouping or a second table
(uniqueness, references, medians, order) add their own branch.  Result columns: rule_id,
expectation, column_name, element_count, unexpected_count, unexpected_percent, observed,
success, severity, weight.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import all_of, col, null_safe_join
from zonecraft.operators.window import exact_quantile, framed, top_per_group

# Rule names and the expectation each stands for.
EXPECTATIONS = {
    "not_null": "expect_column_values_to_not_be_null",
    "completeness": "expect_column_values_to_not_be_null",
    "unique": "expect_column_values_to_be_unique",
    "range": "expect_column_values_to_be_between",
    "min_max": "expect_column_values_to_be_between",
    "date_range": "expect_column_values_to_be_between",
    "between": "expect_column_values_to_be_between",
    "regex": "expect_column_values_to_match_regex",
    "in_set": "expect_column_values_to_be_in_set",
    "not_in_set": "expect_column_values_to_not_be_in_set",
    "length": "expect_column_value_lengths_to_be_between",
    "value_length": "expect_column_value_lengths_to_be_between",
    "row_count": "expect_table_row_count_to_be_between",
    "custom_sql": "expect_column_values_to_match_sql_condition",
    "sql": "expect_column_values_to_match_sql_condition",
    "freshness": "expect_column_max_to_be_between",
    "mean": "expect_column_mean_to_be_between",
    "stdev": "expect_column_stdev_to_be_between",
    "median": "expect_column_median_to_be_between",
    "null_rate": "expect_column_null_value_proportion_to_be_between",
    "compound_unique": "expect_compound_columns_to_be_unique",
    "primary_key": "expect_compound_columns_to_be_unique",
    "increasing": "expect_column_values_to_be_increasing",
    "column_exists": "expect_column_to_exist",
    "column_count": "expect_table_column_count_to_equal",
    "columns_match": "expect_table_columns_to_match_set",
    "columns_ordered": "expect_table_columns_to_match_ordered_list",
    "column_type": "expect_column_values_to_be_of_type",
    "date_format": "expect_column_values_to_match_strftime_format",
    "distinct_count": "expect_column_distinct_values_to_be_in_set",
    "column_pair_comparison": "expect_column_pair_values_A_to_be_greater_than_B",
    "referential": "expect_column_pair_values_to_be_in_set",
    "pair_in_set": "expect_column_pair_values_to_be_in_set",
    "reference": "expect_column_values_to_be_in_set",
    "conditional_not_null": "expect_column_values_to_match_sql_condition",
}


def expectation_of(rule_type) -> Column:
    """The expectation a rule type stands for, null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTATIONS.items() for x in kv]), F.lower(col(rule_type)))


ROW_RULES = {"not_null", "completeness", "null_rate", "range", "min_max", "date_range", "between", "regex", "in_set",
             "not_in_set", "length", "value_length", "custom_sql", "sql", "column_type", "date_format",
             "column_pair_comparison", "referential", "pair_in_set", "conditional_not_null"}
STATIC_RULES = {"column_exists", "column_count", "columns_match", "columns_ordered"}
STAT_RULES = {"row_count", "freshness", "mean", "stdev"}

RESULT = ("rule_id string, expectation string, column_name string, element_count bigint, unexpected_count bigint, "
          "unexpected_percent double, observed double, success boolean, severity string, weight double")


@dataclass(frozen=True)
class RowCheck:
    """`considered` rows are the denominator; a row fails when considered and not `ok`."""

    considered: Column
    ok: Column

    @property
    def failed(self) -> Column:
        return self.considered & ~F.coalesce(self.ok, F.lit(False))


def bound(rule: dict, side: str):
    """A bound under either spelling; zero is a bound."""
    v = rule.get(side)
    return rule.get(f"{side}_value") if v is None else v


def in_bounds(x: Column, rule: dict) -> Column:
    lo, hi = bound(rule, "min"), bound(rule, "max")
    tests = []
    if lo is not None:
        tests.append((x > F.lit(lo)) if rule.get("strict") else (x >= F.lit(lo)))
    if hi is not None:
        tests.append((x < F.lit(hi)) if rule.get("strict") else (x <= F.lit(hi)))
    return all_of(tests)


_PAIR = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
         "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def row_check(rule: dict) -> RowCheck:
    kind = rule["rule_type"]
    every = F.lit(True)
    if kind in ("custom_sql", "sql"):
        return RowCheck(every, F.expr(rule["condition"]))
    if kind == "conditional_not_null":
        return RowCheck(F.coalesce(F.expr(rule["when"]), F.lit(False)), F.col(rule["column"]).isNotNull())
    if kind == "column_pair_comparison":
        a, b = F.col(rule["column"]), F.col(rule["other"])
        return RowCheck(a.isNotNull() & b.isNotNull(), _PAIR[rule.get("op", ">")](a, b))
    if kind in ("pair_in_set", "referential"):
        a, b = F.col(rule["column"]), F.col(rule["other"])
        pairs = [(a == F.lit(x)) & (b == F.lit(y)) for x, y in rule["values"]]
        ok = F.lit(False)
        for p in pairs:
            ok = ok | p
        return RowCheck(a.isNotNull() & b.isNotNull(), ok)
    x = F.col(rule["column"])
    if kind in ("not_null", "completeness", "null_rate"):
        return RowCheck(every, x.isNotNull())
    considered = every if rule.get("null_policy") == "fail" else x.isNotNull()
    if kind in ("range", "min_max", "date_range", "between"):
        ok = in_bounds(x, rule)
    elif kind == "regex":
        ok = x.cast("string").rlike(rule["pattern"])
    elif kind == "in_set":
        ok = x.isin(*rule["values"])
    elif kind == "not_in_set":
        ok = ~x.isin(*rule["values"])
    elif kind in ("length", "value_length"):
        ok = in_bounds(F.length(x.cast("string")), rule)
    elif kind == "column_type":
        ok = x.cast("string").try_cast(rule["type"]).isNotNull()
    elif kind == "date_format":
        ok = F.try_to_timestamp(x.cast("string"), F.lit(rule["format"])).isNotNull()
    else:
        raise ValueError(kind)
    return RowCheck(considered, ok)


def allowed_percent(rule: dict) -> float:
    """Share of failing rows a rule tolerates: `max_fail_pct`, `mostly` or a null proportion."""
    if rule.get("max_fail_pct") is not None:
        return float(rule["max_fail_pct"])
    if rule["rule_type"] == "null_rate":
        return 100.0 * float(bound(rule, "max") or 0.0)
    return 100.0 * (1.0 - float(rule.get("mostly", 1.0)))


def known_rules(rules) -> list[dict]:
    """Rules with an expectation; others are reported and skipped.  Each gets an id."""
    out = []
    for i, r in enumerate(rules):
        if r["rule_type"] not in EXPECTATIONS:
            warnings.warn(f"unknown rule type {r['rule_type']}", stacklevel=2)
            continue
        out.append({**r, "rule_id": r.get("rule_id", f"rule_{i + 1}")})
    return out


def _label(rule: dict) -> str:
    cols = rule.get("columns") or [rule.get("column")]
    return ",".join(c for c in cols if c) or "N/A"


def _result(rule: dict, elements: Column, bad: Column, observed: Column, success: Column) -> Column:
    pct = F.when(elements > 0, F.lit(100.0) * bad / elements).otherwise(F.lit(0.0))
    return F.struct(
        F.lit(rule["rule_id"]).alias("rule_id"), F.lit(EXPECTATIONS[rule["rule_type"]]).alias("expectation"),
        F.lit(_label(rule)).alias("column_name"), elements.cast("bigint").alias("element_count"),
        bad.cast("bigint").alias("unexpected_count"), pct.cast("double").alias("unexpected_percent"),
        observed.cast("double").alias("observed"), F.coalesce(success, F.lit(False)).alias("success"),
        F.lit(rule.get("severity", "ERROR")).alias("severity"), F.lit(float(rule.get("weight", 1))).alias("weight"))


def _tolerated(rule: dict, elements: Column, bad: Column) -> Column:
    return bad * F.lit(100.0) <= elements * F.lit(allowed_percent(rule) + 1e-9)


def _one_pass(df: DataFrame, rule: dict, i: int):
    """Aggregate columns of a rule and the result built from them."""
    kind = rule["rule_type"]
    zero, none = F.lit(0), F.lit(None).cast("double")
    if kind in ROW_RULES:
        c = row_check(rule)
        aggs = [F.count_if(c.considered).alias(f"n{i}"), F.count_if(c.failed).alias(f"u{i}")]
        n, u = F.col(f"n{i}"), F.col(f"u{i}")
        return aggs, _result(rule, n, u, none, _tolerated(rule, n, u))
    if kind in STATIC_RULES:
        have = df.columns
        if kind == "column_exists":
            obs, ok = None, rule["column"] in have
        elif kind == "column_count":
            obs, ok = float(len(have)), len(have) == rule["value"]
        elif kind == "columns_match":
            missing = [c for c in rule["columns"] if c not in have]
            obs, ok = float(len(missing)), not missing and (not rule.get("exact") or len(have) == len(rule["columns"]))
        else:
            obs, ok = None, have == list(rule["columns"])
        return [], _result(rule, zero, zero, F.lit(obs).cast("double"), F.lit(ok))
    if kind == "row_count":
        return [F.count(F.lit(1)).alias(f"o{i}")], _result(rule, F.col(f"o{i}"), zero, F.col(f"o{i}"), in_bounds(F.col(f"o{i}"), rule))
    x = rule["column"]
    if kind == "freshness":
        top = F.col(f"o{i}")
        shown = F.lit(None).cast("double")
        simple = df.schema[x].dataType.simpleString()
        if not simple.startswith(("timestamp", "date", "string")):
            shown = top.cast("double")
        return ([F.max(x).alias(f"o{i}"), F.count(x).alias(f"n{i}")],
                _result(rule, F.col(f"n{i}"), zero, shown, in_bounds(top, rule)))
    f = F.avg if kind == "mean" else F.stddev_samp
    return ([f(x).alias(f"o{i}"), F.count(x).alias(f"n{i}")],
            _result(rule, F.col(f"n{i}"), zero, F.col(f"o{i}"), in_bounds(F.col(f"o{i}"), rule)))


def _expand(df: DataFrame, results) -> DataFrame:
    return df.select(F.inline(F.array(*results)))


def duplicate_counts(df: DataFrame, columns) -> DataFrame:
    """One row: total, dup_rows (rows in repeated groups) and excess_rows (total - distinct).
    Groups are combined map-side, so a hot value costs no more than a rare one."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
                 F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("dup_rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("excess_rows"),
                 F.count_if(F.col("_n") > 1).alias("dup_groups"))


def _branch(df: DataFrame, rule: dict, refs: dict) -> DataFrame:
    kind = rule["rule_type"]
    none = F.lit(None).cast("double")
    if kind in ("unique", "compound_unique", "primary_key"):
        cols = rule.get("columns") or [rule["column"]]
        usable = df if kind == "primary_key" else df.filter(all_of([F.col(c).isNotNull() for c in cols]))
        d = duplicate_counts(usable.select(*cols), cols)
        bad = F.col("dup_rows")
        if kind == "primary_key":  # missing key parts are failures too, counted once per row
            any_null = ~all_of([F.col(c).isNotNull() for c in cols])
            g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", any_null)
            d = g.agg(F.sum("_n").alias("total"), F.sum(F.when((F.col("_n") > 1) | F.col("_null"), F.col("_n")).otherwise(0)).alias("dup_rows"),
                      F.sum(F.col("_n") - 1).alias("excess_rows"))
        return _expand(d, [_result(rule, F.col("total"), bad, F.col("excess_rows"), _tolerated(rule, F.col("total"), bad))])
    if kind == "median":
        x = rule["column"]
        m = exact_quantile(df.select(x), [], x, 0.5, "_m")
        n = df.agg(F.count(x).alias("_n"))
        return _expand(m.crossJoin(n), [_result(rule, F.col("_n"), F.lit(0), F.col("_m"), in_bounds(F.col("_m"), rule))])  # one row each
    if kind == "increasing":
        x, order = rule["column"], rule["order_by"]
        y = framed(df.select(*{x, *order, *rule.get("partition_by", [])}), rule.get("partition_by", []), order, F.expr(rule["bucket"]), 1, 0,
                   {"_prev": lambda w: F.lag(x).over(w)})
        ok = F.col(x) >= F.col("_prev") if rule.get("allow_equal") else F.col(x) > F.col("_prev")
        a = y.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_prev").isNotNull() & ~ok).alias("u"))
        return _expand(a, [_result(rule, F.col("n"), F.col("u"), none, _tolerated(rule, F.col("n"), F.col("u")))])
    if kind == "distinct_count":
        x = F.col(rule["column"])
        g = df.filter(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        outside = ~F.col("_v").isin(*rule["values"])
        a = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("u"))
        return _expand(a, [_result(rule, F.col("n"), F.col("u"), F.col("n"), F.col("u") == 0)])
    if kind == "reference":
        x = rule["column"]
        ref = refs[rule["table"]].select(F.col(rule["ref_column"]).alias("_ref")).distinct()
        per = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
        j = per.join(ref, F.col(x) == F.col("_ref"), "left")
        a = j.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
                  F.coalesce(F.sum(F.when(F.col("_ref").isNull(), F.col("_n"))), F.lit(0)).alias("u"))
        return _expand(a, [_result(rule, F.col("n"), F.col("u"), none, _tolerated(rule, F.col("n"), F.col("u")))])
    raise ValueError(kind)


def run_suite(df: DataFrame, rules, refs: dict | None = None) -> DataFrame:
    """Result rows of a suite; `refs` names reference tables for `reference` rules."""
    aggs, results, branches = [], [], []
    for i, rule in enumerate(known_rules(rules)):
        if rule["rule_type"] in ROW_RULES | STATIC_RULES | STAT_RULES:
            a, r = _one_pass(df, rule, i)
            aggs += a
            results.append(r)
        else:
            branches.append(_branch(df, rule, refs or {}))
    out = None
    if results:
        out = _expand(df.agg(*(aggs or [F.count(F.lit(1)).alias("n")])), results)
    for b in branches:
        out = b if out is None else out.unionByName(b)
    return out


def primary_key_rules(columns) -> list[dict]:
    """Implicit key checks: every part not null, the whole unique; double weight."""
    parts = [{"rule_type": "not_null", "column": c, "rule_id": f"pk_not_null_{c}", "weight": 2} for c in columns]
    return parts + [{"rule_type": "primary_key", "columns": list(columns), "rule_id": "pk_unique", "weight": 2}]


def zone_suite(zone: str, schema, rules=()) -> list[dict]:
    """Rules of a zone profile: transient none; raw structure; silver types and nulls; gold all."""
    if zone == "transient":
        return []
    names = [c["name"] for c in schema]
    exist = [{"rule_type": "column_exists", "column": n, "rule_id": f"exists_{n}"} for n in names]
    if zone == "raw":
        return exist + [{"rule_type": "column_count", "value": len(names), "rule_id": "column_count"},
                        {"rule_type": "columns_match", "columns": names, "rule_id": "columns_match"},
                        {"rule_type": "row_count", "min": 1, "rule_id": "row_count"}]
    typed = [{"rule_type": "column_type", "column": c["name"], "type": c["type"], "rule_id": f"type_{c['name']}"}
             for c in schema if c.get("type")]
    required = [{"rule_type": "not_null", "column": c["name"], "rule_id": f"required_{c['name']}"}
                for c in schema if not c.get("nullable", True)]
    return exist + typed + required + (list(rules) if zone not in ("silver",) else [])


def failed_codes(rules) -> Column:
    """Array of the row-level rules a row breaks."""
    return F.array_compact(F.array(*[F.when(row_check(r).failed, F.lit(r["rule_id"])) for r in known_rules(rules)]))


def split_rejected(df: DataFrame, rules, execution_id: str = "", source_file: Column | None = None):
    """(valid rows, rejected rows with reasons).  Rules are evaluated once per row."""
    rules = known_rules(rules)
    marked = df.withColumn("_rejection_codes", failed_codes(rules))
    why = {r["rule_id"]: f"{r['rule_type']} on {_label(r)}" for r in rules}
    reason = F.transform("_rejection_codes", lambda c: F.element_at(F.create_map(*[F.lit(v) for kv in why.items() for v in kv]), c))
    good = marked.filter(F.size("_rejection_codes") == 0).drop("_rejection_codes")
    extra = {"_rejection_reason": F.array_join(reason, "; "), "_rejected_at": F.current_timestamp(),
             "_execution_id": F.lit(execution_id)}
    if source_file is not None:
        extra["_source_file"] = source_file
    return good, marked.filter(F.size("_rejection_codes") > 0).withColumns(extra)


def failing_samples(df: DataFrame, rules, keys, per_rule: int = 10) -> DataFrame:
    """First failing rows per rule in key order."""
    x = df.withColumn("rule_id", F.explode(failed_codes(rules)))
    return top_per_group(x, ["rule_id"], list(keys), per_rule)


def verdict(results: DataFrame, by=(), fail_on_warning: bool = False) -> DataFrame:
    """Blocking and warning failures and the overall status."""
    failed = ~F.col("success")
    warn = F.upper("severity").isin("WARNING", "INFO")
    r = results.groupBy(*by).agg(F.count_if(failed & ~warn).alias("blocking_failures"),
                                 F.count_if(failed & warn).alias("warning_failures"))
    bad = F.col("blocking_failures") > 0
    if fail_on_warning:
        bad = bad | (F.col("warning_failures") > 0)
    return r.withColumn("status", F.when(bad, "FAIL").when(F.col("warning_failures") > 0, "WARN").otherwise("PASS"))


def plain_score(results: DataFrame, by=()) -> DataFrame:
    return results.groupBy(*by).agg((F.lit(100.0) * F.count_if(F.col("success")) / F.count(F.lit(1))).alias("score"))


def weighted_score(results: DataFrame, by=()) -> DataFrame:
    """Weighted share with partial credit of a failed rule for its passing rows."""
    credit = F.when(F.col("success"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("unexpected_percent") / 100))
    w = F.sum("weight")
    return results.groupBy(*by).agg(
        F.round(F.when(w == 0, F.lit(100.0)).otherwise(100 * F.sum(F.col("weight") * credit) / F.when(w != 0, w)), 2).alias("score"))


# Quality dimensions with their weight, and the lower bound of each grade.
DIMENSIONS = {"completeness": 0.25, "uniqueness": 0.20, "validity": 0.25, "consistency": 0.15, "freshness": 0.15}
GRADES = [(0.95, "A"), (0.85, "B"), (0.75, "C"), (0.65, "D")]


def grade(score) -> Column:
    out = None
    for lo, g in GRADES:
        out = F.when(col(score) >= lo, g) if out is None else out.when(col(score) >= lo, g)
    return out.otherwise("F")


def dimension_of(expectation) -> Column:
    e = col(expectation)
    return (F.when(e.contains("unique"), "uniqueness").when(e.contains("null"), "completeness")
            .when(e.contains("max_to_be"), "freshness").when(e.contains("pair") | e.contains("row_count"), "consistency")
            .otherwise("validity"))


def dimension_scores(results: DataFrame, by=()) -> DataFrame:
    """Average passed share per dimension (1 where untested), weighted overall and grade."""
    share = F.when(F.col("success") & (F.col("element_count") == 0), F.lit(1.0)).when(
        F.col("element_count") == 0, F.lit(0.0)).otherwise(1 - F.col("unexpected_percent") / 100)
    x = results.withColumns({"_d": dimension_of("expectation"), "_s": share})
    per = x.groupBy(*by).agg(*[F.coalesce(F.avg(F.when(F.col("_d") == d, F.col("_s"))), F.lit(1.0)).alias(d) for d in DIMENSIONS])
    overall = sum((F.col(d) * w for d, w in DIMENSIONS.items()), F.lit(0.0))
    return per.withColumn("overall", overall).withColumn("grade", grade("overall"))


def result_table(results: DataFrame, feed_id: str, run_id: str, zone: str, asset: str) -> DataFrame:
    """Stored form of result rows."""
    return results.select(
        F.lit(feed_id).alias("feed_id"), F.lit(run_id).alias("run_id"), F.lit(zone).alias("zone_level"),
        F.lit(asset).alias("data_asset_name"), "rule_id", "column_name", F.col("expectation").alias("expectation_type"),
        F.when(F.col("success"), "PASS").otherwise("FAIL").alias("result"), "element_count",
        F.col("unexpected_count").alias("error_count"),
        F.round(F.when(F.col("element_count") > 0, F.col("unexpected_count") / F.col("element_count")).otherwise(0.0), 6).alias("error_rate"),
        "severity", "weight")


def with_partial_lists(table: DataFrame, df: DataFrame, rules, size: int = 20) -> DataFrame:
    """Add up to `size` distinct failing values per single-column row rule, smallest first, as JSON."""
    rules = [r for r in known_rules(rules) if r["rule_type"] in ROW_RULES and r.get("column")]
    pairs = F.array_compact(F.array(*[
        F.when(row_check(r).failed, F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.col(r["column"]).cast("string").alias("v"))) for r in rules]))
    bad = df.select(F.inline(pairs)).distinct()
    lists = (top_per_group(bad, ["rule_id"], ["v"], size).groupBy("rule_id")
             .agg(F.to_json(F.array_sort(F.collect_list("v"))).alias("partial_unexpected_list")))
    return (table.join(lists, "rule_id", "left")
            .withColumn("partial_unexpected_list", F.coalesce("partial_unexpected_list", F.lit("[]"))))


def summary_table(table: DataFrame) -> DataFrame:
    ok = F.col("result") == "PASS"
    return (table.groupBy("feed_id", "run_id", "zone_level", "data_asset_name")
            .agg(F.count(F.lit(1)).alias("total_expectations"), F.count_if(ok).alias("successful_expectations"),
                 F.count_if(~ok).alias("unsuccessful_expectations"), F.sum("error_count").alias("error_count"),
                 F.max("element_count").alias("records_validated"),
                 F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 2).alias("quality_score"),
                 F.bool_and(ok).alias("success")))


def branch_status(results: DataFrame, wanted: DataFrame, keys=("feed_id", "run_id", "zone")) -> DataFrame:
    """pass / fail of the newest stored result per key; a missing result passes."""
    last = results.groupBy(*keys).agg(F.max_by("status", F.struct("validated_at", "status")).alias("_s"))
    j = null_safe_join(wanted, last, list(keys), "left")
    good = F.lower("_s").isin("pass", "success", "true")
    return j.withColumn("branch", F.when(F.col("_s").isNull() | good, "pass").otherwise("fail")).drop("_s")


def reconcile_counts(source: DataFrame, target: DataFrame, max_loss_pct: float = 5.0) -> DataFrame:
    """Row counts of source and target; more than the tolerated loss is an error."""
    s = source.agg(F.count(F.lit(1)).alias("source_count"))
    t = target.agg(F.count(F.lit(1)).alias("target_count"))
    loss = F.when(F.col("source_count") > 0, 100.0 * (F.col("source_count") - F.col("target_count")) / F.col("source_count")).otherwise(0.0)
    return (s.crossJoin(t).withColumn("loss_pct", F.round(loss, 4))  # one row each
            .withColumn("status", F.when(loss > max_loss_pct, "error").otherwise("ok")))


def layer_check(layers: dict[str, DataFrame], order=("bronze", "silver")) -> DataFrame:
    """Every layer must have rows; the second layer of `order` no more than the first."""
    out = None
    for name, df in layers.items():
        x = df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n_rows"))
        out = x if out is None else out.unionByName(x)
    a, b = order
    wide = out.agg(F.max(F.when(F.col("layer") == a, F.col("n_rows"))).alias("_a"))
    ok = F.col("n_rows") > 0
    checked = out.crossJoin(wide)  # one row per layer against one row
    return checked.select("layer", "n_rows", F.when(ok & ~((F.col("layer") == b) & (F.col("n_rows") > F.col("_a"))), "PASS").otherwise("FAIL").alias("status"))


def contract_check(contracts: DataFrame) -> DataFrame:
    """Violations of contract rows: contract_type, business_keys, vault_type, hub_columns, satellite_columns."""
    def empty(c):
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    v = F.array_compact(F.array(
        F.when((F.col("contract_type") == "SCD2") & empty("business_keys"), F.lit("business_keys missing")),
        F.when((F.col("contract_type") == "DATA_VAULT") & (F.col("vault_type") == "hub") & empty("hub_columns"), F.lit("hub_columns missing")),
        F.when((F.col("contract_type") == "DATA_VAULT") & (F.col("vault_type") == "satellite") & empty("satellite_columns"), F.lit("satellite_columns missing"))))
    return contracts.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)
