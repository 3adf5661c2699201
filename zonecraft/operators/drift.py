"""Profiles, drift, schema evolution and metric anomalies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecraft.functions.exprs import any_of, case_map, col, epoch, null_safe_join
from zonecraft.operators.window import framed_arrays, running, top_per_group
from zonecraft.session import cut_lineage

# Type aliases for schema comparison.
TYPE_ALIASES = {
    "int": "integer", "int4": "integer", "int8": "long", "bigint": "long", "smallint": "short", "tinyint": "byte",
    "float": "double", "float4": "float", "float8": "double", "numeric": "decimal", "number": "decimal",
    "str": "string", "varchar": "string", "text": "string", "char": "string", "bool": "boolean",
    "datetime": "timestamp", "datetime2": "timestamp",
}


def normal_type(c) -> Column:
    x = F.lower(F.trim(col(c)))
    base = F.regexp_replace(x, r"\(.*\)$", "")
    return F.coalesce(case_map(base, TYPE_ALIASES), base)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


# -- profiles -------------------------------------------------------------------------------

def part_profiles(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Mergeable profile of every part of a table: a row per value of `by` (a load, a day; or one row), with
    `_rows` and for each column a struct of counts, bounds, mean and squared distance of numbers, and a sketch
    of the distinct values.  One pass, whatever the columns; rows of new parts are appended to the stored ones."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns or [c for c in df.columns if c not in by]:
        x, kind = F.col(f"`{c}`"), df.schema[c].dataType
        number = isinstance(kind, T.NumericType)
        hashed = x if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else x.cast("string")
        aggs.append(F.struct(
            F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.hll_sketch_agg(hashed, F.lit(SKETCH_BITS)).alias("seen"),
            (F.avg(x).cast("double") if number else F.lit(None).cast("double")).alias("mean"),
            (F.var_pop(x).cast("double") * F.count(x) if number else F.lit(None).cast("double")).alias("m2")).alias(c))
    return df.groupBy(*by).agg(*aggs)


def merged_profiles(parts: DataFrame, by=()) -> DataFrame:
    """One profile of the same form per value of `by` from those of its parts, without their rows."""
    names = [f.name for f in parts.schema if f.name != "_rows" and isinstance(f.dataType, T.StructType) and "seen" in f.dataType.names]
    own = lambda c, f: F.col(f"`{c}`.{f}")
    # the mean of all parts first, then the distances of each part's values and of its mean from that
    means = parts.groupBy(*by).agg(*[(F.sum(own(c, "n") * own(c, "mean")) / F.nullif(F.sum(F.when(own(c, "mean").isNotNull(), own(c, "n"))), F.lit(0))).alias(f"_mean_{i}") for i, c in enumerate(names)])
    x = null_safe_join(parts, means, list(by)) if by else parts.crossJoin(F.broadcast(means))  # one row
    aggs = [F.sum("_rows").alias("_rows")]
    for i, c in enumerate(names):
        away = own(c, "mean") - F.col(f"_mean_{i}")
        aggs.append(F.struct(F.coalesce(F.sum(own(c, "n")), F.lit(0)).alias("n"), F.min(own(c, "lo")).alias("lo"), F.max(own(c, "hi")).alias("hi"), F.hll_union_agg(own(c, "seen")).alias("seen"),
                             F.first(f"_mean_{i}", ignorenulls=True).alias("mean"), F.sum(own(c, "m2") + own(c, "n") * away * away).alias("m2")).alias(c))
    return x.groupBy(*by).agg(*aggs)


SKETCH_BITS = 14  # registers of a distinct sketch as a power of two: 1.6 % error in 95 % of cases


def profile_of(parts: DataFrame) -> DataFrame:
    """Counts, distincts, nulls, bounds and type per column from stored profiles of parts."""
    one = merged_profiles(parts)
    total = F.coalesce("_rows", F.lit(0))

    def pct(x):
        return F.when(total > 0, 100.0 * x / total).otherwise(F.lit(0.0))

    rows = []
    for f in one.schema:
        if f.name != "_rows":
            n, seen = F.col(f"`{f.name}`.n"), F.coalesce(F.hll_sketch_estimate(f"`{f.name}`.seen"), F.lit(0))
            distinct = F.least(seen, n)
            rows.append(F.struct(F.lit(f.name).alias("column_name"), total.alias("row_count"), n.alias("non_null"), distinct.alias("distinct_count"), (total - n).alias("null_count"),
                                 pct(total - n).alias("null_pct"), pct(distinct).alias("unique_pct"), F.col(f"`{f.name}`.lo").cast("string").alias("min_value"),
                                 F.col(f"`{f.name}`.hi").cast("string").alias("max_value"), F.lit(f.dataType["lo"].dataType.simpleString()).alias("data_type")))
    return one.select(F.inline(F.array(*rows)))


def distinct_counts(df: DataFrame, columns, by=()) -> DataFrame:
    """(by, column_name, distinct_count), exact: the values of one column after another are grouped, so a row
    is read once per column but is never copied."""
    out = None
    for c in columns:
        x = df.select(*by, F.col(f"`{c}`").alias("_v")).distinct().groupBy(*by).agg(F.lit(c).alias("column_name"), F.count("_v").alias("distinct_count"))
        out = x if out is None else out.unionByName(x)
    return out


def profile(df: DataFrame, columns=None, exact: bool = False) -> DataFrame:
    """Counts, distincts, nulls, bounds and type per column.

    One pass with sketches of the distinct values (SKETCH_BITS); `exact` counts them in a pass per column."""
    cols = list(columns or df.columns)
    out = profile_of(part_profiles(df.select(*cols), cols))
    if not exact:
        return out
    counts = distinct_counts(df, cols).withColumnRenamed("distinct_count", "_distinct")
    share = F.when(F.col("row_count") > 0, 100.0 * F.col("_distinct") / F.col("row_count")).otherwise(F.lit(0.0))
    return out.join(counts, "column_name").withColumns({"distinct_count": F.col("_distinct"), "unique_pct": share}).drop("_distinct")


def profile_anomalies(current: DataFrame, baseline: DataFrame, row_pct: float = 20.0, null_points: float = 10.0,
                      distinct_pct: float = 50.0) -> DataFrame:
    """Differences between two profiles as rows (anomaly, column_name, severity, change)."""
    c, b = current.alias("c"), baseline.alias("b")
    j = c.join(b, F.col("c.column_name") == F.col("b.column_name"), "left")
    known = F.col("b.column_name").isNotNull()
    rows = F.abs(F.col("c.row_count") - F.col("b.row_count")) * 100.0 / F.when(F.col("b.row_count") > 0, F.col("b.row_count"))
    nulls = F.abs(F.col("c.null_pct") - F.col("b.null_pct"))
    dist = F.abs(F.col("c.distinct_count") - F.col("b.distinct_count")) * 100.0 / F.when(F.col("b.distinct_count") > 0, F.col("b.distinct_count"))

    def row(cond, name, severity, change):
        return F.when(cond, F.struct(F.lit(name).alias("anomaly"), F.col("c.column_name").alias("column_name"),
                                     severity.alias("severity"), change.alias("change")))

    per_col = j.select(F.inline(F.array_compact(F.array(
        row(~known, "NEW_COLUMN", F.lit("INFO"), F.lit(None).cast("double")),
        row(known & (nulls > null_points), "NULL_PERCENTAGE_ANOMALY", F.lit("WARNING"), nulls),
        row(known & (dist > distinct_pct), "CARDINALITY_ANOMALY", F.lit("WARNING"), dist)))))
    table = (j.filter(known).agg(F.max(rows).alias("change")).filter(F.col("change") > row_pct)
             .select(F.lit("ROW_COUNT_ANOMALY").alias("anomaly"), F.lit(None).cast("string").alias("column_name"),
                     F.when(F.col("change") < 50, "WARNING").otherwise("ERROR").alias("severity"), "change"))
    return table.unionByName(per_col)


METRICS = ("mean", "stddev", "min", "max", "distinct")


def stats_of(parts: DataFrame) -> DataFrame:
    """(column_name, metric, value) of the numeric columns from stored profiles of parts, as `numeric_stats`
    gives them but with estimated distinct counts: a baseline that is compared without reading its rows."""
    one, rows = merged_profiles(parts), []
    for f in one.schema:
        if f.name != "_rows" and isinstance(f.dataType["lo"].dataType, T.NumericType):
            x = lambda k: F.col(f"`{f.name}`.{k}")  # noqa: B023,E731
            values = {"mean": x("mean"), "stddev": F.sqrt(x("m2") / F.when(x("n") > 1, x("n") - 1)), "min": x("lo"), "max": x("hi"), "distinct": F.least(F.hll_sketch_estimate(x("seen")), x("n"))}
            rows += [F.struct(F.lit(f.name).alias("column_name"), F.lit(m).alias("metric"), values[m].cast("double").alias("value")) for m in METRICS]
    return one.select(F.inline(F.array(*rows)))


def numeric_stats(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Long-form statistics (column_name, metric, value) of all numeric columns; distinct counts are exact."""
    cols = list(columns or [c for c in numeric_columns(df) if c not in by])
    fns = {"mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*by).agg(*[fns[m](c).cast("double").alias(f"{m}__{i}") for i, c in enumerate(cols) for m in fns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric"), F.col(f"{m}__{i}").alias("value")) for i, c in enumerate(cols) for m in fns]
    counted = distinct_counts(df, cols, by).select(*by, "column_name", F.lit("distinct").alias("metric"), F.col("distinct_count").cast("double").alias("value"))
    return wide.select(*by, F.inline(F.array(*rows))).unionByName(counted)


def severity_of(change: Column, critical: float = 0.5) -> Column:
    return F.when(change < critical, "warning").otherwise("critical")


def statistical_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Relative change of each statistic above the threshold; a statistic that became NULL is
    reported as missing; a zero baseline is skipped."""
    j = null_safe_join(baseline.withColumnRenamed("value", "baseline_value"),
                       current.withColumnRenamed("value", "current_value"), ["column_name", "metric"], "left")
    b, c = F.col("baseline_value"), F.col("current_value")
    change = F.abs((c - b) / F.when(b != 0, b))
    return (j.withColumn("change", change)
            .withColumn("severity", F.when(b.isNotNull() & c.isNull(), "missing").when(change > threshold, severity_of(change)))
            .filter(F.col("severity").isNotNull()))


def volume_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.3) -> DataFrame:
    j = (baseline.agg(F.count(F.lit(1)).alias("baseline_rows"))
         .crossJoin(current.agg(F.count(F.lit(1)).alias("current_rows"))))  # one row each
    b = F.when(F.col("baseline_rows") > 0, F.col("baseline_rows"))
    return (j.withColumn("change", F.abs((F.col("current_rows") - b) / b))
            .withColumn("severity", F.when(F.col("change") > threshold, severity_of(F.col("change")))))


def freshness_drift(df: DataFrame, expected: str, actual: str, minutes: float = 60, critical: float = 180) -> DataFrame:
    delay = (epoch(actual) - epoch(expected)) / 60
    return (df.withColumn("delay_minutes", delay).filter(F.col("delay_minutes") > minutes)
            .withColumn("severity", F.when(F.col("delay_minutes") < critical, "warning").otherwise("critical")))


# -- schemas as tables ----------------------------------------------------------------------

def schema_table(df: DataFrame, dataset: str | None = None) -> DataFrame:
    """Columns of a DataFrame as rows (a table of the schema's own size)."""
    rows = [(dataset, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "dataset string, column_name string, data_type string, nullable boolean")


def schema_diff(old: DataFrame, new: DataFrame, scope=("dataset",)) -> DataFrame:
    """Per column: added | removed | type_changed | none, with both types and nullabilities."""
    keys = [*scope, "column_name"]
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("data_type").alias("old_type"), F.col("nullable").alias("old_nullable"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("data_type").alias("new_type"), F.col("nullable").alias("new_nullable"))
    cond = None
    for k in keys:
        e = F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
        cond = e if cond is None else cond & e
    j = o.join(n, cond, "full_outer")
    change = (F.when(F.col("o_column_name").isNull(), "added").when(F.col("n_column_name").isNull(), "removed")
              .when(normal_type("old_type") != normal_type("new_type"), "type_changed").otherwise("none"))
    return j.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], "old_type", "new_type", "old_nullable",
                    "new_nullable", change.alias("change"))


def schema_drift(diff: DataFrame, scope=("dataset",), many_added: int = 5) -> DataFrame:
    """Counts of changes per dataset and severity."""
    n = {k: F.count_if(F.col("change") == k) for k in ("added", "removed", "type_changed")}
    g = diff.groupBy(*scope).agg(*[v.alias(k) for k, v in n.items()])
    breaking = (F.col("removed") > 0) | (F.col("type_changed") > 0)
    return g.withColumn("severity", F.when(breaking, "critical").when(F.col("added") > many_added, "warning")
                        .when(F.col("added") > 0, "info").otherwise("none"))


def evolution(diff: DataFrame, policy: str = "ADDITIVE") -> DataFrame:
    """Allowed / warning / error per change under STRICT, ADDITIVE or FLEXIBLE; audit columns
    (leading underscore) are ignored."""
    c = F.col("change")
    out = {"STRICT": F.lit("error"), "ADDITIVE": F.when(c == "added", "warning").otherwise("error"), "FLEXIBLE": F.lit("warning")}
    return (diff.filter((c != "none") & ~F.col("column_name").startswith("_"))
            .withColumn("outcome", out.get(policy.upper(), out["ADDITIVE"])))


def evolution_verdict(diff: DataFrame, policy: str = "ADDITIVE", scope=("dataset",)) -> DataFrame:
    e = evolution(diff, policy).groupBy(*scope).agg(F.count_if(F.col("outcome") == "error").alias("errors"),
                                                  F.count_if(F.col("outcome") == "warning").alias("warnings"))
    return e.withColumn("is_valid", F.col("errors") == 0)


def compatibility(diff: DataFrame, scope=("dataset",)) -> DataFrame:
    """Breaking (removed, retyped, nullable tightened) and additive changes per dataset."""
    tight = F.coalesce(F.col("old_nullable") & ~F.col("new_nullable"), F.lit(False))
    g = diff.groupBy(*scope).agg(F.count_if(F.col("change") == "removed").alias("removed"),
                                 F.count_if(F.col("change") == "type_changed").alias("type_changed"),
                                 F.count_if(tight).alias("nullable_tightened"),
                                 F.count_if(F.col("change") == "added").alias("added"))
    return g.withColumn("is_compatible", (F.col("removed") + F.col("type_changed") + F.col("nullable_tightened")) == 0)


def healing(diff: DataFrame, scope=("dataset",)) -> DataFrame:
    """healed when nothing is missing, otherwise manual."""
    g = diff.groupBy(*scope).agg(F.count_if(F.col("change") == "added").alias("new_columns"),
                                 F.count_if(F.col("change") == "removed").alias("missing_columns"))
    return g.withColumns({"healed": F.col("missing_columns") == 0, "manual": F.col("missing_columns") > 0})


# -- metric series --------------------------------------------------------------------------

def rolling_baseline(v: np.ndarray, history: int = 99, trend: int = 10, min_trend: int = 5):
    """Median of the previous `history` values and least-squares slope over the last `trend`
    values (at least `min_trend`), both skipping missing values."""
    past = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(history, np.nan), v]), history)[:len(v)]
    full = ~np.isnan(past).any(axis=1)
    median = np.full(len(v), np.nan)
    median[full] = np.median(past[full], axis=1) if full.any() else np.nan
    for i in np.flatnonzero(~full):
        known = past[i][~np.isnan(past[i])]
        if len(known):
            median[i] = np.median(known)
    y = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(trend - 1, np.nan), v]), trend)
    ok = ~np.isnan(y)
    x, y0 = np.where(ok, np.arange(trend, dtype=float), 0.0), np.where(ok, y, 0.0)
    n = ok.sum(axis=1)
    d = n * (x * x).sum(axis=1) - x.sum(axis=1) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where((n >= min_trend) & (d > 0), (n * (x * y0).sum(axis=1) - x.sum(axis=1) * y0.sum(axis=1)) / d, np.nan)
    return median, slope


def with_baseline(df: DataFrame, keys, order, bucket: Column, value: str, history: int = 99, trend: int = 10,
                  min_trend: int = 5) -> DataFrame:
    """Median of the previous `history` samples and the slope over the last `trend` samples.

    Medians over ordered frames are not built in; they run on numpy arrays in blocks of bounded
    size.  Columns `baseline` and `slope` are NULL where undefined."""
    return framed_arrays(df, keys, order, bucket, max(history, trend), value, lambda v: rolling_baseline(v, history, trend, min_trend), ["baseline", "slope"])


def threshold_confidence(x: Column, threshold: float) -> Column:
    return F.least(F.lit(1.0), 0.7 + 0.3 * (x - threshold) / max(threshold, 0.001))


def classify_metric(df: DataFrame, value: str, threshold: float, warn: float) -> DataFrame:
    """Breach, trend or sudden drop per sample; needs `baseline` and `slope`."""
    x, b, s = F.col(value), F.col("baseline"), F.coalesce(F.col("slope"), F.lit(0.0))
    breach = x >= threshold
    rising = (x >= warn) & (b > 0) & (s > 0.1)
    drop = (b > 1.0) & (x < b * 0.05)
    signal = F.when(breach, "threshold_breach").when(rising, "trend_anomaly").when(drop, "sudden_drop")
    conf = (F.when(breach, threshold_confidence(x, threshold)).when(rising, 0.5 + F.least(F.lit(0.4), s * 2))
            .when(drop, F.lit(0.85)))
    polls = F.when(rising & ~breach, F.floor((F.lit(threshold) - x) / s))
    return df.withColumns({"signal": signal, "confidence": conf, "polls_to_breach": polls.cast("long")})


def correlate(signals: DataFrame, by, confidence: str = "confidence") -> DataFrame:
    """One alert per group: best confidence plus .05 for each further signal, at most .15."""
    g = signals.groupBy(*by).agg(F.count(F.lit(1)).alias("n_signals"), F.max(confidence).alias("_m"),
                                 F.count_if(F.col("signal") == "threshold_breach").alias("breaches"))
    return (g.withColumn("confidence", F.least(F.lit(1.0), F.col("_m") + F.least(F.lit(0.15), 0.05 * (F.col("n_signals") - 1))))
            .withColumn("severity", F.when(F.col("breaches") > 0, "P2").otherwise("P3"))
            .withColumn("kind", F.when(F.col("n_signals") > 1, "multiple").otherwise("single")).drop("_m"))


def suppress_in_buckets(alerts: DataFrame, keys, ts: str, order, minutes: int = 30) -> DataFrame:
    """First alert per key and fixed window."""
    slot = F.floor(epoch(ts) / (60 * minutes)).cast("long")
    return top_per_group(alerts.withColumn("slot", slot), [*keys, "slot"], order, 1)


def suppress_greedy(alerts: DataFrame, keys, ts: str, order, minutes: int = 30) -> DataFrame:
    """Keep an alert when none was kept for its key in the last `minutes`.

    Each alert points to the first later one outside its window.  The kept alerts are those
    reached from the first alert of the key; pointers are doubled every round, so the number
    of rounds is logarithmic in the longest chain and no key is collected into one task."""
    keys, gap = list(keys), 60_000_000 * minutes
    x = alerts.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    x = top_per_group(x, [*keys, "_t"], order, 1)
    seen = x.select(*keys, "_t", F.lit(True).alias("_alert"))
    probes = x.select(*keys, (F.col("_t") + gap).alias("_t"), F.lit(False).alias("_alert"))
    # latest first; at equal times alerts come before the probes that may reach them
    look = running(seen.unionByName(probes), keys, [F.desc("_t"), F.desc("_alert")], -F.floor(F.col("_t") / 60_000_000),
                   _next=("min", F.when(F.col("_alert"), F.col("_t"))))
    jump = cut_lineage(look.filter(~F.col("_alert") & F.col("_next").isNotNull()).select(*keys, (F.col("_t") - gap).alias("_t"), "_next"))
    kept = x.groupBy(*keys).agg(F.min("_t").alias("_t"))
    while True:
        more = null_safe_join(jump, kept, [*keys, "_t"], "left_semi").select(*keys, F.col("_next").alias("_t"))
        kept = cut_lineage(kept.unionByName(more).distinct())
        step = jump.select(*keys, F.col("_t").alias("_from"), F.col("_next").alias("_t"))
        jump = cut_lineage(null_safe_join(step, jump, [*keys, "_t"]).select(*keys, F.col("_from").alias("_t"), "_next"))
        if jump.isEmpty():
            break
    return null_safe_join(x, kept, [*keys, "_t"], "left_semi").drop("_t")


def outside_windows(df: DataFrame, windows: DataFrame, keys, ts: str, row_id, start: str = "win_start", end: str = "win_end") -> DataFrame:
    """Rows not inside any window (bounds included) of their key.

    Window starts and row times form one ordered line per key; a row is inside when the latest
    end among the windows begun so far is not before it.  Linear, whatever the number of windows
    or rows of a key."""
    keys, ids = list(keys), list(row_id)
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(*keys, *ids, t(ts).alias("_t"), F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_kind"))
    marks = windows.select(*keys, t(start).alias("_t"), t(end).alias("_end"), F.lit(0).alias("_kind"))
    line = running(rows.unionByName(marks, allowMissingColumns=True), keys, ["_t", "_kind"], F.floor(F.col("_t") / 60_000_000), _until=("max", "_end"))
    inside = line.filter((F.col("_kind") == 1) & (F.col("_until") >= F.col("_t"))).select(*ids)
    return null_safe_join(df, inside, ids, "left_anti")


# Failure classes with their log signatures and remediation, first match wins.
FAILURES = [
    ("out_of_memory", ["java.lang.OutOfMemoryError", "OOMKilled", "memory exhausted", "GC overhead"], "increase_spark_memory"),
    ("schema_mismatch", ["AnalysisException", "cannot resolve column", "schema mismatch", "field not found"], None),
    ("source_unavailable", ["Connection refused", "Unable to connect", "timeout", "ECONNREFUSED", "host unreachable"], "retry_with_backoff"),
    ("permission_denied", ["Access Denied", "PermissionDenied", "403", "Forbidden", "insufficient privileges"], None),
    ("timeout", ["Task timeout", "execution timeout", "soft_time_limit", "TimedOut"], "increase_timeout"),
    ("data_quality_fail", ["Great Expectations", "expectation_failed", "ValidationError", "quality check failed"], None),
]

# Error classes of job exceptions with their message terms, first match wins.
ERROR_TERMS = [
    ("TRANSIENT_ERROR", ["connection reset", "timeout", "temporary", "retry", "service unavailable", "rate limit"]),
    ("RESOURCE_EXHAUSTED", ["out of memory", "oom", "resource exhausted", "container killed", "executor lost"]),
    ("FILE_NOT_FOUND", ["file not found", "no such file", "path does not exist"]),
    ("SCHEMA_MISMATCH", ["schema mismatch", "column not found", "type mismatch"]),
    ("VALIDATION_FAILED", ["validation failed", "quality check failed", "constraint violated"]),
    ("TIMEOUT", ["timeout", "timed out"]),
]


def _classify(text: Column, table, default: str) -> Column:
    out = None
    for name, terms, *_ in table:
        hit = any_of([text.contains(s) for s in terms])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def failure_class(text) -> Column:
    """Class of a job log; signatures match without regard to case."""
    low = [(n, [s.lower() for s in terms]) for n, terms, _ in FAILURES]
    return _classify(F.lower(col(text)), low, "unknown")


def error_class(message) -> Column:
    return _classify(F.lower(col(message)), ERROR_TERMS, "UNKNOWN")


def remediation_of(failure) -> Column:
    return case_map(col(failure), {n: r for n, _, r in FAILURES if r})


def run_health(runs: DataFrame, by, failed: Column, duration: str, sla: float) -> DataFrame:
    """Counts, breaches, duration spread and healthy / degraded / failing per group."""
    g = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(failed).alias("failed_runs"),
        F.count_if(F.col(duration) > sla).alias("sla_breaches"), F.avg(duration).alias("avg_duration"),
        F.min(duration).alias("_lo"), F.max(duration).alias("_hi"))
    return g.withColumns({
        "high_variance": F.col("_hi") > F.col("_lo") * 3,
        "mostly_late": F.col("sla_breaches") > F.col("runs") / 2,
        "health": F.when(F.col("failed_runs") == 0, "healthy").when(F.col("failed_runs") == F.col("runs"), "failing").otherwise("degraded"),
    }).drop("_lo", "_hi")


def trailing_counts(df: DataFrame, keys, ts: str, row_id, windows, conditions: dict) -> DataFrame:
    """Rows of the key in the last `seconds` up to each row, both ends included.

    `windows` maps a prefix to seconds; `conditions` maps a name to the condition counted; the
    result columns are prefix + name.  A count is the difference of two running counts, read at
    the row's time and before the start of its window, so no key and no window length makes a
    group large.  `row_id` identifies the rows."""
    keys, ids = list(keys), list(row_id)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    flags = {f"_f_{n}": c.cast("long") for n, c in conditions.items()}
    rows = df.select(*keys, t.alias("_t"), F.lit(1).alias("_kind"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in flags.items()])
    # readers: at the row's own time after its peers, and just before each window's first instant
    reads = F.array(F.struct(F.lit(2).alias("_kind"), F.lit("now").alias("_w"), t.alias("_t")),
                    *[F.struct(F.lit(0).alias("_kind"), F.lit(w).alias("_w"), (t - int(sec * 1_000_000)).alias("_t")) for w, sec in windows.items()])
    probes = df.select(*keys, *ids, F.inline(reads))
    line = running(rows.unionByName(probes, allowMissingColumns=True), keys, ["_t", "_kind"], F.floor(F.col("_t") / 60_000_000),
                   **{f"_c_{n}": ("sum", F.coalesce(f"_f_{n}", F.lit(0))) for n in conditions})
    at = line.filter(F.col("_kind") != 1).groupBy(*ids).agg(*[
        F.max(F.when(F.col("_w") == w, F.col(f"_c_{n}"))).alias(f"_{w}_{n}") for w in ["now", *windows] for n in conditions])
    out = null_safe_join(df, at, ids)
    out = out.withColumns({f"{w}{n}": F.col(f"_now_{n}") - F.col(f"_{w}_{n}") for w in windows for n in conditions})
    return out.drop(*[f"_{w}_{n}" for w in ["now", *windows] for n in conditions])


def counter_rates(df: DataFrame, keys, ts: str, row_id, seconds: int, bad: Column, limit: float) -> DataFrame:
    """Events per second over the window, share of bad ones and whether it exceeds the limit."""
    x = trailing_counts(df, keys, ts, row_id, {"_w": seconds}, {"n": F.lit(True), "b": bad})
    ratio = F.col("_wb") / F.col("_wn")
    return x.withColumns({"rate": F.col("_wn") / float(seconds), "error_ratio": ratio, "firing": ratio > limit}).drop("_wn", "_wb")


def sustained(df: DataFrame, keys, ts: str, row_id, seconds: int, condition: Column, name: str = "firing") -> DataFrame:
    """True where the condition held at every sample of a fully covered window."""
    x = trailing_counts(df, keys, ts, row_id, {"_w": seconds}, {"broken": ~F.coalesce(condition, F.lit(False))})
    x = null_safe_join(x, df.groupBy(*keys).agg(F.min(ts).alias("_t0")), list(keys))
    return x.withColumn(name, (F.col("_wbroken") == 0) & (epoch(ts) - seconds >= epoch("_t0"))).drop("_wbroken", "_t0")


def observability_baseline(metrics: DataFrame, keys, day: str, as_of: str, days: int, values: dict) -> DataFrame:
    """Mean (and deviation of `rows`) of each metric over the last `days` days."""
    aggs = [F.avg(c).alias(f"avg_{n}") for n, c in values.items()] + [F.stddev_samp(c).alias(f"sd_{n}") for n, c in values.items()]
    recent = metrics.filter(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days))
    return recent.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("samples"), F.max(day).alias("last_day"))


def all_drifts(*parts: DataFrame) -> DataFrame:
    """Union of drift findings (kind, subject, severity) with a flag for any critical one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flag = out.agg(F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("any_critical"))
    return out.crossJoin(F.broadcast(flag))  # one row
