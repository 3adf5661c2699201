"""Queries for profiling, drift, evolution and observability (DF)."""

from pyspark.sql import functions as F

from zonecraft.functions.exprs import ymd
from zonecraft.operators import drift as D
from zonecraft.plans import catalog as cat
from zonecraft.plans.registry import query
from zonecraft.plans.relational_plans import _stats_sql, slot


def _profile_sql(table, cols, total="count(*)"):
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count,
 round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, round(100.0 * count(DISTINCT {c}) / count(*), 4) AS unique_pct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, '{ty}' AS data_type FROM {table}"""
                              for c, ty in cols)


_OCOLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("prio", "string")]


def _prio(t):
    return t.orders.withColumn("prio", F.when(F.col("o_totalprice") >= 40000, F.col("o_orderpriority")))


@query("df_1", _profile_sql("(SELECT *, CASE WHEN o_totalprice >= 40000 THEN o_orderpriority END AS prio FROM orders)", _OCOLS))
def df_1(t):
    x = D.profile(_prio(t), [c for c, _ in _OCOLS], exact=True)
    return x.withColumns({"null_pct": F.round("null_pct", 4), "unique_pct": F.round("unique_pct", 4)})


@query("df_2", """
WITH b AS (SELECT *, o_orderpriority AS prio FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), c AS (SELECT *, CASE WHEN o_totalprice >= 150000 THEN o_orderpriority END AS prio, o_custkey AS fresh FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
n AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc),
d AS (SELECT 'o_orderkey' AS col, (SELECT count(DISTINCT o_orderkey) FROM b) AS db, (SELECT count(DISTINCT o_orderkey) FROM c) AS dc UNION ALL SELECT 'o_custkey', (SELECT count(DISTINCT o_custkey) FROM b), (SELECT count(DISTINCT o_custkey) FROM c)
 UNION ALL SELECT 'prio', (SELECT count(DISTINCT prio) FROM b), (SELECT count(DISTINCT prio) FROM c))
SELECT * FROM (SELECT 'ROW_COUNT_ANOMALY' AS anomaly, NULL AS column_name, CASE WHEN abs(nc - nb) * 100.0 / nb < 50 THEN 'WARNING' ELSE 'ERROR' END AS severity, round(abs(nc - nb) * 100.0 / nb, 4) AS change FROM n WHERE abs(nc - nb) * 100.0 / nb > 20)
UNION ALL SELECT 'CARDINALITY_ANOMALY', col, 'WARNING', round(abs(dc - db) * 100.0 / db, 4) FROM d WHERE abs(dc - db) * 100.0 / db > 50
UNION ALL SELECT 'NULL_PERCENTAGE_ANOMALY', 'prio', 'WARNING', round(100.0 * count(*) FILTER (WHERE prio IS NULL) / count(*), 4) FROM c HAVING 100.0 * count(*) FILTER (WHERE prio IS NULL) / count(*) > 10
UNION ALL SELECT 'NEW_COLUMN', 'fresh', 'INFO', NULL""")
def df_2(t):
    cols = ["o_orderkey", "o_custkey", "prio"]
    b = t.orders.filter("o_orderdate < timestamp_ntz'1998-01-01'").withColumn("prio", F.col("o_orderpriority"))
    c = t.orders.filter("o_orderdate >= timestamp_ntz'1998-01-01'").withColumns({"prio": F.when(F.col("o_totalprice") >= 150000, F.col("o_orderpriority")), "fresh": F.col("o_custkey")})
    x = D.profile_anomalies(D.profile(c, [*cols, "fresh"], exact=True), D.profile(b, cols, exact=True))
    return x.withColumn("change", F.round("change", 4))


@query("df_3", _stats_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def df_3(t):
    return D.numeric_stats(t.part).withColumn("value", F.round("value", 4))


_B, _C = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')", "(SELECT *, CASE WHEN l_tax >= 0 THEN NULL ELSE l_tax END AS gone FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')"
_SC = ["l_quantity", "l_extendedprice", "l_orderkey"]


def _split(t):
    li = t.lineitem
    return li.filter("l_shipdate < timestamp_ntz'1997-01-01'"), li.filter("l_shipdate >= timestamp_ntz'1997-01-01'")


_DRIFT4 = f"""b AS ({_stats_sql(_B, _SC)}), c AS ({_stats_sql(_C, _SC)}),
s AS (SELECT b.column_name, b.metric, b.value AS bv, c.value AS cv, abs((c.value - b.value) / nullif(b.value, 0)) AS ch FROM b JOIN c ON b.column_name = c.column_name AND b.metric = c.metric)"""


@query("df_4", f"""WITH {_DRIFT4}, m AS (SELECT round(CAST(v AS DOUBLE), 4) AS bv, metric FROM (SELECT unnest(['mean', 'stddev', 'max', 'distinct']) AS metric, unnest([avg(l_tax), stddev_samp(l_tax), max(l_tax), count(DISTINCT l_tax)]) AS v FROM {_B}))
SELECT column_name, metric, bv AS baseline_value, cv AS current_value, round(ch, 4) AS change, CASE WHEN ch < 0.5 THEN 'warning' ELSE 'critical' END AS severity FROM s WHERE ch > 0.2
UNION ALL SELECT 'l_tax', metric, bv, CASE WHEN metric = 'distinct' THEN 0.0 END, CASE WHEN metric = 'distinct' THEN 1.0 END, CASE WHEN metric = 'distinct' THEN 'critical' ELSE 'missing' END FROM m
UNION ALL SELECT 'l_tax', 'min', round(min(l_tax), 4), NULL, NULL, 'missing' FROM {_B}""")
def df_4(t):
    b, c = _split(t)
    c = c.withColumn("l_tax", F.when(F.col("l_tax") < 0, F.col("l_tax")))
    r = lambda x: x.withColumn("value", F.round("value", 4))
    x = D.statistical_drift(r(D.numeric_stats(b, [*_SC, "l_tax"])), r(D.numeric_stats(c, [*_SC, "l_tax"])))
    return x.select("column_name", "metric", "baseline_value", "current_value", F.round("change", 4).alias("change"), "severity")


@query("df_5", f"""WITH n AS (SELECT (SELECT count(*) FROM {_B}) AS b, (SELECT count(*) FROM {_C}) AS c)
SELECT b AS baseline_rows, c AS current_rows, round(abs((c - b) / b), 4) AS change, CASE WHEN abs((c - b) / b) > 0.3 THEN CASE WHEN abs((c - b) / b) < 0.5 THEN 'warning' ELSE 'critical' END END AS severity FROM n""")
def df_5(t):
    return D.volume_drift(*_split(t)).withColumn("change", F.round("change", 4))


@query("df_6", """SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7, 3) AS delay_minutes, CASE WHEN (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7 < 180 THEN 'warning' ELSE 'critical' END AS severity
FROM events WHERE (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7 > 60""")
def df_6(t):
    x = D.freshness_drift(t.events.withColumn("expected", F.date_trunc("day", "ts")), "expected", "ts")
    return x.select("event_id", F.round("delay_minutes", 3).alias("delay_minutes"), "severity")


_NORM = "CASE data_type WHEN 'int' THEN 'integer' WHEN 'varchar' THEN 'string' ELSE data_type END"
DIFF_SQL = cat.COLUMNS_SQL + f""", df AS (SELECT coalesce(o.dataset, n.dataset) AS dataset, coalesce(o.column_name, n.column_name) AS column_name, o.data_type AS old_type, n.data_type AS new_type, o.nullable AS old_nullable, n.nullable AS new_nullable,
 CASE WHEN o.column_name IS NULL THEN 'added' WHEN n.column_name IS NULL THEN 'removed' WHEN o.norm <> n.norm THEN 'type_changed' ELSE 'none' END AS change
 FROM (SELECT *, {_NORM} AS norm FROM cols_old) o FULL JOIN (SELECT *, {_NORM} AS norm FROM cols_new) n ON o.dataset = n.dataset AND o.column_name = n.column_name)
"""


def diff(t):
    return D.schema_diff(cat.columns_old(t), cat.columns_new(t), ["dataset"])


_DRIFT7 = """SELECT dataset, added, removed, type_changed, CASE WHEN removed > 0 OR type_changed > 0 THEN 'critical' WHEN added > 5 THEN 'warning' WHEN added > 0 THEN 'info' ELSE 'none' END AS severity
FROM (SELECT dataset, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'type_changed') AS type_changed FROM df GROUP BY 1)"""


@query("df_7", DIFF_SQL + _DRIFT7)
def df_7(t):
    return D.schema_drift(diff(t))


@query("df_8", f"""WITH {_DRIFT4}, n AS (SELECT (SELECT count(*) FROM {_B}) AS b, (SELECT count(*) FROM {_C}) AS c),
a AS (SELECT 'statistical' AS kind, column_name || '.' || metric AS subject, CASE WHEN ch < 0.5 THEN 'warning' ELSE 'critical' END AS severity FROM s WHERE ch > 0.2
 UNION ALL SELECT 'volume', 'rows', CASE WHEN abs((c - b) / b) < 0.5 THEN 'warning' ELSE 'critical' END FROM n WHERE abs((c - b) / b) > 0.3
 UNION ALL SELECT 'schema', dataset, severity FROM ({DIFF_SQL + _DRIFT7}) WHERE severity <> 'none'
 UNION ALL SELECT 'freshness', CAST(event_id AS VARCHAR), 'critical' FROM events WHERE (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7 >= 1400)
SELECT kind, subject, severity, bool_or(severity = 'critical') OVER () AS any_critical FROM a""")
def df_8(t):
    b, c = _split(t)
    r = lambda x: x.withColumn("value", F.round("value", 4))
    a = D.statistical_drift(r(D.numeric_stats(b, _SC)), r(D.numeric_stats(c, _SC))).select(
        F.lit("statistical").alias("kind"), F.concat("column_name", F.lit("."), "metric").alias("subject"), "severity")
    v = D.volume_drift(b, c).filter("severity IS NOT NULL").select(F.lit("volume").alias("kind"), F.lit("rows").alias("subject"), "severity")
    s = D.schema_drift(diff(t)).filter("severity <> 'none'").select(F.lit("schema").alias("kind"), F.col("dataset").alias("subject"), "severity")
    f = D.freshness_drift(t.events.withColumn("expected", F.date_trunc("day", "ts")), "expected", "ts", minutes=1400).select(
        F.lit("freshness").alias("kind"), F.col("event_id").cast("string").alias("subject"), "severity")
    return D.all_drifts(a, v, s, f)


@query("df_9", DIFF_SQL + """, e AS (SELECT p.policy, df.* FROM df CROSS JOIN (SELECT unnest(['STRICT', 'ADDITIVE', 'FLEXIBLE']) AS policy) p WHERE change <> 'none' AND column_name NOT LIKE '\\_%' ESCAPE '\\'),
o AS (SELECT policy, dataset, CASE WHEN policy = 'STRICT' THEN 'error' WHEN policy = 'FLEXIBLE' OR change = 'added' THEN 'warning' ELSE 'error' END AS outcome FROM e)
SELECT policy, dataset, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'warning') AS warnings, count(*) FILTER (WHERE outcome = 'error') = 0 AS is_valid FROM o GROUP BY 1, 2""")
def df_9(t):
    out = None
    for p in ("STRICT", "ADDITIVE", "FLEXIBLE"):
        x = D.evolution_verdict(diff(t), p).select(F.lit(p).alias("policy"), "*")
        out = x if out is None else out.unionByName(x)
    return out


@query("df_10", DIFF_SQL + """SELECT dataset, removed, type_changed, tight AS nullable_tightened, added, removed + type_changed + tight = 0 AS is_compatible FROM (SELECT dataset, count(*) FILTER (WHERE change = 'removed') AS removed,
 count(*) FILTER (WHERE change = 'type_changed') AS type_changed, count(*) FILTER (WHERE old_nullable AND NOT new_nullable) AS tight, count(*) FILTER (WHERE change = 'added') AS added FROM df GROUP BY 1)""")
def df_10(t):
    return D.compatibility(diff(t))


@query("df_11", DIFF_SQL + "SELECT dataset, a AS new_columns, m AS missing_columns, m = 0 AS healed, m > 0 AS manual FROM (SELECT dataset, count(*) FILTER (WHERE change = 'added') AS a, count(*) FILTER (WHERE change = 'removed') AS m FROM df GROUP BY 1)")
def df_11(t):
    return D.healing(diff(t))


_OBS = """SELECT user_id AS feed_id, event_type AS zone, date_trunc('day', ts) AS d, count(*) AS row_count, avg(value) AS quality, max(epoch_us(ts) - epoch_us(date_trunc('day', ts))) AS delay FROM events GROUP BY 1, 2, 3"""


@query("df_12", f"""SELECT feed_id, zone, round(avg(row_count), 4) AS avg_rows, round(stddev_samp(row_count), 4) AS sd_rows, round(avg(quality), 8) AS avg_quality, avg(delay) / 6e7 AS avg_delay, count(*) AS samples, strftime(max(d), '%Y-%m-%d') AS last_day
FROM ({_OBS}) WHERE d >= DATE '2024-02-05' - INTERVAL 30 DAY GROUP BY 1, 2""")
def df_12(t):
    d = F.date_trunc("day", "ts")
    obs = (t.events.groupBy(F.col("user_id").alias("feed_id"), F.col("event_type").alias("zone"), d.alias("d"))
           .agg(F.count(F.lit(1)).alias("row_count"), F.avg("value").alias("quality"), F.max(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(d.cast("timestamp"))).alias("delay")))
    x = D.observability_baseline(obs, ["feed_id", "zone"], "d", "2024-02-05", 30, {"rows": "row_count", "quality": "quality", "delay": "delay"})
    return x.select("feed_id", "zone", F.round("avg_rows", 4).alias("avg_rows"), F.round("sd_rows", 4).alias("sd_rows"), F.round("avg_quality", 8).alias("avg_quality"),
                    (F.col("avg_delay") / 6e7).alias("avg_delay"), "samples", ymd("last_day").alias("last_day"))


_BASE = """p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT event_id, event_type, ts, value, median(value) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING) AS baseline,
 CASE WHEN count(*) OVER w >= 5 THEN regr_slope(value, i) OVER w END AS slope FROM p WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN value >= 120 THEN 'threshold_breach' WHEN value >= 60 AND baseline > 0 AND coalesce(slope, 0) > 0.1 THEN 'trend_anomaly' WHEN baseline > 1 AND value < baseline * 0.05 THEN 'sudden_drop' END AS signal FROM m),
s AS (SELECT *, CASE signal WHEN 'threshold_breach' THEN least(1.0, 0.7 + 0.3 * (value - 120) / 120) WHEN 'trend_anomaly' THEN 0.5 + least(0.4, slope * 2) WHEN 'sudden_drop' THEN 0.85 END AS confidence FROM k)"""


def signals(t):
    x = D.with_baseline(t.events, ["event_type"], ["ts", "event_id"], slot(), "value")
    return D.classify_metric(x, "value", 120.0, 60.0)


@query("df_13", f"WITH {_BASE} SELECT event_id, round(confidence, 6) AS confidence FROM s WHERE signal = 'threshold_breach'")
def df_13(t):
    return signals(t).filter("signal = 'threshold_breach'").select("event_id", F.round("confidence", 6).alias("confidence"))


@query("df_14", f"WITH {_BASE} SELECT event_id, round(confidence, 6) AS confidence, CAST(floor(round((120 - value) / slope, 6)) AS BIGINT) AS polls_to_breach FROM s WHERE signal = 'trend_anomaly'")
def df_14(t):
    return signals(t).filter("signal = 'trend_anomaly'").select("event_id", F.round("confidence", 6).alias("confidence"), F.floor(F.round((120 - F.col("value")) / F.col("slope"), 6)).alias("polls_to_breach"))


@query("df_15", f"WITH {_BASE} SELECT event_id, round(baseline, 6) AS baseline, value FROM s WHERE signal = 'sudden_drop'")
def df_15(t):
    return signals(t).filter("signal = 'sudden_drop'").select("event_id", F.round("baseline", 6).alias("baseline"), "value")


@query("df_16", f"""WITH {_BASE}, g AS (SELECT event_type AS service, date_trunc('day', ts) AS d, count(*) AS n, max(confidence) AS c, count(*) FILTER (WHERE signal = 'threshold_breach') AS b FROM s WHERE signal IS NOT NULL GROUP BY 1, 2)
SELECT service, strftime(d, '%Y-%m-%d') AS day, n AS n_signals, round(least(1.0, c + least(0.15, 0.05 * (n - 1))), 6) AS confidence, CASE WHEN b > 0 THEN 'P2' ELSE 'P3' END AS severity, CASE WHEN n > 1 THEN 'multiple' ELSE 'single' END AS kind FROM g""")
def df_16(t):
    x = signals(t).filter("signal IS NOT NULL").withColumns({"service": F.col("event_type"), "day": ymd("ts")})
    return D.correlate(x, ["service", "day"]).select("service", "day", "n_signals", F.round("confidence", 6).alias("confidence"), "severity", "kind")


@query("df_17", """
WITH RECURSIVE a AS (SELECT event_type AS k, epoch_us(ts) AS t, event_id FROM events),
r AS (SELECT k, min(t) AS t FROM a GROUP BY k UNION ALL SELECT r.k, (SELECT min(a.t) FROM a WHERE a.k = r.k AND a.t >= r.t + 1800000000) FROM r WHERE r.t IS NOT NULL)
SELECT a.event_id, a.k AS event_type FROM r JOIN a ON a.k = r.k AND a.t = r.t""")
def df_17(t):
    return D.suppress_greedy(t.events, ["event_type"], "ts", ["event_id"], 30).select("event_id", "event_type")


@query("df_17_slots", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, floor(epoch_us(ts) / 1.8e9) ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, event_type FROM r WHERE rn = 1""")
def df_17_slots(t):
    return D.suppress_in_buckets(t.events, ["event_type"], "ts", ["ts", "event_id"], 30).select("event_id", "event_type")


@query("df_18", """WITH w AS (SELECT user_id, ts AS s, ts + INTERVAL 30 HOUR AS e FROM events WHERE event_type = 'signup' AND value > 60)
SELECT event_id FROM events x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = x.user_id AND x.ts BETWEEN w.s AND w.e)""")
def df_18(t):
    w = t.events.filter("event_type = 'signup' AND value > 60").select("user_id", F.col("ts").alias("win_start"), F.expr("ts + INTERVAL 30 HOURS").alias("win_end"))
    return D.outside_windows(t.events, w, ["user_id"], "ts", ["event_id"]).select("event_id")


_LOGS = """SELECT doc_id, text || CASE source WHEN 'src0' THEN ' java.lang.OutOfMemoryError: heap' WHEN 'src1' THEN ' AnalysisException: cannot resolve column' WHEN 'src2' THEN ' connection refused by host' WHEN 'src3' THEN ' 403 Forbidden'
 WHEN 'src4' THEN ' soft_time_limit reached' WHEN 'src5' THEN ' ValidationError in suite' ELSE '' END AS log FROM documents"""


def _logs(t):
    s = F.col("source")
    tail = (F.when(s == "src0", " java.lang.OutOfMemoryError: heap").when(s == "src1", " AnalysisException: cannot resolve column").when(s == "src2", " connection refused by host")
            .when(s == "src3", " 403 Forbidden").when(s == "src4", " soft_time_limit reached").when(s == "src5", " ValidationError in suite").otherwise(""))
    return t.spread("documents").select("doc_id", F.concat("text", tail).alias("log"))


def _case(table, default):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(log), '{s.lower()}')" for s in terms) + f" THEN '{n}'" for n, terms, *_ in table) + f" ELSE '{default}' END"


@query("df_19", f"SELECT doc_id, {_case(D.FAILURES, 'unknown')} AS failure, {_case(D.ERROR_TERMS, 'UNKNOWN')} AS error FROM ({_LOGS})")
def df_19(t):
    return _logs(t).select("doc_id", D.failure_class("log").alias("failure"), D.error_class("log").alias("error"))


@query("df_20", f"""WITH {cat.EXEC_SQL}, g AS (SELECT feed_id, count(*) AS runs, count(*) FILTER (WHERE status = 'FAILED') AS failed_runs, count(*) FILTER (WHERE duration_s > 60) AS sla_breaches, avg(duration_s) AS a, min(duration_s) AS lo, max(duration_s) AS hi FROM ex GROUP BY 1)
SELECT feed_id, runs, failed_runs, sla_breaches, round(a, 4) AS avg_duration, hi > lo * 3 AS high_variance, sla_breaches > runs / 2 AS mostly_late, CASE WHEN failed_runs = 0 THEN 'healthy' WHEN failed_runs = runs THEN 'failing' ELSE 'degraded' END AS health FROM g""")
def df_20(t):
    return D.run_health(cat.executions(t), ["feed_id"], F.col("status") == "FAILED", "duration_s", 60.0).withColumn("avg_duration", F.round("avg_duration", 4))


@query("df_21", """SELECT event_id, count(*) OVER w / 21600.0 AS rate, round(count(*) FILTER (WHERE event_type = 'error') OVER w / count(*) OVER w, 6) AS error_ratio, count(*) FILTER (WHERE event_type = 'error') OVER w / count(*) OVER w > 0.25 AS firing
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def df_21(t):
    x = D.counter_rates(t.events, ["user_id"], "ts", ["event_id"], 21600, F.col("event_type") == "error", 0.25)
    return x.select("event_id", "rate", F.round("error_ratio", 6).alias("error_ratio"), "firing")


@query("df_22", """WITH x AS (SELECT *, value > 5 AS c, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events)
SELECT event_id, bool_and(c) OVER w AND ts - INTERVAL 12 HOUR >= t0 AS firing FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)""")
def df_22(t):
    return D.sustained(t.events, ["user_id"], "ts", ["event_id"], 43200, F.col("value") > 5).select("event_id", "firing")
