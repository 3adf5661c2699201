"""Queries for streaming operators in their batch form (SM) and extension points (UD)."""

from pyspark.sql import functions as F

from zonecraft.functions.exprs import hms, money
from zonecraft.operators import rules as R
from zonecraft.plans.registry import query
from zonecraft.plans.relational_plans import slot
from zonecraft.session import store
from zonecraft.streaming import events as E
from zonecraft.streaming import state as S
from zonecraft.streaming import windows as W


def _win(t, spec):
    x = W.windowed(t.events, spec, ["event_type"], F.count(F.lit(1)).alias("n"), F.round(money("value"), 2).alias("total"))
    return x.select(hms("window_start").alias("window_start"), "event_type", "n", "total")


@query("sm_3", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(28, 6))), 2)::DOUBLE AS total FROM events GROUP BY 1, 2")
def sm_3(t):
    return _win(t, W.WindowSpec("tumbling", "6 hours", column="ts"))


@query("sm_4", """WITH b AS (SELECT *, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events), x AS (SELECT event_type, value, s AS w FROM b UNION ALL SELECT event_type, value, s - INTERVAL 3 HOUR FROM b)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(28, 6))), 2)::DOUBLE AS total FROM x GROUP BY 1, 2""")
def sm_4(t):
    return _win(t, W.WindowSpec("sliding", "6 hours", "3 hours", column="ts"))


@query("sm_5", """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def sm_5(t):
    x = W.sessions(t.events, ["user_id"], "ts", ["ts", "event_id"], 14400.0, slot(), F.count(F.lit(1)).alias("n"))
    return x.select("user_id", hms("session_start").alias("session_start"), hms("session_end").alias("session_end"), "n")


@query("sm_6", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 30 HOUR THEN 'late' ELSE 'on_time' END AS side, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def sm_6(t):
    good, late = W.split_late(t.events, "ts", "2024-01-20", 30)
    show = lambda x, s: x.groupBy(F.lit(s).alias("side"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    return show(good, "on_time").unionByName(show(late, "late"))


_MSG = "CASE event_type WHEN 'view' THEN substring(props, 1, 3) WHEN 'click' THEN '{\"z\": 1}' ELSE props END"


@query("sm_7", f"""WITH m AS (SELECT event_id, event_type, props FROM events) SELECT event_id, CASE event_type WHEN 'view' THEN 'malformed' WHEN 'click' THEN 'missing k' END AS error, CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM m""")
def sm_7(t):
    m = t.events.select("event_id", F.when(F.col("event_type") == "view", F.substring("props", 1, 3)).when(F.col("event_type") == "click", '{"z": 1}').otherwise(F.col("props")).alias("value"))
    good, dead = E.split_malformed(m, "k bigint", required=["k"])
    return good.select("event_id", F.lit(None).cast("string").alias("error"), "k").unionByName(dead.select("event_id", "error", F.lit(None).cast("bigint").alias("k")))


@query("sm_9", """WITH r AS (SELECT *, epoch_us(ts) // 3600000000 AS slot, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, 'INC-PIPE-' || upper(substring(sha256('pipeline:' || user_id || ':' || event_type || ':' || slot), 1, 12)) AS incident_id FROM r WHERE rn = 1""")
def sm_9(t):
    x = E.dedup_slots(t.events, ["user_id"], "ts", ["ts", "event_id"])
    return x.select("event_id", E.incident_id(F.col("user_id").cast("string"), F.col("event_type"), "ts").alias("incident_id"))


_PAT = "CASE WHEN value > 150 THEN 'schema_mismatch' WHEN value > 80 THEN 'out_of_memory' WHEN value > 40 THEN 'permission_denied' WHEN value > 20 THEN 'odd' END"


def messages(t):
    """Events as JSON messages: errors are failures, signups missed deadlines, views healthy runs, clicks configuration."""
    v, e = F.col("value"), F.col("event_type")
    pat = F.when(v > 150, "schema_mismatch").when(v > 80, "out_of_memory").when(v > 40, "permission_denied").when(v > 20, "odd")
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    task = lambda n, p: F.struct(F.concat(F.lit(n), uid).alias("task_id"), p.alias("failure_pattern"), F.lit("log of task").alias("log_snippet"))
    kind = F.when(e == "error", "pipeline.failed").when(e == "signup", "pipeline.sla_missed").when(e == "view", "pipeline.healthy").when(e == "click", "config.updated").otherwise("other")
    body = F.struct(
        eid.alias("event_id"), kind.alias("event_type"), hms("ts").alias("timestamp"), uid.alias("correlation_id"), F.lit("events").alias("source"), F.lit("5.0").alias("version"),
        F.concat(F.lit("p"), uid).alias("pipeline_id"), F.concat(F.lit("dag_"), uid).alias("dag_id"), eid.alias("run_id"), F.when(v > 10, "core").alias("team"),
        F.when(pat.isNotNull(), F.array(task("a", pat), task("b", F.lit("timeout")))).otherwise(F.array().cast("array<struct<task_id:string,failure_pattern:string,log_snippet:string>>")).alias("failed_tasks"),
        v.alias("elapsed_minutes"), F.lit(60.0).alias("sla_deadline_minutes"), F.floor(v / 20).cast("int").alias("run_number"),
        F.concat(F.lit("key"), uid).alias("config_key"), F.col("props").alias("config_value"), F.lit("all").alias("scope"))
    return t.events.select("ts", F.to_json(body).alias("value"))


@query("sm_10", f"""WITH f AS (SELECT *, coalesce({_PAT}, 'unknown') AS pat FROM events WHERE event_type = 'error')
SELECT 'INC-PIPE-' || upper(substring(sha256('pipeline:dag_' || user_id || ':' || event_id || ':' || epoch_us(ts) // 3600000000), 1, 12)) AS incident_id, 'dag_' || user_id AS dag_id, CAST(event_id AS VARCHAR) AS run_id, CASE WHEN value > 10 THEN 'core' ELSE 'data-engineering' END AS team, pat AS pattern,
 CASE WHEN pat IN ('schema_mismatch', 'permission_denied', 'data_quality_fail') THEN 'P2' ELSE 'P3' END AS severity, CASE pat WHEN 'out_of_memory' THEN 'memory_exhaustion' WHEN 'permission_denied' THEN 'permission_denied' ELSE 'dag_failure' END AS cause_hint,
 CASE WHEN value > 20 THEN 2 ELSE 0 END AS n_tasks, CASE WHEN value > 20 THEN 'a' || user_id || ': ' || pat || ' - log of task' || chr(10) || 'b' || user_id || ': timeout - log of task' ELSE '' END AS summary FROM f""")
def sm_10(t):
    p = E.parse(messages(t), "pipeline.failed").withColumn("at", F.to_timestamp("timestamp"))
    x = E.failure_incidents(p, "at", most_tasks=5, most_chars=200)
    return x.select("incident_id", "dag_id", "run_id", "team", "pattern", "severity", "cause_hint", "n_tasks", "summary")


@query("sm_11", """SELECT 'INC-PIPE-' || upper(substring(sha256('pipeline:dag_' || user_id || ':sla_' || event_id || ':' || epoch_us(ts) // 3600000000), 1, 12)) AS incident_id, 'dag_' || user_id AS dag_id, 'P3' AS severity, 'timeout' AS classification FROM events WHERE event_type = 'signup'""")
def sm_11(t):
    p = E.parse(messages(t), "pipeline.sla_missed").withColumn("at", F.to_timestamp("timestamp"))
    return E.sla_incidents(p, "at").select("incident_id", "dag_id", "severity", "classification")


@query("sm_12", """SELECT 'key' || user_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'config.republished' AS kind, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2""")
def sm_12(t):
    x = E.config_messages(E.parse(messages(t), "config.updated"))
    inner = F.get_json_object("value", "$.config_value")
    return x.groupBy("key", F.get_json_object(inner, "$.k").cast("bigint").alias("k"), F.get_json_object("value", "$.event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("sm_13", """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events),
s AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g) SELECT event_id, user_id FROM s WHERE event_type <> 'error' AND streak = 3""")
def sm_13(t):
    return S.auto_close(t.events, ["user_id"], ["ts", "event_id"], slot(), F.col("event_type") != "error").filter("closes").select("event_id", "user_id")


STATES = {"signup": ["view", "click"], "view": ["view", "click", "purchase"], "click": ["view", "click", "purchase", "error"], "purchase": ["view", "signup"], "error": ["view", "error"]}


@query("sm_14", """WITH l AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, p AS previous_state, CASE WHEN p IS NULL THEN TRUE ELSE """ + " OR ".join(f"(p = '{a}' AND event_type IN (" + ", ".join(f"'{b}'" for b in bs) + "))" for a, bs in STATES.items()) + " END AS is_legal FROM l")
def sm_14(t):
    return S.transitions(t.events, ["user_id"], ["ts", "event_id"], slot(), "event_type", STATES).select("event_id", "previous_state", "is_legal")


_STEPS = ["requested", "planning", "planned", "generating", "generated", "validating", "validated", "pending_approval", "approved", "rejected", "deploying", "deployed", "failed"]


@query("sm_14_pipeline", f"""WITH s AS (SELECT user_id, event_id, ts, ({_STEPS})[(event_id + user_id) % 13 + 1] AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM s)
SELECT event_id, state, p AS previous_state, CASE WHEN p IS NULL THEN state = 'requested' ELSE (p || '>' || state) IN ('requested>planning', 'planning>planned', 'planning>failed', 'planned>generating', 'generating>generated', 'generating>failed', 'generated>validating',
 'validating>validated', 'validating>failed', 'validated>pending_approval', 'validated>approved', 'pending_approval>approved', 'pending_approval>rejected', 'approved>deploying', 'deploying>deployed', 'deploying>failed') END AS is_legal FROM l""")
def sm_14_pipeline(t):
    steps = F.array(*[F.lit(x) for x in _STEPS])
    x = t.events.withColumn("state", F.element_at(steps, ((F.col("event_id") + F.col("user_id")) % 13 + 1).cast("int")))
    return S.transitions(x, ["user_id"], ["ts", "event_id"], slot(), "state", S.PIPELINE_TRANSITIONS, ["requested"]).select("event_id", "state", "previous_state", "is_legal")


@query("sm_15", "SELECT CASE event_type WHEN 'error' THEN 'pipeline.failed' WHEN 'signup' THEN 'pipeline.sla_missed' ELSE 'unhandled' END AS handler, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def sm_15(t):
    parts = E.route(E.envelope(messages(t)), ["pipeline.failed", "pipeline.sla_missed"])
    out = None
    for name, x in parts.items():
        x = x.agg(F.lit(name).alias("handler"), F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("bigint")).alias("ids"))
        out = x if out is None else out.unionByName(x)
    return out


@query("sm_16", "SELECT event_id, 'dag_' || user_id AS dag_id, CAST(floor(value / 20) AS INTEGER) AS run_number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, '5.0' AS version FROM events WHERE event_type = 'view'")
def sm_16(t):
    x = E.parse(messages(t), "pipeline.healthy")
    return x.select(F.col("event_id").cast("bigint").alias("event_id"), "dag_id", "run_number", F.col("timestamp").alias("at"), "version")


@query("sm_17", "SELECT event_id, CASE event_type WHEN 'error' THEN '2' WHEN 'view' THEN '4' WHEN 'signup' THEN '1' ELSE '3' END AS priority FROM events")
def sm_17(t):
    e = F.col("event_type")
    return t.events.select("event_id", E.external_priority(F.when(e == "error", "error").when(e == "view", "Info").when(e == "signup", "CRITICAL").otherwise("odd")).alias("priority"))


@query("sm_18", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM events GROUP BY 1")
def sm_18(t):
    return S.current_state(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("sm_20", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS short_n, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS long_n,
 count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) <= 2 AND count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) <= 6 AS allowed FROM events""")
def sm_20(t):
    return S.rate_limit(t.events, ["user_id"], "ts", ["event_id"], [("short_n", 21600, 2), ("long_n", 172800, 6)]).select("event_id", "short_n", "long_n", "allowed")


# ---- extension points ------------------------------------------------------------------------

@query("ud_1", "SELECT c_nationkey, count(*) AS n_rows, count(*) AS n_ids, TRUE AS well_formed FROM customer GROUP BY 1")
def ud_1(t):
    x = store(R.bronze_audit(t.customer, "2024-01-01", "r1"))
    # a 64-bit hash of an id is a fifth of its text
    return x.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.xxhash64("_record_uuid")).alias("n_ids"),
                                        F.bool_and(F.col("_record_uuid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"))


@R.register_rule("price_band")
def price_band(df, cfg):
    return df.withColumn(cfg["output"], F.when(F.col(cfg["column"]) > cfg["high"], "high").otherwise("low"))


@query("ud_2", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' ELSE 'low' END AS band FROM orders")
def ud_2(t):
    return R.apply_rules(t.orders, [{"type": "price_band", "config": {"column": "o_totalprice", "high": 300000, "output": "band"}}]).select("o_orderkey", "band")


@query("ud_3", "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def ud_3(t):
    return R.apply_rules(t.orders, [{"type": "sql", "config": {
        "statement": "SELECT o_custkey, count(*) AS n FROM {df} JOIN {cust} ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1", "tables": {"cust": t.customer}}}])
