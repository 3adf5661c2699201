"""Queries for metadata analytics (MD) and graphs (GR)."""

from pyspark.sql import functions as F

from zonecraft.functions.exprs import hms, money, ymd
from zonecraft.operators import graph as G
from zonecraft.operators import joins as J
from zonecraft.operators import metadata as M
from zonecraft.plans import catalog as cat
from zonecraft.plans.registry import query

RUN = """run AS (SELECT event_id AS run_id, user_id AS pipeline_id, ts AS executed_at, 100 - value / 5 AS quality_score,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS run_status, event_type, value FROM events)"""


def runs(t):
    e = F.col("event_type")
    return t.events.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("pipeline_id"), F.col("ts").alias("executed_at"),
                           (100 - F.col("value") / 5).alias("quality_score"), F.when(e == "error", "failed").when(e == "signup", "running").otherwise("success").alias("run_status"),
                           "event_type", "value")


@query("md_1", f"""
WITH {RUN}, reg AS (SELECT c_custkey AS pipeline_id, c_mktsegment AS domain, c_nationkey FROM customer WHERE c_acctbal >= 0),
le AS (SELECT pipeline_id, arg_max(run_status, (executed_at, run_id)) AS st, arg_max(quality_score, (executed_at, run_id)) AS q, max(executed_at) AS at FROM run GROUP BY 1),
cost AS (SELECT pipeline_id, sum(CAST(value AS DECIMAL(28, 6)))::DOUBLE AS c FROM run WHERE executed_at >= DATE '2024-02-10' - INTERVAL 30 DAY GROUP BY 1)
SELECT r.pipeline_id, domain, le.st AS run_status, strftime(le.at, '%Y-%m-%d') AS last_day, CASE WHEN c_nationkey < 15 THEN 80 + c_nationkey END AS quality_min, round(coalesce(cost.c, 0), 2) AS recent_cost,
 CASE WHEN le.st = 'success' AND le.q >= coalesce(CASE WHEN c_nationkey < 15 THEN 80 + c_nationkey END, 95) THEN 'healthy' WHEN le.st = 'success' THEN 'warning' WHEN le.st = 'failed' THEN 'critical' ELSE 'unknown' END AS health
FROM reg r LEFT JOIN le ON r.pipeline_id = le.pipeline_id LEFT JOIN cost ON cost.pipeline_id = r.pipeline_id""")
def md_1(t):
    c = t.customer
    reg = c.select(F.col("c_custkey").alias("pipeline_id"), F.col("c_mktsegment").alias("domain"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("retired").alias("status"))
    con = c.select(F.col("c_custkey").alias("pipeline_id"), F.when(F.col("c_nationkey") < 15, "active").otherwise("draft").alias("contract_status"), (F.col("c_nationkey") + 80).alias("quality_min"))
    costs = runs(t).select("pipeline_id", F.col("executed_at").alias("cost_date"), F.col("value").alias("cost"))
    x = M.pipeline_health(reg, runs(t), con, costs, "2024-02-10")
    return x.select("pipeline_id", "domain", "run_status", ymd("executed_at").alias("last_day"), "quality_min", F.round("recent_cost", 2).alias("recent_cost"), "health")


@query("md_2", """WITH d AS (SELECT event_type AS p, date_trunc('day', ts) AS d, round(sum(CAST(value AS DECIMAL(28, 6))), 2)::DOUBLE AS c FROM events GROUP BY 1, 2)
SELECT p AS pipeline, strftime(d, '%Y-%m-%d') AS day, c AS cost, round(100.0 * (c - lag(c) OVER w) / nullif(lag(c) OVER w, 0), 4) AS change_pct, round(avg(c) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg_7d FROM d WINDOW w AS (PARTITION BY p ORDER BY d)""")
def md_2(t):
    d = t.events.groupBy(F.col("event_type").alias("pipeline"), F.date_trunc("day", "ts").alias("d")).agg(F.round(money("value"), 2).alias("cost"))
    x = M.cost_trend(d, "pipeline", "d", "cost")
    return x.select("pipeline", ymd("d").alias("day"), "cost", F.round("change_pct", 4).alias("change_pct"), F.round("avg_7d", 4).alias("avg_7d"))


@query("md_3", """WITH l AS (SELECT o_custkey AS feed_id, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'SPARK' WHEN 'N' THEN 'STORAGE' ELSE 'NETWORK' END AS rt, l_quantity AS q, l_quantity * 0.75 * 0.05 + l_quantity * 0.25 * 0.01 AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1999-01-01')
SELECT c_custkey AS feed_id, c_name, count(DISTINCT l_orderkey) AS executions, round(sum(CAST(cost AS DECIMAL(28, 6))), 4)::DOUBLE AS total_cost, coalesce(sum(q) FILTER (WHERE rt = 'SPARK'), 0) AS spark_hours, coalesce(sum(q) FILTER (WHERE rt = 'STORAGE'), 0) AS storage_gb
FROM customer JOIN l ON c_custkey = feed_id GROUP BY 1, 2""")
def md_3(t):
    x = J.join_on(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")])
    r = F.col("l_returnflag")
    logs = x.select(F.col("o_custkey").alias("feed_id"), F.col("l_orderkey").alias("execution_id"), F.col("o_orderdate").alias("start_ts"),
                    F.when(r == "A", "SPARK").when(r == "N", "STORAGE").otherwise("NETWORK").alias("resource_type"), F.col("l_quantity").alias("quantity"),
                    M.compute_cost("l_quantity", 0.25).alias("cost"))
    feeds = t.customer.select(F.col("c_custkey").alias("feed_id"), "c_name")
    y = M.cost_by_pipeline(feeds, logs, "1999-01-01")
    return y.select("feed_id", "c_name", "executions", F.round("total_cost", 4).alias("total_cost"), F.coalesce("spark_hours", F.lit(0.0)).alias("spark_hours"), F.coalesce("storage_gb", F.lit(0.0)).alias("storage_gb"))


_SLA = "d AS (SELECT c_custkey AS feed_id, 20 + c_nationkey AS w, 60 + c_nationkey AS c FROM customer)"


def _sla(t):
    return t.customer.select(F.col("c_custkey").alias("feed_id"), (F.col("c_nationkey") + 20).alias("warning"), (F.col("c_nationkey") + 60).alias("critical"))


def _feed_runs(t):
    return t.events.select("event_id", F.col("user_id").alias("feed_id"), F.col("ts").alias("start_ts"), F.col("value").alias("duration_minutes"))


@query("md_4", f"""WITH {_SLA}, g AS (SELECT d.feed_id, count(event_id) AS n, count(event_id) FILTER (WHERE value > w) AS b, max(ts) FILTER (WHERE value > w) AS last FROM d LEFT JOIN (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-08') ON user_id = feed_id GROUP BY 1)
SELECT feed_id, n AS total_runs, b AS breaches, round(100.0 * (n - b) / nullif(n, 0), 2) AS compliance_pct, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_breach FROM g""")
def md_4(t):
    return M.sla_compliance(_sla(t), _feed_runs(t), "2024-01-08").withColumn("last_breach", hms("last_breach"))


@query("md_5", f"WITH {_SLA} SELECT event_id, CASE WHEN value > c THEN 'CRITICAL' WHEN value > w THEN 'WARNING' END AS breach FROM events JOIN d ON user_id = feed_id WHERE value > w")
def md_5(t):
    x = _feed_runs(t).join(_sla(t), "feed_id").withColumn("breach", M.sla_breach("duration_minutes", "warning", "critical"))
    return x.filter("breach IS NOT NULL").select("event_id", "breach")


@query("md_6", """SELECT o_orderkey AS execution_id, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS task_count, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS failed_tasks,
 (SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS total_records FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'""")
def md_6(t):
    r = t.orders.select(F.col("o_orderkey").alias("execution_id"), "o_orderstatus", F.col("o_orderdate").alias("start_ts"))
    k = t.lineitem.select(F.col("l_orderkey").alias("execution_id"), F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("SUCCESS").alias("task_status"), F.col("l_quantity").alias("records"))
    return M.execution_summary(r, k, "2000-06-01").select("execution_id", "o_orderstatus", "task_count", "failed_tasks", "total_records")


@query("md_7", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_records, failed_records, round(100.0 * failed_records / nullif(total_records, 0), 2) AS failure_rate
FROM (SELECT *, l_quantity AS failed_records, floor(l_extendedprice / 100) AS total_records FROM lineitem) WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-01-01'
ORDER BY failure_rate DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20""")
def md_7(t):
    log = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") / 100).cast("double").alias("total_records"), F.col("l_quantity").alias("failed_records"),
                            (F.col("l_returnflag") != "R").alias("is_passed"), F.col("l_shipdate").alias("created_at"))
    return M.validation_failures(log, "1997-01-01", top=20).drop("is_passed", "created_at")


@query("md_8", """SELECT event_type AS error_type, count(*) AS error_count, count(DISTINCT user_id) AS affected_runs, round(avg(event_id % 4), 6) AS avg_retries, count(*) FILTER (WHERE value < 50) AS resolved, count(*) FILTER (WHERE value > 100) AS transient
FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def md_8(t):
    e = t.events.select(F.col("event_type").alias("error_type"), F.col("user_id").alias("execution_id"), (F.col("event_id") % 4).alias("retry_count"),
                        F.when(F.col("value") < 50, "RESOLVED").otherwise("OPEN").alias("resolution_status"), (F.col("value") > 100).alias("is_transient"), F.col("ts").alias("created_at"))
    return M.error_analysis(e, "2024-01-10").withColumn("avg_retries", F.round("avg_retries", 6))


@query("md_9", """WITH g AS (SELECT l_suppkey AS feed_id, l_returnflag AS zone, avg(100 - l_quantity) AS p, count(*) AS n, count(*) FILTER (WHERE l_quantity > 30 AND l_linestatus = 'O') AS b FROM lineitem GROUP BY 1, 2)
SELECT feed_id, zone, round(p, 6) AS quality_score, CASE WHEN p >= 95 THEN 'A' WHEN p >= 85 THEN 'B' WHEN p >= 75 THEN 'C' WHEN p >= 65 THEN 'D' ELSE 'F' END AS grade, n AS validations, b AS blocking_failures FROM g""".replace("round(p, 6)", "round(p, 2)"))
def md_9(t):
    log = t.lineitem.select(F.col("l_suppkey").alias("feed_id"), F.col("l_returnflag").alias("zone"), (100 - F.col("l_quantity")).alias("pass_percentage"),
                            (F.col("l_quantity") <= 30).alias("is_passed"), (F.col("l_linestatus") == "O").alias("is_blocking"))
    return M.quality_grades(log)


@query("md_10", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS anomaly_type, CASE WHEN value > 100 THEN 'ERROR' ELSE 'WARNING' END AS severity, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2, 3")
def md_10(t):
    return (t.events.filter("ts >= timestamp_ntz'2024-01-05'").groupBy(ymd("ts").alias("day"), F.col("event_type").alias("anomaly_type"),
                                                                    F.when(F.col("value") > 100, "ERROR").otherwise("WARNING").alias("severity")).agg(F.count(F.lit(1)).alias("n")))


@query("md_11", f"""WITH {RUN}, l AS (SELECT pipeline_id, max(executed_at) AS lat FROM run WHERE run_status = 'success' GROUP BY 1)
SELECT c_custkey AS feed_id, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(lat)) / 3.6e9, 4) AS hours_since, CASE WHEN lat IS NULL THEN 'NEVER_RUN' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(lat) > 24 * 3600000000 THEN 'STALE'
 WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(lat) > 12 * 3600000000 THEN 'WARNING' ELSE 'FRESH' END AS freshness FROM customer LEFT JOIN l ON c_custkey = pipeline_id""")
def md_11(t):
    r = runs(t).select(F.col("pipeline_id").alias("feed_id"), "run_status", F.col("executed_at").alias("end_ts"))
    x = M.freshness(t.customer.select(F.col("c_custkey").alias("feed_id")), r, "2024-01-31")
    return x.select("feed_id", F.round("hours_since", 4).alias("hours_since"), "freshness")


_TICKET = """tk AS (SELECT o_orderkey AS ticket_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'open' END AS status, CAST(o_orderdate AS DATE) AS created, CASE WHEN o_totalprice < 50000 THEN NULL ELSE CAST(o_orderdate AS DATE) + 1200 END AS due,
 o_totalprice > 250000 AS mig, '{"legacy_system": "' || o_orderpriority || '", "package_count": ' || CAST(o_custkey AS VARCHAR) || '}' AS scope, '[' || CAST(o_custkey AS VARCHAR) || ', 2]' AS ids,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority, o_custkey FROM orders)"""


def tickets(t):
    s, p, d = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    k = F.col("o_custkey").cast("string")
    return t.orders.select(
        F.col("o_orderkey").alias("ticket_id"), F.when(s == "F", "completed").when(s == "O", "in_progress").otherwise("open").alias("status"), d.alias("created_at"),
        F.when(F.col("o_totalprice") >= 50000, F.date_add(d, 1200)).alias("due_date"), (F.col("o_totalprice") > 250000).alias("is_migration"),
        F.concat(F.lit('{"legacy_system": "'), p, F.lit('", "package_count": '), k, F.lit("}")).alias("scope"), F.concat(F.lit("["), k, F.lit(", 2]")).alias("pipeline_ids"),
        F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low").alias("priority"), "o_custkey")


@query("md_12", f"""WITH {_TICKET} SELECT ticket_id, CASE WHEN status = 'completed' THEN 'completed' WHEN due < DATE '2001-08-02' THEN 'overdue' WHEN due <= DATE '2001-08-04' THEN 'at_risk' ELSE 'on_track' END AS sla_status, CAST(date_diff('day', created, DATE '2001-08-02') AS INTEGER) AS days_open,
 CAST(json_array_length(ids) AS INTEGER) AS pipeline_count, CASE WHEN mig THEN json_extract_string(scope, '$.legacy_system') END AS legacy_system, CASE WHEN mig THEN CAST(json_extract_string(scope, '$.package_count') AS INTEGER) END AS package_count,
 CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END AS priority_rank FROM tk""")
def md_12(t):
    x = M.ticket_dashboard(tickets(t), "2001-08-02").orderBy(F.asc_nulls_last("priority_rank"), F.asc_nulls_last("due_date"))
    return x.select("ticket_id", "sla_status", "days_open", "pipeline_count", "legacy_system", "package_count", "priority_rank")


@query("md_13", f"WITH {_TICKET} SELECT ticket_id, status, l_linenumber, l_returnflag AS relationship, l_partkey, p_name AS pipeline_name, p_brand AS pipeline_status, l_suppkey FROM tk JOIN lineitem ON ticket_id = l_orderkey JOIN part ON l_partkey = p_partkey")
def md_13(t):
    m = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("relationship"), "l_partkey", "l_suppkey")
    x = J.multi_join(tickets(t).select("ticket_id", "status"), [
        {"table": m, "keys": [("ticket_id", "l_orderkey")], "join_order": 1, "join_type": "inner"},
        {"table": t.part.select("p_partkey", F.col("p_name").alias("pipeline_name"), F.col("p_brand").alias("pipeline_status")), "keys": [("l_partkey", "p_partkey")], "join_order": 2, "join_type": "inner"}])
    return x.select("ticket_id", "status", "l_linenumber", "relationship", "l_partkey", "pipeline_name", "pipeline_status", "l_suppkey")


@query("md_14", f"""WITH {_TICKET} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount < 0.02 THEN 'resolved' WHEN tk.status IN ('completed', 'in_progress') THEN 'in_progress' ELSE 'blocked' END AS resolution
FROM lineitem LEFT JOIN tk ON ticket_id = l_partkey * 3 WHERE l_linestatus = 'O'""")
def md_14(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") < 0.02).alias("right_exists"), (F.col("l_linestatus") == "O").alias("is_placeholder"),
                          (F.col("l_partkey") * 3).alias("expected_ticket"))
    return M.pending_dependencies(d, tickets(t)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "resolution")


@query("md_15", """SELECT p_partkey AS product_id, p_name, p_brand, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'A') AS active_subscribers, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS pending_requests
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3""")
def md_15(t):
    f = F.col("l_returnflag")
    sub = t.lineitem.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("subscription_id"), F.when(f == "A", "APPROVED").when(f == "N", "PENDING").otherwise("REJECTED").alias("sub_status"))
    return M.product_catalog(t.part.select(F.col("p_partkey").alias("product_id"), "p_name", "p_brand"), sub)


@query("md_16", """WITH j AS (SELECT c_custkey AS job_id, TIMESTAMP '2001-01-01' AS s, CASE WHEN c_acctbal < 0 THEN NULL ELSE TIMESTAMP '2001-01-01' + to_seconds(CAST(floor(c_acctbal) AS BIGINT)) END AS e FROM customer),
o AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1), a AS (SELECT user_id, count(DISTINCT event_id) AS n, avg(value) AS c FROM events GROUP BY 1),
l AS (SELECT o_custkey, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT job_id, coalesce(o.n, 0) AS object_count, coalesce(a.n, 0) AS artifact_count, coalesce(l.n, 0) AS edge_count, round(a.c, 8) AS avg_confidence, CAST(epoch(coalesce(e, TIMESTAMP '2001-01-02')) - epoch(s) AS BIGINT) AS duration_seconds
FROM j LEFT JOIN o ON job_id = o.o_custkey LEFT JOIN a ON job_id = user_id LEFT JOIN l ON job_id = l.o_custkey""")
def md_16(t):
    s = F.lit("2001-01-01").cast("timestamp")
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"), s.alias("started_at"),
                             F.when(F.col("c_acctbal") >= 0, F.timestamp_seconds(F.unix_timestamp(s) + F.floor("c_acctbal"))).alias("completed_at"))
    obj = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("object_id"))
    art = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("artifact_id"), F.col("value").alias("confidence"))
    lin = J.join_on(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")]).select(F.col("o_custkey").alias("job_id"), F.struct("l_orderkey", "l_partkey").alias("lineage_id"))
    x = M.migration_summary(jobs, obj, art, lin, "2001-01-02")
    return x.select("job_id", "object_count", "artifact_count", "edge_count", F.round("avg_confidence", 8).alias("avg_confidence"), "duration_seconds")


@query("md_17", f"WITH {cat.COLUMNS_SQL.strip()[5:]} SELECT p_partkey, p_name, n.column_name, n.data_type AS new_type, n.nullable FROM cols_new n JOIN part ON p_brand = n.dataset")
def md_17(t):
    return J.join_on(t.part.select("p_partkey", "p_name", "p_brand"), cat.columns_new(t), [("p_brand", "dataset")]).select(
        "p_partkey", "p_name", "column_name", F.col("data_type").alias("new_type"), "nullable")


@query("md_18", """WITH a AS (SELECT *, regexp_split_to_array(lower(concat_ws(' ', text, source, lang)), '[^\\pL0-9]+') AS w, [lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] AS tags FROM documents)
SELECT doc_id, lang, n_chars FROM a WHERE list_contains(w, 'the') AND list_contains(w, 'on') AND lang = 'en' AND list_has_any(tags, ['long', 'fr']) ORDER BY doc_id DESC LIMIT 50""")
def md_18(t):
    a = t.spread("documents").withColumn("tags", F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short")))
    return M.search(a, ["text", "source", "lang"], "the on", {"lang": "en"}, "tags", ["long", "fr"], [F.desc("doc_id")], 50).select("doc_id", "lang", "n_chars")


@query("md_19", "SELECT p_partkey, p_name FROM part WHERE list_contains(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\pL0-9]+'), 'bolt') ORDER BY p_name, p_partkey LIMIT 100")
def md_19(t):
    return M.search(t.part, ["p_name", "p_type"], "Bolt", order=["p_name", "p_partkey"], limit=100).select("p_partkey", "p_name")


_HEALTH = f"""{RUN}, f AS (SELECT pipeline_id, avg(quality_score) / 100 AS pass_rate, sum(value) AS rr, sum(CASE WHEN run_status = 'failed' THEN 1 ELSE 0 END) AS rj, max(value) AS run_s, count(*) FILTER (WHERE run_status = 'success') / count(*) AS sr, count(*) AS n FROM run GROUP BY 1),
h AS (SELECT pipeline_id, round(least(1.0, greatest(0.0, pass_rate * 0.7 + greatest(0.0, 1 - rj / rr * 10) * 0.3)), 3) AS quality, CASE WHEN run_s / 200 <= 1 THEN 1.0 WHEN run_s / 200 <= 1.5 THEN 0.8 WHEN run_s / 200 <= 2 THEN 0.5 ELSE 0.2 END AS freshness, round(sr, 3) AS stability,
 CASE WHEN n / 70.0 <= 0.5 THEN 1.0 WHEN n / 70.0 <= 1 THEN 0.8 WHEN n / 70.0 <= 1.5 THEN 0.5 ELSE 0.2 END AS cost_efficiency FROM f)"""


def health(t):
    g = runs(t).groupBy("pipeline_id").agg(
        (F.avg("quality_score") / 100).alias("pass_rate"), F.sum("value").alias("records_read"), F.count_if(F.col("run_status") == "failed").alias("records_rejected"), F.max("value").alias("run_seconds"),
        (F.count_if(F.col("run_status") == "success") / F.count(F.lit(1))).alias("success_rate"), F.count(F.lit(1)).alias("slot_hours"))
    return M.health_score(g.withColumns({"sla_seconds": F.lit(200), "slot_budget": F.lit(70.0)}))


@query("md_20", f"WITH {_HEALTH} SELECT pipeline_id, quality, freshness::DOUBLE AS freshness, stability, cost_efficiency::DOUBLE AS cost_efficiency, round(0.4 * quality + 0.3 * freshness + 0.2 * stability + 0.1 * cost_efficiency, 6) AS overall FROM h")
def md_20(t):
    x = health(t)
    o = 0.4 * F.col("quality") + 0.3 * F.col("freshness") + 0.2 * F.col("stability") + 0.1 * F.col("cost_efficiency")
    return x.select("pipeline_id", "quality", "freshness", "stability", "cost_efficiency", F.round(o, 6).alias("overall"))


@query("md_21", f"WITH {_HEALTH} SELECT pipeline_id, round(round(0.4 * quality + 0.3 * freshness + 0.2 * stability + 0.1 * cost_efficiency, 6), 3) >= 0.7 AS passed FROM h")
def md_21(t):
    return M.promotion_gate(health(t)).select("pipeline_id", "passed")


@query("md_22", "WITH cal AS (SELECT DISTINCT CAST(ts AS DATE) AS d, dayofweek(ts) NOT IN (0, 6) AS b FROM events WHERE event_type <> 'view' AND day(ts) < 20) SELECT event_id, coalesce(b, TRUE) AS is_business_day FROM events LEFT JOIN cal ON CAST(ts AS DATE) = d")
def md_22(t):
    d = F.to_date("ts")
    c = t.events.filter((F.col("event_type") != "view") & (F.day("ts") < 20)).select(d.alias("cal_date"), (~F.dayofweek(d).isin(1, 7)).alias("is_business_day")).distinct()
    return M.business_days(t.events.withColumn("d", d), c, "d").select("event_id", "is_business_day")


@query("md_23", f"WITH {cat.EXEC_SQL} SELECT feed_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS running FROM ex WHERE CAST(started_at AS DATE) = DATE '2024-01-15' GROUP BY 1")
def md_23(t):
    return M.file_status_counts(cat.executions(t), "2024-01-15", "feed_id", "status", "started_at")


@query("md_24", "WITH w AS (SELECT c_custkey AS feed_id, 5000 + c_nationkey AS wm FROM customer UNION ALL SELECT user_id, event_id FROM events) SELECT feed_id, CAST(max(wm) AS BIGINT) AS wm FROM w GROUP BY 1")
def md_24(t):
    table = t.customer.select(F.col("c_custkey").alias("feed_id"), (F.col("c_nationkey") + 5000).cast("long").alias("wm"))
    return M.advance_watermarks(table, t.events.select(F.col("user_id").alias("feed_id"), F.col("event_id").alias("wm")), ["feed_id"], "wm")


@query("md_25", """WITH u AS (SELECT conv_id, turn, conv_id // 10 AS d, CASE role WHEN 'user' THEN 'gpt-4' WHEN 'assistant' THEN 'claude-3-sonnet' ELSE 'other' END AS model, len(string_split(text, ' ')) AS i, length(text) AS o FROM conversations),
c AS (SELECT *, i / 1000 * CASE model WHEN 'gpt-4' THEN 0.03 WHEN 'claude-3-sonnet' THEN 0.003 ELSE 0.01 END + o / 1000 * CASE model WHEN 'gpt-4' THEN 0.06 WHEN 'claude-3-sonnet' THEN 0.015 ELSE 0.03 END AS cost FROM u),
r AS (SELECT *, sum(CAST(cost AS DECIMAL(28, 8))) OVER (PARTITION BY d ORDER BY conv_id, turn)::DOUBLE AS spent FROM c)
SELECT conv_id, turn, round(cost, 6) AS cost, round(spent, 6) AS spent, round(1.0 - spent, 6) AS budget_left, CASE WHEN spent / 1.0 * 100 >= 90 THEN 'critical' WHEN spent / 1.0 * 100 >= 75 THEN 'high' ELSE 'none' END AS alert FROM r""")
def md_25(t):
    r = F.col("role")
    u = t.conversations.select("conv_id", "turn", F.floor(F.col("conv_id") / 10).alias("d"), F.when(r == "user", "gpt-4").when(r == "assistant", "claude-3-sonnet").otherwise("other").alias("model"),
                               F.size(F.split("text", " ", -1)).alias("i"), F.length("text").alias("o"))
    x = M.budget_use(u.withColumn("cost", M.usage_cost("model", "i", "o")), "d", ["conv_id", "turn"], F.col("conv_id"), "cost", 1.0)
    return x.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("cost", "spent", "budget_left")], "alert")


_PLAN = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'restart' WHEN 'N' THEN 'delete' ELSE 'mystery' END AS action, CASE WHEN l_discount < 0.03 THEN 'test' WHEN l_discount < 0.06 THEN 'development' WHEN l_discount < 0.08 THEN 'staging' ELSE 'production' END AS env,
 l_quantity AS n, l_linestatus = 'O' AS rb, l_tax > 0.04 AS dry FROM lineitem),
s AS (SELECT *, greatest(0.0, least(1.0, CASE action WHEN 'restart' THEN 0.3 WHEN 'delete' THEN 0.9 ELSE 0.7 END * CASE env WHEN 'test' THEN 0.3 WHEN 'development' THEN 0.5 WHEN 'staging' THEN 1.5 ELSE 2.0 END + least(n / 10, 1.0) * 0.2 - (CASE WHEN rb THEN 0.2 ELSE 0.0 END + CASE WHEN dry THEN 0.3 ELSE 0.0 END))) AS sc FROM p)"""


def risk(t):
    f, d = F.col("l_returnflag"), F.col("l_discount")
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(f == "A", "restart").when(f == "N", "delete").otherwise("mystery").alias("action"),
                          F.when(d < 0.03, "test").when(d < 0.06, "development").when(d < 0.08, "staging").otherwise("production").alias("environment"), F.col("l_quantity").alias("affected"),
                          (F.col("l_linestatus") == "O").alias("has_rollback"), (F.col("l_tax") > 0.04).alias("dry_run"))
    return M.risk(x)


@query("md_26", f"WITH {_PLAN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sc, 6) AS risk_score, CASE WHEN round(sc, 6) < 0.3 THEN 'low' WHEN round(sc, 6) < 0.5 THEN 'medium' WHEN round(sc, 6) < 0.8 THEN 'high' ELSE 'critical' END AS risk_level FROM s")
def md_26(t):
    x = risk(t).withColumn("risk_score", F.round("risk_score", 6))
    s = F.col("risk_score")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "risk_score", F.when(s < 0.3, "low").when(s < 0.5, "medium").when(s < 0.8, "high").otherwise("critical").alias("risk_level"))


@query("md_27", """WITH c AS (SELECT event_id, value / 100 AS c, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS r FROM events)
SELECT event_id, CASE WHEN c < 0.3 THEN 'rejected' WHEN c < 0.5 THEN 'very_low' WHEN c < 0.75 THEN 'moderate' WHEN c < 0.85 THEN 'high' ELSE 'very_high' END AS level,
 CASE WHEN c < 0.3 THEN 'auto_rejected' WHEN c < 0.5 THEN 'manual_review_required' WHEN r IN ('high', 'critical') THEN CASE WHEN c < 0.85 THEN 'requires_senior_approval' ELSE 'requires_approval' END WHEN c >= 0.75 AND r = 'low' THEN 'can_auto_approve' ELSE 'requires_approval' END AS advice FROM c""")
def md_27(t):
    e = F.col("event_type")
    x = t.events.select("event_id", (F.col("value") / 100).alias("c"), F.when(e == "error", "critical").when(e == "view", "high").when(e == "click", "medium").otherwise("low").alias("r"))
    return x.select("event_id", M.confidence_level("c").alias("level"), M.recommendation("c", "r").alias("advice"))


@query("md_28", """WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS s, min(ts) FILTER (WHERE event_type = 'view') AS v, min(ts) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT user_id, round((epoch_us(v) - epoch_us(s)) / 6e7, 4) AS to_view, round((epoch_us(p) - epoch_us(s)) / 6e7, 4) AS to_purchase FROM f""")
def md_28(t):
    x = M.event_durations(t.events, "user_id", "event_type", "ts", [("to_view", "signup", "view"), ("to_purchase", "signup", "purchase")])
    return x.select("user_id", F.round("to_view", 4).alias("to_view"), F.round("to_purchase", 4).alias("to_purchase"))


@query("md_29", """SELECT p_partkey, p_type, count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS active_feeds, count(DISTINCT l_orderkey) AS feed_groups, strftime(max(l_shipdate), '%Y-%m-%d') AS last_execution,
 CASE WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') = 0 THEN 'UNUSED' WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') < 5 THEN 'UNDERUTILIZED' WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') < 20 THEN 'MODERATE'
  WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') < 50 THEN 'WELL_UTILIZED' ELSE 'HIGH_UTILIZATION' END AS utilisation FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2""")
def md_29(t):
    uses = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("feed_id"), F.col("l_orderkey").alias("feed_group_id"), (F.col("l_linestatus") == "O").alias("is_active"), F.col("l_shipdate").alias("executed_at"))
    x = M.template_use(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), uses, "l_partkey")
    return x.select(F.col("l_partkey").alias("p_partkey"), "p_type", "active_feeds", "feed_groups", ymd("last_execution").alias("last_execution"), "utilisation")


@query("md_30", """WITH f AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) < 25), m AS (SELECT DISTINCT l_partkey AS member_id, p_type AS group_type, l_returnflag || l_linestatus AS item FROM lineitem JOIN f USING (l_partkey) JOIN part ON p_partkey = l_partkey)
SELECT member_id, group_type, item, first_id, group_size FROM (SELECT *, min(member_id) OVER (PARTITION BY group_type, item) AS first_id, count(*) OVER (PARTITION BY group_type, item) AS group_size FROM m) WHERE group_size > 1""")
def md_30(t):
    g = t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("kinds"))  # at most six kinds
    x = J.join_on(g.filter("n < 25"), t.part.select("p_partkey", "p_type"), [("l_partkey", "p_partkey")])
    return J.overlap_groups(x, "l_partkey", "p_type", "kinds")


@query("md_31", """WITH c AS (SELECT c_custkey AS feed_id, c_acctbal >= 0 AS a, c_custkey IN (SELECT o_custkey FROM orders) AS b, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS s, coalesce(z, 0) = 3 AS v, c_custkey IN (SELECT user_id FROM events) AS r
 FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS z FROM orders GROUP BY 1) ON c_custkey = o_custkey)
SELECT feed_id, unnest(['FEED_EXISTS', 'CONTRACT_EXISTS', 'SCHEMA_EXISTS', 'VIEWS_COMPLETE', 'RULES_EXIST']) AS "check", unnest([a, b, s, v, r]) AS is_valid FROM c""")
def md_31(t):
    o = t.orders.select(F.col("o_custkey").alias("feed_id"), "o_orderstatus")
    return M.completeness_checks(t.customer.select(F.col("c_custkey").alias("feed_id")), {
        "FEED_EXISTS": t.customer.select(F.col("c_custkey").alias("feed_id"), (F.col("c_acctbal") >= 0).alias("ok")), "CONTRACT_EXISTS": o.select("feed_id"),
        "SCHEMA_EXISTS": o.select("feed_id", (F.col("o_orderstatus") == "P").alias("ok")),
        "VIEWS_COMPLETE": o.groupBy("feed_id").agg((F.count_distinct("o_orderstatus") == 3).alias("ok")), "RULES_EXIST": t.events.select(F.col("user_id").alias("feed_id"))})


_DEP = """dep AS (SELECT c_nationkey AS downstream_id, c_custkey AS upstream_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'failed' ELSE 'success' END AS st, 24 * (1 + c_nationkey) AS h FROM customer)"""


@query("md_32", f"""WITH {RUN}, {_DEP}, l AS (SELECT pipeline_id, run_status, max(executed_at) AS lat FROM run WHERE executed_at <= TIMESTAMP '2024-01-28' GROUP BY 1, 2),
m AS (SELECT dep.*, coalesce(epoch_us(lat) >= epoch_us(TIMESTAMP '2024-01-28') - h * 3600000000, FALSE) AS met FROM dep LEFT JOIN l ON upstream_id = pipeline_id AND st = run_status)
SELECT downstream_id, count(*) AS dependencies, count(*) FILTER (WHERE met) AS met, bool_and(met) AS ready FROM m GROUP BY 1""")
def md_32(t):
    deps = t.customer.select(F.col("c_nationkey").alias("downstream_id"), F.col("c_custkey").alias("upstream_id"), F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("success").alias("required_status"),
                             (24 * (1 + F.col("c_nationkey"))).alias("lookback_hours"))
    r = runs(t).select(F.col("pipeline_id").alias("feed_id"), "run_status", F.col("executed_at").alias("end_ts"))
    return M.readiness(M.upstream_ready(deps, r, "2024-01-28"))


@query("md_33", """WITH s AS (SELECT p_partkey, list(DISTINCT l_returnflag) AS z, list(DISTINCT l_linestatus) AS ls, list(DISTINCT l_linenumber) AS ln FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)
SELECT p_partkey, round(CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 0.30 WHEN p_type = 'LARGE' THEN 0.15 ELSE 0.0 END + CASE WHEN p_size < 20 THEN 0.25 WHEN p_size < 30 THEN 0.12 ELSE 0.0 END + 0.20 * len(list_intersect(['A', 'R'], z)) / 2
 + CASE WHEN len(list_intersect(ls, ['O', 'F'])) = 2 THEN 0.15 ELSE 0 END + CASE WHEN list_contains(ln, 1) AND list_contains(ln, 7) THEN 0.10 ELSE 0 END, 6) AS score FROM s JOIN part USING (p_partkey)""")
def md_33(t):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    g = t.lineitem.groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("zones"), F.collect_set("l_linestatus").alias("transforms"), F.collect_set("l_linenumber").alias("validations"))  # fixed small domains
    x = J.join_on(g, t.part, [("l_partkey", "p_partkey")]).withColumns({
        "sources": arr("PROMO", "SMALL"), "adaptable_sources": arr("LARGE"), "source": F.col("p_type"), "loads": arr("full"), "adaptable_loads": arr("cdc"),
        "load": F.when(F.col("p_size") < 20, "full").when(F.col("p_size") < 30, "cdc").otherwise("odd"), "need_zones": arr("A", "R"), "need_transforms": arr("O", "F"), "need_validations": arr(1, 7)})
    return M.compatibility(x).select(F.col("l_partkey").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("md_34", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def md_34(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


# ---- graphs ----------------------------------------------------------------------------------

# documents form a lineage: each derives from the documents with half and a third of its number
EDGES = "e AS (SELECT DISTINCT d // 2 AS src, d AS dst FROM (SELECT doc_id AS d FROM documents WHERE doc_id > 0) UNION SELECT DISTINCT d // 3, d FROM (SELECT doc_id AS d FROM documents WHERE doc_id > 0))"


def doc_edges(t):
    d = t.documents.filter("doc_id > 0").select("doc_id")
    a = G.edges_of(d, F.floor(F.col("doc_id") / 2), "doc_id")
    return a.union(G.edges_of(d, F.floor(F.col("doc_id") / 3), "doc_id")).distinct()


@query("gr_1", f"""WITH RECURSIVE {EDGES}, r AS (SELECT dst AS start, src AS node, 1 AS depth FROM e UNION SELECT r.start, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 6)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def gr_1(t):
    return G.upstream(doc_edges(t), t.documents.select("doc_id"), 6)


@query("gr_2", f"""WITH RECURSIVE {EDGES}, s AS (SELECT doc_id AS start FROM documents WHERE lang = 'fr'), r AS (SELECT start, start AS node, 0 AS depth FROM s UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node <> start GROUP BY 1, 2""")
def gr_2(t):
    return G.downstream(doc_edges(t), t.documents.filter("lang = 'fr'").select("doc_id"), 4)


@query("gr_3", f"""WITH RECURSIVE {EDGES}, s AS (SELECT doc_id AS node FROM documents WHERE lang = 'de'), r AS (SELECT node, 0 AS depth FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node NOT IN (SELECT node FROM s) GROUP BY 1""")
def gr_3(t):
    return G.impact(doc_edges(t), t.documents.filter("lang = 'de'").select("doc_id"))


_SERVICES = """e AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


def services(t):
    tag = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    e = G.edges_of(t.lineitem, tag("part", "l_partkey"), tag("supplier", "l_suppkey"))
    e = e.union(G.edges_of(t.supplier, tag("supplier", "s_suppkey"), tag("nation", "s_nationkey")))
    return e.union(G.edges_of(t.nation, tag("nation", "n_nationkey"), tag("region", "n_regionkey")))


@query("gr_4", f"""WITH RECURSIVE {_SERVICES}, r AS (SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT r.start, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3)
SELECT start AS service, node AS dependent, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY 1, 2""")
def gr_4(t):
    s = t.region.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("s"))
    return G.upstream(services(t), s, 3).select(F.col("start").alias("service"), F.col("node").alias("dependent"), "depth")


@query("gr_5", f"""WITH {_SERVICES}, n AS (SELECT dst AS asset, 'upstream' AS direction, src AS neighbour FROM e UNION SELECT src, 'downstream', dst FROM e)
SELECT asset, direction, neighbour, s_name AS label FROM n LEFT JOIN (SELECT 'supplier:' || s_suppkey AS k, s_name FROM supplier WHERE s_acctbal > 0) ON neighbour = k""")
def gr_5(t):
    c = t.supplier.filter("s_acctbal > 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_name").alias("label"))
    return G.neighbours(services(t), c, "k")


@query("gr_6", f"WITH {EDGES} SELECT src, dst, a.source AS src_source, a.lang AS src_lang, b.source AS dst_source, b.lang AS dst_lang FROM e JOIN documents a ON a.doc_id = src JOIN documents b ON b.doc_id = dst")
def gr_6(t):
    return G.named_edges(doc_edges(t), t.documents, "doc_id", ["source", "lang"])


_LEVELS = f"""{EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.node)"""


@query("gr_7", f"WITH RECURSIVE {_LEVELS} SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1")
def gr_7(t):
    return G.levels(doc_edges(t))


@query("gr_7_batches", f"WITH RECURSIVE {_LEVELS}, l AS (SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1) SELECT level, count(*) AS nodes FROM l GROUP BY 1")
def gr_7_batches(t):
    return G.batches(doc_edges(t))


@query("gr_8", """WITH RECURSIVE e AS (SELECT doc_id AS src, (doc_id // 8) * 8 + (doc_id * 3 + n_chars) % 8 AS dst FROM documents), v AS (SELECT * FROM e WHERE dst IN (SELECT doc_id FROM documents)),
r AS (SELECT src AS start, dst AS node, 1 AS depth FROM v UNION ALL SELECT r.start, v.dst, r.depth + 1 FROM r JOIN v ON v.src = r.node WHERE r.depth < 8), c AS (SELECT DISTINCT start AS node FROM r WHERE start = node),
m AS (SELECT c.node, min(r.node) AS component, count(DISTINCT r.node) AS size FROM c JOIN r ON r.start = c.node GROUP BY 1) SELECT * FROM m""")
def gr_8(t):
    d = t.documents.select(F.col("doc_id").alias("src"), (F.floor(F.col("doc_id") / 8) * 8 + (F.col("doc_id") * 3 + F.col("n_chars")) % 8).alias("dst"))
    known = t.documents.select(F.col("doc_id").alias("dst"))
    return G.cycles(d.join(known, "dst", "left_semi").select("src", "dst"))


@query("gr_9", f"""WITH {cat.EXEC_SQL}, l AS (SELECT *, lag(zone) OVER (PARTITION BY feed_id ORDER BY started_at, execution_id) AS p FROM ex) SELECT feed_id, execution_id, p AS source_zone, zone AS target_zone FROM l WHERE p <> zone""")
def gr_9(t):
    x = G.zone_transitions(cat.executions(t), "feed_id", ["started_at", "execution_id"], "zone", F.date_trunc("minute", "started_at"))
    return x.select("feed_id", "execution_id", "source_zone", "target_zone")
