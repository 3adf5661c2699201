"""Operational metadata: pipeline views, scores, searches and checks over metadata tables.

Tables are DataFrames with the column names given in each function; `as_of` replaces "now"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import all_of, case_map, col, epoch, money, null_safe_join
from zonecraft.operators.joins import latest_child, with_child_stats
from zonecraft.operators.window import framed, running


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def pipeline_health(registry: DataFrame, runs: DataFrame, contracts: DataFrame, costs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Active pipelines with their latest run, active contract, recent cost and health status.

    registry(pipeline_id, status), runs(pipeline_id, run_id, run_status, executed_at, quality_score),
    contracts(pipeline_id, contract_status, quality_min), costs(pipeline_id, cost_date, cost)."""
    x = latest_child(registry.filter(F.col("status") == "active"), runs, "pipeline_id", "pipeline_id", ["executed_at", "run_id"],
                     ["run_status", "executed_at", "quality_score"])
    c = contracts.filter(F.col("contract_status") == "active").select(F.col("pipeline_id").alias("_p"), "quality_min")
    x = x.join(c, F.col("pipeline_id") == F.col("_p"), "left").drop("_p")
    recent = costs.filter(F.col("cost_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    x = with_child_stats(x, recent, "pipeline_id", "pipeline_id", money("cost").alias("recent_cost"), zero=["recent_cost"])
    need = F.coalesce("quality_min", F.lit(95))
    ok = F.col("run_status") == "success"
    return x.withColumn("health", F.when(ok & (F.col("quality_score") >= need), "healthy").when(ok, "warning")
                        .when(F.col("run_status") == "failed", "critical").otherwise("unknown"))


def cost_trend(costs: DataFrame, key: str, day: str, cost: str) -> DataFrame:
    """Daily cost with percentage change and 7-day average."""
    x = framed(costs, [key], [day], F.date_trunc("month", day), 6, 0, {
        "_prev": lambda w: F.lag(cost).over(w), "avg_7d": lambda w: F.avg(cost).over(w.rowsBetween(-6, 0))})
    return x.withColumn("change_pct", 100.0 * (F.col(cost) - F.col("_prev")) / F.when(F.col("_prev") != 0, F.col("_prev"))).drop("_prev")


def compute_cost(core_hours, preemptible_ratio=0.0, on_demand: float = 0.05, preemptible: float = 0.01) -> Column:
    h = col(core_hours)
    r = F.lit(preemptible_ratio) if not isinstance(preemptible_ratio, (str, Column)) else col(preemptible_ratio)
    return h * (1 - r) * on_demand + h * r * preemptible


def cost_by_pipeline(feeds: DataFrame, logs: DataFrame, since: str) -> DataFrame:
    """feeds(feed_id, ...), logs(feed_id, execution_id, start_ts, resource_type, quantity, cost)."""
    g = logs.filter(F.col("start_ts") >= ts(since)).groupBy("feed_id").agg(
        F.count_distinct("execution_id").alias("executions"), money("cost").alias("total_cost"), F.avg("cost").alias("avg_cost"),
        money(F.when(F.col("resource_type") == "SPARK", F.col("quantity"))).alias("spark_hours"),
        money(F.when(F.col("resource_type") == "STORAGE", F.col("quantity"))).alias("storage_gb"))
    return feeds.join(g, "feed_id")


def sla_breach(duration_minutes, warning, critical) -> Column:
    d = col(duration_minutes)
    return F.when(d > col(critical), "CRITICAL").when(d > col(warning), "WARNING")


def sla_compliance(definitions: DataFrame, runs: DataFrame, since: str) -> DataFrame:
    """definitions(feed_id, warning, critical), runs(feed_id, start_ts, duration_minutes)."""
    r = runs.filter(F.col("start_ts") >= ts(since)).join(definitions, "feed_id")
    r = r.withColumn("_b", sla_breach("duration_minutes", "warning", "critical"))
    g = r.groupBy("feed_id").agg(F.count(F.lit(1)).alias("total_runs"), F.count("_b").alias("breaches"),
                                 F.max(F.when(F.col("_b").isNotNull(), F.col("start_ts"))).alias("last_breach"))
    x = definitions.select("feed_id").join(g, "feed_id", "left")
    n, b = F.coalesce("total_runs", F.lit(0)), F.coalesce("breaches", F.lit(0))
    return x.select("feed_id", n.alias("total_runs"), b.alias("breaches"),
                    F.round(100.0 * (n - b) / F.when(n != 0, n), 2).alias("compliance_pct"), "last_breach")


def execution_summary(runs: DataFrame, tasks: DataFrame, since: str) -> DataFrame:
    """Recent runs with task counts; runs(execution_id, start_ts), tasks(execution_id, task_status, records)."""
    return with_child_stats(runs.filter(F.col("start_ts") >= ts(since)), tasks, "execution_id", "execution_id",
                            F.count(F.lit(1)).alias("task_count"), F.count_if(F.col("task_status") == "FAILED").alias("failed_tasks"),
                            money("records").alias("total_records"), zero=["task_count", "failed_tasks"])


def validation_failures(log: DataFrame, since: str, top: int | None = None) -> DataFrame:
    """Failed validations by failure rate, all or the `top` worst; log(..., is_passed, total_records, failed_records, created_at)."""
    rate = F.round(100.0 * F.col("failed_records") / F.when(F.col("total_records") != 0, F.col("total_records")), 2)
    ties = [c for c in log.columns if c not in ("is_passed",)]
    out = log.filter(~F.col("is_passed") & (F.col("created_at") >= ts(since))).withColumn("failure_rate", rate).orderBy(F.desc_nulls_last("failure_rate"), *ties)
    return out if top is None else out.limit(top)


def error_analysis(errors: DataFrame, since: str) -> DataFrame:
    return errors.filter(F.col("created_at") >= ts(since)).groupBy("error_type").agg(
        F.count(F.lit(1)).alias("error_count"), F.count_distinct("execution_id").alias("affected_runs"), F.avg("retry_count").alias("avg_retries"),
        F.count_if(F.col("resolution_status") == "RESOLVED").alias("resolved"), F.count_if("is_transient").alias("transient"))


def quality_grades(log: DataFrame, by=("feed_id", "zone")) -> DataFrame:
    g = log.groupBy(*by).agg(F.avg("pass_percentage").alias("_p"), F.count(F.lit(1)).alias("validations"),
                             F.count_if(~F.col("is_passed") & F.col("is_blocking")).alias("blocking_failures"))
    p = F.col("_p")
    grade = F.when(p >= 95, "A").when(p >= 85, "B").when(p >= 75, "C").when(p >= 65, "D").otherwise("F")
    return g.select(*by, F.round(p, 2).alias("quality_score"), grade.alias("grade"), "validations", "blocking_failures")


def freshness(feeds: DataFrame, runs: DataFrame, as_of: str, warn_hours: float = 12, stale_hours: float = 24) -> DataFrame:
    """FRESH / WARNING / STALE / NEVER_RUN by the newest successful run."""
    g = runs.filter(F.col("run_status") == "success").groupBy(F.col("feed_id").alias("_f")).agg(F.max("end_ts").alias("last_run"))
    x = feeds.join(g, F.col("feed_id") == F.col("_f"), "left").drop("_f")
    h = (F.unix_timestamp(ts(as_of)) - epoch("last_run")) / 3600
    return x.withColumn("hours_since", h).withColumn("freshness", F.when(F.col("last_run").isNull(), "NEVER_RUN")
                                                     .when(h > stale_hours, "STALE").when(h > warn_hours, "WARNING").otherwise("FRESH"))


def ticket_dashboard(tickets: DataFrame, as_of: str) -> DataFrame:
    """tickets(status, due_date, created_at, is_migration, scope JSON, pipeline_ids JSON, priority)."""
    now = F.lit(as_of).cast("date")
    sla = (F.when(F.col("status") == "completed", "completed").when(F.col("due_date") < now, "overdue")
           .when(F.col("due_date") <= F.date_add(now, 2), "at_risk").otherwise("on_track"))
    return tickets.withColumns({
        "sla_status": sla, "days_open": F.datediff(now, "created_at"), "pipeline_count": F.json_array_length("pipeline_ids"),
        "legacy_system": F.when(F.col("is_migration"), F.get_json_object("scope", "$.legacy_system")),
        "package_count": F.when(F.col("is_migration"), F.get_json_object("scope", "$.package_count").try_cast("int")),
        "priority_rank": case_map(F.col("priority"), {"critical": 1, "high": 2, "medium": 3, "low": 4})})


def pending_dependencies(deps: DataFrame, tickets: DataFrame) -> DataFrame:
    """deps(pipeline_id, right_exists, is_placeholder, expected_ticket), tickets(ticket_id, status)."""
    t = tickets.select(F.col("ticket_id").alias("_t"), F.col("status").alias("ticket_status"))
    x = deps.filter("is_placeholder").join(t, F.col("expected_ticket") == F.col("_t"), "left").drop("_t")
    return x.withColumn("resolution", F.when(F.col("right_exists"), "resolved")
                        .when(F.col("ticket_status").isin("completed", "in_progress"), "in_progress").otherwise("blocked"))


def product_catalog(products: DataFrame, subscriptions: DataFrame) -> DataFrame:
    g = subscriptions.groupBy("product_id").agg(
        F.count_distinct(F.when(F.col("sub_status") == "APPROVED", F.col("subscription_id"))).alias("active_subscribers"),
        F.count_distinct(F.when(F.col("sub_status") == "PENDING", F.col("subscription_id"))).alias("pending_requests"))
    return products.join(g, "product_id", "left").na.fill(0, ["active_subscribers", "pending_requests"])


def migration_summary(jobs: DataFrame, objects: DataFrame, artifacts: DataFrame, lineage: DataFrame, as_of: str) -> DataFrame:
    """Each child is aggregated before the join, so that rows do not multiply."""
    o = objects.groupBy("job_id").agg(F.count_distinct("object_id").alias("object_count"))
    a = artifacts.groupBy("job_id").agg(F.count_distinct("artifact_id").alias("artifact_count"), F.avg("confidence").alias("avg_confidence"))
    li = lineage.groupBy("job_id").agg(F.count_distinct("lineage_id").alias("edge_count"))
    x = jobs.join(o, "job_id", "left").join(a, "job_id", "left").join(li, "job_id", "left")
    end = F.coalesce(epoch("completed_at"), F.unix_timestamp(ts(as_of)).cast("double"))
    return x.withColumn("duration_seconds", F.floor(end - epoch("started_at")).cast("long")).na.fill(0, ["object_count", "artifact_count", "edge_count"])


def tokens(c) -> Column:
    """Lower-case words of a text."""
    return F.split(F.lower(col(c)), r"[^\p{L}0-9]+", -1)


def search(assets: DataFrame, text_columns, query: str | None = None, equals: dict | None = None, tags_column: str | None = None,
           tags=None, order=(), limit: int | None = None) -> DataFrame:
    """All query words present, equality filters, any of the tags; in order, all or the first `limit`."""
    tests = []
    if query:
        words = tokens(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in text_columns]))
        tests += [F.array_contains(words, w) for w in query.lower().split()]
    tests += [F.col(c) == v for c, v in (equals or {}).items()]
    if tags:
        tests.append(F.arrays_overlap(F.col(tags_column), F.array(*[F.lit(x) for x in tags])))
    out = assets.filter(all_of(tests)).orderBy(*order) if order else assets.filter(all_of(tests))
    return out if limit is None else out.limit(limit)


def health_score(df: DataFrame, weights=(0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """Columns pass_rate, records_read, records_rejected, run_seconds, sla_seconds, success_rate,
    slot_hours, slot_budget give quality, freshness, stability, cost and the overall score."""
    rej = F.when(F.col("records_read") > 0, F.greatest(F.lit(0.0), 1 - F.col("records_rejected") / F.col("records_read") * 10)).otherwise(1.0)
    quality = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pass_rate") * 0.7 + rej * 0.3)), 3)

    def steps(ratio, bounds, values):
        out = None
        for b, v in zip(bounds, values):
            out = F.when(ratio <= b, v) if out is None else out.when(ratio <= b, v)
        return out.otherwise(values[-1])

    fresh = F.when(F.col("sla_seconds") > 0, steps(F.col("run_seconds") / F.col("sla_seconds"), (1.0, 1.5, 2.0), (1.0, 0.8, 0.5, 0.2))).otherwise(1.0)
    cost = F.when(F.col("slot_budget") > 0, steps(F.col("slot_hours") / F.col("slot_budget"), (0.5, 1.0, 1.5), (1.0, 0.8, 0.5, 0.2))).otherwise(1.0)
    x = df.withColumns({"quality": quality, "freshness": fresh, "stability": F.round(F.col("success_rate"), 3), "cost_efficiency": cost})
    q, f, s, c = weights
    return x.withColumn("overall", F.round(q * F.col("quality") + f * F.col("freshness") + s * F.col("stability") + c * F.col("cost_efficiency"), 3))


def promotion_gate(scored: DataFrame, minimum: float = 0.7) -> DataFrame:
    return scored.withColumn("passed", F.coalesce(F.col("overall") >= minimum, F.lit(False)))


def business_days(dates: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """calendar(cal_date, is_business_day); unknown dates count as business days."""
    return (dates.join(calendar, F.col(day) == F.col("cal_date"), "left")
            .withColumn("is_business_day", F.coalesce("is_business_day", F.lit(True))).drop("cal_date"))


def file_status_counts(log: DataFrame, day: str, by: str, status: str, when: str) -> DataFrame:
    x = log.filter(F.to_date(F.col(when)) == F.lit(day).cast("date"))
    s = F.col(status)
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "SUCCESS").alias("succeeded"), F.count_if(s == "FAILED").alias("failed"),
                             F.count_if(s == "RUNNING").alias("running"))


def advance_watermarks(table: DataFrame, batch: DataFrame, keys, value: str) -> DataFrame:
    """Watermark table raised to the newest value per key; never lowered."""
    new = batch.groupBy(*keys).agg(F.max(value).alias(value))
    return table.unionByName(new).groupBy(*keys).agg(F.max(value).alias(value))


# Price per 1000 input and output tokens by model, and the price of any other.
TOKEN_PRICES = {
    "gpt-4-turbo-preview": (0.01, 0.03), "gpt-4": (0.03, 0.06), "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-opus": (0.015, 0.075), "claude-3-sonnet": (0.003, 0.015),
}
DEFAULT_PRICE = (0.01, 0.03)


def usage_cost(model, input_tokens, output_tokens, prices=None) -> Column:
    p = prices or TOKEN_PRICES
    return (col(input_tokens) / 1000 * case_map(col(model), {k: v[0] for k, v in p.items()}, DEFAULT_PRICE[0])
            + col(output_tokens) / 1000 * case_map(col(model), {k: v[1] for k, v in p.items()}, DEFAULT_PRICE[1]))


def budget_use(usage: DataFrame, day: str, order, bucket: Column, cost: str, budget: float) -> DataFrame:
    """Running cost of the day, budget left and alert level at each call."""
    x = running(usage, [day], order, bucket, _spent=("sum", F.col(cost).cast("decimal(28,8)")))
    spent = F.col("_spent").cast("double")
    pct = spent / budget * 100
    return x.withColumns({"spent": spent, "budget_left": budget - spent,
                          "alert": F.when(pct >= 90, "critical").when(pct >= 75, "high").otherwise("none")}).drop("_spent")


# Risk of actions and multiplier of environments, with the value of unknown ones.
ACTION_RISK = {
    "restart": 0.3, "scale": 0.4, "config_update": 0.5, "deploy": 0.6, "patch": 0.6, "delete": 0.9, "terminate": 0.9,
    "modify_infrastructure": 0.7, "database_migration": 0.8, "shell": 0.3, "ansible": 0.4, "terraform": 0.6, "unknown": 0.7,
}
ENV_FACTOR = {"production": 2.0, "staging": 1.5, "development": 0.5, "test": 0.3}


def risk(df: DataFrame) -> DataFrame:
    """Columns action, environment, affected, has_rollback, dry_run give risk_score and risk_level."""
    base = case_map(F.col("action"), ACTION_RISK, 0.7) * case_map(F.col("environment"), ENV_FACTOR, 1.5)
    blast = F.least(F.col("affected") / 10, F.lit(1.0)) * 0.2
    less = F.when(F.col("has_rollback"), 0.2).otherwise(0.0) + F.when(F.col("dry_run"), 0.3).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + blast - less))
    s = F.col("risk_score")
    return df.withColumn("risk_score", score).withColumn(
        "risk_level", F.when(s < 0.3, "low").when(s < 0.5, "medium").when(s < 0.8, "high").otherwise("critical"))


# Confidence bounds.
REJECT, LOW, HIGH, CRITICAL = 0.30, 0.50, 0.75, 0.85


def confidence_level(confidence) -> Column:
    c = col(confidence)
    return F.when(c < REJECT, "rejected").when(c < LOW, "very_low").when(c < HIGH, "moderate").when(c < CRITICAL, "high").otherwise("very_high")


def recommendation(confidence, risk_level) -> Column:
    c, r = col(confidence), col(risk_level)
    risky = r.isin("high", "critical")
    return (F.when(c < REJECT, "auto_rejected").when(c < LOW, "manual_review_required").when(risky & (c < CRITICAL), "requires_senior_approval")
            .when(risky, "requires_approval").when((c >= HIGH) & (r == "low"), "can_auto_approve").otherwise("requires_approval"))


def event_durations(events: DataFrame, entity: str, kind: str, when: str, pairs) -> DataFrame:
    """Minutes between the first events of two kinds per entity; pairs are (name, from, to)."""
    kinds = sorted({k for _, a, b in pairs for k in (a, b)})
    g = events.groupBy(entity).agg(*[F.min(F.when(F.col(kind) == k, F.col(when))).alias(f"at_{k}") for k in kinds])
    return g.select(entity, *[((epoch(f"at_{b}") - epoch(f"at_{a}")) / 60).alias(n) for n, a, b in pairs])


def utilisation(count) -> Column:
    n = col(count)
    return (F.when(n == 0, "UNUSED").when(n < 5, "UNDERUTILIZED").when(n < 20, "MODERATE").when(n < 50, "WELL_UTILIZED").otherwise("HIGH_UTILIZATION"))


def template_use(templates: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """uses(template key, feed_id, feed_group_id, is_active, executed_at)."""
    g = uses.groupBy(F.col(key).alias("_k")).agg(
        F.count_distinct(F.when(F.col("is_active"), F.col("feed_id"))).alias("active_feeds"),
        F.count_distinct("feed_group_id").alias("feed_groups"), F.max("executed_at").alias("last_execution"))
    x = templates.join(g, templates[key] == F.col("_k"), "left").drop("_k").na.fill(0, ["active_feeds", "feed_groups"])
    return x.withColumn("utilisation", utilisation("active_feeds"))


def completeness_checks(feeds: DataFrame, checks: dict) -> DataFrame:
    """One row per feed and check; `checks` maps a name to a DataFrame with feed_id and `ok`, or
    with feed_id only (existence)."""
    x = feeds.select("feed_id")
    for name, df in checks.items():
        ok = F.col("ok") if "ok" in df.columns else F.lit(True)
        g = df.groupBy(F.col("feed_id").alias("_f")).agg(F.bool_or(ok).alias(name))
        x = x.join(g, F.col("feed_id") == F.col("_f"), "left").drop("_f").withColumn(name, F.coalesce(name, F.lit(False)))
    return x.unpivot(["feed_id"], list(checks), "check", "is_valid")


def upstream_ready(deps: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """deps(downstream_id, upstream_id, required_status, lookback_hours): met when the newest
    upstream run of that status lies inside the lookback; ready when all are met."""
    now = ts(as_of)
    last = (runs.filter(F.col("end_ts") <= now).groupBy(F.col("feed_id").alias("upstream_id"), F.col("run_status").alias("required_status"))
            .agg(F.max("end_ts").alias("last_run")))
    x = null_safe_join(deps, last, ["upstream_id", "required_status"], "left")
    met = F.coalesce(epoch("last_run") >= F.unix_timestamp(now) - F.col("lookback_hours") * 3600, F.lit(False))
    return x.withColumn("is_met", met)


def readiness(checked: DataFrame) -> DataFrame:
    return checked.groupBy("downstream_id").agg(F.count(F.lit(1)).alias("dependencies"), F.count_if("is_met").alias("met"), F.bool_and("is_met").alias("ready"))


def compatibility(df: DataFrame) -> DataFrame:
    """Arrays sources, adaptable_sources, loads, adaptable_loads, zones, transforms, validations of a
    template against source, load, need_zones, need_transforms, need_validations."""
    def has_all(have, need):
        return F.size(F.array_except(need, have)) == 0

    src = F.when(F.array_contains("sources", F.col("source")), 0.30).when(F.array_contains("adaptable_sources", F.col("source")), 0.15).otherwise(0.0)
    load = F.when(F.array_contains("loads", F.col("load")), 0.25).when(F.array_contains("adaptable_loads", F.col("load")), 0.12).otherwise(0.0)
    zones = F.size(F.array_intersect("need_zones", "zones")) / F.size(F.array_distinct("need_zones"))
    return df.withColumn("score", src + load + 0.20 * zones + F.when(has_all("transforms", "need_transforms"), 0.15).otherwise(0.0)
                         + F.when(has_all("validations", "need_validations"), 0.10).otherwise(0.0))
