"""Event payloads: parsing, routing, dead letters, incident rows, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import case_map, col, epoch
from zonecraft.operators.window import top_per_group

ENVELOPE = "event_id string, event_type string, timestamp string, correlation_id string, source string, version string"

# Payload fields by event type.
PAYLOADS = {
    "pipeline.failed": "pipeline_id string, dag_id string, run_id string, team string, jira_ticket string, failed_tasks array<struct<task_id string, failure_pattern string, log_snippet string>>",
    "pipeline.sla_missed": "dag_id string, run_id string, team string, elapsed_minutes double, sla_deadline_minutes double",
    "pipeline.healthy": "dag_id string, run_number int",
    "config.updated": "config_key string, config_value string, scope string",
}

# Severity and cause hint of failure patterns; priority of external severities.
SEVERITY = {"schema_mismatch": "P2", "permission_denied": "P2", "data_quality_fail": "P2", "out_of_memory": "P3", "timeout": "P3",
            "source_unavailable": "P3", "unknown": "P3"}
CAUSE = {"schema_mismatch": "dag_failure", "permission_denied": "permission_denied", "data_quality_fail": "dag_failure", "out_of_memory": "memory_exhaustion",
         "timeout": "timeout", "source_unavailable": "connectivity_failure", "unknown": "dag_failure"}
EXTERNAL_PRIORITY = {"CRITICAL": "1", "ERROR": "2", "WARNING": "3", "INFO": "4"}
DEDUP_SECONDS = 3600


def parse(df: DataFrame, event_type: str, value: str = "value") -> DataFrame:
    """Typed rows of one event type: envelope and payload fields."""
    schema = f"{ENVELOPE}, {PAYLOADS[event_type]}"
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("e")).select("e.*").filter(F.col("event_type") == event_type)


def envelope(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("e", F.from_json(F.col(value).cast("string"), ENVELOPE)).select(*[c for c in df.columns], "e.*")


def route(df: DataFrame, types, column: str = "event_type") -> dict:
    """One filtered stream per type and `unhandled` for all others."""
    out = {t: df.filter(F.col(column) == t) for t in types}
    out["unhandled"] = df.filter(F.col(column).isNull() | ~F.col(column).isin(*types))
    return out


def split_malformed(df: DataFrame, schema: str, value: str = "value", handling: str = "redirect", required=()) -> tuple[DataFrame, DataFrame | None]:
    """(parsed rows, dead letters).  Rows that do not parse or miss a required field are
    redirected with reason and time, skipped, or fail the job."""
    text = F.col(value).cast("string")
    x = df.withColumn("_r", F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    reason = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), "malformed")
    for c in required:
        reason = reason.when(F.col(f"_r.{c}").isNull(), f"missing {c}")
    x = x.withColumn("_reason", reason)
    fine = F.col("_reason").isNull()
    if handling == "fail":
        fine = F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "_reason")).cast("boolean"))
    good = x.filter(fine).select(*[c for c in df.columns if c != value], "_r.*").drop("_bad")
    if handling != "redirect":
        return good, None
    return good, x.filter(F.col("_reason").isNotNull()).select(*df.columns, F.col("_reason").alias("error"), F.current_timestamp().alias("failed_at"))


def dead_letter_batch(schema: str, good_path: str, dead_path: str, value: str = "value", required=()):
    """foreachBatch function that writes parsed rows and dead letters; the batch id makes a
    repeated batch overwrite itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good, bad = split_malformed(batch, schema, value, "redirect", required)
            good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            bad.write.mode("overwrite").json(f"{dead_path}/batch={batch_id}")
        finally:
            batch.unpersist()
    return write


def incident_id(dag: Column, run: Column, when, window: int = DEDUP_SECONDS) -> Column:
    """Deterministic id from job, run and time bucket."""
    slot = F.floor(epoch(when) / window).cast("long").cast("string")
    return F.concat(F.lit("INC-PIPE-"), F.upper(F.substring(F.sha2(F.concat_ws(":", F.lit("pipeline"), dag, run, slot), 256), 1, 12)))


def failure_incidents(failed: DataFrame, when: str, most_tasks: int | None = None, most_chars: int | None = None) -> DataFrame:
    """Incident rows from failure events: severity and cause of the first task, a line of summary per task, of all or the
    first `most_tasks`, each with its whole log snippet or `most_chars` of it."""
    tasks = F.col("failed_tasks")
    first = F.coalesce(F.get(tasks, F.lit(0)).getField("failure_pattern"), F.lit("unknown"))
    log = lambda x: x["log_snippet"] if most_chars is None else F.substring(x["log_snippet"], 1, most_chars)
    lines = F.transform(tasks if most_tasks is None else F.slice(tasks, 1, most_tasks), lambda x: F.concat(x["task_id"], F.lit(": "), x["failure_pattern"], F.lit(" - "), log(x)))
    return failed.select(
        incident_id(F.col("dag_id"), F.col("run_id"), when).alias("incident_id"), "pipeline_id", "dag_id", "run_id",
        F.coalesce("team", F.lit("data-engineering")).alias("team"), first.alias("pattern"), case_map(first, SEVERITY, "P3").alias("severity"),
        case_map(first, CAUSE, "dag_failure").alias("cause_hint"), F.coalesce(F.size(tasks), F.lit(0)).alias("n_tasks"),
        F.array_join(lines, "\n").alias("summary"), F.col(when).alias("occurred_at"))


def sla_incidents(missed: DataFrame, when: str) -> DataFrame:
    return missed.select(
        incident_id(F.col("dag_id"), F.concat(F.lit("sla_"), "run_id"), when).alias("incident_id"), "dag_id", "run_id",
        F.concat(F.lit("Job '"), "dag_id", F.lit("' has been running for "), F.format_string("%.1f", "elapsed_minutes"), F.lit(" minutes")).alias("description"),
        F.lit("P3").alias("severity"), F.lit("timeout").alias("classification"), F.col(when).alias("occurred_at"))


def config_messages(updates: DataFrame) -> DataFrame:
    """Key and JSON value for the configuration topic."""
    return updates.select(F.col("config_key").alias("key"), F.to_json(F.struct("config_key", "config_value", "scope", F.lit("config.republished").alias("event_type"))).alias("value"))


def external_priority(severity) -> Column:
    return case_map(F.upper(col(severity)), EXTERNAL_PRIORITY, "3")


def dedup_stream(df: DataFrame, keys, ts: str, window: str = "60 minutes") -> DataFrame:
    """First event per key; repeats inside the watermark delay are dropped."""
    return df.withWatermark(ts, window).dropDuplicatesWithinWatermark(list(keys))


def dedup_slots(df: DataFrame, keys, ts: str, order, seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Batch form on fixed slots: first event per key and slot."""
    slot = F.floor(epoch(ts) / seconds).cast("long")
    return top_per_group(df.withColumn("slot", slot), [*keys, "slot"], order, 1)


def merge_batches(path: str, keys, combine: dict):
    """foreachBatch function that folds streaming aggregates into a batch table: `combine` maps a
    measure to sum, min or max.  Each batch writes its own partition once and readers fold the
    partitions, so a replayed batch replaces itself and nothing is rewritten."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fns = {"sum": F.sum, "min": F.min, "max": F.max}
        g = batch.groupBy(*keys).agg(*[fns[f](c).alias(c) for c, f in combine.items()])
        g.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
    return write


def read_merged(spark, path: str, keys, combine: dict) -> DataFrame:
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    return spark.read.parquet(path).groupBy(*keys).agg(*[fns[f](c).alias(c) for c, f in combine.items()])
