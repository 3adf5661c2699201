"""Stream sources, triggers and checkpointed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Reader format, option name and configuration key per source type.
SOURCE_OPTIONS = {
    "kafka": ("kafka", [("kafka.bootstrap.servers", "bootstrap.servers", ""), ("subscribe", "topic", ""), ("startingOffsets", "auto.offset.reset", "earliest"),
                        ("failOnDataLoss", "fail_on_data_loss", False), ("kafka.group.id", "group.id", "")]),
    "pubsub": ("pubsub", [("projectId", "project_id", ""), ("subscriptionId", "subscription", ""), ("maxMessagesPerBatch", "max_messages", 1000)]),
    "kinesis": ("kinesis", [("streamName", "stream_name", ""), ("region", "region", ""), ("startingPosition", "shard_iterator_type", "TRIM_HORIZON"),
                            ("endpointUrl", "endpoint_url", "")]),
    "eventhub": ("eventhubs", [("eventhubs.connectionString", "connection_string", ""), ("eventhubs.consumerGroup", "consumer_group", "$Default")]),
}


def source_options(source_type: str, config: dict) -> tuple[str, dict]:
    """(format, options) for readStream from a consumer configuration."""
    fmt, opts = SOURCE_OPTIONS[source_type]
    out = {o: str(config.get(c, d)).lower() if isinstance(config.get(c, d), bool) else str(config.get(c, d)) for o, c, d in opts}
    if source_type == "kafka" and config.get("schema.registry.url"):
        out["schema.registry.url"] = config["schema.registry.url"]
    return fmt, {k: v for k, v in out.items() if v != ""}


# what a micro-batch takes by default, so that its size is bounded after a pause too
LIMITS = {"kafka": ("maxOffsetsPerTrigger", "max_offsets", 5_000_000), "eventhub": ("maxEventsPerTrigger", "max_events", 5_000_000), "file": ("maxFilesPerTrigger", "max_files", 1_000)}


def limit_of(source_type: str, config: dict) -> dict:
    """The option that bounds a micro-batch of a source; a configured None takes everything there is."""
    if source_type not in LIMITS:
        return {}
    option, key, default = LIMITS[source_type]
    most = config.get(key, default)
    return {} if most is None else {option: str(most)}


def read_stream(spark: SparkSession, source_type: str, config: dict) -> DataFrame:
    """Connector streams need the connector on the class path; `file` and `rate` are built in."""
    if source_type == "rate":
        return spark.readStream.format("rate").options(**{k: str(v) for k, v in config.items()}).load()
    if source_type == "file":
        r = spark.readStream.schema(config["schema"]).format(config.get("format", "parquet"))
        return r.options(**limit_of("file", config)).load(config["path"])
    fmt, opts = source_options(source_type, config)
    return spark.readStream.format(fmt).options(**opts, **limit_of(source_type, config)).load()


def trigger_of(mode: str, interval: str = "1 minute") -> dict:
    """Trigger arguments for batch (drain and stop) or micro-batch runs."""
    return {"availableNow": True} if mode == "batch" else {"processingTime": interval}


def run(df: DataFrame, checkpoint: str, *, path: str | None = None, each=None, output: str = "append", mode: str = "batch",
        fmt: str = "parquet", interval: str = "1 minute"):
    """Start a checkpointed query into files or through `each(batch, id)`.  Offsets and state live
    in the checkpoint, so a restart continues where the last committed batch ended."""
    w = df.writeStream.outputMode(output).option("checkpointLocation", checkpoint).trigger(**trigger_of(mode, interval))
    return w.foreachBatch(each).start() if each else w.format(fmt).option("path", path).start()
