"""Session helpers: defaults, lineage cutting and size-checked broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# runtime settings the operators rely on: skewed join partitions are split even where that costs
# another exchange, and timestamps without zone read as UTC
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

BROADCAST_LIMIT = 64 << 20


def tune(spark: SparkSession) -> SparkSession:
    for k, v in TUNING.items():
        spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, app: str = "zonecraft", **conf: str) -> SparkSession:
    """A session with the library defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **TUNING, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_private_dir: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a private one only where none
    is set on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private_dir:
        _private_dir[app] = tempfile.mkdtemp(prefix="zonecraft-")
        # what a local run has stored goes with the process; a cluster's shared folder is its owner's to clear
        atexit.register(shutil.rmtree, _private_dir[app], ignore_errors=True)
    return _private_dir[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: it survives lost executors and stops plan growth
    in iterations."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


# Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def store(df: DataFrame) -> DataFrame:
    """Like cut_lineage, as a Parquet table of the shared folder: for large results that several
    later jobs read, since columns are pruned and the size is known to the planner.  What the job
    has shuffled goes when it ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/zonecraft-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    _stored[stored] = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `store` returned and nothing will read again, also not a result that is still to
    be computed.  Other DataFrames are left alone."""
    for df in tables:
        if path := _stored.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the estimate proves it small; otherwise leave the join to
    the shuffle strategies (with adaptive skew splitting)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def partition_count(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the configured number, at least one per task slot."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan with fewer partitions than the cluster has task slots, for operators that
    spend much time per row; a scan that is already wide is left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
