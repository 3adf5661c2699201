"""Sinks and the set operations behind reloads and merges."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecraft.functions.exprs import null_safe_join
from zonecraft.operators.window import top_per_group

TRUNC = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def write_zone(df: DataFrame, path: str, partition_by=("_reporting_date",), mode: str = "overwrite") -> None:
    """Partitioned Parquet; overwriting replaces only the partitions present in `df`."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# ---- versioned tables ------------------------------------------------------------------------
#
# A table is a folder of data folders, which are written once, and of numbered manifests.  A manifest
# lists the data folders of each partition; the one with the greatest number is the table.  A change
# writes its new data beside the old and then one small manifest, so a reader sees all of it or nothing,
# a failure in between leaves the last version as it was, and nothing is renamed.  One writer at a time.

MANIFESTS, DATA = "_manifests", "data"


def _at(path: str):
    """(file system, folder) of a path, by pyarrow; a path without scheme is local."""
    from pyarrow import fs
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"
    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)


def _names(system, folder: str, kind) -> list[str]:
    from pyarrow import fs
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == kind)


def manifest(path: str) -> dict | None:
    """The newest manifest: version, partition_by, schema and {partition folder: data folders}; None before the first."""
    from pyarrow import fs
    system, folder = _at(path)
    found = [n for n in _names(system, f"{folder}/{MANIFESTS}", fs.FileType.File) if n.endswith(".json")]
    if not found:
        return None
    with system.open_input_file(f"{folder}/{MANIFESTS}/{found[-1]}") as f:
        return json.loads(f.read())


def _switch(path: str, content: dict) -> None:
    """Make `content` the table: one file under a new name, complete before it has that name."""
    system, folder = _at(path)
    name = f"{folder}/{MANIFESTS}/{content['version']:012d}"
    system.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
    with system.open_output_stream(f"{name}.part") as f:
        f.write(json.dumps(content).encode())
    system.move(f"{name}.part", f"{name}.json")


def read_versioned(spark, path: str) -> DataFrame:
    """The table as its newest manifest lists it."""
    now = manifest(path)
    if now is None:
        raise FileNotFoundError(f"no table at {path}")
    folders = sorted({f for fs_ in now["parts"].values() for f in fs_})
    schema = T.StructType.fromJson(now["schema"])
    if not folders:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/{f}/{p}" if p else f"{path}/{f}" for p, fs_ in now["parts"].items() for f in fs_]
    if not now["partition_by"]:
        return spark.read.schema(schema).parquet(*paths)
    # every data folder has its own partition folders below it
    out = None
    for f in folders:
        own = [f"{path}/{f}/{p}" for p, fs_ in now["parts"].items() if f in fs_]
        one = spark.read.schema(schema).option("basePath", f"{path}/{f}").parquet(*own)
        out = one if out is None else out.unionByName(one)
    return out.select(*schema.names)


def _written(df: DataFrame, path: str, partition_by) -> dict:
    """{partition folder: [data folder]} of new data; without partitions the one key is ''."""
    from pyarrow import fs
    folder = f"{DATA}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{path}/{folder}")
    if not partition_by:
        return {"": [folder]}
    system, root = _at(f"{path}/{folder}")
    found = [""]
    for _ in partition_by:
        found = [f"{p}/{n}" if p else n for p in found for n in _names(system, f"{root}/{p}" if p else root, fs.FileType.Directory) if "=" in n]
    return {p: [folder] for p in found}


def _commit(df: DataFrame, path: str, partition_by, parts: dict) -> None:
    before = manifest(path)
    _switch(path, {"version": before["version"] + 1 if before else 1, "partition_by": list(partition_by), "schema": json.loads(df.schema.json()), "parts": parts})


def rewrite(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace a versioned table, which `df` may itself read, by a new version."""
    _commit(df, path, partition_by, _written(df, path, partition_by))


def append_versioned(df: DataFrame, path: str) -> None:
    """Add rows to a versioned table; a first append makes it, without partitions."""
    now = manifest(path) or {"partition_by": [], "parts": {}}
    parts = {k: list(v) for k, v in now["parts"].items()}
    for k, v in _written(df, path, now["partition_by"]).items():
        parts[k] = parts.get(k, []) + v
    _commit(df, path, now["partition_by"], parts)


def reload_versioned(batch: DataFrame, path: str) -> None:
    """Delete and insert: the partitions that `batch` has are replaced by its rows, all others stay as they are
    without being read or written."""
    now = manifest(path)
    if not now or not now["partition_by"]:
        raise ValueError("only a partitioned table can be reloaded by partition")
    _commit(batch, path, now["partition_by"], {**now["parts"], **_written(batch, path, now["partition_by"])})


def upsert_versioned(batch: DataFrame, path: str, keys) -> None:
    """Merge by keys into a versioned table whose keys tell the partition: only the partitions of `batch` are read,
    merged and written anew."""
    spark, now = batch.sparkSession, manifest(path)
    if now is None:
        raise FileNotFoundError(f"no table at {path}")
    if not set(now["partition_by"]) <= set(keys):
        raise ValueError("the partition columns must be among the keys, or a row could move")
    table = read_versioned(spark, path)
    if not now["partition_by"]:
        return rewrite(upsert(table, batch.select(*table.columns), keys), path)
    touched = batch.select(*now["partition_by"]).distinct()
    # partition values are read from folder names, so a join on them prunes folders
    old = null_safe_join(table, F.broadcast(touched), now["partition_by"], "left_semi")  # one row a partition
    return reload_versioned(upsert(old, batch.select(*table.columns), keys), path)


def drop_old_versions(path: str, keep: int = 2) -> int:
    """Delete the data folders that none of the newest `keep` manifests lists, then older manifests; how many
    folders went.  Readers of older versions must have ended."""
    from pyarrow import fs
    system, folder = _at(path)
    names = [n for n in _names(system, f"{folder}/{MANIFESTS}", fs.FileType.File) if n.endswith(".json")]
    used = set()
    for n in names[-keep:]:
        with system.open_input_file(f"{folder}/{MANIFESTS}/{n}") as f:
            used |= {x.split("/", 1)[1] for xs in json.loads(f.read())["parts"].values() for x in xs}
    gone = [n for n in _names(system, f"{folder}/{DATA}", fs.FileType.Directory) if n not in used]
    for n in gone:
        system.delete_dir(f"{folder}/{DATA}/{n}")
    for n in names[:-keep]:
        system.delete_file(f"{folder}/{MANIFESTS}/{n}")
    return len(gone)


def write_table(df: DataFrame, table: str, mode: str = "append", partition_by=(), cluster_by=(), buckets: int = 0) -> None:
    """Managed table with a partition column and up to four clustering columns."""
    if len(cluster_by) > 4:
        raise ValueError("at most four clustering columns")
    if cluster_by and not buckets:
        df = df.repartitionByRange(*partition_by, *cluster_by).sortWithinPartitions(*partition_by, *cluster_by)
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if buckets and cluster_by:
        w = w.bucketBy(buckets, *cluster_by).sortBy(*cluster_by)
    w.saveAsTable(table)


def reload_partitions(existing: DataFrame, batch: DataFrame, partition: Column) -> DataFrame:
    """Delete-and-insert: every partition the batch touches is replaced by the batch."""
    touched = batch.select(partition.alias("_zc_p")).distinct()
    kept = null_safe_anti(existing.withColumn("_zc_p", partition), touched, ["_zc_p"]).drop("_zc_p")
    return kept.unionByName(batch)


def reload_period(existing: DataFrame, batch: DataFrame, date_col: str, delete_mode: str) -> DataFrame:
    """Reload by calendar period: none | daily | weekly | monthly | yearly."""
    if delete_mode == "none":
        return existing.unionByName(batch)
    return reload_partitions(existing, batch, F.date_trunc(TRUNC[delete_mode], F.col(date_col)))


def null_safe_anti(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return null_safe_join(left, right, keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys) -> DataFrame:
    """Merge by keys: matched rows take the source values, unmatched source rows are added.
    One full outer join; each side has one row per key."""
    keys, cols = list(keys), target.columns
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_s"))
    cond = [target[k].eqNullSafe(s[f"_s_{k}"]) for k in keys]
    j = target.join(s, cond, "full_outer")
    return j.select(*[F.when(F.col("_s"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def append_since(target: DataFrame, source: DataFrame, watermark: str) -> DataFrame:
    """Append source rows later than the newest target row."""
    last = target.agg(F.max(watermark)).scalar()
    return target.unionByName(source.filter(last.isNull() | (F.col(watermark) > last)))


def apply_changes(changes: DataFrame, keys, order, op_col: str, delete_op: str = "DELETE") -> DataFrame:
    """Current state of a change log: last change per key, deleted keys removed."""
    last = top_per_group(changes, keys, [F.desc(c) for c in order], 1)
    return last.filter(~F.col(op_col).eqNullSafe(F.lit(delete_op)))


def reorder(df: DataFrame, first) -> DataFrame:
    """Listed columns first (those present), all others after in their order."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def define_view(spark, name: str, statement: str, **params) -> DataFrame:
    """Parameterised SQL registered as a view of a zone."""
    df = spark.sql(statement, args=params) if params else spark.sql(statement)
    df.createOrReplaceTempView(name)
    return df
