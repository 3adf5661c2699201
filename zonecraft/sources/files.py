"""File scans and landing-side helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecraft.functions.exprs import all_of
from zonecraft.operators.window import top_per_group


def read_csv(spark: SparkSession, path, delimiter: str = ",", header_rows: int = 1,
             encoding: str = "UTF-8", footer_rows: int = 0, multiline: bool = False,
             schema=None) -> DataFrame:
    """Quoted CSV.  One header row of each file is taken by the reader; further ones are skipped as data.
    Values with line breaks need `multiline`, which makes a file one task."""
    r = (spark.read.option("header", header_rows > 0).option("sep", delimiter)
         .option("quote", '"').option("escape", '"').option("multiLine", multiline)
         .option("encoding", encoding).option("ignoreLeadingWhiteSpace", True)
         .option("ignoreTrailingWhiteSpace", True))
    if schema is not None:
        r = r.schema(schema)
    return skip_rows(r.csv(path), max(header_rows - 1, 0), footer_rows)


def read_tsv(spark: SparkSession, path, header: bool = True) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", header).csv(path)


def read_json(spark: SparkSession, path, multiline: bool = False, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path) -> DataFrame:
    return spark.read.orc(path)


def read_avro(spark: SparkSession, path) -> DataFrame:
    """Needs the Avro module of the Spark distribution on the class path."""
    return spark.read.format("avro").load(path)


def read_xml(spark: SparkSession, path, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw_line")


def read_api_staged(spark: SparkSession, path, record_path: str | None = None, multiline: bool = True) -> DataFrame:
    """Staged API responses, a document per file; `record_path` names the array of records in each page."""
    pages = read_json(spark, path, multiline)
    return explode_records(pages, record_path) if record_path else pages


def explode_records(pages: DataFrame, record_path: str) -> DataFrame:
    """A row per record of the array that `record_path` names in each page."""
    return pages.select(F.explode(F.col(record_path)).alias("r")).select("r.*")


READERS = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet,
           "orc": read_orc, "avro": read_avro, "text": read_lines, "fixed_width": read_lines}


def read_any(spark: SparkSession, fmt: str, path, **options) -> DataFrame:
    return READERS[fmt](spark, path, **options)


def detect_schema(spark: SparkSession, path, fmt: str, delimiter: str = ",") -> list[dict]:
    """Column list of a sample file."""
    if fmt in ("csv", "tsv"):
        sep = "\t" if fmt == "tsv" else delimiter
        df = spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)
    else:
        df = read_any(spark, fmt, path)
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]


def infer_types(df: DataFrame) -> DataFrame:
    """Narrowest type that holds every non-null value of each string column, in one pass."""
    tries = [("bigint", "bigint"), ("double", "double"), ("timestamp", "timestamp")]
    aggs = []
    for c in df.columns:
        x = F.col(c)
        aggs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count(x).alias("non_null"),
            *[F.count(x.try_cast(t)).alias(n) for t, n in tries]).alias(c))
    row = df.agg(*aggs)
    long = row.select(F.inline(F.array(*[F.col(c) for c in df.columns])))
    kind = F.lit("string")
    for _, n in reversed(tries):
        kind = F.when((F.col("non_null") > 0) & (F.col(n) == F.col("non_null")), F.lit(n)).otherwise(kind)
    return long.select("column_name", "non_null", kind.alias("inferred_type"))


def skip_rows(df: DataFrame, head: int = 0, foot: int = 0) -> DataFrame:
    """Drop the first `head` and last `foot` rows of every file of a scan.

    Rows of a file are ordered by the block they were read from and their place in it.  The rows to
    drop are a top-n per file, cut before the shuffle; nothing is renumbered."""
    if not head and not foot:
        return df
    x = df.withColumns({"_zc_file": F.col("_metadata.file_path"), "_zc_block": F.col("_metadata.file_block_start"), "_zc_id": F.monotonically_increasing_id()})
    cut = None
    for n, order in ((head, ["_zc_block", "_zc_id"]), (foot, [F.desc("_zc_block"), F.desc("_zc_id")])):
        if n:
            part = top_per_group(x.select("_zc_file", "_zc_block", "_zc_id"), ["_zc_file"], order, n).select("_zc_id")
            cut = part if cut is None else cut.union(part)
    return x.join(cut, "_zc_id", "left_anti").drop("_zc_id", "_zc_block", "_zc_file")


def to_landing(df: DataFrame) -> DataFrame:
    """Schema-less landing form: every column as string."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def landing_audit(df: DataFrame, feed_id: str, batch_id: str, source_file: Column | None = None) -> DataFrame:
    return df.withColumns({
        "_feed_id": F.lit(feed_id), "_batch_id": F.lit(batch_id),
        "_load_timestamp": F.current_timestamp(),
        "_source_file": F.input_file_name() if source_file is None else source_file})


# Date patterns of file names, tried in this order (year, month, day groups).
_Y, _M, _D = r"(\d{4})", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
DATE_PATTERNS = [
    ("YYYYMMDD", _Y + _M + _D, (1, 2, 3)),
    ("YYYY-MM-DD", _Y + "[-_]" + _M + "[-_]" + _D, (1, 2, 3)),
    ("MMDDYYYY", _M + _D + _Y, (3, 1, 2)),
    ("MM-DD-YYYY", _M + "[-_]" + _D + "[-_]" + _Y, (3, 1, 2)),
    ("DDMMYYYY", _D + _M + _Y, (3, 2, 1)),
]


def reporting_date(file_name: Column, hint: str | None = None) -> Column:
    """Business date in a file name as DATE, or NULL; `hint` restricts to one pattern."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    hits = []
    for name, pattern, (y, m, d) in DATE_PATTERNS:
        if hint is None or name == hint.upper():
            part = lambda g: F.regexp_extract(stem, pattern, g)
            hits.append(F.try_to_date(F.concat_ws("-", part(y), part(m), part(d)), "yyyy-MM-dd"))
    return F.coalesce(*hits) if hits else F.lit(None).cast("date")


def new_files(listing: DataFrame, log: DataFrame, keys=("feed_id", "file_name")) -> DataFrame:
    """Files without a successful load in the log."""
    done = log.filter(F.col("status") == "success").select(*keys).distinct()
    return listing.join(done, list(keys), "left_anti")


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a shell pattern with `*`, `?` and `[...]`."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        j = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif j > 0:
            body = glob[i + 1:j]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j
        else:
            out += "\\" + ch if ch in r"\.^$|()+{}[]" else ch
        i += 1
    return "^(?s:" + out + ")$"


def file_events(listing: DataFrame, bucket: str, prefix: str = "", glob: str = "*", min_size: int = 0) -> DataFrame:
    """File notifications that should start a load."""
    return listing.filter(all_of([
        F.col("bucket") == bucket, F.col("name").startswith(prefix),
        F.col("name").rlike(glob_regex(glob)), F.col("size") >= min_size]))


def size_plan(listing: DataFrame, size_col: str = "size", partition_mb: int = 128, big_gb: float = 10.0) -> DataFrame:
    """Partition count and big-data flag from the file size in bytes."""
    gb = F.col(size_col) / F.lit(float(1 << 30))
    return listing.withColumns({
        "size_gb": gb,
        "num_partitions": F.greatest(F.lit(1), F.floor(gb * 1024 / partition_mb)).cast("long"),
        "is_big": gb >= big_gb})


def partitioning_advice(df: DataFrame, rows: str, requested: str, has_keys: str) -> DataFrame:
    """Recommended layout from a row estimate; 500,000 rows per partition."""
    n, req = F.col(rows), F.lower(F.col(requested))
    rec = (F.when(n < 0, F.col(requested)).when(n < 100_000, F.lit("no_partitioning"))
           .when(n < 10_000_000, F.lit("ingestion_date"))
           .when(n < 1_000_000_000, F.when(F.col(has_keys), F.lit("ingestion_date + source_region"))
                 .otherwise(F.lit("ingestion_date")))
           .otherwise(F.lit("ingestion_date + bucket_by_id")))
    ok = (F.when(n < 0, F.lit(True)).when(n < 100_000, F.col(requested).isin("no_partitioning", "ingestion_date"))
          .when(n < 10_000_000, F.lit(True)).when(n < 1_000_000_000, req.contains("date"))
          .otherwise(req.contains("bucket") | req.contains("ingestion_date")))
    parts = F.when(n <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 500_000))).cast("long")
    return df.withColumns({
        "recommended": rec, "is_appropriate": ok, "est_partitions": parts,
        "rows_per_partition": F.when(n < 0, F.lit(0)).otherwise(
            F.floor(n / F.greatest(F.lit(1), parts))).cast("long")})
