"""Mainframe-style records: fixed layouts, EBCDIC and packed decimals, RDW files, trailers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecraft.functions.exprs import col
from zonecraft.session import store


def slice_fixed(df: DataFrame, layout, source: str = "raw_line", keep=()) -> DataFrame:
    """Cut text by `(name, start, length)`, 1-based; length None takes the rest of the line."""
    cut = []
    for name, start, length in layout:
        n = F.length(source) if length is None else F.lit(length)
        cut.append(F.trim(F.substring(F.col(source), F.lit(start), n)).alias(name))
    return df.select(*keep, *cut)


def ebcdic_text(raw: Column, codepage: str = "cp037") -> Column:
    """Single-byte code page to text, with a byte table taken from the codec's own rule."""
    table = bytes(range(256)).decode(codepage, errors="replace")
    latin = bytes(range(256)).decode("latin-1")
    return F.translate(F.decode(raw, "ISO-8859-1"), latin, table)


def to_ebcdic(text: Column, length: int, codepage: str = "cp037") -> Column:
    """Text as a field of `length` bytes of a single-byte code page, padded with blanks."""
    table = bytes(range(256)).decode(codepage, errors="replace")
    latin = bytes(range(256)).decode("latin-1")
    return F.encode(F.translate(F.rpad(text, length, " "), table, latin), "ISO-8859-1")


def to_packed(value: Column, length: int, scale: int = 0) -> Column:
    """A number as COMP-3 bytes."""
    whole = (F.abs(value.cast(f"decimal({2 * length},{scale})")) * 10 ** scale).cast("bigint").cast("string")
    return F.unhex(F.concat(F.lpad(whole, 2 * length - 1, "0"), F.when(value < 0, "D").otherwise("C")))


def to_binary(value: Column, length: int) -> Column:
    """A whole number as a signed big-endian COMP field of up to 8 bytes."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * length)))


def packed_decimal(raw: Column, length: int, scale: int = 0) -> Column:
    """COMP-3 bytes: two digits per byte, the last nibble is the sign (B or D negative)."""
    digits = F.substring(F.hex(raw), 1, 2 * length - 1)
    whole = F.substring(digits, 1, 2 * length - 1 - scale)
    text = F.concat(whole, F.lit("."), F.substring(digits, 2 * length - scale, scale)) if scale else whole
    value = F.concat(F.lit("0"), text).try_cast(f"decimal({max(2 * length, scale + 1)},{scale})")
    return F.when(F.substring(F.hex(raw), 2 * length, 1).isin("B", "D"), -value).otherwise(value)


def binary_number(raw: Column, length: int) -> Column:
    """Signed big-endian COMP field of up to 8 bytes."""
    v = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    wrap = F.lit(str(2 ** (8 * length))).cast("decimal(20,0)")
    half = F.lit(str(2 ** (8 * length - 1))).cast("decimal(20,0)")
    return F.when(v >= half, v - wrap).otherwise(v).cast("long")


def decode_ebcdic(df: DataFrame, layout, source: str = "record", codepage: str = "cp037", keep=()) -> DataFrame:
    """Decode fixed-length binary records.

    `layout` holds dicts `name, offset (0-based), length, kind (text | comp | comp3), scale`."""
    out = []
    for f in layout:
        raw = F.substring(F.col(source), f["offset"] + 1, f["length"])
        kind = f.get("kind", "text")
        if kind == "comp3":
            v = packed_decimal(raw, f["length"], f.get("scale", 0))
        elif kind == "comp":
            v = binary_number(raw, f["length"])
        else:
            v = F.trim(ebcdic_text(raw, codepage))
        out.append(v.alias(f["name"]))
    return df.select(*keep, *out)


RANGE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20


def opened(path: str):
    """A file for reads at any place, by the file systems of pyarrow; a path without scheme is local."""
    from pyarrow import fs
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"
    system, where = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def listed(spark: SparkSession, path) -> DataFrame:
    """(path, length) of files, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _records(ranges: DataFrame, cut) -> DataFrame:
    """(path, record_no, record) of ranges (path, first_no, start, stop): each is read in a task of its own
    choosing, a piece at a time; `cut(data, last)` gives starts, ends and how many bytes are used up."""

    def work(batches):
        import pyarrow as pa
        for batch in batches:
            for path, number, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as f:
                    f.seek(start)
                    data, at = b"", start
                    while at < stop:
                        piece = f.read(min(PIECE_BYTES, stop - at))
                        if not piece:
                            raise ValueError(f"{path}: ends at byte {at}, before byte {stop}")
                        at += len(piece)
                        data += piece
                        starts, ends, used = cut(data)
                        if starts:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([path] * len(starts)), pa.array(range(number, number + len(starts)), pa.int64()), pa.array([data[a:b] for a, b in zip(starts, ends)], pa.binary())],
                                ["path", "record_no", "record"])
                        number, data = number + len(starts), data[used:]
                    if data:
                        raise ValueError(f"{path}: a record is cut off at byte {stop}")

    spread = ranges.select("path", "first_no", "start", "stop").repartition(F.col("path"), F.col("start"))
    return spread.mapInArrow(work, "path string, record_no bigint, record binary")


def read_fixed_records(spark: SparkSession, path, record_length: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, record_no, record) of files of fixed-length binary records, in ranges of at most `range_bytes` that
    end where a record does.  A file whose length is not a multiple of the record's is an error."""
    each = max(1, range_bytes // record_length)
    whole = F.when(F.col("length") % record_length != 0, F.raise_error(F.concat("path", F.lit(f": not a multiple of {record_length} bytes")))).otherwise(F.col("length"))
    files = listed(spark, path).select("path", whole.cast("bigint").alias("length"))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {each * record_length}"))).alias("i")
    ranges = files.filter("length > 0").select("path", "length", numbers).select(
        "path", (F.col("i") * each).alias("first_no"), (F.col("i") * each * record_length).alias("start"), F.least((F.col("i") + 1) * each * record_length, "length").alias("stop"))

    def cut(data):
        n = len(data) // record_length
        return [i * record_length for i in range(n)], [(i + 1) * record_length for i in range(n)], n * record_length

    return _records(ranges, cut)


def rdw_borders(spark: SparkSession, path, rdw_length: int = 4, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, first_no, start, stop): ranges of whole variable-length records of about `range_bytes`.

    One pass follows the chain of lengths from header to header, skipping what lies between; a file is one
    task here, as each length says where the next one stands, but none of its records is kept.  A length shorter
    than its header, or that goes beyond the file, is an error that names the file and place."""

    def work(batches):
        import pyarrow as pa
        for batch in batches:
            for name, length in zip(*(c.to_pylist() for c in batch.columns)):
                found, at, number, begin, first = [], 0, 0, 0, 0
                window, base = b"", 0
                with opened(name) as f:
                    while at < length:
                        if not base <= at <= base + len(window) - 2:
                            f.seek(at)
                            window, base = f.read(1 << 16), at
                        size = int.from_bytes(window[at - base:at - base + 2], "big") if at + rdw_length <= length else -1
                        if size < rdw_length or at + size > length:
                            raise ValueError(f"{name}: record {number} at byte {at} has length {max(size, 0)}, the file {length} bytes")
                        at, number = at + size, number + 1
                        if at - begin >= range_bytes or at == length:
                            found.append((name, first, begin, at))
                            begin, first = at, number
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)], ["path", "first_no", "start", "stop"])

    return listed(spark, path).repartition("path").mapInArrow(work, "path string, first_no bigint, start bigint, stop bigint")


def read_rdw(spark: SparkSession, path, rdw_length: int = 4, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, record_no, record) of variable-length records: a big-endian 2-byte length (header included)
    leads each one.  The borders are found once and stored; then all ranges are read side by side."""

    def cut(data):
        at, starts, ends = 0, [], []
        while at + rdw_length <= len(data):
            size = int.from_bytes(data[at:at + 2], "big")
            if at + size > len(data):
                break
            starts.append(at + rdw_length)
            ends.append(at + size)
            at += size
        return starts, ends, at

    return _records(store(rdw_borders(spark, path, rdw_length, range_bytes)), cut)


def record_type(source, offset: int, length: int) -> Column:
    """Indicator field of a record (0-based offset)."""
    return F.substring(col(source), offset + 1, length)


def split_by_type(df: DataFrame, types, source: str = "raw_line", offset: int = 0, length: int = 1) -> dict:
    """One lazily filtered DataFrame per record type."""
    t = record_type(source, offset, length)
    return {k: df.filter(t == k) for k in types}


def check_trailer(df: DataFrame, file_key, index: str, claimed: Column) -> DataFrame:
    """Compare the count a file's last record claims with the number of records before it."""
    keys = [file_key] if isinstance(file_key, str) else list(file_key)
    return (df.groupBy(*keys)
            .agg(F.max_by(claimed, F.col(index)).alias("expected_count"),
                 (F.count(F.lit(1)) - 1).alias("actual_count"))
            .withColumn("difference", F.col("actual_count") - F.col("expected_count"))
            .withColumn("valid", F.coalesce(F.col("difference") == 0, F.lit(False))))
