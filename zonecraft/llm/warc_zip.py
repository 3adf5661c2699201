"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file of stored members: `archive/data.warc.gz`, whose records are gzip members
of their own, and `indexes/index.cdxj`, one line per record with its offset and length.  The reader
parses the central directory (with its ZIP64 fields) from the end of the file, finds where the
members lie, reads the indexes by range, and then reads records by range: nothing is
extracted, and any record is one small read, so archives and records are spread over tasks.  It also takes
archives of other writers, with several data members (the index names them), and indexes that are
gzipped or deflated; data that is not stored cannot be read by range and is an error.

Archives lie in a folder that driver and executors share, named by a URI that pyarrow's file systems
know (file, s3, gs, hdfs)."""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from zonecraft.session import checkpoint_dir, store

DATA, INDEX, SAME_FROM = "archive/data.warc.gz", "indexes/index.cdxj", 100
ROLL = 64 << 20  # bytes of records after which a task starts another archive
BATCH, BATCH_BYTES = 256, 8 << 20  # records, and bytes of payloads, that are returned together
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


# ---- writing ----------------------------------------------------------------------------------

def _header(value) -> str:
    """A header value: control characters and non-ASCII are percent-encoded."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def _id(value) -> str:
    """An id as a header value that can be read back."""
    return quote(str(value), safe="!#$&'()*+,/:;=?@[]~ ") if not isinstance(value, int) else str(value)


def record_bytes(kind: str, page_id, url, payload: bytes, digest: str, refers_to, length: int) -> bytes:
    """One record as a gzip member; `length` is that of the payload, which a revisit does not hold."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _header(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", _id(page_id)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", length)]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", _id(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def _write_archive(folder: str, records, count: int) -> str:
    """Writes records into one archive, both members stored; returns its name."""
    files, root = open_folder(folder)
    name = f"{uuid.uuid4().hex}.wacz"
    index, at = [], 0
    with files.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for key, data in records:
                member.write(data)
                index.append(f"{key} {json.dumps({'offset': at, 'length': len(data)})}\n")
                at += len(data)
        with archive.open(zipfile.ZipInfo(INDEX), "w") as member:
            member.write("".join(index).encode())
    return name


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes (page_id, url, payload, digest, kind, refers_to, payload_bytes) as archives into `folder`; returns
    (archive, records) of those that count.

    A task that runs again writes other names, and only names in the stored result count, so lost
    executors and speculative tasks do no harm."""

    def work(batches):
        names, counts, held, size = [], [], [], 0

        def close():
            nonlocal held, size
            if held:
                names.append(_write_archive(folder, held, len(held)))
                counts.append(len(held))
            held, size = [], 0

        for batch in batches:
            for kind, page_id, url, payload, digest, refers_to, length in zip(*(c.to_pylist() for c in batch.columns)):
                data = record_bytes(kind, page_id, url, payload or b"", digest, refers_to, length)
                held.append(("-" if page_id is None else quote(str(page_id), safe=""), data))
                size += len(data)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    return store(pages.select("kind", "page_id", "url", "payload", "digest", "refers_to", "payload_bytes").mapInArrow(work, "archive string, records bigint"))


def new_folder(spark) -> str:
    """A folder of its own below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


# ---- reading ----------------------------------------------------------------------------------

def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """The values of a ZIP64 extra field for those of `wanted` that are all ones, in order."""
    at, found = 0, []
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            body, i = extra[at + 4:at + 4 + size], 0
            for value, width in zip(wanted, (8, 8, 8)):
                if value == 0xFFFFFFFF:
                    if i + width > len(body):
                        raise ValueError("short ZIP64 field")
                    value, i = int.from_bytes(body[i:i + width], "little"), i + width
                found.append(value)
            return found
        at += 4 + size
    if 0xFFFFFFFF in wanted:
        raise ValueError("no ZIP64 field")
    return wanted


def directory(file, size: int) -> dict[str, tuple[int, int]]:
    """name -> (where its bytes begin, how many) of the stored members of a ZIP file."""
    return {name: (at, n) for name, (at, n, method) in members_of(file, size).items() if method == 0}


def members_of(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (where its bytes begin, how many, compression method) of the members of a ZIP file, from its
    end record, ZIP64 end record, central directory and the members' local headers."""
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        got = file.read(n)
        if len(got) < n:
            raise ValueError("the archive is cut off")
        return got

    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end record")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    entries, at, members = read(start, length), 0, {}
    for _ in range(count):
        if entries[at:at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, = struct.unpack_from("<H", entries, at + 10)
        packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", entries, at + 20)
        local, = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46:at + 46 + name_n].decode()
        full, packed, local = _zip64(entries[at + 46 + name_n:at + 46 + name_n + extra_n], [full, packed, local])
        at += 46 + name_n + extra_n + note_n
        head = read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        members[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method)
    return members


def index_of(file, members: dict[str, tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(where it begins in the file, length) of every record that the indexes of an archive list."""
    data = [n for n in members if n.startswith("archive/") and not n.endswith("/")]
    found = []
    for name in sorted(n for n in members if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdxj", ".cdx"))):
        at, size, method = members[name]
        file.seek(at)
        raw = file.read(size)
        if method == 8:
            raw = zlib.decompress(raw, -15)
        elif method:
            raise ValueError(f"{name} is packed by method {method}")
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
            if "{" in line:  # others are comments or lead to further blocks
                entry = json.loads(line[line.index("{"):])
                if "offset" not in entry or "length" not in entry:
                    continue
                of = f"archive/{entry['filename']}" if "filename" in entry else data[0] if len(data) == 1 else None
                if of not in members:
                    raise ValueError(f"{name} names no member of the archive: {line[:200]}")
                begin, _, packed = members[of]
                if packed:
                    raise ValueError(f"{of} is packed by method {packed}; records can be read from stored members only")
                found.append((begin + int(entry["offset"]), int(entry["length"])))
    return found


def index_rows(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, at, length) of every record of the archives named in `archive`, from their indexes."""

    def work(batches):
        files, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{root}/{name}") as f:
                    entries = index_of(f, members_of(f, f.size()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(entries), pa.string()), *(pa.array([e[i] for e in entries], pa.int64()) for i in (0, 1))], ["archive", "at", "length"])

    return archives.select("archive").mapInArrow(work, "archive string, at bigint, length bigint")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP payload of a record's bytes."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_records(entries: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, kind, digest, refers_to, payload, payload_bytes) of the records at (archive, at, length); the payload
    of a revisit is null, its length what its record says.  `id_type` is bigint or string."""

    def work(batches):
        import re
        files, root = open_folder(folder)
        name, file, found, size = None, None, [], 0
        number = lambda fields, k: None if k not in fields else int(fields[k]) if id_type == "bigint" else unquote(fields[k])
        own = pa.int64() if id_type == "bigint" else pa.string()
        types = (own, pa.string(), pa.string(), pa.string(), own, pa.binary(), pa.int64())

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "kind", "digest", "refers_to", "payload", "payload_bytes"])

        for batch in batches:
            for archive, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, files.open_input_file(f"{root}/{archive}")
                file.seek(at)
                fields, payload = parse_record(file.read(length))
                response = fields["warc-type"] != "revisit"
                digest = re.sub(r"^sha-?256:", "", fields.get("warc-payload-digest", ""))
                found.append((number(fields, "x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], digest, number(fields, "x-refers-to-page-id"),
                              payload if response else None, len(payload) if response else int(fields["x-payload-length"]) if "x-payload-length" in fields else None))
                size += len(payload)
                if len(found) >= BATCH or size >= BATCH_BYTES:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)
        if file is not None:
            file.close()

    return entries.select("archive", "at", "length").mapInArrow(work, f"page_id {id_type}, url string, kind string, digest string, refers_to {id_type}, payload binary, payload_bytes bigint")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", same_from: int = SAME_FROM) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to, payload_bytes): a record for every page; ids that are no
    whole numbers are strings.

    Of pages with equal payloads of at least `same_from` bytes, those with the smallest id are
    responses and the others revisit them; shorter payloads are all responses.  A null payload is
    empty.  Null ids count as largest; if all of a group are null, all are responses.  Repeated rows
    of the smallest id are all responses."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    x = pages.select(F.col(id_col).cast(id_type_of(pages, id_col)).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = x.filter(F.octet_length("payload") >= same_from)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "first")
    joined = x.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
                         F.octet_length("payload").cast("long").alias("payload_bytes"))


def id_type_of(pages: DataFrame, id_col: str) -> str:
    return "bigint" if isinstance(pages.schema[id_col].dataType, IntegralType) else "string"


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """(page_id, url, kind, digest, refers_to, payload, payload_bytes): every page's record, written to archives
    and read back, each once.  `payload` of a revisit is null and its length what its record says.
    Control characters of an address come back percent-encoded.  An empty table gives no rows."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark)
    archives = write_archives(with_revisits(pages, id_col, url_col, html_col), folder)
    entries = store(index_rows(archives.repartition(spark.sparkContext.defaultParallelism, "archive"), folder))
    return read_records(entries, folder, id_type_of(pages, id_col))
