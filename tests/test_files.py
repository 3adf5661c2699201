"""Scans, landing helpers and sinks on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from zonecraft.operators import quality as Q
from zonecraft.operators import rules as R
from zonecraft.plans import registry
from zonecraft.sources import extract, files, legacy, sinks


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_csv_headers_footers_and_quotes(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,name\nsecond header,x\n1,"O\'Brien, ""Jr"""\n2,"two\nlines"\n3,  pad  \nTOTAL,3\n')
    got = rows(files.read_csv(spark, p, header_rows=2, footer_rows=1, multiline=True))
    assert got == [("1", 'O\'Brien, "Jr"'), ("2", "two\nlines"), ("3", "pad")]
    assert len(rows(files.read_csv(spark, p, header_rows=0, multiline=True))) == 6


def test_skip_rows_keeps_duplicates(spark, tmp_path):
    p = write(tmp_path / "a.txt", "h\nx\nx\nx\nf\n")
    assert [r[0] for r in rows(files.skip_rows(files.read_lines(spark, p), 1, 1))] == ["x", "x", "x"]


@pytest.mark.parametrize("split", [1 << 30, 60])
def test_header_and_footer_rows_of_every_file(spark, tmp_path, split):
    want = []
    for f, n in enumerate((3, 40, 0)):
        write(tmp_path / f"part{f}.csv", "id,name\nmeta,meta\n" + "".join(f"{f}-{i},n{i}\n" for i in range(n)) + f"END,{n}\n")
        want += [f"{f}-{i}" for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.read_csv(spark, str(tmp_path), header_rows=2, footer_rows=1).select("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.id for r in got) == sorted(want)


def test_extract_takes_all_rows_unless_told(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 1, F.col("id")).alias("w"))
    assert extract.extract_batch(df, "w").count() == 10
    assert extract.extract_batch(df, "w", 4).count() == 5
    assert sorted(r.id for r in extract.extract_batch(df, "w", batch_size=3).collect()) == [0, 1, 2, 3, 4]


def test_changes_without_operation_stay(spark):
    log = spark.createDataFrame([(1, 1, None), (2, 1, "DELETE"), (3, 1, "INSERT"), (3, 2, "DELETE"), (4, 1, "DELETE"), (4, 2, None)], "k int, t int, op string")
    assert sorted(r.k for r in sinks.apply_changes(log, ["k"], ["t"], "op").collect()) == [1, 4]


def test_other_formats(spark, tmp_path):
    assert rows(files.read_tsv(spark, write(tmp_path / "a.tsv", "a\tb\n1\t2\n"))) == [("1", "2")]
    assert rows(files.read_json(spark, write(tmp_path / "a.json", json.dumps([{"a": 1}, {"a": 2}])))) == [(1,), (2,)]
    page = write(tmp_path / "p.json", json.dumps({"data": {"items": [{"id": 1}, {"id": 2}]}}))
    assert rows(files.read_api_staged(spark, page, "data.items")) == [(1,), (2,)]
    x = write(tmp_path / "a.xml", "<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert rows(files.read_xml(spark, x, "row")) == [(1,), (2,)]
    spark.range(3).write.orc(str(tmp_path / "o"))
    assert files.read_orc(spark, str(tmp_path / "o")).count() == 3
    assert files.read_any(spark, "parquet", "/root/testdata/sf0.001/region.parquet").count() == 5


def test_avro_needs_its_module(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)avro"):
        files.read_avro(spark, str(tmp_path)).count()


def test_detect_schema(spark, tmp_path):
    p = write(tmp_path / "a.csv", "i,d,s\n1,2.5,x\n2,3.5,y\n")
    assert [(c["name"], c["type"]) for c in files.detect_schema(spark, p, "csv")] == [("i", "int"), ("d", "double"), ("s", "string")]


@pytest.mark.parametrize("name,hint,want", [
    ("till_20250316_b.csv", None, "2025-03-16"), ("in/members 2025-03-16.dat", None, "2025-03-16"),
    ("m03162025.csv", "MMDDYYYY", "2025-03-16"), ("d31012025.csv", None, "2025-01-31"), ("undated.csv", None, None),
    ("feb20250230.csv", None, None), ("z_11-30-2024.csv", None, "2024-11-30")])
def test_reporting_date(spark, name, hint, want):
    got = spark.range(1).select(files.reporting_date(F.lit(name), hint)).first()[0]
    assert got == (datetime.date.fromisoformat(want) if want else None)


def test_glob(spark):
    import re
    for glob, text, ok in [("*.csv", "a/b.csv", True), ("a?c.[ct]sv", "abc.tsv", True), ("a[!b]*", "abx", False), ("a.csv", "aXcsv", False)]:
        assert bool(re.search(files.glob_regex(glob), text)) is ok


@pytest.mark.parametrize("n,requested,keys,rec,ok,parts", [
    (-1, "x", True, "x", True, 0), (50_000, "bucket", False, "no_partitioning", False, 1), (5_000_000, "any", False, "ingestion_date", True, 10),
    (500_000_000, "load_date", True, "ingestion_date + source_region", True, 1000), (500_000_000, "region", False, "ingestion_date", False, 1000),
    (2_000_000_000, "bucket_by_id", True, "ingestion_date + bucket_by_id", True, 4000)])
def test_partitioning_advice(spark, n, requested, keys, rec, ok, parts):
    df = spark.createDataFrame([(n, requested, keys)], "n long, r string, k boolean")
    r = files.partitioning_advice(df, "n", "r", "k").first()
    assert (r.recommended, r.is_appropriate, r.est_partitions) == (rec, ok, parts)


def test_zone_sink_replaces_only_its_partitions(spark, tmp_path):
    p = str(tmp_path / "z")
    day = lambda d, v: spark.createDataFrame([(d, v)], "_reporting_date string, v int")
    sinks.write_zone(day("2024-01-01", 1).union(day("2024-01-02", 2)), p)
    sinks.write_zone(day("2024-01-02", 9), p)
    assert [r[0] for r in rows(spark.read.parquet(p).select("v"))] == [1, 9]


def test_rewrite_of_a_table_it_reads(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.rewrite(spark.range(5), p)
    before = sinks.read_versioned(spark, p)
    sinks.rewrite(sinks.read_versioned(spark, p).filter("id > 2"), p)
    sinks.append_versioned(spark.range(1), p)
    assert [r[0] for r in rows(sinks.read_versioned(spark, p))] == [0, 3, 4] and before.count() == 5  # a reader keeps its version
    assert sinks.drop_old_versions(p, 1) == 1 and [r[0] for r in rows(sinks.read_versioned(spark, p))] == [0, 3, 4]
    sinks.rewrite(spark.range(0), p)
    assert sinks.read_versioned(spark, p).count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_versioned(spark, str(tmp_path / "none"))


def test_a_failure_between_the_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "t")
    sinks.rewrite(spark.range(3), p)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.rewrite(spark.range(9), p)
    assert sinks.read_versioned(spark, p).count() == 3
    with pytest.raises(Exception, match="broken"):
        sinks.rewrite(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), p)
    assert sinks.read_versioned(spark, p).count() == 3 and sinks.manifest(p)["version"] == 1
    assert sinks.drop_old_versions(p) == 2 and sinks.read_versioned(spark, p).count() == 3


def test_partitions_of_a_versioned_table(spark, tmp_path):
    """Reloads and upserts write the partitions they touch and list all others as they were."""
    p = str(tmp_path / "t")
    day = lambda *xs: spark.createDataFrame(list(xs), "day date, k int, region string, v string")
    d = [datetime.date(2024, 1, i) for i in range(1, 5)]
    sinks.rewrite(day((d[0], 1, "a b/c", "x"), (d[0], 2, None, "x"), (d[1], 1, "n", "y"), (d[2], 3, "n", None)), p, ["day", "region"])
    table = lambda: sorted((r.day, r.k, r.region or "", r.v) for r in sinks.read_versioned(spark, p).collect())
    assert table() == [(d[0], 1, "a b/c", "x"), (d[0], 2, "", "x"), (d[1], 1, "n", "y"), (d[2], 3, "n", None)]
    first = sinks.manifest(p)["parts"]
    sinks.reload_versioned(day((d[1], 7, "n", "z"), (d[1], 8, "n", "z"), (d[3], 1, "n", "new")), p)
    second = sinks.manifest(p)["parts"]
    assert table() == [(d[0], 1, "a b/c", "x"), (d[0], 2, "", "x"), (d[1], 7, "n", "z"), (d[1], 8, "n", "z"), (d[2], 3, "n", None), (d[3], 1, "n", "new")]
    assert sum(first.get(k) == v for k, v in second.items()) == 3 and len(second) == 5
    sinks.upsert_versioned(day((d[0], 1, "a b/c", "changed"), (d[0], 9, "a b/c", "added"), (d[0], 5, None, "null region")), p, ["day", "region", "k"])
    assert table() == [(d[0], 1, "a b/c", "changed"), (d[0], 2, "", "x"), (d[0], 5, "", "null region"), (d[0], 9, "a b/c", "added"), (d[1], 7, "n", "z"), (d[1], 8, "n", "z"), (d[2], 3, "n", None), (d[3], 1, "n", "new")]
    assert sum(second[k] == v for k, v in sinks.manifest(p)["parts"].items()) == 3
    sinks.append_versioned(day((d[2], 4, "n", "more")), p)
    assert (d[2], 4, "n", "more") in table() and len(table()) == 9
    pruned = sinks.read_versioned(spark, p).filter(F.col("day") == F.lit(d[3]))
    assert pruned.count() == 1 and [f.dataType.simpleString() for f in pruned.schema] == ["date", "int", "string", "string"]
    with pytest.raises(ValueError):
        sinks.upsert_versioned(day(), p, ["k"])


def test_tables(spark):
    sinks.write_table(spark.range(100).withColumn("p", F.col("id") % 2), "zc_t1", partition_by=["p"], cluster_by=["id"])
    sinks.write_table(spark.range(100), "zc_t2", cluster_by=["id"], buckets=4)
    assert spark.table("zc_t1").count() == spark.table("zc_t2").count() == 100
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), "zc_t3", cluster_by=list("abcde"))


def test_jdbc_options():
    o = extract.jdbc_options("jdbc:x", "t", db_type="postgres", predicate="a > 1", partition=("id", 0, 100, 8))
    assert o["dbtable"] == "(SELECT * FROM t WHERE a > 1) q" and o["numPartitions"] == "8" and o["driver"].endswith("postgresql.Driver")


def test_extract_modes(spark):
    df = spark.createDataFrame([(i, i // 2, "I" if i % 2 else "D") for i in range(10)], "id int, w int, op string")
    assert extract.load(df, "full").count() == 10
    assert [r[0] for r in rows(extract.load(df, "incremental", watermark="w", last=0, batch_size=3).select("id"))] == [2, 3, 4, 5]
    assert extract.load(df, "cdc", watermark="w", last=2, op_col="op", ops=["I"]).count() == 2
    with pytest.raises(ValueError):
        extract.load(df, "odd")


def test_ebcdic(spark):
    def packed(value, size):
        digits = f"{abs(value):0{2 * size - 1}d}" + ("D" if value < 0 else "C")
        return bytes.fromhex(digits)
    rec = "1234567890".encode("cp037") + "ÀCME  Öl".ljust(12).encode("cp037") + packed(-12345, 6) + (-77).to_bytes(4, "big", signed=True)
    layout = [{"name": "id", "offset": 0, "length": 10}, {"name": "name", "offset": 10, "length": 12},
              {"name": "bal", "offset": 22, "length": 6, "kind": "comp3", "scale": 2}, {"name": "n", "offset": 28, "length": 4, "kind": "comp"}]
    df = spark.createDataFrame([(bytearray(rec),)], "record binary")
    r = legacy.decode_ebcdic(df, layout).first()
    assert (r.id, r.name, float(r.bal), r.n) == ("1234567890", "ÀCME  Öl", -123.45, -77)


def test_fixed_and_variable_records(spark, tmp_path):
    """Two files each, one name with a blank, in ranges of a few records and in one."""
    fixed = {"a.bin": b"".join(b"%05d" % i for i in range(1000)), "b c.bin": b"AAAAABBBBB", "empty.bin": b""}
    records = {"v.dat": [bytes([i % 251]) * (i * 7 % 90) for i in range(900)], "w x.dat": [b"one", b"", b"three" * 3000], "none.dat": []}
    for name, raw in fixed.items():
        write(tmp_path / name, raw, "wb")
    for name, found in records.items():
        write(tmp_path / name, b"".join((len(x) + 4).to_bytes(2, "big") + b"\0\0" + x for x in found), "wb")
    name = lambda r: r.path.rsplit("/", 1)[1]
    for size in (64, 1 << 20):
        got = sorted((name(r), r.record_no, bytes(r.record)) for r in legacy.read_fixed_records(spark, str(tmp_path / "*.bin"), 5, size).collect())
        assert got == sorted((n, i, raw[5 * i:5 * i + 5]) for n, raw in fixed.items() for i in range(len(raw) // 5))
        got = sorted((name(r), r.record_no, bytes(r.record)) for r in legacy.read_rdw(spark, str(tmp_path / "*.dat"), range_bytes=size).collect())
        assert got == sorted((n, i, x) for n, xs in records.items() for i, x in enumerate(xs))
    borders = legacy.rdw_borders(spark, str(tmp_path / "*.dat"), range_bytes=2000).collect()
    assert sum(name(r) == "v.dat" for r in borders) > 10 and all(r.stop - r.start < 2000 + 15010 for r in borders)


@pytest.mark.parametrize("tail", [b"\0\1\0\0", b"\0\x20\0\0short", b"\0\4\0", b"\0"])
def test_broken_records_are_errors(spark, tmp_path, tail):
    write(tmp_path / "v.bin", b"".join((len(x) + 4).to_bytes(2, "big") + b"\0\0" + x for x in (b"one", b"two")) + tail, "wb")
    with pytest.raises(Exception, match="record 2 at byte 14"):
        legacy.read_rdw(spark, str(tmp_path / "v.bin"))
    write(tmp_path / "f.bin", b"AAABBBC", "wb")
    with pytest.raises(Exception, match="multiple of 3"):
        legacy.read_fixed_records(spark, str(tmp_path / "f.bin"), 3).collect()


SALES = """ORD-001,CUST-101,Acme Corp,PROD-A,Widget Pro,10,25.99,2024-01-15,COMPLETED,WEST
ORD-002,CUST-102,Beta Ltd,PROD-B,Gadget Plus,5,49.99,2024-01-16,SHIPPED,EAST
ORD-003,CUST-101,Acme Corp,PROD-C,Super Tool,20,12.50,2024-01-17,COMPLETED,WEST
ORD-004,CUST-103,Gamma Inc,PROD-A,Widget Pro,3,25.99,2024-01-18,PENDING,NORTH
ORD-005,CUST-102,Beta Ltd,PROD-D,Mega Kit,1,199.99,2024-01-19,COMPLETED,EAST
ORD-006,CUST-104,Delta Co,PROD-B,Gadget Plus,8,49.99,2024-01-20,SHIPPED,SOUTH
ORD-007,CUST-103,Gamma Inc,PROD-C,Super Tool,15,12.50,2024-01-21,COMPLETED,NORTH
ORD-008,CUST-101,Acme Corp,PROD-D,Mega Kit,2,199.99,2024-01-22,PENDING,WEST
ORD-009,CUST-105,Epsilon LLC,PROD-A,Widget Pro,25,25.99,2024-01-23,COMPLETED,EAST
ORD-010,CUST-104,Delta Co,PROD-C,Super Tool,7,12.50,2024-01-24,SHIPPED,SOUTH
ORD-011,CUST-105,Epsilon LLC,PROD-B,Gadget Plus,4,49.99,2024-01-25,COMPLETED,EAST
ORD-012,CUST-102,Beta Ltd,PROD-A,Widget Pro,12,25.99,2024-01-26,COMPLETED,EAST
ORD-013,CUST-103,Gamma Inc,PROD-D,Mega Kit,3,199.99,2024-01-27,PENDING,NORTH
ORD-014,CUST-101,Acme Corp,PROD-B,Gadget Plus,6,49.99,2024-01-28,COMPLETED,WEST
ORD-015,CUST-104,Delta Co,PROD-A,Widget Pro,9,25.99,2024-01-29,SHIPPED,SOUTH
"""


def test_sales_from_file_to_gold(spark, tmp_path):
    from zonecraft.operators.aggregate import order_summary
    cols = "order_id,customer_id,customer_name,product_id,product_name,quantity,unit_price,order_date,status,region"
    landing = files.landing_audit(files.to_landing(files.read_csv(spark, write(tmp_path / "s.csv", cols + "\n" + SALES))), "sales", "b1")
    schema = [{"name": "quantity", "type": "int"}, {"name": "unit_price", "type": "double"}, {"name": "order_date", "type": "date"}]
    bronze, lost = R.cast_declared(landing, schema)
    silver = R.apply_rules(bronze, [{"type": "standard_cleaning", "sequence_order": 1}, {"type": "dedup", "sequence_order": 2, "config": {"keys": ["order_id"]}}])
    assert lost.count() == 0 and silver.count() == 15
    gold = order_summary(silver, "customer_id", F.col("quantity") * F.col("unit_price"), "order_date", "status",
                         {"completed": "COMPLETED", "shipped": "SHIPPED", "pending": "PENDING"})
    assert [tuple(r[c] for c in ("customer_id", "total_orders", "total_revenue", "completed", "shipped", "pending")) for r in gold.collect()] == [
        ("CUST-101", 4, 1209.82, 3, 0, 1), ("CUST-103", 3, 865.44, 1, 0, 2), ("CUST-105", 2, 849.71, 2, 0, 0),
        ("CUST-102", 3, 761.82, 2, 1, 0), ("CUST-104", 3, 721.33, 0, 3, 0)]
    assert {r.status for r in Q.layer_check({"raw": landing, "bronze": bronze, "silver": silver, "gold": gold}).collect()} == {"PASS"}


def test_registry_has_no_duplicates():
    registry.load()
    assert len(registry.QUERIES) > 300
