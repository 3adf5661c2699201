"""Queries for scans, sources and sinks (SC)."""

from pyspark.sql import functions as F

from zonecraft.functions.exprs import ymd
from zonecraft.operators import quality as Q
from zonecraft.operators import drift as D
from zonecraft.plans import catalog as cat
from zonecraft.plans.registry import query
from zonecraft.sources import extract, files, legacy, sinks

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@query("sc_4", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def sc_4(t):
    out = None
    for n in TABLES:
        x = files.read_parquet(t.spark, t.path(n)).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = x if out is None else out.union(x)
    return out


@query("sc_9", """
SELECT doc_id, trim(substring(text, 1, 8), ' ') AS f1, trim(substring(text, 9, 12), ' ') AS f2,
       md5(trim(substring(text, 21), ' ')) AS rest_md5 FROM documents""")
def sc_9(t):
    x = legacy.slice_fixed(t.documents, [("f1", 1, 8), ("f2", 9, 12), ("rest", 21, None)], "text", keep=["doc_id"])
    return x.select("doc_id", "f1", "f2", F.md5("rest").alias("rest_md5"))


@query("sc_12", """
WITH r AS (SELECT o_orderstatus || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || o_orderpriority AS raw_line FROM orders)
SELECT substring(raw_line, 1, 1) AS record_type, count(*) AS n, min(substring(raw_line, 2, 12)) AS first_key,
       max(substring(raw_line, 2, 12)) AS last_key FROM r GROUP BY 1""")
def sc_12(t):
    r = t.orders.select(F.concat("o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
                                 "o_orderpriority").alias("raw_line"))
    key = F.substring("raw_line", 2, 12)
    return (r.groupBy(legacy.record_type("raw_line", 0, 1).alias("record_type"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key")))


@query("sc_13", """
SELECT user_id, CAST(floor(arg_max(value, event_id)) AS BIGINT) AS expected_count, count(*) - 1 AS actual_count,
       count(*) - 1 - CAST(floor(arg_max(value, event_id)) AS BIGINT) AS difference,
       count(*) - 1 = CAST(floor(arg_max(value, event_id)) AS BIGINT) AS valid
FROM events GROUP BY user_id""")
def sc_13(t):
    return legacy.check_trailer(t.events, "user_id", "event_id", F.floor("value").cast("long"))


@query("sc_15", """
WITH r AS (SELECT *, rank() OVER (ORDER BY o_orderdate) AS rk FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30')
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM r WHERE rk <= 1000""")
def sc_15(t):
    x = extract.extract_batch(t.orders, "o_orderdate", "1996-06-30", 1000)
    return x.select("o_orderkey", "o_custkey", "o_totalprice", ymd("o_orderdate").alias("order_day"))


@query("sc_16", """
SELECT event_id, user_id, event_type, value FROM events
WHERE ts > TIMESTAMP '2024-01-10' AND event_type IN ('signup', 'purchase')""")
def sc_16(t):
    x = extract.change_rows(t.events, "ts", "event_type", "2024-01-10", ["signup", "purchase"])
    return x.select("event_id", "user_id", "event_type", "value")


_TYPED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("sc_21", "WITH s AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _TYPED) + " FROM orders) " +
       " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS non_null,
CASE WHEN count({c}) > 0 AND count(TRY_CAST({c} AS BIGINT)) FILTER (WHERE {c} NOT LIKE '%.%') = count({c}) THEN 'bigint'
     WHEN count({c}) > 0 AND count(TRY_CAST({c} AS DOUBLE)) = count({c}) THEN 'double'
     WHEN count({c}) > 0 AND count(TRY_CAST({c} AS TIMESTAMP)) = count({c}) THEN 'timestamp'
     ELSE 'string' END AS inferred_type FROM s""" for c in _TYPED))
def sc_21(t):
    return files.infer_types(files.to_landing(t.orders))


@query("sc_22", "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _TYPED) + " FROM orders")
def sc_22(t):
    return files.to_landing(t.orders)


@query("sc_23", """
SELECT c_custkey, 'feed_customer' AS _feed_id, 'B1' AS _batch_id, 'customer.parquet' AS source_name, TRUE AS stamped FROM customer""")
def sc_23(t):
    x = files.landing_audit(t.customer, "feed_customer", "B1", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return x.select("c_custkey", "_feed_id", "_batch_id", F.col("_source_file").alias("source_name"),
                    F.col("_load_timestamp").isNotNull().alias("stamped"))


@query("sc_24", """
WITH f AS (SELECT o_orderkey, 'in/' || o_orderpriority || '_' || CASE o_orderstatus
  WHEN 'F' THEN strftime(o_orderdate, '%Y%m%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
  ELSE 'final' END || '.csv' AS file_name FROM orders)
SELECT o_orderkey, file_name, CASE WHEN file_name LIKE '%final%' THEN NULL ELSE
  strftime(CAST(regexp_replace(regexp_extract(file_name, '_([0-9-]+)\\.csv', 1), '^(\\d{4})-?(\\d{2})-?(\\d{2})$', '\\1-\\2-\\3') AS DATE), '%Y-%m-%d')
  END AS reporting_date FROM f""")
def sc_24(t):
    d = F.col("o_orderdate")
    stamp = (F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyyMMdd"))
             .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("final")))
    f = t.orders.select("o_orderkey", F.concat(F.lit("in/"), "o_orderpriority", F.lit("_"), stamp, F.lit(".csv")).alias("file_name"))
    return f.withColumn("reporting_date", ymd(files.reporting_date(F.col("file_name"))))


@query("sc_25", """
WITH l AS (SELECT DISTINCT event_type AS feed_id, event_type || '_' || strftime(ts, '%Y%m%d%H') || '.csv' AS file_name FROM events),
g AS (SELECT event_type AS feed_id, event_type || '_' || strftime(ts, '%Y%m%d%H') || '.csv' AS file_name,
      CASE WHEN value > 50 THEN 'success' ELSE 'failed' END AS status FROM events)
SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.status = 'success' AND g.feed_id = l.feed_id AND g.file_name = l.file_name)""")
def sc_25(t):
    g = t.events.select(F.col("event_type").alias("feed_id"),
                        F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyyMMddHH"), F.lit(".csv")).alias("file_name"),
                        F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"))
    return files.new_files(g.select("feed_id", "file_name").distinct(), g)


@query("sc_26", """
SELECT page_id, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS name, length(html) AS size FROM pages
WHERE url LIKE 'http://%' AND regexp_matches(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '^en/.*[0-9]$')
  AND length(html) >= 1000""")
def sc_26(t):
    x = t.pages.select("page_id", F.when(F.col("url").startswith("http://"), "plain").otherwise("tls").alias("bucket"),
                       F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1).alias("name"), F.length("html").cast("long").alias("size"))
    return files.file_events(x, "plain", "en/", "en/*[0-9]", 1000).select("page_id", "name", "size")


@query("sc_27", """
SELECT doc_id, round(n_chars * 1000000.0 / 1073741824.0, 4) AS size_gb,
  CAST(greatest(1, floor(CAST(n_chars * 1000000 AS DOUBLE) / 1073741824.0 * 1024 / 128)) AS BIGINT) AS num_partitions,
  CAST(n_chars * 1000000 AS DOUBLE) / 1073741824.0 >= 10 AS is_big FROM documents""")
def sc_27(t):
    x = files.size_plan(t.documents.select("doc_id", (F.col("n_chars") * 1_000_000).alias("size")))
    return x.select("doc_id", F.round("size_gb", 4).alias("size_gb"), "num_partitions", "is_big")


@query("sc_28", """
WITH e AS (SELECT p_partkey, CAST(p_partkey * p_partkey * p_size * 40 - 1 AS BIGINT) AS n,
  CASE WHEN p_type = 'PROMO' THEN 'no_partitioning' WHEN p_type = 'SMALL' THEN 'bucket_by_id' ELSE 'ingestion_date' END AS requested,
  p_size > 25 AS has_keys FROM part)
SELECT p_partkey, n AS row_estimate, requested,
 CASE WHEN n < 0 THEN requested WHEN n < 100000 THEN 'no_partitioning' WHEN n < 10000000 THEN 'ingestion_date'
  WHEN n < 1000000000 THEN CASE WHEN has_keys THEN 'ingestion_date + source_region' ELSE 'ingestion_date' END
  ELSE 'ingestion_date + bucket_by_id' END AS recommended,
 CASE WHEN n < 0 THEN TRUE WHEN n < 100000 THEN requested IN ('no_partitioning', 'ingestion_date') WHEN n < 10000000 THEN TRUE
  WHEN n < 1000000000 THEN requested LIKE '%date%' ELSE requested LIKE '%bucket%' OR requested LIKE '%ingestion_date%' END AS is_appropriate,
 CASE WHEN n <= 0 THEN 0 ELSE greatest(1, n // 500000) END AS est_partitions,
 CASE WHEN n < 0 THEN 0 ELSE n // greatest(1, n // 500000) END AS rows_per_partition FROM e""")
def sc_28(t):
    e = t.part.select("p_partkey", (F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 40 - 1).cast("long").alias("row_estimate"),
                      F.when(F.col("p_type") == "PROMO", "no_partitioning").when(F.col("p_type") == "SMALL", "bucket_by_id")
                      .otherwise("ingestion_date").alias("requested"), (F.col("p_size") > 25).alias("has_keys"))
    return files.partitioning_advice(e, "row_estimate", "requested", "has_keys").drop("has_keys")


_RELOAD = """
WITH b AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 480000),
r AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders o
      WHERE date_trunc('{u}', o_orderdate) NOT IN (SELECT date_trunc('{u}', o_orderdate) FROM b)
      UNION ALL SELECT * FROM b)
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM r"""


def _reload(t, mode):
    cols = ["o_orderkey", "o_totalprice", "o_orderdate"]
    batch = t.orders.filter("o_totalprice > 480000").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate")
    x = sinks.reload_period(t.orders.select(*cols), batch, "o_orderdate", mode)
    return x.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), ymd("o_orderdate").alias("order_day"))


@query("sc_32", _RELOAD.format(u="day"))
def sc_32(t):
    return _reload(t, "daily")


@query("sc_33", """
SELECT c.c_custkey, c.c_name, CASE WHEN c.c_acctbal < 0 THEN 0.0 ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment FROM customer c
UNION ALL SELECT c_custkey + 10000000, c_name, 0.0, NULL FROM customer WHERE c_mktsegment = 'BUILDING'""")
def sc_33(t):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changed = c.filter("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))
    added = c.filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name",
                                                         F.lit(0.0).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return sinks.upsert(c, changed.union(added), ["c_custkey"])


@query("sc_34", """
WITH tgt AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM (SELECT * FROM tgt UNION ALL
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM tgt))""")
def sc_34(t):
    o = t.orders.select("o_orderkey", "o_orderdate")
    x = sinks.append_since(o.filter("o_orderdate < timestamp_ntz'1998-01-01'"), o, "o_orderdate")
    return x.select("o_orderkey", ymd("o_orderdate").alias("order_day"))


@query("sc_35", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, value FROM r WHERE rn = 1 AND event_type <> 'error'""")
def sc_35(t):
    log = t.events.withColumn("op", F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT"))
    return sinks.apply_changes(log, ["user_id"], ["ts", "event_id"], "op").select("user_id", "event_id", "value")


@query("sc_36", """
SELECT c_custkey AS customer_id, upper(trim(c_name, ' ')) AS name, n_name AS nation, 'E1' AS execution_id,
  CASE WHEN regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'VALID' ELSE 'INVALID' END AS name_status
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IS NOT NULL AND c_acctbal >= 100""")
def sc_36(t):
    t.customer.createOrReplaceTempView("zc_src_customer")
    t.nation.createOrReplaceTempView("zc_src_nation")
    sinks.define_view(t.spark, "zc_bronze_customer", """
        SELECT cast(c_custkey AS bigint) AS customer_id, trim(upper(c_name)) AS name, c_name, c_nationkey, c_acctbal,
               'E1' AS execution_id FROM zc_src_customer WHERE c_custkey IS NOT NULL""")
    return sinks.define_view(t.spark, "zc_silver_customer", """
        SELECT customer_id, name, n_name AS nation, execution_id,
               CASE WHEN c_name RLIKE '^Customer#[0-9]{9}$' THEN 'VALID' ELSE 'INVALID' END AS name_status
        FROM zc_bronze_customer JOIN zc_src_nation ON c_nationkey = n_nationkey WHERE c_acctbal >= :floor""", floor=100)


@query("sc_37", "SELECT s_name, s_suppkey, s_nationkey, s_acctbal FROM supplier")
def sc_37(t):
    return sinks.reorder(t.supplier, ["s_name", "missing", "s_suppkey"])


@query("sc_38", """
SELECT count(*) AS source_count, count(*) FILTER (WHERE l_quantity >= 3) AS target_count,
 round(100.0 * (count(*) - count(*) FILTER (WHERE l_quantity >= 3)) / count(*), 4) AS loss_pct,
 CASE WHEN 100.0 * (count(*) - count(*) FILTER (WHERE l_quantity >= 3)) / count(*) > 5 THEN 'error' ELSE 'ok' END AS status FROM lineitem""")
def sc_38(t):
    return Q.reconcile_counts(t.lineitem, t.lineitem.filter("l_quantity >= 3"), 5.0)


_RULES = [
    {"rule_type": "between", "column": "l_quantity", "min": 5, "rule_id": "R1"},
    {"rule_type": "in_set", "column": "l_returnflag", "values": ["A", "N"], "rule_id": "R2"},
    {"rule_type": "sql", "condition": "l_discount <= 0.08", "rule_id": "R3"},
]


@query("sc_39", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate_s, concat_ws(',', r1, r2, r3) AS codes, 'E7' AS execution_id FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_s,
  CASE WHEN NOT (l_quantity >= 5) THEN 'R1' END AS r1, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'R2' END AS r2,
  CASE WHEN NOT (l_discount <= 0.08) THEN 'R3' END AS r3 FROM lineitem) WHERE coalesce(r1, r2, r3) IS NOT NULL""")
def sc_39(t):
    _, bad = Q.split_rejected(t.lineitem, _RULES, execution_id="E7")
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ymd("l_shipdate").alias("l_shipdate_s"),
                      F.array_join("_rejection_codes", ",").alias("codes"), F.col("_execution_id").alias("execution_id"))


@query("sc_40", cat.COLUMNS_SQL + """
SELECT coalesce(r.dataset, l.dataset) AS dataset, coalesce(r.column_name, l.column_name) AS column_name,
 r.data_type AS requested_type, l.data_type AS live_type,
 CASE WHEN l.column_name IS NULL THEN 'missing' WHEN r.column_name IS NULL THEN 'extra'
  WHEN r.norm <> l.norm THEN 'type_mismatch' ELSE 'match' END AS status
FROM (SELECT *, CASE data_type WHEN 'int' THEN 'integer' WHEN 'varchar' THEN 'string' ELSE data_type END AS norm FROM cols_old) r
FULL JOIN (SELECT *, CASE data_type WHEN 'int' THEN 'integer' WHEN 'varchar' THEN 'string' ELSE data_type END AS norm FROM cols_new) l
 ON r.dataset = l.dataset AND r.column_name = l.column_name""")
def sc_40(t):
    return (D.schema_diff(cat.columns_old(t), cat.columns_new(t), ["dataset"])
            .select("dataset", "column_name", F.col("old_type").alias("requested_type"), F.col("new_type").alias("live_type"),
                    F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "extra")
                    .when(F.col("change") == "type_changed", "type_mismatch").otherwise("match").alias("status")))


@query("sc_41", _RELOAD.format(u="month"))
def sc_41(t):
    return _reload(t, "monthly")


# records as a mainframe would send them: a binary number, EBCDIC text and a packed amount
LAYOUT = [{"name": "nation", "offset": 0, "length": 4, "kind": "comp"}, {"name": "name", "offset": 4, "length": 30}, {"name": "balance", "offset": 34, "length": 7, "kind": "comp3", "scale": 2}]


@query("sc_10", "SELECT c_custkey, c_nationkey::BIGINT AS nation, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def sc_10(t):
    record = F.concat(legacy.to_binary(F.col("c_nationkey"), 4), legacy.to_ebcdic(F.col("c_name"), 30), legacy.to_packed(F.round("c_acctbal", 2), 7, 2))
    x = legacy.decode_ebcdic(t.customer.select("c_custkey", record.alias("record")), LAYOUT, keep=["c_custkey"])
    return x.withColumn("balance", F.col("balance").cast("double"))


# pages of an API with up to a hundred records each
@query("sc_19", "SELECT event_id, user_id, event_type FROM events")
def sc_19(t):
    record = F.struct("event_id", "user_id", "event_type")
    pages = t.events.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(record).alias("items"))
    text = pages.select("page", F.to_json(F.struct(F.struct("items").alias("data"))).alias("body"))
    read = text.select(F.from_json("body", "data struct<items: array<struct<event_id: bigint, user_id: bigint, event_type: string>>>").alias("p")).select("p.*")
    return files.explode_records(read, "data.items")
