"""Metadata tables derived from the data tables, with the same definitions as SQL.

feed = customer, execution = order, task / validation result = line item, run event = event,
dataset columns = parts grouped by brand.
"""

from pyspark.sql import functions as F

COLUMNS_SQL = """
WITH cb AS (SELECT p_brand AS dataset, CASE WHEN p_type = 'PROMO' AND p_size < 10 THEN '_audit' ELSE lower(p_type) || '_' || CAST(p_size // 10 AS VARCHAR) END AS column_name,
  p_retailprice AS price FROM part),
cols_old AS (SELECT dataset, column_name, CASE WHEN min(price) < 915 THEN 'int' WHEN min(price) < 940 THEN 'varchar' ELSE 'double' END AS data_type,
  max(price) > 925 AS nullable FROM cb WHERE price < 980 GROUP BY 1, 2),
cols_new AS (SELECT dataset, column_name, CASE WHEN min(price) < 925 THEN 'integer' WHEN min(price) < 950 THEN 'string' ELSE 'double' END AS data_type,
  max(price) > 935 AS nullable FROM cb WHERE price > 905 GROUP BY 1, 2)
"""


def _columns(t):
    return t.part.select(
        F.col("p_brand").alias("dataset"),
        F.when((F.col("p_type") == "PROMO") & (F.col("p_size") < 10), F.lit("_audit"))
        .otherwise(F.concat(F.lower("p_type"), F.lit("_"), F.floor(F.col("p_size") / 10).cast("string"))).alias("column_name"),
        F.col("p_retailprice").alias("price"))


def columns_old(t):
    m = F.min("price")
    return (_columns(t).filter("price < 980").groupBy("dataset", "column_name")
            .agg(F.when(m < 915, "int").when(m < 940, "varchar").otherwise("double").alias("data_type"),
                 (F.max("price") > 925).alias("nullable")))


def columns_new(t):
    m = F.min("price")
    return (_columns(t).filter("price > 905").groupBy("dataset", "column_name")
            .agg(F.when(m < 925, "integer").when(m < 950, "string").otherwise("double").alias("data_type"),
                 (F.max("price") > 935).alias("nullable")))


# -- customer as an existing dimension and a changed delivery of it -------------------------
# incoming: balances below 0 rise by 100 and move segment, customers of nation 3 are absent,
# every AUTOMOBILE customer also arrives under a new key.
INCOMING_SQL = """
incoming AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'RECOVERY' ELSE c_mktsegment END AS c_mktsegment,
   CASE WHEN c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3
 UNION ALL SELECT c_custkey + 10000000, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
"""


def incoming(t):
    c = t.customer
    low = F.col("c_acctbal") < 0
    moved = c.filter("c_nationkey <> 3").select(
        "c_custkey", "c_name", F.when(low, F.lit("RECOVERY")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(low, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    fresh = c.filter("c_mktsegment = 'AUTOMOBILE'").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name",
                                                          "c_mktsegment", "c_acctbal")
    return moved.unionByName(fresh)


# -- run events as operational metadata -------------------------------------------------------
EXEC_SQL = """
ex AS (SELECT event_id AS execution_id, user_id AS feed_id, ts AS started_at, value AS duration_s, round(value / 10, 4) AS cost,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
  CASE event_type WHEN 'click' THEN 'bronze' WHEN 'view' THEN 'silver' ELSE 'gold' END AS zone FROM events)
"""


def executions(t):
    e = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("execution_id"), F.col("user_id").alias("feed_id"), F.col("ts").alias("started_at"),
        F.col("value").alias("duration_s"), F.round(F.col("value") / 10, 4).alias("cost"),
        F.when(e == "error", "FAILED").when(e == "signup", "RUNNING").otherwise("SUCCESS").alias("status"),
        F.when(e == "click", "bronze").when(e == "view", "silver").otherwise("gold").alias("zone"))
