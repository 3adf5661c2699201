"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.session import partition_count, store


def spread_class(col: Column) -> Column:
    """One of 256 classes of a value, by its MD5; null has a class of its own."""
    return F.coalesce(F.substring(F.md5(col.cast("string")), 1, 2), F.lit(""))


def numbered(rows: DataFrame, keys: list[str], buckets: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """`rows` with the number (from 1) of each row within its key, in the order of `buckets`, then
    `order`; with `weight`, the running sum of that column instead.

    `buckets` cut a key into ordered pieces that one task can sort; a key's number of different
    bucket values must be bounded.  Only rows of one key and bucket meet; between buckets only their
    totals are carried.  Null keys, buckets and order values are values like any other, nulls first."""
    inner = Window.partitionBy("__kb").orderBy(*order)
    own = (F.row_number().over(inner) if weight is None else F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    keyed = rows.withColumn("__kb", F.struct(F.struct(*keys).alias("k"), F.struct(*buckets).alias("b")))
    totals = keyed.groupBy("__kb").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c"))
    before = totals.select("__kb", (F.sum("__c").over(Window.partitionBy("__kb.k").orderBy("__kb.b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    return keyed.withColumn("__own", own).join(before, "__kb").withColumn(name, F.col("__own") + F.col("__before")).drop("__kb", "__own", "__before")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with the number (from 1) of each row in the order of `order` over the whole table.

    Rows are dealt into ranges of the order, each range is numbered by itself, and the rows of the ranges
    before it are added: their counts are one row a partition.  The ranges are stored, so numbers
    stay as they are when a task runs again."""
    n = partition_count(rows.sparkSession)
    dealt = store(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # one row a partition
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")
