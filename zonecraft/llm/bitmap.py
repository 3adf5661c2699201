"""Rows that may be among a list of wanted hashes, by a broadcast of bounded size.

A shuffle join moves all of its larger side to find the few rows that match.  Here the wanted hashes
mark bits of a bitmap; rows whose bit is not marked are dropped where they are read, before any
shuffle.  The bitmap has sixteen bits per wanted hash and at most MOST_BITS (64 MB as broadcast), so
its size is known beforehand; a longer list fills it up, and then more rows go on to the join that
follows.  No wanted row is ever dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT, MOST_BITS = 1 << 15, 1 << 28


def may_match(rows: DataFrame, place: Column, wanted: DataFrame, wanted_place: Column, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose 64-bit hash `place` is among the hashes `wanted_place` of `wanted`, and about one in
    sixteen of the others.  `wanted` is read twice, so it should be a stored table."""
    bits = min(max(1 << (16 * wanted.count()).bit_length(), SLOT), most_bits)
    spot = F.pmod(wanted_place, F.lit(bits)).alias("p")
    marked = wanted.select(spot).groupBy(F.expr(f"p div {SLOT}").alias("__slot")).agg(F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(SLOT))).alias("m"))
    # 4 bytes of the map per number, the first byte on top
    numbers = F.expr(f"transform(sequence(0, {SLOT // 32 - 1}), i -> cast(conv(hex(substring(m, 4 * i + 1, 4)), 16, 10) as bigint))")
    maps = marked.select("__slot", numbers.alias("__map"))
    x = rows.withColumn("__spot", F.pmod(place, F.lit(bits))).withColumn("__slot", F.expr(f"__spot div {SLOT}")).withColumn("__spot", F.pmod("__spot", F.lit(SLOT)).cast("int"))
    word = F.get("__map", F.expr("__spot div 32").cast("int"))
    bit = F.getbit(word, F.expr("(3 - (__spot % 32) div 8) * 8 + __spot % 8").cast("int"))
    return x.join(F.broadcast(maps), "__slot").filter(bit == 1).select(*rows.columns)
