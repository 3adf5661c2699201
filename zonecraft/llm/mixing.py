"""Mixing sources to target weights by systematic sampling.

A document of a source whose target is e times its size is expected e times in the mix.  The
expected copies are summed up along the source, one random offset per source is added, and a copy
is emitted at every integer the sum crosses.  Documents run in order of size, so the words taken,
and not only their number of documents, stay near the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.llm.numbering import numbered, spread_class
from zonecraft.llm.rows import column, row_key, whole
from zonecraft.session import store

WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
PIECE = 4096  # copies of one row that a task emits at a time


def size_of(text: Column) -> Column:
    """Words (runs of other than ASCII white space) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, take the weights in turn and share `share_percent` of
    all sizes; no target is above `most` times its size.  Filling the source that reaches its bound
    soonest first gives the shares in one pass: with sources by bound per weight, each takes the
    smaller of its bound and its weight's part of what the sources before it have left.  The table
    has one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(ordered) - 1
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn % len(weights) == i, w).otherwise(weight)
    x = sources.withColumn("weight", weight.cast("long")).withColumn("bound", most * F.col("source_size"))
    everything = Window.partitionBy()
    soon = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = soon.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("left", F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0) - (F.sum("bound").over(upto) - F.col("bound")))
    x = x.withColumn("weights", F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")))
    # the first source whose part stays within its bound ends the filling; all later ones take their part of what it saw
    x = x.withColumn("level", F.col("left") / F.col("weights"))
    x = x.withColumn("open", F.col("level") * F.col("weight") <= F.col("bound"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(upto)
    target = F.when(level.isNull(), F.col("bound").cast("double")).otherwise(F.least(level * F.col("weight"), F.col("bound").cast("double")))
    return x.select("source", "source_size", target.alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): the leading 32 bits of an MD5 of seed and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """Ordered classes of sizes that keep four leading bits."""
    cut = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, cut), cut)


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: int = 11) -> DataFrame:
    """(`__id`, `__size`, `__source_size`, `__target`, `__copies`) and the columns `keep` for every row.

    Sizes are counted once and stored with id, source and `keep`; texts take no part in what follows.
    Within a source rows run by size class, a class of the id's MD5, size, id and `keep`: any source is
    cut into pieces that one task can sort, and the result depends on the rows alone.  Rows that tie
    in all of these (repeated rows) are exchangeable.  A null source is a source, a null id has a
    class of its own; empty and null texts have size 0 and take no words, and a source of such
    documents has target 0 and is taken 0 times.  An empty table gives no rows.  All sources are
    ordered in one task for their targets, so there may be as many as one task can sort."""
    keep = keep or []
    x = store(docs.select(column(id_col).alias("__id"), column(source_col).alias("__source"), size_of(column(text_col).cast("string")).alias("__size"), *keep))
    totals = x.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    goal = store(targets(totals)).select(F.struct("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    x = x.withColumn("__s", F.struct(F.col("__source").alias("source"))).withColumn("__class", size_class(F.col("__size"))).withColumn("__spread", spread_class(F.col("__id")))
    x = numbered(x, ["__source"], ["__class", "__spread"], ["__size", "__id", *keep], "__rank").join(goal, "__s")
    each = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    offset = offset_of(F.col("__source"), seed)
    copies = F.floor(each * F.col("__rank") + offset) - F.floor(each * (F.col("__rank") - 1) + offset)
    return x.select("__id", "__size", "__source_size", "__target", F.least(copies, F.lit(MOST)).cast("long").alias("__copies"), *keep)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The rows of `docs`, with their columns, each as often as the mix takes it.

    The draw works on id, source, size and a 128-bit key of the row; whole rows meet its result in one
    join.  Equal rows have one key: their copies are added up and given to one of them, in pieces, so
    that repeated rows are as often in the mix as their draws say."""
    slim = docs.select(column(id_col).alias("i"), column(text_col).alias("t"), column(source_col).alias("s"), row_key(docs).alias("key"))
    found = drawn(slim, "i", "t", "s", ["key"], seed).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("__copies").alias("copies"))
    found = store(found.filter("copies > 0"))
    rows = docs.select(whole(docs).alias("row"), row_key(docs).alias("key"))
    out = rows.join(found.filter("n = 1").select("key", "copies"), "key")
    twins = store(found.filter("n > 1"))
    if not twins.isEmpty():
        one = rows.join(twins.select("key"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        part = twins.select("key", "copies", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {PIECE}"))).alias("part"))
        part = part.select("key", F.least(F.lit(PIECE), F.col("copies") - F.col("part") * PIECE).alias("copies"))
        out = out.unionByName(part.join(one, "key").select(*out.columns))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
