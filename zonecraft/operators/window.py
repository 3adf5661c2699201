"""Window operators that stay safe when one key holds a large share of all rows.

A plain window sorts each key in one task.  Here the rows of a key are first cut into
ordered buckets (a monotone function of the leading order column, e.g. the day of a
timestamp).  Work inside a bucket is a small window; what has to be carried from earlier
buckets is an aggregate with one row per (key, bucket).  Row frames are evaluated on blocks
of consecutive positions, each with a halo of the neighbouring rows the frame can reach.

Where no such function is known (`bucket` None), the rows are dealt into ranges of key and order whose
bounds come from the data, so a dense stretch of a key is cut as often as it needs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.functions.exprs import all_of, any_of, col, null_safe_join
from zonecraft.session import store

OFF = "_zc_offset"
KEY = "_zc_key"
RANGE = "_zc_range"
AT = "_zc_at"


def _order(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _keyed(df: DataFrame, keys, bucket: Column) -> DataFrame:
    """Key and bucket packed into one struct.  Struct equality treats NULL fields as equal, and
    grouping, window and join on this one column share a single exchange of the rows."""
    return df.withColumn(KEY, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("b")))


def _prior_struct(keys):
    return (Window.partitionBy(*[F.col(f"{KEY}.k{i}") for i in range(len(keys))]).orderBy(F.col(f"{KEY}.b"))
            .rowsBetween(Window.unboundedPreceding, -1))


def in_ranges(df: DataFrame, keys, order) -> DataFrame:
    """`df` with the number of each row's range of (keys, order), ascending.

    Bounds are sampled from the rows, so a task holds its share of them however few keys there are; a key
    has at most as many ranges as there are partitions, and rows that are equal in keys and order share one.
    The ranges are stored, so numbers stay as they are when a task runs again and the input is read once."""
    return store(df.repartitionByRange(*_order([*keys, *order])).withColumn(RANGE, F.spark_partition_id()))


def _cut(df: DataFrame, keys, order, bucket: Column | None) -> tuple[DataFrame, Column]:
    return (df, bucket) if bucket is not None else (in_ranges(df, keys, order), F.col(RANGE))


def with_position(df: DataFrame, keys, order, bucket: Column | None = None, name: str = "position") -> DataFrame:
    """1-based row number per key."""
    keys, have = list(keys), df.columns
    df, bucket = _cut(df, keys, order, bucket)
    x = _keyed(df, keys, bucket)
    sizes = x.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select(KEY, F.coalesce(F.sum("_n").over(_prior_struct(keys)), F.lit(0)).alias(OFF))
    local = F.row_number().over(Window.partitionBy(KEY).orderBy(*_order(order)))
    y = x.withColumn("_rn", local).join(offs, KEY)
    return y.withColumn(name, (F.col(OFF) + F.col("_rn")).cast("long")).select(*dict.fromkeys([*have, name]))


def with_ranks(df: DataFrame, keys, order, ties, bucket: Column | None = None) -> DataFrame:
    """row_number (total order `order`), rank and dense_rank over the tie columns `ties`, the leading ones of
    the order; rows that tie share a range, as their rank is one."""
    keys, ties = list(keys), list(ties)
    df, bucket = _cut(df, keys, list(order)[:len(ties)], bucket)
    x = _keyed(df, keys, bucket)
    levels = x.groupBy(KEY, *ties).agg(F.count(F.lit(1)).alias("_n"))
    sizes = levels.groupBy(KEY).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    prior = _prior_struct(keys)
    offs = sizes.select(KEY, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias(OFF),
                        F.coalesce(F.sum("_d").over(prior), F.lit(0)).alias("_doff"))
    w_total = Window.partitionBy(KEY).orderBy(*_order(order))
    w_ties = Window.partitionBy(KEY).orderBy(*_order(order)[:len(ties)])
    y = x.withColumns({"_rn": F.row_number().over(w_total), "_rk": F.rank().over(w_ties), "_dr": F.dense_rank().over(w_ties)}).join(offs, KEY)
    return (y.withColumn("row_num", (F.col(OFF) + F.col("_rn")).cast("long"))
             .withColumn("rank", (F.col(OFF) + F.col("_rk")).cast("long"))
             .withColumn("dense_rank", (F.col("_doff") + F.col("_dr")).cast("long"))
             .drop(KEY, OFF, "_doff", "_rn", "_rk", "_dr", RANGE))


_COMBINE = {
    "sum": (F.sum, F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
}


def running(df: DataFrame, keys, order, bucket: Column | None = None, **aggs) -> DataFrame:
    """Running aggregates from the first row of the key to the current row.

    Each keyword is `out=("sum" | "count" | "min" | "max", column)`."""
    keys, have = list(keys), df.columns
    df, bucket = _cut(df, keys, order, bucket)
    x = _keyed(df, keys, bucket)
    per = x.groupBy(KEY).agg(*[_COMBINE[f][0](col(c)).alias(f"_p_{n}") for n, (f, c) in aggs.items()])
    prior = per.select(KEY, *[_COMBINE[f][1](f"_p_{n}").over(_prior_struct(keys)).alias(f"_o_{n}") for n, (f, _) in aggs.items()])
    w = (Window.partitionBy(KEY).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    y = x.withColumns({f"_l_{n}": _COMBINE[f][0](col(c)).over(w) for n, (f, c) in aggs.items()}).join(prior, KEY)
    y = y.withColumns({n: _COMBINE[f][2](F.col(f"_o_{n}"), F.col(f"_l_{n}")) for n, (f, _) in aggs.items()})
    return y.select(*dict.fromkeys([*have, *aggs]))


def _blocks(df: DataFrame, keys, order, bucket, preceding: int, following: int, block: int | None, pos: str) -> DataFrame:
    """Rows with their position, copied into each block of positions whose frames need them:
    `_zc_c.blk` is the block, `_zc_c.own` marks the row's own one."""
    reach = max(preceding, following, 1)
    block = max(block or 4096, reach)
    x = with_position(df, keys, order, bucket, pos)
    i = F.col(pos) - 1
    k = F.floor(i / block)
    m = i % block
    copies = F.array_compact(F.array(
        F.struct(k.alias("blk"), F.lit(True).alias("own")),
        F.when(m >= block - preceding, F.struct((k + 1).alias("blk"), F.lit(False).alias("own"))),
        F.when((m < following) & (k > 0), F.struct((k - 1).alias("blk"), F.lit(False).alias("own")))))
    return x.withColumn("_zc_c", F.explode(copies))


def framed(df: DataFrame, keys, order, bucket: Column | None, preceding: int, following: int, exprs,
           block: int | None = None, position: str | None = None) -> DataFrame:
    """Bounded row frames: `exprs` maps a name to `f(window_spec)`; the spec is ordered and
    unframed so `exprs` may use lag/lead (within the reach) or `rowsBetween`."""
    keys, pos, have = list(keys), position or "_zc_pos", df.columns
    df, bucket = _cut(df, keys, order, bucket)
    y = _blocks(df, keys, order, bucket, preceding, following, block, pos)
    w = Window.partitionBy(*keys, F.col("_zc_c.blk")).orderBy(pos)
    y = y.withColumns({n: f(w) for n, f in exprs.items()}).filter("_zc_c.own")
    return y.select(*dict.fromkeys([*have, *([pos] if position else []), *exprs]))


def framed_arrays(df: DataFrame, keys, order, bucket: Column, preceding: int, value: str, fn, outputs, block: int | None = None) -> DataFrame:
    """Frames that built-in windows cannot express: `fn(values)` gets the float values of one
    block with its halo in order and returns one array per name in `outputs`.  A block holds at
    most `block + preceding` rows."""
    keys = list(keys)
    y = _blocks(df, keys, order, bucket, preceding, 0, block, "_zc_pos")
    y = y.select(*df.columns, F.struct(*keys, F.col("_zc_c.blk")).alias("_zc_g"), "_zc_pos", F.col("_zc_c.own").alias("_zc_own"), F.col(value).cast("double").alias("_zc_v"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"{n} double" for n in outputs]])
    names = df.columns

    def step(table):  # Arrow tables keep the types of the columns that are only passed through
        table = table.sort_by("_zc_pos")
        got = fn(table["_zc_v"].to_numpy().astype(float))
        out = table.select(names)
        for n, a in zip(outputs, got):
            out = out.append_column(n, pa.array(a, pa.float64(), from_pandas=True))
        return out.filter(table["_zc_own"])

    return y.groupBy("_zc_g").applyInArrow(step, schema)


def with_group_stats(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """Whole-partition aggregates: partial aggregation plus a join back, so that a large key
    is combined map-side and the join can be split by adaptive execution."""
    return null_safe_join(df, df.groupBy(*keys).agg(*aggs), list(keys))


def top_per_group(df: DataFrame, keys, order, k: int, rank_name: str | None = None) -> DataFrame:
    """First k rows per key.  The rank filter is pushed below the shuffle as a group limit, so
    each task forwards at most k rows of a key."""
    name = rank_name or "_zc_top"
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_name else out.drop(name)


def exact_quantiles(df: DataFrame, keys, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key, a column for each of `quantiles` (name to share), in one pass.

    Equal values are counted before they are shuffled, so a frequent value is one row.  The counts are cut into
    ranges of (key, value) and added up, one row per key and range; only the ranges that hold a wanted
    rank are read again, and there the running count of values says which of them has it."""
    keys = list(keys)
    x = in_ranges(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, [value])
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_p").over(whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = x.groupBy(*keys, RANGE).agg(F.sum("_n").alias("_p")).select(*keys, RANGE, "_p", before.alias(OFF), F.sum("_p").over(whole).alias("_tot"))
    at = {n: (F.col("_tot") - 1) * F.lit(float(q)) for n, q in quantiles.items()}
    ends = {n: (F.floor(a), F.ceil(a)) for n, a in at.items()}
    holds = lambda rank, first, count: (rank >= first) & (rank < first + count)
    wanted = per.filter(any_of([holds(r, F.col(OFF), F.col("_p")) for pair in ends.values() for r in pair])).drop("_p")
    upto = F.sum("_n").over(Window.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    y = null_safe_join(x, wanted, [*keys, RANGE]).withColumn("_i", F.col(OFF) + upto - F.col("_n"))
    pick = lambda rank: F.max(F.when(holds(rank, F.col("_i"), F.col("_n")), F.col(value)))
    shares = {n: F.max(a - F.floor(a)) for n, a in at.items()}
    return y.groupBy(*keys).agg(*[(pick(lo) + (pick(hi) - pick(lo)) * shares[n]).alias(n) for n, (lo, hi) in ends.items()])


def exact_quantile(df: DataFrame, keys, value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """One of `exact_quantiles`."""
    return exact_quantiles(df, keys, value, {name: q})


def sequenced(df: DataFrame, order, start: Column | int = 0, name: str = "sk") -> DataFrame:
    """Dense numbers after `start` in the order of `order` over the whole table, whatever its values.

    Rows are sorted in ranges whose bounds come from the data and stored with their place in the range;
    a number is that place after the rows of the ranges before, whose counts are one row a partition."""
    have = df.columns
    sorted_ = df.repartitionByRange(*_order(order)).sortWithinPartitions(*_order(order))
    x = store(sorted_.withColumn(AT, F.monotonically_increasing_id())).withColumn(RANGE, F.shiftright(AT, 33))  # the partition stands above 33 bits
    per = x.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    y = x.join(F.broadcast(per.select(RANGE, before.alias(OFF))), RANGE)  # one row a partition
    base = F.lit(start) if isinstance(start, int) else F.coalesce(start, F.lit(0))
    number = base + F.col(OFF) + F.col(AT).bitwiseAND((1 << 33) - 1) + 1
    return y.withColumn(name, number.cast("long")).select(*dict.fromkeys([*have, name]))


def same_keys(a: DataFrame, b: DataFrame, keys) -> Column:
    return all_of([a[k].eqNullSafe(b[k]) for k in keys])
