"""Connected components and the exact linking of banded sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecraft.llm.bitmap import may_match
from zonecraft.session import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for every end of the edges (x, y): the smallest key of its component.

    Alternates hooking the larger neighbours and the smaller neighbours of every node to the
    smallest key around it, until only stars are left.  A step is two aggregations and two joins
    over edge rows; nothing is gathered per node, so a node may have any number of edges.  Rounds
    grow with the logarithm of the longest path."""
    e = edges.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    while True:
        last = e
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        e = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").distinct()
        least = e.groupBy("x").agg(F.min("y").alias("m"))
        hooked = e.join(least, "x")
        e = store(hooked.select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").unionByName(least.select("x", F.col("m").alias("y"))).distinct())
        discard(last)
        again = e.groupBy("x").count().filter("count > 1").select("x").limit(1)
        chained = e.join(e.select(F.col("x").alias("y")).distinct(), "y", "left_semi").select("x").limit(1)
        if not again.unionByName(chained).take(1):
            break
    roots = e.select(F.col("y").alias("key"), F.col("y").alias("label")).distinct()
    return e.select(F.col("x").alias("key"), F.col("y").alias("label")).unionByName(roots)


def linked(rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, block: int = 1 << 17) -> DataFrame:
    """(key, label): components of sets with 100 |intersection| >= percent |union|, among sets that
    share a band.  `rows` has (band, key); equal rows are allowed.  It is read twice, so that little is
    shuffled whole: the first halves of the least and largest key of a band, then the rows whose
    band two keys share, the others being dropped where they are read.  `fetch` returns (key, s) for the
    stored table of keys it is given.  Keys without a link are left out.  What is stored on the way goes
    as soon as it has been read for the last time; the result is stored.

    No bucket is expanded into pairs.  First every bucket's members are compared with one of them, the
    smallest key, which is the same for most buckets of a group; this joins almost all that belongs
    together.  Buckets whose members are one component then are done.  Buckets that still hold
    several are put together where they overlap, and in such a cluster the members outside its
    largest component are compared with all members, as blocks of at most `block` shingles (or one
    set) that tasks multiply as 0-1 matrices: only links are emitted.  So no link that joins two components
    is lost, and a cluster costs its size times what stands apart in it."""
    half = F.col("key.a")
    shared = store(rows.groupBy("band").agg(F.min(half).alias("lo"), F.max(half).alias("hi")).filter("lo != hi").select("band"))
    # equal rows meet by band and key, so a band with many keys is dealt out
    members = may_match(rows, F.col("band"), shared, F.col("band")).dropDuplicates()
    members = store(members.join(shared, "band", "left_semi"))
    discard(shared)
    needed = store(members.select("key").distinct())
    sets = store(fetch(needed))
    star = store(members.groupBy("band").agg(F.min("key").alias("p")).join(members, "band").filter("p != key"))
    discard(needed, members)
    pairs = star.select("p", "key").distinct()
    both = pairs.join(sets.select("key", "s"), "key").join(sets.select(F.col("key").alias("p"), F.col("s").alias("sp")), "p")
    few, many = F.least(F.size("s"), F.size("sp")), F.greatest(F.size("s"), F.size("sp"))
    same = F.size(F.array_intersect("s", "sp"))
    links = both.filter(100 * few >= percent * many).filter(100 * same >= percent * (few + many - same))
    links = store(links.select(F.col("key").alias("x"), F.col("p").alias("y")))
    labels = store(components(links))
    discard(links)

    label = lambda key, name: labels.select(F.col("key").alias(key), F.col("label").alias(name))
    apart = star.join(label("key", "lk"), "key", "left").join(label("p", "lp"), "p", "left").filter(F.coalesce("lk", "key") != F.coalesce("lp", "p"))
    overlap = store(star.join(apart.select("band").distinct(), "band", "left_semi").select(F.col("key").alias("x"), F.col("p").alias("y")).distinct())
    discard(star)
    if overlap.isEmpty():
        discard(overlap, sets)
        return labels
    clusters = components(overlap).withColumnRenamed("label", "cluster")
    member = store(clusters.join(label("key", "label"), "key", "left").withColumn("label", F.coalesce("label", "key")).join(sets, "key"))
    discard(overlap, sets)
    found = store(_between_blocks(member, percent, block))
    discard(member)
    if found.isEmpty():
        discard(found)
        return labels
    joins = store(components(found))
    discard(found)
    moved = labels.join(joins.select(F.col("key").alias("label"), F.col("label").alias("to")), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    out = store(moved.unionByName(joins.join(labels.select("key"), "key", "left_anti")))
    discard(labels, joins)
    return out


def _between_blocks(member: DataFrame, percent: int, block: int) -> DataFrame:
    """(x, y): labels of linked members (key, cluster, label, s) of a cluster with different labels."""
    weighed = member.select("key", "cluster", "label", "s", (F.size("s") + 64).cast("long").alias("w"))
    per = weighed.groupBy("cluster", "label").agg(F.sum("w").alias("w"))
    sizes = per.groupBy("cluster").agg(F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("w"))
    sizes = store(sizes.select("cluster", F.col("most.label").alias("main"), F.ceil((F.col("w") - F.col("most.w")) / block).alias("nl"), F.ceil(F.col("w") / block).alias("nr"), "w"))
    small = sizes.filter("nr = 1").agg(F.sum("w").alias("w")).first()["w"] or 0
    # small clusters are worked many at a time
    unit = F.when(F.col("nr") == 1, F.pmod(F.xxhash64("cluster"), F.lit(small // block + 1))).otherwise(F.xxhash64("cluster"))
    x = weighed.join(sizes.drop("w"), "cluster").withColumn("unit", unit).withColumn("h", F.xxhash64("key"))
    columns = ["unit", "lb", "rb", F.xxhash64("cluster").alias("c"), F.col("label.a").alias("a"), F.col("label.b").alias("b"), "s"]
    names = ["unit", "lb", "rb", "c", "a", "b", "s"]
    left = x.filter("label != main").withColumn("lb", F.pmod("h", "nl")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1))).select(*columns).toDF(*names)
    right = x.withColumn("rb", F.pmod("h", "nr")).withColumn("lb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1))).select(*columns).toDF(*names)

    def work(one: pa.Table, other: pa.Table) -> pa.Table:
        sides = []
        for t in (one.combine_chunks(), other.combine_chunks()):
            lists = t.column("s").combine_chunks()
            sides.append(([t.column(c).to_numpy() for c in ("c", "a", "b")], lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())))
        found = [np.zeros((0, 4), np.int64)]
        for c in np.intersect1d(sides[0][0][0], sides[1][0][0]):
            (la, lb, lv, ln), (ra, rb, rv, rn) = (_rows_of(names, values, sizes, names[0] == c) for names, values, sizes in sides)
            same = common_counts(lv, ln, rv, rn)
            hit = (100 * same >= percent * (ln[:, None] + rn[None, :] - same)) & ((la[:, None] != ra[None, :]) | (lb[:, None] != rb[None, :]))
            i, j = np.nonzero(hit)
            found.append(np.unique(np.stack([la[i], lb[i], ra[j], rb[j]], axis=1), axis=0))
        out = np.concatenate(found)
        return pa.table([pa.array(out[:, i]) for i in range(4)], ["xa", "xb", "ya", "yb"])

    keys = ("unit", "lb", "rb")
    links = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "xa bigint, xb bigint, ya bigint, yb bigint")
    return links.select(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")).alias("x"), F.struct(F.col("ya").alias("a"), F.col("yb").alias("b")).alias("y")).distinct()


def _rows_of(names, values, sizes, pick):
    return names[1][pick], names[2][pick], values[np.repeat(pick, sizes)], sizes[pick].astype(np.int64)


def common_counts(lv, ln, rv, rn, width: int = 4096) -> np.ndarray:
    """How many values every set of one side shares with every set of the other; sets are runs of the
    lengths `ln` and `rn` in `lv` and `rv`."""
    shared = np.intersect1d(lv, rv)
    same = np.zeros((len(ln), len(rn)), dtype=np.float32)
    places = []
    for values, sizes in ((lv, ln), (rv, rn)):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order], len(sizes)))
    for lo in range(0, len(shared), width):
        parts = []
        for at, owner, n in places:
            a, b = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, min(width, len(shared) - lo)), dtype=np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            parts.append(m)
        same += parts[0] @ parts[1].T
    return same.astype(np.int64)
