"""Lineage and dependency graphs as edge tables.

Traversals are frontier joins with the nodes already seen removed; every round is stored or checkpointed
so that plans stay short and survive lost executors.  Many starts travel together as the bits of a
number, and stretches without branches are crossed by doubling, in the logarithm of their length."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import null_safe_join
from zonecraft.operators.window import sequenced
from zonecraft.session import cut_lineage, store

BITS = 64


def edges_of(df: DataFrame, src, dst) -> DataFrame:
    e = df.select(F.col(src).alias("src") if isinstance(src, str) else src.alias("src"),
                  F.col(dst).alias("dst") if isinstance(dst, str) else dst.alias("dst"))
    return e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def numbered_starts(starts: DataFrame) -> DataFrame:
    """(start, block, bit): the distinct starts of a one-column table, BITS to a block."""
    one = sequenced(starts.select(F.col(starts.columns[0]).alias("start")).distinct(), ["start"], -1, "_no")
    return store(one.select("start", F.expr(f"_no div {BITS}").alias("block"), (F.col("_no") % BITS).cast("int").alias("bit")))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, block, bits, depth): which starts of `numbered_starts` reach a node first after `depth` steps, as
    the bits of a number, for all depths or up to `max_depth`.

    A round moves at most one row per edge and block of starts, so its work does not grow with the
    pairs of start and node; equal targets are combined before they are shuffled."""
    edges = store(edges)
    front = store(starts.groupBy(F.col("start").alias("node"), "block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")))
    seen, found = front, []
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        old = seen.select(F.col("node").alias("_n"), F.col("block").alias("_b"), F.col("bits").alias("_old"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))
        front = store(step.join(old, (F.col("node") == F.col("_n")) & (F.col("block") == F.col("_b")), "left").select("node", "block", new.alias("bits")).filter("bits != 0"))
        if front.isEmpty():
            break
        found.append(front.withColumn("depth", F.lit(depth)))
        seen = store(seen.unionByName(front).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
    out = front.withColumn("depth", F.lit(0)).limit(0)
    for x in found:
        out = out.unionByName(x)
    return out


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): every node reached from each start, or within `max_depth` steps if given,
    at its least depth.  `starts` has one column.  Pairs are made from the bits of `reach` at the end."""
    numbered = numbered_starts(starts)
    found = reach(edges, numbered, max_depth).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))))
    found = found.filter(F.getbit("bits", F.col("bit")) == 1)
    return found.join(numbered, ["block", "bit"]).select("start", "node", "depth")


def upstream(edges: DataFrame, entities: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sources an entity derives from (edges point from source to target)."""
    return traverse(reverse(edges), entities, max_depth)


def downstream(edges: DataFrame, entities: DataFrame, max_depth: int | None = None) -> DataFrame:
    return traverse(edges, entities, max_depth)


def impact(edges: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Affected nodes and their least distance from any changed node; linear in the graph."""
    edges = cut_lineage(edges)
    front = changed.select(F.col(changed.columns[0]).alias("node")).distinct()
    seen, out = front, None
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        hit = front.withColumn("depth", F.lit(depth))
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else front.withColumn("depth", F.lit(0)).limit(0)


def neighbours(edges: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """Direct sources and targets of every asset with the catalog row of the neighbour."""
    up = edges.select(F.col("dst").alias("asset"), F.lit("upstream").alias("direction"), F.col("src").alias("neighbour"))
    down = edges.select(F.col("src").alias("asset"), F.lit("downstream").alias("direction"), F.col("dst").alias("neighbour"))
    return up.unionByName(down).distinct().join(catalog, F.col("neighbour") == F.col(name), "left").drop(name)


def named_edges(edges: DataFrame, nodes: DataFrame, key: str, columns) -> DataFrame:
    """Edge list with the attributes of both ends."""
    s = nodes.select(F.col(key).alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    d = nodes.select(F.col(key).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns])
    return edges.join(s, "src").join(d, "dst")


def _chain(edges: DataFrame) -> DataFrame:
    """(node, before, after) of the nodes with one edge in and one out, other than to themselves."""
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_in"), F.min("src").alias("before"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_out"), F.min("dst").alias("after"))
    return store(ins.join(outs, "node").filter("_in = 1 and _out = 1 and after != node").select("node", "before", "after"))


def _ends(chain: DataFrame, towards: str) -> tuple[DataFrame, DataFrame]:
    """((node, end, steps): where each chain node's stretch ends, (node, component): those on rings of chain nodes,
    with the least of the ring).

    A node's step is doubled by joining it with that of the node it has come to, until that is no chain
    node; a node that goes on for more steps than there are chain nodes has seen all of its ring."""
    size = chain.count()
    inside = chain.select(F.col("node").alias(towards), F.lit(True).alias("going"))
    at = store(chain.select("node", towards).join(inside, towards, "left").select(
        "node", F.col(towards).alias("end"), F.lit(1).cast("long").alias("steps"), F.coalesce("going", F.lit(False)).alias("going"), F.least("node", towards).alias("least")))
    done, going, hop = at.filter("not going"), at.filter("going"), 1
    while hop <= size and not going.isEmpty():
        ahead = done.unionByName(going).select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("going").alias("_going"), F.col("least").alias("_least"))
        met = store(going.drop("going").join(ahead, "end").select("node", F.col("_end").alias("end"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_going").alias("going"), F.least("least", "_least").alias("least")))
        done, going, hop = done.unionByName(met.filter("not going")), met.filter("going"), 2 * hop
    return done.select("node", "end", "steps"), going.select("node", F.col("least").alias("component"))


def _short(edges: DataFrame, chain: DataFrame, ends: DataFrame) -> DataFrame:
    """(src, dst, length): the edges between nodes that are no chain nodes, each stretch as one."""
    outer = edges.join(chain.select(F.col("node").alias("src")), "src", "left_anti")
    return store(outer.join(ends.select(F.col("node").alias("dst"), "end", "steps"), "dst", "left").select(
        "src", F.coalesce("end", "dst").alias("dst"), (F.coalesce("steps", F.lit(0)) + 1).alias("length")))


def levels(edges: DataFrame) -> DataFrame:
    """Level of each node: 0 without outgoing edges, otherwise one more than the highest target;
    nodes on or above a cycle get level 0.

    Stretches without branches are one long edge, so rounds grow with the branchings of a path, not with its
    steps; the nodes inside a stretch follow from its end."""
    edges = store(edges.select("src", "dst").distinct())
    nodes = store(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    chain = _chain(edges)
    ends, _ = _ends(chain, "after")
    rest = _short(edges, chain, ends)
    done = store(nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0).cast("long")))
    known, upto = done, None
    while not done.isEmpty():
        # what the levels just found say about the nodes before them
        told = rest.join(done.select(F.col("node").alias("dst"), "level"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("level") + F.col("length")).alias("level"))
        upto = store((told if upto is None else upto.unionByName(told)).groupBy("node").agg(F.max("level").alias("level")))
        rest = store(rest.join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "length"))
        done = store(upto.join(rest.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        upto = upto.join(done.select("node"), "node", "left_anti")
        known = known.unionByName(done)
    inner = ends.join(known.select(F.col("node").alias("end"), "level"), "end").select("node", (F.col("level") + F.col("steps")).alias("level"))
    return nodes.join(known.unionByName(inner), "node", "left").select("node", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def batches(edges: DataFrame) -> DataFrame:
    """Nodes per level: those of one level can run in parallel."""
    return levels(edges).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle: ends without incoming or outgoing edges."""
    while True:
        n = edges.count()
        if not n:
            return edges
        src, dst = edges.select(F.col("src").alias("v")).distinct(), edges.select(F.col("dst").alias("v")).distinct()
        core = src.join(dst, "v", "left_semi")
        edges = cut_lineage(edges.join(core.withColumnRenamed("v", "src"), "src", "left_semi")
                            .join(core.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
        if edges.count() == n:
            return edges


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes on cycles with the least member of their strongly connected component and its size.

    Stretches without branches are put together first; rings of them are components as they are.  Of the
    graph that is left, components are found by spreading labels; a node of a stretch belongs to the
    component that has both ends of it."""
    edges = store(edges.select("src", "dst").distinct())
    chain = _chain(edges)
    ends, ring = _ends(chain, "after")
    heads, _ = _ends(chain, "before")
    knots = store(_components(_short(edges, chain, ends)).select("node", "component"))
    of = lambda c: knots.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    inner = ends.select("node", "end").join(heads.select("node", F.col("end").alias("head")), "node").join(of("end"), "end").join(of("head"), "head").filter("_end = _head")
    member = store(knots.unionByName(inner.select("node", F.col("_end").alias("component"))).unionByName(ring))
    whole = member.groupBy("component").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("size"))
    return member.join(whole, "component").select("node", F.col("_least").alias("component"), "size")


def _components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes on cycles.

    Labels (the least node that reaches a node) are spread forward until stable; within one
    label the nodes that reach the label's own node form a component, which is then removed."""
    left = _trim(cut_lineage(edges.select("src", "dst").distinct()))
    out = None
    while not left.isEmpty():
        color = cut_lineage(left.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")))
        while True:
            sent = left.join(color, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("n2")).agg(F.min("color").alias("c2"))
            nxt = cut_lineage(color.join(sent, F.col("node") == F.col("n2"), "left")
                              .select("node", F.least("color", "c2").alias("color"), (F.col("c2") < F.col("color")).alias("moved")))
            color = nxt.select("node", "color")
            if nxt.filter("moved").isEmpty():
                break
        same = (left.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src")
                .join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").filter("cs = cd"))
        back = cut_lineage(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("color")))
        front = color.filter("node = color")
        member = front
        while True:
            step = (back.join(front.withColumnRenamed("node", "src"), ["src", "color"])
                    .select(F.col("dst").alias("node"), "color").distinct())
            front = cut_lineage(step.join(member, ["node", "color"], "left_anti").select("node", "color"))
            if front.isEmpty():
                break
            member = member.unionByName(front)
        member = cut_lineage(member)
        # a component of one node is a cycle only with an edge to itself
        loops = left.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
        sized = null_safe_join(member, member.groupBy("color").agg(F.count(F.lit(1)).alias("size")), ["color"]).join(loops, "node", "left")
        found = sized.filter("size > 1 OR loop").select("node", F.col("color").alias("component"), "size")
        out = found if out is None else out.unionByName(found)
        gone = member.select("node")
        left = _trim(cut_lineage(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
                                 .join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    return out


def zone_transitions(runs: DataFrame, feed: str, order, zone: str, bucket) -> DataFrame:
    """Lineage rows for consecutive runs of a feed in different zones."""
    from zonecraft.operators.window import framed
    x = framed(runs, [feed], order, bucket, 1, 0, {"source_zone": lambda w: F.lag(zone).over(w)})
    return x.filter(F.col("source_zone") != F.col(zone)).withColumnRenamed(zone, "target_zone")
