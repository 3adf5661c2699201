"""Exact top-k by cosine over a coarse partition of the corpus.

Every vector falls into a cell, the signs of its projections on a few random directions.  Where it is
read, it is packed into a block with others of its cell, and the block keeps its centre and the largest
angle of a member to it; so the index is one pass without a shuffle.  A query first looks
into the cells nearest to it that hold k vectors; the k-th score found there is a floor.  No vector of a
cell or block is nearer to the query than the angle between query and centre less the largest
angle of a member, so those that cannot reach the floor are left out, and the result is exact."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from zonecraft.operators.window import top_per_group
from zonecraft.session import store

PLANES, BLOCK, QUERIES, SLACK = 6, 1024, 512, 1e-9


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _spread(units: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean direction of vectors and the largest angle of one to it; without a direction, half a turn."""
    centre = units.mean(axis=0)
    size = np.linalg.norm(centre)
    if size < 1e-9:
        return centre * 0, math.pi
    centre = centre / size
    return centre, float(np.arccos(np.clip(units @ centre, -1, 1)).max())


def _widened(df: DataFrame, c: str) -> tuple[DataFrame, str]:
    """Identifiers travel as bigint or string."""
    kind = "bigint" if isinstance(df.schema[c].dataType, IntegralType) else "string"
    return df.withColumn(c, F.col(c).cast(kind)), kind


def vector_blocks(corpus: DataFrame, key: str, vector: str, planes: int = PLANES, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(cell, n, centre, radius, ids, vectors): at most `block` vectors of one cell, one after another in
    `vectors`.  A task holds at most eight blocks' worth of vectors; null vectors are left out."""
    corpus, kind = _widened(corpus, key)
    item = corpus.schema[vector].dataType.elementType.simpleString()

    def work(batches):
        directions, held, size = None, {}, 0

        def packed(cell):
            ids, parts = zip(*held.pop(cell))
            raw = np.concatenate(parts)
            centre, radius = _spread(_units(raw.astype(np.float64)))
            lists = [pa.array([cell], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])]
            return len(raw), pa.RecordBatch.from_arrays(
                [*lists, pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), pa.concat_arrays(ids)), pa.ListArray.from_arrays(pa.array([0, raw.size], pa.int32()), pa.array(raw.ravel()))],
                ["cell", "n", "centre", "radius", "ids", "vectors"])

        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if directions is None:
                directions = np.random.default_rng(seed).standard_normal((planes, raw.shape[1]))
            cells = ((raw.astype(np.float64) @ directions.T) > 0) @ (1 << np.arange(planes))
            for cell in np.unique(cells).tolist():
                some = np.flatnonzero(cells == cell)
                for lo in range(0, len(some), block):
                    rows = some[lo:lo + block]
                    if sum(len(p) for _, p in held.get(cell, ())) + len(rows) > block:
                        n, out = packed(cell)
                        size -= n
                        yield out
                    held.setdefault(cell, []).append((b.column(0).take(pa.array(rows)), raw[rows]))
                    size += len(rows)
                while size > 8 * block:
                    n, out = packed(max(held, key=lambda c: sum(len(p) for _, p in held[c])))
                    size -= n
                    yield out
        for cell in sorted(held):
            yield packed(cell)[1]

    rows = corpus.filter(F.col(vector).isNotNull()).select(key, vector)
    return rows.mapInArrow(work, f"cell int, n bigint, centre array<double>, radius double, ids array<{kind}>, vectors array<{item}>")


def vector_cells(blocks: DataFrame) -> DataFrame:
    """(cell, n, centre, radius) of the cells, from the centres of their blocks: one row per sign pattern."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, centres = table["n"].to_numpy(), _matrix(table["centre"].combine_chunks(), table.num_rows)
        centre = (centres * n[:, None]).sum(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-9 else centre * 0
        far = np.arccos(np.clip(centres @ centre, -1, 1)) + table["radius"].to_numpy()
        # a block without a direction says nothing about its members
        vague = size <= 1e-9 or (np.abs(centres).sum(axis=1) == 0).any()
        return pa.table({"cell": table["cell"][:1], "n": [int(n.sum())], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [math.pi if vague else float(min(far.max(), math.pi))]})

    return blocks.select("cell", "n", "centre", "radius").groupBy("cell").applyInArrow(merge, "cell int, n bigint, centre array<double>, radius double")


def _found(blocks: DataFrame, pairs: DataFrame, k: int, threshold: float, types: tuple[str, str]) -> DataFrame:
    """(query_id, doc_id, score) above `threshold` and not below the query's floor, at most k (and ties) per
    query and block, for pairs (query_id, vector, cell, floor).  Queries of a cell travel in bounded groups."""
    count = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("groups"))
    grouped = pairs.join(F.broadcast(count), "cell").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")))  # one row a cell
    asked = grouped.groupBy("cell", "group").agg(F.collect_list(F.struct("query_id", "vector", "floor")).alias("q"))
    asked = asked.select("cell", F.col("q.query_id").alias("names"), F.flatten("q.vector").alias("queries"), F.col("q.floor").alias("floors"))

    def best(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                at = {n: row.column(j) for j, n in enumerate(row.schema.names)}
                names, floors = at["names"].flatten(), at["floors"].flatten().to_numpy(zero_copy_only=False)
                q = _units(_matrix(at["queries"], len(names)))
                centre, radius = at["centre"].flatten().to_numpy(), at["radius"][0].as_py()
                if radius < math.pi:
                    nearest = np.maximum(np.arccos(np.clip(q @ centre, -1, 1)) - radius, 0)
                    open_ = np.flatnonzero((np.cos(nearest) + 1) / 2 + SLACK >= np.maximum(floors, threshold))
                    names, floors, q = names.take(pa.array(open_)), floors[open_], q[open_]
                if not len(names):
                    continue
                ids = at["ids"].flatten()
                s = (_units(_matrix(at["vectors"], len(ids))) @ q.T + 1.0) / 2.0
                hit = (s > threshold) & (s + SLACK >= floors)
                if len(ids) > k:
                    hit &= s + SLACK >= -np.partition(-s, k - 1, axis=0)[k - 1]
                d, j = np.nonzero(hit)
                if len(d):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), ids.take(pa.array(d)), pa.array(s[d, j])], ["query_id", "doc_id", "score"])

    met = blocks.select("cell", "centre", "radius", "ids", "vectors").join(asked, "cell").drop("cell")
    return met.mapInArrow(best, f"query_id {types[0]}, doc_id {types[1]}, score double")


def vector_scores(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, threshold: float = 0.3, planes: int = PLANES, block: int = BLOCK) -> DataFrame:
    """Top-k by cosine, mapped to (s+1)/2, above the threshold, for every query (query_id, vector), ties by
    id.  Ids of queries are distinct."""
    queries, qtype = _widened(queries, "query_id")
    types = (qtype, _widened(corpus, key)[1])
    blocks = store(vector_blocks(corpus, key, vector, planes, block))
    cells = vector_cells(blocks)
    queries = store(queries.filter(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector")))
    # every query against every cell: as many cells as sign patterns
    dot = F.aggregate(F.zip_with("vector", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b * b))
    near = F.least(F.greatest(F.coalesce(dot / F.nullif(size, F.lit(0.0)), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    met = queries.crossJoin(F.broadcast(cells)).select("query_id", "cell", "n", "radius", near.alias("near"))
    bound = F.when(F.col("radius") >= math.pi, 1.0).otherwise((F.cos(F.greatest(F.acos("near") - F.col("radius"), F.lit(0.0))) + 1) / 2)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    met = store(met.withColumn("bound", bound).filter(F.col("bound") + SLACK >= threshold).withColumn("before", F.coalesce(F.sum("n").over(nearest), F.lit(0))))
    order = [F.desc(F.round("score", 12)), "doc_id"]  # products of equal vectors may differ in their last digits
    asked = lambda pairs: pairs.join(queries, "query_id")
    first = _found(blocks, asked(met.filter(F.col("before") < k).select("query_id", "cell", F.lit(0.0).alias("floor"))), k, threshold, types)
    first = store(top_per_group(first, ["query_id"], order, k))
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("floor"))
    rest = met.filter(F.col("before") >= k).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).filter(F.col("bound") + SLACK >= F.col("floor"))
    second = _found(blocks, asked(rest.select("query_id", "cell", "floor")), k, threshold, types)
    return top_per_group(first.unionByName(second), ["query_id"], order, k)
