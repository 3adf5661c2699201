"""Joins.  Strategies are left to Catalyst and adaptive execution; a broadcast is hinted only
behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.functions.exprs import all_of, null_safe_join
from zonecraft.operators.window import KEY, _cut, _keyed
from zonecraft.session import BROADCAST_LIMIT, broadcast_if_small, estimated_bytes, store


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner", select=None, null_safe: bool = False,
            broadcast: bool = False) -> DataFrame:
    """Join on `(left column, right column)` pairs; equal names are merged.

    A product has every row of the left side once per row of the right, so it is made only for a right side
    whose size Catalyst can prove to be small; its rows are then what the caller asks for.  For a larger
    one, join on a key or a range."""
    how = {"full": "full_outer", "left_outer": "left", "right_outer": "right"}.get(how, how)
    if how == "cross":
        if estimated_bytes(right) > BROADCAST_LIMIT:
            raise ValueError(f"a product needs a right side of at most {BROADCAST_LIMIT} bytes; join on a key instead")
        return left.crossJoin(F.broadcast(right))
    r = right
    for a, b in keys:
        r = r.withColumnRenamed(b, f"_r_{b}")
    tests = [(left[a].eqNullSafe(r[f"_r_{b}"]) if null_safe else left[a] == r[f"_r_{b}"]) for a, b in keys]
    if broadcast:
        r = broadcast_if_small(r)
    out = left.join(r, all_of(tests), how)
    if how not in ("left_semi", "left_anti"):
        same = [(a, b) for a, b in keys if a == b]
        if how in ("right", "full_outer"):
            out = out.withColumns({a: F.coalesce(F.col(a), F.col(f"_r_{b}")) for a, b in same}) if same else out
        out = out.drop(*[f"_r_{b}" for _, b in same])
        out = out.withColumnsRenamed({f"_r_{b}": b for a, b in keys if a != b})
    return out.select(*select) if select else out


def multi_join(base: DataFrame, dependencies) -> DataFrame:
    """Joins in `join_order`; each dependency is a dict with table, keys, join_type, select,
    null_safe and broadcast (a wish that is honoured only for sizes proven small)."""
    for d in sorted(dependencies, key=lambda d: d.get("join_order", 0)):
        right = d["table"]
        if d.get("select"):
            right = right.select(*dict.fromkeys([*[k[1] for k in d["keys"]], *d["select"]]))
        base = join_on(base, right, d["keys"], d.get("join_type", "left"), null_safe=d.get("null_safe", False), broadcast=d.get("broadcast", False))
    return base


def lookup(df: DataFrame, reference: DataFrame, keys, columns, default=None) -> DataFrame:
    """Left join to a reference query, optionally with a default for misses."""
    out = join_on(df, reference.select(*[k[1] for k in keys], *columns), keys, "left", broadcast=True)
    return out if default is None else out.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def merge_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    return join_on(left, right.hint("merge"), keys, how)


def changed(current: DataFrame, incoming: DataFrame, keys, hash_col: str) -> DataFrame:
    """Incoming rows whose key exists with a different hash."""
    c = current.select(*keys, F.col(hash_col).alias("_old_hash"))
    return null_safe_join(incoming, c, list(keys)).filter(~F.col(hash_col).eqNullSafe(F.col("_old_hash"))).drop("_old_hash")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_pk")), F.col(child_key) == F.col("_pk"), "left_anti")


def latest_child(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, order, columns, how: str = "left") -> DataFrame:
    """Newest child row per parent: partial max aggregation, then a join of one row per key."""
    last = child.groupBy(F.col(child_key).alias("_ck")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_c"))
    return parent.join(last, parent[parent_key] == F.col("_ck"), how).select(*parent.columns, "_c.*")


def with_child_stats(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, *aggs: Column, zero=()) -> DataFrame:
    """Per-parent aggregates of the children; `zero` names counts that default to 0."""
    g = child.groupBy(F.col(child_key).alias("_ck")).agg(*aggs)
    out = parent.join(g, parent[parent_key] == F.col("_ck"), "left").drop("_ck")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}) if zero else out


def as_of(facts: DataFrame, versions: DataFrame, keys, ts: str, start: str, end: str | None, columns, bucket=None) -> DataFrame:
    """Version of the dimension valid at the time of each fact, null where none is.

    Facts and versions are merged into one ordered stream per key, in which a version travels as a
    struct: within a time bucket a window carries the last one forward, between buckets only the last of
    each is carried.  So rows are exchanged once, and no fact meets more than one version.  Of versions
    with one start the one that ends last holds.  `bucket(column)` gives the time bucket of a timestamp
    column; without it, buckets are ranges taken from the data, at the cost of another exchange."""
    keys = list(keys)
    until = F.col(end) if end else F.lit(None).cast(versions.schema[start].dataType)
    held = F.struct(F.col(start).alias("s"), until.alias("e"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    # a version without start holds for no time
    marks = versions.filter(F.col(start).isNotNull()).select(*keys, F.col(start).alias("_t"), held.alias("_v"), F.lit(False).alias("_fact"))
    line = facts.withColumns({"_t": F.col(ts), "_v": F.lit(None).cast(marks.schema["_v"].dataType), "_fact": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_fact"), F.asc_nulls_last("_v.e")]
    x, b = _cut(line, keys, order, bucket(F.col("_t")) if bucket else None)
    x = _keyed(x, keys, b)
    # what a bucket hands on is its last version, so only versions are aggregated; buckets of facts just ask for it
    newest = x.filter(~F.col("_fact")).groupBy(KEY).agg(F.max_by("_v", F.struct("_t", F.col("_v.e").isNull(), "_v.e")).alias("_last"))
    asking = x.filter("_fact").select(KEY).distinct().withColumn("_last", F.lit(None).cast(newest.schema["_last"].dataType))
    # a bucket of both has two rows; the one that asks comes first and sees no more than what was before it
    both = newest.withColumn("_asks", F.lit(False)).unionByName(asking.withColumn("_asks", F.lit(True)))
    before = Window.partitionBy(*[F.col(f"{KEY}.k{i}") for i in range(len(keys))]).orderBy(F.col(f"{KEY}.b"), F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    prior = both.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).filter("_asks").select(KEY, "_carried")
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    y = x.withColumn("_seen", seen).filter("_fact").join(prior, KEY).withColumn("_seen", F.coalesce("_seen", "_carried"))
    valid = F.col("_seen.e").isNull() | (F.col(ts) < F.col("_seen.e"))
    return y.select(*facts.columns, F.when(valid, F.col("_seen.s")).alias(start), *[F.when(valid, F.col(f"_seen.c{i}")).alias(c) for i, c in enumerate(columns)])


def cross_reference(df: DataFrame, xref: DataFrame, key: str, source_key: str, master: str, name: str = "master_id") -> DataFrame:
    """Master id by cross reference, the own id where there is none."""
    x = xref.select(F.col(source_key).alias("_sk"), F.col(master).alias("_m"))
    return df.join(x, df[key] == F.col("_sk"), "left").withColumn(name, F.coalesce("_m", key)).drop("_sk", "_m")


def overlap_groups(df: DataFrame, id_col: str, type_col: str, items: str) -> DataFrame:
    """Members of the same type that share a list item (or the item of distinct rows).

    Two ids are candidates exactly when they occur in a common (type, item) group.  The groups
    are returned member by member with the group's first id and size: the same information as
    the list of all pairs at linear instead of quadratic size."""
    listed = df.schema[items].dataType.typeName() == "array"
    item = F.explode(F.array_distinct(items)) if listed else F.col(items)
    m = df.select(F.col(id_col).alias("member_id"), F.col(type_col).alias("group_type"), item.alias("item"))
    g = m.groupBy("group_type", "item").agg(F.min("member_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    return null_safe_join(m, g.filter("group_size > 1"), ["group_type", "item"])
