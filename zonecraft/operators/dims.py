"""Slowly changing dimensions, facts and star-schema helpers.

One full outer join of current and incoming rows decides the fate of every key; the rows that
result from it (keep, close, insert) are emitted from that join as an array, so neither input
is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecraft.functions.exprs import all_of, col, null_safe_join
from zonecraft.functions.hashing import hash_diff, hash_key
from zonecraft.operators.window import framed, sequenced, top_per_group
from zonecraft.session import store


def number_rows(df: DataFrame, keys, start: Column | int = 0, name: str = "sk") -> DataFrame:
    """Consecutive numbers after `start`, in key order for one numeric key, otherwise in the
    order of the key hash."""
    single = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType)
    return sequenced(df.drop(name), [keys[0]] if single else [hash_key(keys, "job"), *keys], start, name).select(*df.columns)


def _full(existing: DataFrame, incoming: DataFrame, keys) -> DataFrame:
    """Full outer join of whole rows as structs `_e` and `_i`; each side has unique keys."""
    e = existing.select(F.struct(*existing.columns).alias("_e"))
    i = incoming.select(F.struct(*incoming.columns).alias("_i"))
    return e.join(i, all_of([F.col(f"_e.{k}").eqNullSafe(F.col(f"_i.{k}")) for k in keys]), "full_outer")


HAS_E, HAS_I = "_e IS NOT NULL", "_i IS NOT NULL"


def _same(tracked) -> Column:
    """Whether the tracked columns of both sides agree, NULL being a value like any other."""
    return all_of([F.col(f"_e.{c}").eqNullSafe(F.col(f"_i.{c}")) for c in tracked])


def _assign(df: DataFrame, keys, sk: str, mode: str, salt: Column | None = None) -> DataFrame:
    """Fill missing surrogate keys: `dense` continues after the largest key, `hash` derives a
    64-bit key without any further pass over the data.  `df` holds all rows of `existing`; for dense
    keys it is written once, so the join it comes from is not run again for the largest key, the
    known and the new rows."""
    if mode == "hash":
        parts = [F.col(k) for k in keys] + ([salt] if salt is not None else [])
        return df.withColumn(sk, F.coalesce(F.col(sk), F.xxhash64(*parts)))
    x = store(df)
    top = x.agg(F.max(sk)).scalar()
    return x.filter(F.col(sk).isNotNull()).unionByName(number_rows(x.filter(F.col(sk).isNull()), keys, top, sk))


def _with_sk(incoming: DataFrame, sk: str) -> DataFrame:
    return incoming.withColumn(sk, F.lit(None).cast("long"))


def scd0(incoming: DataFrame, existing: DataFrame, keys, sk: str = "sk", sk_mode: str = "dense") -> DataFrame:
    """Add new keys only."""
    k = existing.select(*keys)
    fresh = _with_sk(null_safe_join(incoming, k, list(keys), "left_anti"), sk)
    return _assign(existing.unionByName(fresh.select(*existing.columns)), keys, sk, sk_mode)


def scd1(incoming: DataFrame, existing: DataFrame, keys, sk: str = "sk", sk_mode: str = "dense") -> DataFrame:
    """Overwrite attributes of known keys, keep their surrogate key, add new keys."""
    j = _full(existing, incoming, keys)
    def pick(c):
        if c == sk:
            return F.col(f"_e.{sk}")
        return F.when(F.expr(HAS_I), F.col(f"_i.{c}")).otherwise(F.col(f"_e.{c}")) if c in incoming.columns else F.col(f"_e.{c}")
    return _assign(j.select(*[pick(c).alias(c) for c in existing.columns]), keys, sk, sk_mode)


def scd2_first(incoming: DataFrame, keys, as_of: str, sk: str = "sk", start: str = "effective_start", end: str = "effective_end",
               current: str = "is_current", open_end: str | None = None) -> DataFrame:
    x = _with_sk(incoming, sk).withColumns({start: F.lit(as_of).cast("date"), end: F.lit(open_end).cast("date"), current: F.lit(True)})
    return number_rows(x, list(keys), 0, sk)


def versioned(incoming: DataFrame, existing: DataFrame, keys, tracked, as_of, *, start: str = "effective_start",
              end: str = "effective_end", current: str | None = "is_current", open_end=None, sk: str | None = None,
              sk_mode: str = "dense", only_changed: bool = True, stamp: dict | None = None) -> DataFrame:
    """Type 2 history: changed current rows are closed at `as_of` and a new version is added;
    keys without a current row get one (including keys known only from closed history).

    `only_changed=False` closes and re-inserts every delivered key.  `stamp` gives further
    columns of inserted rows."""
    fields = {f.name: f.dataType for f in existing.schema}
    is_open = F.col(end).isNull() if open_end is None else F.col(end) == F.lit(open_end).cast(fields[end])
    live = F.col(current) if current else is_open
    j = _full(existing.filter(live), incoming, keys)
    same = _same(tracked)
    has_e, has_i = F.expr(HAS_E), F.expr(HAS_I)
    change = has_e & has_i & (~same if only_changed else F.lit(True))
    stamp = stamp or {}

    def row(values):
        return F.struct(*[values(c).cast(t).alias(c) for c, t in fields.items()])

    def closed(c):
        return F.lit(as_of) if c == end else F.lit(False) if c == current else F.col(f"_e.{c}")

    def fresh(c):
        if c in (start, end, current):
            return {start: F.lit(as_of), end: F.lit(open_end), current: F.lit(True)}[c]
        if c == sk:
            return F.lit(None)
        return F.lit(stamp[c]) if c in stamp else F.col(f"_i.{c}")

    rows = F.array_compact(F.array(
        F.when(has_e & ~change, row(lambda c: F.col(f"_e.{c}"))), F.when(change, row(closed)),
        F.when(change | (has_i & ~has_e), row(fresh))))
    out = existing.filter(~F.coalesce(live, F.lit(False))).unionByName(j.select(F.inline(rows)))
    return _assign(out, list(keys), sk, sk_mode, F.lit(str(as_of))) if sk else out


def scd3(incoming: DataFrame, existing: DataFrame, keys, attributes, sk: str = "sk", sk_mode: str = "dense") -> DataFrame:
    """Previous-value columns: delivered keys move the old value to `prev_x`."""
    j = _full(existing, incoming, keys)
    has_e, has_i = F.expr(HAS_E), F.expr(HAS_I)
    out = []
    for c in existing.columns:
        if c == sk or c not in incoming.columns and not c.startswith("prev_"):
            out.append(F.col(f"_e.{c}").alias(c))
        elif c.startswith("prev_"):
            out.append(F.when(has_e & has_i, F.col(f"_e.{c[5:]}")).otherwise(F.col(f"_e.{c}")).alias(c))
        else:
            out.append(F.when(has_i, F.col(f"_i.{c}")).otherwise(F.col(f"_e.{c}")).alias(c))
    have = {f"prev_{a}" for a in attributes} & set(existing.columns)
    out += [F.when(has_e & has_i, F.col(f"_e.{a}")).alias(f"prev_{a}") for a in attributes if f"prev_{a}" not in have]
    return _assign(j.select(*out), list(keys), sk, sk_mode)


def change_labels(incoming: DataFrame, existing: DataFrame, keys, tracked) -> DataFrame:
    """new | changed | unchanged | absent per key."""
    j = _full(existing, incoming, keys)
    same = _same(tracked)
    label = (F.when(F.expr("_e IS NULL"), "new").when(F.expr("_i IS NULL"), "absent").when(same, "unchanged").otherwise("changed"))
    return j.select(*[F.coalesce(f"_e.{k}", f"_i.{k}").alias(k) for k in keys], label.alias("change"))


def change_counts(incoming, existing, keys, tracked) -> DataFrame:
    return change_labels(incoming, existing, keys, tracked).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def hash_columns(df: DataFrame, tracked, effective_from: str, recipe: str = "job") -> DataFrame:
    return df.withColumns({"_hash_diff": hash_diff(tracked, recipe), "_effective_from": F.lit(effective_from).cast("date"),
                           "_effective_to": F.lit(None).cast("date"), "_is_current": F.lit(True)})


def integrity(dim: DataFrame, keys, bucket: Column | None = None, sk: str = "sk", start: str = "effective_start", end: str = "effective_end",
              current: str = "is_current") -> DataFrame:
    """Violations per check: repeated surrogate keys, reversed ranges, several current rows of a
    key, overlapping versions.  Without a `bucket` of the start, the versions of a key are cut into
    ranges taken from the data, so one key may have most of them, at any starts."""
    def check(name, x):
        return x.select(F.lit(name).alias("check"), "violations")

    sks = dim.groupBy(sk).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    ranges = dim.agg(F.count_if(F.col(end) < F.col(start)).alias("violations"))
    cur = dim.groupBy(*keys).agg(F.count_if(current).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    nxt = framed(dim.select(*keys, start, end, sk), keys, [start, F.asc_nulls_last(end), sk], bucket, 0, 1, {"_next": lambda w: F.lead(start).over(w)})
    over = nxt.agg(F.count_if(F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("_next")))).alias("violations"))
    out = check("unique_surrogate_keys", sks).unionByName(check("valid_date_ranges", ranges)).unionByName(
        check("single_current_per_key", cur)).unionByName(check("no_overlap", over))
    return out.withColumn("passed", F.col("violations") == 0)


def load_dimension(source: DataFrame, existing: DataFrame | None, keys, attributes, scd_type: int, as_of: str, order=None,
                   sk: str = "sk", **kw) -> DataFrame:
    """Select key and attributes, reduce to one row per key, route by SCD type."""
    cols = [*keys, *attributes]
    rest = [F.asc_nulls_last(c) for c in attributes]
    incoming = top_per_group(source, keys, [*(order or []), *rest], 1).select(*cols)
    if existing is None:
        if scd_type == 2:
            return scd2_first(incoming, keys, as_of, sk)
        return number_rows(_with_sk(incoming, sk), list(keys), 0, sk)
    if scd_type == 2:
        return versioned(incoming, existing, keys, attributes, as_of, sk=sk, **kw)
    return {0: scd0, 1: scd1}[scd_type](incoming, existing, keys, sk, **kw) if scd_type < 2 else scd3(incoming, existing, keys, attributes, sk, **kw)


UNKNOWN = -1


def load_fact(source: DataFrame, lookups, grain, measures, execution_date: str, run_id: str) -> DataFrame:
    """Grain, surrogate keys and measures.

    `lookups` holds dicts dimension, table, join_key, dim_key, sk, filter; rows without a match
    get key -1.  `measures` maps the fact's name to the source column."""
    out, keys = source, []
    for d in lookups:
        t, name = d["table"], f"{d['dimension']}_{d.get('sk', 'sk')}"
        if d.get("filter"):
            t = t.filter(d["filter"])
        t = t.select(F.col(d.get("dim_key", d["join_key"])).alias("_dk"), F.col(d.get("sk", "sk")).alias("_dsk"))
        out = (out.join(t, F.col(d["join_key"]) == F.col("_dk"), "left")
               .withColumn(name, F.coalesce("_dsk", F.lit(UNKNOWN))).drop("_dk", "_dsk"))
        keys.append(name)
    return out.select(*grain, *keys, *[F.col(c).alias(n) for n, c in measures.items()],
                      F.lit(execution_date).cast("date").alias("_execution_date"), F.lit(run_id).alias("_run_id"),
                      F.current_timestamp().alias("_load_timestamp"))


def late_arrivals(fact: DataFrame, key_columns) -> DataFrame:
    """Rows with an unknown member per dimension key, in one pass."""
    rows = [F.struct(F.lit(c).alias("dimension_key"), F.col(f"n_{c}").alias("late_rows"), F.col("_total").alias("total_rows")) for c in key_columns]
    return fact.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(c) == UNKNOWN).alias(f"n_{c}") for c in key_columns]).select(F.inline(F.array(*rows)))


def placeholders(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str, defaults: dict, sk: str = "sk") -> DataFrame:
    """Dimension plus one default row per fact key it does not know."""
    missing = (fact.select(F.col(fact_key).alias(dim_key)).filter(F.col(dim_key).isNotNull()).distinct()
               .join(dim.select(F.col(dim_key).alias("_k")), F.col(dim_key) == F.col("_k"), "left_anti"))
    rows = missing.withColumns({c: F.lit(defaults.get(c)).cast(dim.schema[c].dataType) for c in dim.columns if c != dim_key})
    return _assign(dim.unionByName(rows.select(*dim.columns)), [dim_key], sk, "dense")


def date_dimension(spark, start: Column | str, end: Column | str, grain: str = "DAY", source: DataFrame | None = None) -> DataFrame:
    """One row per period; bounds are dates or aggregates over `source`."""
    unit = {"DAY": "1 day", "WEEK": "7 days", "MONTH": "1 month", "QUARTER": "3 months", "YEAR": "1 year"}[grain.upper()]
    lo = F.lit(start).cast("date") if isinstance(start, str) else start.cast("date")
    hi = F.lit(end).cast("date") if isinstance(end, str) else end.cast("date")
    unit_name = grain.upper() if grain.upper() != "DAY" else "DAY"
    if unit_name != "DAY":
        lo = F.trunc(lo, unit_name)
    base = source.agg(lo.alias("lo"), hi.alias("hi")) if source is not None else spark.range(1).select(lo.alias("lo"), hi.alias("hi"))
    d = base.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {unit}"))).alias("date"))
    x = F.col("date")
    return d.select(
        (F.year(x) * 10000 + F.month(x) * 100 + F.dayofmonth(x)).alias("date_key"), x, F.year(x).alias("year"), F.quarter(x).alias("quarter"),
        F.month(x).alias("month"), F.weekofyear(x).alias("week"), F.dayofmonth(x).alias("day"), F.dayofweek(x).alias("day_of_week"),
        F.date_format(x, "EEEE").alias("day_name"), F.date_format(x, "MMMM").alias("month_name"), F.dayofweek(x).isin(1, 7).alias("is_weekend"))


def grain_violations(fact: DataFrame, grain) -> DataFrame:
    return fact.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reconcile_sums(base: DataFrame, rolled: DataFrame, measures, tolerance: float = 0.01) -> DataFrame:
    """Totals of the base fact against those of an aggregate built from it."""
    def total(x, tag):
        return x.agg(*[F.sum(F.col(m).cast("decimal(28,6)")).cast("double").alias(f"{tag}_{i}") for i, m in enumerate(measures)])

    j = total(base, "b").crossJoin(total(rolled, "r"))  # one row each
    return j.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"b_{i}").alias("base_total"), F.col(f"r_{i}").alias("rolled_total"),
                 (F.abs(F.col(f"b_{i}") - F.col(f"r_{i}")) <= tolerance).alias("matches")) for i, m in enumerate(measures)])))


def generation(age) -> Column:
    a = col(age)
    return F.when(a < 25, "Gen Z").when(a < 40, "Millennial").when(a < 55, "Gen X").otherwise("Boomer")


def dimension_view(silver: DataFrame, key: str, age: Column, as_of: str, keep=()) -> DataFrame:
    """Numbered dimension with an age band and open validity."""
    x = silver.select(F.col(key), *keep, age.alias("age")).withColumn("sk", F.lit(None).cast("long"))
    x = number_rows(x, [key], 0, "sk")
    return x.withColumns({"generation": generation("age"), "effective_from": F.lit(as_of).cast("date"),
                          "effective_to": F.lit("9999-12-31").cast("date"), "is_current": F.lit(True)})


def normalise(dim: DataFrame, key: str, levels) -> dict:
    """Split a wide dimension into parent levels.

    `levels` lists `(name, columns)` from nearest to farthest (at most three); each level becomes
    a distinct table with a hash key and a reference to the next level."""
    if len(levels) > 3:
        raise ValueError("at most three levels")
    out, moved = {}, {c for _, cols in levels for c in cols}
    ids = [hash_key([c for _, cols in levels[i:] for c in cols], "place") for i in range(len(levels))]
    out["dimension"] = dim.select(*[c for c in dim.columns if c not in moved], ids[0].alias(f"{levels[0][0]}_id"))
    for i, (name, cols) in enumerate(levels):
        up = [ids[i + 1].alias(f"{levels[i + 1][0]}_id")] if i + 1 < len(levels) else []
        out[name] = dim.select(ids[i].alias(f"{name}_id"), *cols, *up).distinct()
    return out


def flat_table(base: DataFrame, dependencies) -> DataFrame:
    """One wide table from a chain of joins in declared order."""
    from zonecraft.operators.joins import multi_join
    return multi_join(base, dependencies)


def refresh_flat(existing: DataFrame | None, batch: DataFrame, mode: str, keys=(), watermark: str | None = None) -> DataFrame:
    """full | append (after the watermark) | merge by keys."""
    from zonecraft.sources.sinks import append_since, upsert
    if existing is None or mode == "full":
        return batch
    return append_since(existing, batch, watermark) if mode == "append" else upsert(existing, batch, keys)
