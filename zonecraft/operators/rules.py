"""Ordered chains of declarative transform rules.

A rule is `{"type": name, "config": {...}, "sequence_order": n, "is_active": bool}` (also
accepted: `transform_type`).  Each handler is a DataFrame -> DataFrame function, so a chain is
one logical plan."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.functions import hashing as H
from zonecraft.functions.exprs import all_of, null_safe_join
from zonecraft.operators import window as W
from zonecraft.operators.aggregate import collect_chunks

HANDLERS: dict = {}


def register_rule(*names):
    """Decorator: make `fn(df, config)` available to rule chains under the given names."""
    def add(fn):
        for n in names:
            HANDLERS[n] = fn
        return fn
    return add


def apply_rules(df: DataFrame, rules) -> DataFrame:
    """Apply active rules by sequence order; unknown types pass through with a warning."""
    for r in sorted(rules, key=lambda r: r.get("sequence_order", 0)):
        if not r.get("is_active", True):
            continue
        kind = r.get("type") or r.get("transform_type", "")
        fn = HANDLERS.get(kind)
        if fn is None:
            warnings.warn(f"unknown rule type {kind}", stacklevel=2)
            continue
        df = fn(df, r.get("config", {}))
    return df


def _pairs(cfg, one, many="columns", value="value"):
    m = cfg.get(many)
    return dict(m) if isinstance(m, dict) and m else ({cfg[one]: cfg.get(value)} if cfg.get(one) else {})


@register_rule("deduplicate", "dedup")
def dedup(df, cfg):
    """Keep the latest (or earliest) row per key; remaining columns break ties."""
    keys = cfg.get("keys", [])
    if not keys:
        return df
    order = cfg.get("order_by") or []
    order = [order] if isinstance(order, str) else list(order)
    last = cfg.get("order_desc", cfg.get("keep", "latest") == "latest")
    d = F.desc_nulls_last if last else F.asc_nulls_last
    rest = [c for c in df.columns if c not in keys and c not in order]
    return W.top_per_group(df, keys, [*[d(c) for c in order], *[F.asc_nulls_last(c) for c in rest]], 1)


@register_rule("distinct")
def distinct(df, cfg):
    return df.dropDuplicates(cfg["keys"]) if cfg.get("keys") else df.distinct()


@register_rule("null_fill", "null_handling")
def null_fill(df, cfg):
    fills = _pairs(cfg, "column")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if c in df.columns})


@register_rule("null_drop")
def null_drop(df, cfg):
    return df.dropna(cfg.get("how", "any"), subset=cfg.get("columns") or None)


@register_rule("rename")
def rename(df, cfg):
    old = cfg.get("old_name") or cfg.get("from") or cfg.get("source")
    new = cfg.get("new_name") or cfg.get("to") or cfg.get("target")
    return df.withColumnsRenamed({**cfg.get("mapping", {}), **({old: new} if old else {})})


@register_rule("cast")
def cast(df, cfg):
    """Values that do not fit become NULL."""
    types = _pairs(cfg, "column", value="type") if not cfg.get("cast_type") else {cfg["column"]: cfg["cast_type"]}
    return df.withColumns({c: F.col(c).try_cast(t.lower()) for c, t in types.items() if c in df.columns})


@register_rule("expression", "derive")
def derive(df, cfg):
    return df.withColumn(cfg.get("column") or cfg["name"], F.expr(cfg["expression"]))


@register_rule("add_column")
def add_column(df, cfg):
    v = F.expr(cfg["expression"]) if cfg.get("expression") else F.lit(cfg.get("value"))
    return df.withColumn(cfg["column"], v)


@register_rule("filter")
def keep(df, cfg):
    return df.filter(cfg["condition"])


@register_rule("select")
def select(df, cfg):
    return df.select(*cfg["columns"]) if cfg.get("columns") else df


@register_rule("drop_columns")
def drop(df, cfg):
    return df.drop(*cfg.get("columns", []))


def _each(df, cfg, fn):
    cols = cfg.get("columns") or ([cfg["column"]] if cfg.get("column") else [])
    return df.withColumns({c: fn(F.col(c)) for c in cols if c in df.columns})


@register_rule("trim")
def trim(df, cfg):
    return _each(df, cfg, F.trim)


@register_rule("uppercase", "upper")
def upper(df, cfg):
    return _each(df, cfg, F.upper)


@register_rule("lowercase", "lower")
def lower(df, cfg):
    return _each(df, cfg, F.lower)


@register_rule("date_format")
def date_format(df, cfg):
    c = F.col(cfg["column"])
    parsed = F.try_to_timestamp(c, F.lit(cfg["input_format"])) if cfg.get("input_format") else c.try_cast("timestamp")
    return df.withColumn(cfg["column"], F.date_format(parsed, cfg.get("output_format", "yyyy-MM-dd")))


@register_rule("standardize_date")
def standardize_date(df, cfg):
    return df.withColumn(cfg["column"], F.try_to_date(F.col(cfg["column"]), cfg.get("input_format", "yyyy-MM-dd")))


@register_rule("regex_replace")
def regex_replace(df, cfg):
    return df.withColumn(cfg["column"], F.regexp_replace(cfg["column"], cfg.get("pattern", ""), cfg.get("replacement", "")))


@register_rule("mask")
def mask(df, cfg):
    return df.withColumn(cfg["column"], H.mask_keep_last(cfg["column"], cfg.get("keep_last", 4), cfg.get("char", "*"), cfg.get("reveal_short", False)))


@register_rule("hash")
def hash_rule(df, cfg):
    """One column in place, or several columns joined into an output column."""
    algo = cfg.get("algorithm", "md5" if cfg.get("columns") else "sha256")
    if cfg.get("columns"):
        return df.withColumn(cfg.get("output_column", "_hash_key"),
                             H.digest(F.concat_ws("|", *[F.col(c).cast("string") for c in cfg["columns"]]), algo))
    return df.withColumn(cfg["column"], H.digest(cfg["column"], algo))


@register_rule("coalesce")
def coalesce(df, cfg):
    return df.withColumn(cfg["output_column"], F.coalesce(*cfg["columns"]))


_AGG = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
        "count_distinct": F.count_distinct, "countDistinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct,
        "collect_set": lambda c: F.sort_array(F.collect_set(c)), "collect_list": lambda c: F.sort_array(F.collect_list(c)),
        "stddev": F.stddev_samp}


def agg_column(spec):
    """`{column, function, alias, order_by}`; first and last follow `order_by`."""
    c, fn = spec["column"], spec.get("function") or spec.get("func")
    name = spec.get("alias") or f"{c}_{fn}"
    if fn in ("first", "last"):
        by = spec["order_by"]
        order = F.struct(*([by] if isinstance(by, str) else by), c)
        return (F.min_by if fn == "first" else F.max_by)(F.col(c), order).alias(name)
    return _AGG[fn](F.col(c)).alias(name)


@register_rule("aggregate")
def aggregate(df, cfg):
    """Group by with aggregates.  Lists (collect_list, collect_set) may have any length, so they come in
    parts of at most `chunk_size` sorted values: a row per key and `part`, from 0, with the other aggregates on each."""
    keys, specs = cfg.get("group_by", []), cfg["aggregations"]
    kind = lambda a: a.get("function") or a.get("func")
    lists = [a for a in specs if kind(a) in ("collect_list", "collect_set")]
    out = df.groupBy(*keys).agg(*([agg_column(a) for a in specs if a not in lists] or [F.count(F.lit(1)).alias("_n")]))
    if not lists:
        return out
    parts = None
    for a in lists:
        values = df.select(*keys, a["column"]).filter(F.col(a["column"]).isNotNull())
        values = values.distinct() if kind(a) == "collect_set" else values
        name = a.get("alias") or f"{a['column']}_{kind(a)}"
        one = collect_chunks(values, keys, a["column"], [a["column"]], None, cfg.get("chunk_size", 10_000)).withColumnRenamed("values", name)
        if parts is None:
            parts = one
        else:
            parts = parts.withColumnsRenamed({k: f"_l_{k}" for k in [*keys, "part"]})
            same = all_of([F.col(f"_l_{k}").eqNullSafe(one[k]) for k in [*keys, "part"]])
            lists_of = [c for c in parts.columns if not c.startswith("_l_")]
            parts = parts.join(one, same, "full_outer").select(*[F.coalesce(F.col(f"_l_{k}"), one[k]).alias(k) for k in [*keys, "part"]], *lists_of, name)
    if keys:
        out = null_safe_join(out, parts, keys, "left")
    else:
        out = out.crossJoin(parts)  # one row of aggregates
    names = [a.get("alias") or f"{a['column']}_{kind(a)}" for a in lists]
    none = {n: F.coalesce(F.col(n), F.array().cast(parts.schema[n].dataType)) for n in names}
    return out.withColumns({"part": F.coalesce("part", F.lit(0).cast("long")), **none}).drop("_n")


RUNNING = {"sum", "count", "min", "max", "avg", "mean"}
SPLIT_FUNCTIONS = RUNNING | {"row_number", "rank", "dense_rank", "lag", "lead"}


def _running_with_ties(df, keys, order, ties, bucket, aggs):
    """Running aggregates up to the last row that ties with the current one, as SQL's default frame has
    them: rows that tie are aggregated first, so many of them are one."""
    per = df.groupBy(*keys, *ties).agg(*[W._COMBINE[f][0](F.col(v) if isinstance(v, str) else v).alias(f"_p{n}") for n, (f, v) in aggs.items()])
    run = W.running(per, keys, order, bucket, **{n: ("sum" if f == "count" else f, f"_p{n}") for n, (f, _) in aggs.items()})
    return null_safe_join(df, run.drop(*[f"_p{n}" for n in aggs]), [*keys, *ties])


@register_rule("window")
def window(df, cfg):
    """Window column.  Large keys are split: at `bucket`, a SQL expression monotone in the first order
    column, or else into ranges taken from the data.  With `bounded`, every key is known to be small and is one group."""
    if cfg.get("func"):  # text form, e.g. "rank()" with "price DESC"
        fn, _, arg = cfg["func"].strip().rstrip(")").partition("(")
        args = [x.strip() for x in arg.split(",") if x.strip()]
        order = [dict(zip(("column", "direction"), o.split())) for o in cfg.get("order_by", [])]
        known = fn.lower() in SPLIT_FUNCTIONS and len(args) <= 1 + (fn.lower() in ("lag", "lead")) and (not args or args[0] in df.columns) and all(o["column"] in df.columns for o in order)
        if known and not cfg.get("bounded"):
            more = {"offset": int(args[1])} if len(args) > 1 else {}
            return window(df, {"function": fn.lower(), "column": args[0] if args else None, "partition_by": cfg.get("partition_by", []), "order_by": order,
                               "bucket": cfg.get("bucket"), "frame": "range", "output_column": cfg["name"], **more})
        part = f"PARTITION BY {', '.join(cfg['partition_by'])} " if cfg.get("partition_by") else ""
        ordered = f"ORDER BY {', '.join(cfg['order_by'])}" if cfg.get("order_by") else ""
        return df.withColumn(cfg["name"], F.expr(f"{cfg['func']} OVER ({part}{ordered})"))
    keys, fn, c = cfg.get("partition_by", []), cfg.get("function", "sum"), cfg.get("column")
    order = [(F.desc if o.get("direction", "asc").lower() == "desc" else F.asc)(o["column"]) if isinstance(o, dict) else F.asc(o)
             for o in cfg.get("order_by", [])]
    out, off = cfg.get("output_column") or f"{c}_{fn}", cfg.get("offset", 1)
    frame = cfg.get("rows_between")
    fns = {"row_number": lambda w: F.row_number().over(w), "rank": lambda w: F.rank().over(w), "dense_rank": lambda w: F.dense_rank().over(w),
           "lag": lambda w: F.lag(c, off).over(w), "lead": lambda w: F.lead(c, off).over(w)}
    if not order:
        return W.with_group_stats(df, keys, _AGG[fn](F.col(c)).alias(out))
    if not cfg.get("bounded"):
        b = F.expr(cfg["bucket"]) if cfg.get("bucket") else None
        ties = [o["column"] if isinstance(o, dict) else o for o in cfg["order_by"]]
        if fn in ("lag", "lead"):
            return W.framed(df, keys, order, b, off, off, {out: fns[fn]})
        if fn == "row_number":
            return W.with_position(df, keys, order, b, out)
        if fn in ("rank", "dense_rank"):
            r = W.with_ranks(df, keys, order, ties, b)
            return r.withColumn(out, F.col(fn)).drop(*[x for x in ("row_num", "rank", "dense_rank") if x != out])
        if frame:
            return W.framed(df, keys, order, b, max(-frame[0], 0), max(frame[1], 0), {out: lambda w: _AGG[fn](F.col(c)).over(w.rowsBetween(*frame))})
        if fn in RUNNING:
            value = F.lit(1) if c is None or c == "*" else c
            aggs = {"_zc_sum": ("sum", value), "_zc_n": ("count", value)} if fn in ("avg", "mean") else {out: (fn, value)}
            x = _running_with_ties(df, keys, order, ties, b, aggs) if cfg.get("frame") == "range" else W.running(df, keys, order, b, **aggs)
            if fn in ("avg", "mean"):
                x = x.withColumn(out, F.col("_zc_sum") / F.when(F.col("_zc_n") > 0, F.col("_zc_n"))).drop("_zc_sum", "_zc_n")
            return x
    w = Window.partitionBy(*keys).orderBy(*order)
    if fn in fns:
        return df.withColumn(out, fns[fn](w))
    return df.withColumn(out, _AGG[fn](F.col(c)).over(w.rowsBetween(*frame) if frame else w))


@register_rule("pivot")
def pivot(df, cfg):
    """Values must be listed, which keeps the plan free of an extra distinct job."""
    return df.groupBy(*cfg["group_by"]).pivot(cfg["column"], cfg["values"]).agg(*[agg_column(a) for a in cfg["aggregations"]])


@register_rule("unpivot")
def unpivot(df, cfg):
    return df.unpivot(cfg["ids"], cfg["columns"], cfg.get("name_column", "name"), cfg.get("value_column", "value"))


@register_rule("flatten")
def flatten(df, cfg):
    """Structs one level up; listed arrays are exploded keeping empty ones."""
    for a in cfg.get("explode", []):
        df = df.withColumn(a, F.explode_outer(a))
    cols = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            cols += [F.col(f"{f.name}.{s.name}").alias(f"{f.name}_{s.name}") for s in f.dataType]
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@register_rule("join")
def join(df, cfg):
    """`right` is a DataFrame; keys are `[{left, right}]`."""
    from zonecraft.operators.joins import join_on
    return join_on(df, cfg["right"], [(k["left"], k["right"]) for k in cfg["join_keys"]], cfg.get("join_type", "inner"), cfg.get("select_columns"))


@register_rule("scd2_merge", "scd")
def scd2_columns(df, cfg):
    """Change-hash and effectivity columns of a first load."""
    return df.withColumns({
        "_hash_diff": H.hash_diff(cfg["tracked_columns"], "job"),
        "_effective_from": F.lit(cfg["effective_date"]).cast("date") if cfg.get("effective_date") else F.current_date(),
        "_effective_to": F.lit(None).cast("date"), "_is_current": F.lit(True)})


@register_rule("data_vault_hash")
def vault_hash(df, cfg):
    kind = cfg.get("hash_type", "hub")
    out = cfg.get("output_column", "_hk")
    df = df.withColumn(out, H.hash_diff(cfg["columns"], "registry") if kind == "diff" else H.hash_key(cfg["columns"], "registry"))
    return df.withColumn("_record_source", F.lit(cfg["record_source"])) if cfg.get("record_source") else df


@register_rule("sql")
def sql_rule(df, cfg):
    """Statement over the frame, written as `{df}`."""
    return df.sparkSession.sql(cfg["statement"], df=df, **cfg.get("tables", {}))


@register_rule("standard_cleaning")
def clean(df, cfg=None):
    """Trim every non-audit string column and turn empty text into NULL, in one projection."""
    return df.select(*[
        F.nullif(F.trim(F.col(f.name)), F.lit("")).alias(f.name)
        if f.dataType.typeName() == "string" and not f.name.startswith("_") else F.col(f.name) for f in df.schema])


@register_rule("encode")
def encode(df, cfg):
    return df.withColumn(cfg.get("output_column") or cfg["column"], F.encode(cfg["column"], cfg.get("charset", "UTF-8")))


def predicate(column: str, op: str, value=None):
    """Named predicates that combine with & and |."""
    c = F.col(column)
    ops = {
        "is null": lambda: c.isNull(), "is not null": lambda: c.isNotNull(), "is empty": lambda: c == "", "is not empty": lambda: c != "",
        "equals": lambda: c == value, "not equal to": lambda: c != value, "greater than": lambda: c > value, "less than": lambda: c < value,
        "greater than or equal to": lambda: c >= value, "less than or equal to": lambda: c <= value,
        "contains": lambda: c.contains(value), "starts with": lambda: c.startswith(value), "ends with": lambda: c.endswith(value)}
    return ops[op]()


def where(df: DataFrame, *tests) -> DataFrame:
    """All of the `(column, op, value)` predicates."""
    return df.filter(all_of([predicate(*p) for p in tests]))


def route(df: DataFrame, cases, default: str = "default", name: str = "_route") -> DataFrame:
    """Label each row with the first case `(label, SQL condition)` it meets."""
    out = None
    for label, cond in cases:
        out = F.when(F.expr(cond), label) if out is None else out.when(F.expr(cond), label)
    return df.withColumn(name, out.otherwise(default))


def split(df: DataFrame, cases, default: str = "default") -> dict:
    """Named outputs of a conditional split; every row belongs to exactly one."""
    r = route(df, cases, default)
    return {n: r.filter(F.col("_route") == n).drop("_route") for n in [*[c[0] for c in cases], default]}


def zone_columns(df: DataFrame, zone: str, batch_id: str = "", schema=()) -> DataFrame:
    """Default transforms of a zone: transient none, raw audit, silver typed and trimmed, gold
    and consumption stamps."""
    now = F.current_timestamp()
    if zone == "raw":
        return df.withColumns({"_ingestion_timestamp": now, "_batch_id": F.lit(batch_id), "_source_file": F.input_file_name()})
    if zone == "silver":
        typed = {}
        for c in schema:
            if c["name"] in df.columns:
                x = F.col(c["name"]).try_cast(c.get("type", "string").lower())
                typed[c["name"]] = F.trim(x) if c.get("type", "string").lower() == "string" else x
        return df.withColumns({**typed, "_silver_timestamp": now})
    if zone == "gold":
        return df.withColumns({"_gold_timestamp": now, "_is_current": F.lit(True)})
    return df.withColumn("_consumption_timestamp", now) if zone == "consumption" else df


def bronze_audit(df: DataFrame, reporting_date: str, run_id: str) -> DataFrame:
    return df.withColumns({"_record_uuid": F.uuid(), "_reporting_date": F.lit(reporting_date).cast("date"),
                           "_run_id": F.lit(run_id), "_load_timestamp": F.current_timestamp()})


def cast_declared(df: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rows with a value lost by its cast and the columns concerned)."""
    types = {c["name"]: c["type"].lower() for c in schema if c["name"] in df.columns}
    lost = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]))
    typed = df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    return typed, df.withColumn("_lost", lost).filter(F.size("_lost") > 0)


def counted(df: DataFrame, name: str = "rows"):
    """(frame, observation): the row count is collected while the frame is consumed, without a
    job of its own; read it from `observation.get[name]` after the action."""
    from pyspark.sql import Observation
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen
