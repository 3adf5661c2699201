"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def epoch(c) -> Column:
    """Seconds since 1970 as double, for timestamps with or without zone."""
    return F.unix_micros(col(c).cast("timestamp")) / F.lit(1e6)


def ymd(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def hms(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def rnd(c, digits: int = 4) -> Column:
    return F.round(col(c), digits)


def money(c) -> Column:
    """Order-independent sum of an amount: exact decimals inside, double outside."""
    return F.sum(col(c).cast("decimal(28,6)")).cast("double")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join that also matches NULL keys; key columns come from the left side."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = all_of([left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def case_map(c: Column, mapping: dict, default=None) -> Column:
    """Literal lookup as a CASE expression (stays in generated code)."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def first_match(pairs, default=None) -> Column:
    """CASE over (condition, value) pairs; the first true condition wins."""
    out = None
    for cond, v in pairs:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def match_count(c: Column, patterns) -> Column:
    """How many of the patterns occur in the text."""
    return reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in patterns], F.lit(0))


def json_valid(c) -> Column:
    """Whether the whole text is one JSON value.  The lenient parsers stop after the first
    value, so the text is tested as the only member of an array and of an object."""
    x = col(c)
    inside = F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    return F.coalesce(inside & F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}"))).isNotNull(), F.lit(False))
