"""Whole rows as one value, and names that no column of a table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, without: str | None = None) -> Column:
    """A row as one struct, so that no helper column can meet a column of the user's; `without` is a column
    that goes beside it, since a text in both would be copied with every step."""
    return F.struct(*[column(c).alias(c) for c in df.columns if c != without])


def unpacked(df: DataFrame, row: str, **given: Column) -> list[Column]:
    """The columns of `df` out of a `whole` row, those `given` by their new values."""
    return [given[c].alias(c) if c in given else F.col(row).getField(c).alias(c) for c in df.columns]


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores behind it as make it new among `taken` (case is ignored)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns of a row: rows with one key are equal.  Maps are hashed as JSON."""
    parts = [F.to_json(F.struct(column(f.name))) if "map<" in f.dataType.simpleString() else column(f.name) for f in df.schema]
    # a hash skips nulls, so which columns are null is hashed too
    nulls = F.concat(F.lit(""), *[F.when(column(c).isNull(), "0").otherwise("1") for c in df.columns])
    return F.struct(F.xxhash64(nulls, *parts).alias("a"), F.xxhash64(F.lit("b"), nulls, *parts).alias("b"))
