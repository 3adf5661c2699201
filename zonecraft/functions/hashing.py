"""Hash keys, change hashes and text normalisation used by rules, dimensions and vaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecraft.functions.exprs import col

RECIPES = ("job", "registry", "vault", "place")


def hash_key(cols, recipe: str = "vault") -> Column:
    """Hash of several columns.

    job: md5 over `||`-joined values; registry: md5 over `|`-joined trimmed upper-case values;
    vault: sha-256 like registry, with NULL as empty so that positions never shift; place: like job,
    but NULL keeps its place and separators inside values are escaped, so different rows differ."""
    text = [col(c).cast("string") for c in cols]
    if recipe == "job":
        return F.md5(F.concat_ws("||", *text))
    if recipe == "registry":
        return F.md5(F.concat_ws("|", *[F.upper(F.trim(c)) for c in text]))
    if recipe == "vault":
        return F.sha2(F.concat_ws("|", *[F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in text]), 256)
    if recipe == "place":
        escaped = [F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in text]
        return F.md5(F.concat_ws("||", *[F.coalesce(c, F.lit("\\N")) for c in escaped]))
    raise ValueError(f"unknown recipe {recipe}")


def hash_diff(cols, recipe: str = "vault") -> Column:
    """Change hash of tracked attributes: like hash_key, but values keep their case."""
    text = [col(c).cast("string") for c in cols]
    if recipe == "vault":
        return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in text]), 256)
    return F.md5(F.concat_ws("||", *text))


def digest(c, algorithm: str = "sha256") -> Column:
    x = col(c).cast("string")
    if algorithm == "md5":
        return F.md5(x)
    return F.sha2(x, 512 if algorithm == "sha512" else 256)


def short_id(*parts, size: int = 16, algorithm: str = "sha256") -> Column:
    """Truncated hash as a deterministic identifier."""
    return F.substring(digest(F.concat_ws("|", *[col(p).cast("string") for p in parts]), algorithm), 1, size)


def mask_keep_last(c, keep: int = 4, char: str = "*", reveal_short: bool = False) -> Column:
    """Mask all but the last characters; values no longer than that are hidden entirely."""
    x = col(c).cast("string")
    n = F.length(x)
    masked = F.concat(F.repeat(F.lit(char), F.greatest(n - keep, F.lit(0))), F.right(x, F.lit(keep)))
    short = x if reveal_short else F.repeat(F.lit(char), n)
    return F.when(n > keep, masked).otherwise(short)
