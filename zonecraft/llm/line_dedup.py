"""Line dedup by site-relative frequency.

A line that stands on more than a given share of a site's pages is boilerplate there, and is dropped
from that site's pages only.  Where no address tells the host of a page, its source and language together
are the site: lines are written in one language, and over all languages of a source the
boilerplate of one of them would be diluted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.llm.rows import column, free_name, unpacked, whole
from zonecraft.session import store

RATIO, MIN_PAGES = 0.05, 5
SITE = ["source", "lang"]


def line_keys(text: Column) -> Column:
    """A 64-bit hash of every line of a text, without the spaces around it; null for blank lines."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def host_of(url: Column) -> Column:
    """The lower-case host of an address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_of(site_cols: str | list[str]) -> Column:
    """The site of a page: one column or several together, as a struct, so null is a value."""
    return F.struct(*[column(c).alias(c) for c in ([site_cols] if isinstance(site_cols, str) else site_cols)])


def boilerplate(pages: DataFrame, site_cols: str | list[str], text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, keys): the hashes of each site's boilerplate lines; `site` is a struct of `site_cols`.

    A page counts a line once, and lines are counted before they are shuffled.  A site has at most
    its lines per page divided by `ratio` such lines, so `keys` stays small however large the site."""
    site = site_of(site_cols).alias("site")
    found = pages.select(site, F.explode(F.array_compact(F.array_distinct(line_keys(column(text_col))))).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("c"))
    totals = pages.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    often = found.filter(F.col("c") >= min_pages).join(totals, "site").filter(F.col("c") > F.lit(ratio) * F.col("n"))
    return store(often.groupBy("site").agg(F.collect_list("key").alias("keys")))


def without_boilerplate(pages: DataFrame, site_cols: str | list[str] = SITE, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`pages` with its columns, `text_col` without boilerplate lines, and `__dropped`, their number (with
    underscores behind it if `pages` has that column).

    A line (without the spaces around it) is boilerplate for a site if more than `ratio` of the site's
    rows and at least `min_pages` rows have it.  Blank lines stay, as do all other bytes of the text.  A
    null in a site column is a value; a null text stays null and has no lines, but counts as a page; repeated
    rows count as pages; a text of boilerplate lines alone becomes empty.  An empty table gives none."""
    bad = boilerplate(pages, site_cols, text_col, ratio, min_pages)
    joined = pages.select(whole(pages, text_col).alias("row"), column(text_col).alias("text"), site_of(site_cols).alias("site")).join(bad, "site", "left")
    # the hits of a text are a hash intersection; lines are then looked up among these few
    hits = F.coalesce(F.array_intersect(line_keys(F.col("text")), F.col("keys")), F.array().cast("array<bigint>"))
    joined = joined.withColumn("hits", F.when(F.col("keys").isNotNull(), hits).otherwise(F.array().cast("array<bigint>")))
    lines = F.split(F.col("text"), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("hits"), F.xxhash64(F.trim(x))))
    touched = F.size("hits") > 0
    out = joined.withColumn("left", F.when(touched, kept))
    dropped = F.when(touched, F.size(lines) - F.size("left")).otherwise(F.lit(0)).cast("long")
    text = F.when(touched, F.array_join("left", "\n")).otherwise(F.col("text"))
    return out.select(*unpacked(pages, "row", **{text_col: text}), dropped.alias(free_name("__dropped", pages.columns)))
