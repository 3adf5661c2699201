"""Quality rules with adaptive limits from mergeable quantile sketches.

Every measure of a document is an integer.  A sketch of a group is the number of documents per
value class: classes keep the leading six bits of a value, so a quantile is off by less than one
part in 32, and sketches merge by adding counts.  Sketches are kept per language and source and
merge into those of a language and of the whole corpus, which serve groups with few documents.  A
limit is the upper quartile plus a multiple of the quartile distance plus the least width that
counts as different (mirrored for lower limits)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.llm import arrow_text as T
from zonecraft.llm.rows import column, free_name
from zonecraft.session import store

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# measure -> (SQL over the counts, multiple of the quartile distance, least width, sides that are limited)
MEASURES = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", 3, 100, "upper"),
    "word_length": ("100 * word_chars div nullif(n_words, 0)", 3, 100, "both"),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", 3, 400, "upper"),
}
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_GROUP = 20, 30, 50
ADDED = ("__q", "__base_failed", "__kept")
SYMBOL, CONTINUATION = T.table(b"#*$%&|<>"), (np.arange(256) & 0xC0) == 0x80


def count_block(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of every text of a block."""
    n = len(offsets) - 1
    per = lambda rows: np.bincount(rows, minlength=n).astype(np.int64)
    start, end, row = T.spans(buf, offsets, T.SPACE)
    inside = np.concatenate([[0], np.cumsum(~(T.SPACE | CONTINUATION)[buf])])
    chars = inside[offsets[1:]] - inside[offsets[:-1]]
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[buf])])

    first, last, line_row = T.lines(buf, offsets)
    filled = np.searchsorted(start, last) > np.searchsorted(start, first)
    first, last, line_row = first[filled], last[filled], line_row[filled]
    own = T.mix(T.span_hash(buf, first, last) + T.mix(line_row.astype(T.U) + T.U(1)))
    distinct = line_row[np.unique(own, return_index=True)[1]]

    repeated = np.zeros(len(row) + 1, dtype=np.int64)
    windows, window_row = T.grams(T.span_hash(buf, start, end), row, 8, shorter=False)
    if len(windows):
        at = np.flatnonzero(row[:len(row) - 7] == row[7:])
        _, which, times = np.unique(windows + T.mix(window_row.astype(T.U) + T.U(1)), return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 8, -1)
    covered = row[np.cumsum(repeated)[:-1] > 0]
    return [per(row), chars, symbols[offsets[1:]] - symbols[offsets[:-1]], per(line_row) - per(distinct), per(covered), per(line_row)]


def counted(docs: DataFrame, text_col: str = "text", name: str = "__q") -> DataFrame:
    """`docs` with a struct `name` (a new one) of COUNTS.  Columns of any type pass through.

    Lines and windows of words are told apart by 64-bit hashes."""
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            parts = [count_block(buf, offsets) for _, _, buf, offsets in T.blocks(batch.column(at))]
            fields = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, list(COUNTS))], [*batch.schema.names, "q"])

    # names of any kind come back behind the Python stage
    texts = docs.withColumn(text_col, column(text_col).cast("string")).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return texts.mapInArrow(work, texts.withColumn("q", F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])).schema).toDF(*docs.columns, name)


def _base_failed(q: str = "__q"):
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))


def _measures(q: str = "__q"):
    return F.struct(*[F.expr(sql.replace("n_", f"{q}.n_").replace("word_chars", f"{q}.word_chars")).alias(m) for m, (sql, *_) in MEASURES.items()])


def value_class(v):
    """The lower bound of a value's class: its six leading bits."""
    cut = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut)


def limits(counted_docs: DataFrame, lang_col: str = "lang", source_col: str = "source", q: str = "__q") -> DataFrame:
    """(group, low and high per measure), one row per language and source: struct `group` of both,
    in which null is a value like any other.

    Counts are added up per value class before any shuffle, so a source with most documents costs no
    more than another; what meets in one task is at most the value classes of one group."""
    measured = counted_docs.filter(~_base_failed(q)).select(F.struct(column(lang_col).alias("lang"), column(source_col).alias("source")).alias("group"), _measures(q).alias("m"))
    values = measured.select("group", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(f"m.{m}").cast("long"))])).alias("measure", "v"))
    sketch = store(values.groupBy("group", "measure", value_class(F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    levels = [("group", F.col("group")), ("lang", F.struct("group.lang")), ("all", F.lit(0))]
    found = None
    for i, (name, key) in enumerate(levels):
        merged = sketch.groupBy(key.alias("key"), "measure", "v").agg(F.sum("c").alias("c"))
        order = Window.partitionBy("key", "measure").orderBy("v")
        run = merged.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy("key", "measure")))
        at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("n"), F.col("v")))  # noqa: B023,E731
        level = run.groupBy("key", "measure").agg(F.max("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))
        groups = sketch.select("group", "measure", key.alias("key")).distinct()
        level = groups.join(level, ["key", "measure"]).select("group", "measure", F.lit(i).alias("level"), "n", "q1", "q3")
        found = level if found is None else found.unionByName(level)
    usable = (F.col("n") >= MIN_GROUP) | (F.col("level") == len(levels) - 1)
    best = found.filter(usable).groupBy("group", "measure").agg(F.min(F.struct("level", "n", "q1", "q3")).alias("s")).select("group", "measure", "s.q1", "s.q3")
    columns = []
    for m, (_, times, width, sides) in MEASURES.items():
        mine = F.col("measure") == m
        columns.append(F.max(F.when(mine, F.col("q3") + times * (F.col("q3") - F.col("q1")) + width)).alias(f"{m}_high"))
        columns.append((F.max(F.when(mine, F.col("q1") - times * (F.col("q3") - F.col("q1")) - width)) if sides == "both" else F.lit(None).cast("long")).alias(f"{m}_low"))
    return store(best.groupBy("group").agg(*columns))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`docs` with `__q` (COUNTS), `__base_failed` and `__kept`; a name that `docs` has gets underscores behind it.

    Words are runs of other than ASCII white space; a null text has none and fails.  A document is
    kept if it passes the base rules and no measure is outside its group's limits.  A null language or
    source is a group; a group of fewer than MIN_GROUP documents that pass the base rules takes the
    limits of its language, or else of the corpus.  Repeated rows are judged alike.  Every row is
    returned; an empty table gives none."""
    names = [free_name(n, docs.columns) for n in (*ADDED, "__group", "__l", "__m")]
    q, failed, kept, group, bound, measure = names
    seen = counted(docs, text_col, q)
    bounds = limits(seen, lang_col, source_col, q)
    bounds = bounds.select(F.col("group").alias(group), F.struct(*[c for c in bounds.columns if c != "group"]).alias(bound))
    joined = seen.withColumn(group, F.struct(column(lang_col).alias("lang"), column(source_col).alias("source"))).join(bounds, group, "left")
    inside = F.lit(True)
    for m in MEASURES:
        v = F.col(f"{measure}.{m}")
        inside = inside & F.coalesce(v <= F.col(f"{bound}.{m}_high"), F.lit(True)) & F.coalesce(v >= F.col(f"{bound}.{m}_low"), F.lit(True))
    return (joined.withColumn(failed, _base_failed(q)).withColumn(measure, F.when(~F.col(failed), _measures(q)))
            .withColumn(kept, ~F.col(failed) & inside).select(*map(column, docs.columns), q, failed, kept))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that `judged` keeps, with their columns."""
    return judged(docs, text_col, lang_col, source_col).filter(F.col(free_name(ADDED[2], docs.columns))).select(*map(column, docs.columns))
