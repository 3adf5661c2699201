"""Importance resampling towards a target distribution, on hashed word n-grams.

A document's features are its runs of one to three consecutive words.  A feature falls into one of
`buckets` by the CRC-32 of its bytes.  The corpus and the target texts each give a distribution over
the buckets; a bucket's gain is the logarithm of their ratio, and a document's weight the sum of
the gains of its features.  Weight plus Gumbel noise, of which the largest are drawn, samples documents
without putting back in proportion to their importance.

Checksums are taken in matrices: the distinct features of a block of texts are grouped by length into
two-dimensional arrays of bytes, all checksums of an array are updated column by column, and the
buckets are scattered back to the places of the features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.llm import arrow_text as T
from zonecraft.llm import crc
from zonecraft.llm.bitmap import may_match
from zonecraft.llm.numbering import ranked
from zonecraft.llm.rows import column, free_name, row_key, whole
from zonecraft.session import store

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
SLICE = 1 << 18  # words whose features are worked at a time

# bytes that are no part of a word: ASCII other than digits and letters
GAP = T.table(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words per row, number of features per row, bucket of every feature, row by row)."""
    folded, rows = T.FOLD[buf], len(offsets) - 1
    start, end, row = T.spans(folded, offsets, GAP)
    words = np.bincount(row, minlength=rows)
    sizes = end - start
    # the words again, each with one space behind it, so that a feature is one run of bytes
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = folded[~GAP[folded]]
    parts, owners = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for lo in range(0, len(row), SLICE):
        hi = min(lo + SLICE, len(row))
        first, last, owner = [], [], []
        for n in range(longest):
            at = np.arange(lo, min(hi, len(row) - n))
            at = at[row[at] == row[at + n]]
            first.append(begin[at])
            last.append(begin[at + n] + sizes[at + n])
            owner.append(row[at])
        first, last, owner = map(np.concatenate, (first, last, owner))
        span = slice(int(first.min()), int(last.max()))
        piece, first, last = text[span], first - span.start, last - span.start
        # equal features are told by a 64-bit hash of their bytes
        _, one, which = np.unique(T.span_hash(piece, first, last), return_index=True, return_inverse=True)
        found = (crc.of_spans(piece, first[one], last[one]) % np.uint32(buckets)).astype(np.uint16)[which]
        order = np.argsort(owner, kind="stable")
        parts.append(found[order])
        owners.append(owner[order])
    owner = np.concatenate(owners)
    # slices cut long texts only between words, so rows ascend over all of them
    return words, np.bincount(owner, minlength=rows), np.concatenate(parts)


def bucketed(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The columns of `texts` but its last, a text, and n_words, n_features and `buckets`: two bytes a feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit into two bytes")
    names = texts.columns[:-1]

    def work(batches):
        for batch in batches:
            for lo, hi, buf, offsets in T.blocks(batch.column(len(names))):
                words, count, found = features(buf, offsets, buckets, longest)
                at = np.concatenate([[0], np.cumsum(2 * count)])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(found.astype("<u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(names))], pa.array(words.astype(np.int64)), pa.array(count.astype(np.int64)), data],
                                                 [*names, "n_words", "n_features", "buckets"])

    plain = texts.withColumn(texts.columns[-1], column(texts.columns[-1]).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])
    return plain.mapInArrow(work, f"{schema}, n_words bigint, n_features bigint, buckets binary")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of `bucketed` rows, with a row for every bucket that occurs.

    Every task adds its rows up in one array, so it sends at most one row a bucket."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from the histograms (bucket, n): thousandths of the logarithm of the
    target's share by the corpus's, each with one feature more in every bucket; rounded down."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    number = lambda c, more: (F.col(c) + more).cast("double")
    ratio = (number("t", 1) * number("all_s", buckets)) / (number("s", 1) * number("all_t", buckets))
    return both.crossJoin(totals).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of totals


def weighed(found: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`bucketed` rows with `weight` for `buckets`: the sum of the gains of a row's features.

    The gains are one number per bucket and travel with the tasks."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # `buckets` rows
        table[r["bucket"]] = r["gain"]
    names = found.columns[:-1]

    def work(batches):
        for batch in batches:
            sums = [int(table[np.frombuffer(data.as_buffer(), "<u2")].sum()) for data in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*names, "weight"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema[:-1])
    return found.mapInArrow(work, f"{schema}, weight bigint")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the leading 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: list[str] | None = None, buckets: int = BUCKETS,
           longest: int = LONGEST, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, `keep`, n_words, n_features, weight, score, rank) for every row of `docs`.

    Words are runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased.  Of the N rows with at
    least `min_words` words, floor(percent * N / 100) are drawn: those with the highest scores, ties by
    the smaller id (null first), numbered in `rank`, which is null for all others.  Texts are read once;
    what is kept of them is two bytes a feature.  A null or empty text has no features and weight 0; without
    any target text every bucket is weighed as if the target were even.  Repeated rows have equal scores and
    ranks of their own.  Very long texts are worked in slices.  An empty table gives no rows."""
    keep = keep or []
    found = store(bucketed(docs.select(column(id_col).alias("id"), *keep, column(text_col).alias("text")), buckets, longest))
    wanted = store(bucketed(target.select(F.lit(0).alias("id"), column(target_col).alias("text")), buckets, longest))
    gain = gains(histogram(found, buckets), histogram(wanted, buckets), buckets)
    rows = weighed(found, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = store(rows.select("id", *keep, "n_words", "n_features", "weight", "score"))
    enough = rows.filter(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    order = ranked(enough, [F.col("score").desc(), F.col("id").asc()], "rank")
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.unionByName(rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that `scored` draws, with their columns, and `rank` (with underscores behind it if `docs` has that column).

    Rows meet their draw by a 128-bit key of the whole row; of equal rows, each is returned as often as it is drawn."""
    slim = docs.select(column(id_col).alias("i"), column(text_col).alias("t"), row_key(docs).alias("key"))
    drawn = store(scored(slim, target, "i", "t", keep=["key"], **options).filter("rank is not null").select("key", "rank"))
    rows = may_match(docs.select(whole(docs).alias("row"), row_key(docs).alias("key")), F.col("key.a"), drawn, F.col("key.a")).dropDuplicates(["key"])
    return rows.join(drawn, "key").select("row.*", F.col("rank").alias(free_name("rank", docs.columns)))
