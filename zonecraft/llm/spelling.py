"""Spelling variants of frequent words, found by permuterm rotations.

A word with a terminator behind it is turned so that every one of its characters comes last once.
Without that last character, the rotation is a prefix that skips the character: words that differ by
a replaced character there have the prefix in common, and a word that lacks the character has it as
a whole rotation.  Rotations are dealt out and sorted by their prefix; one scan of a group gives every
member its neighbours.  A group has at most one member per character and one whole word, so it
is bounded by the alphabet, and only the number and the best of a member's neighbours go on.

Rotations of a word take the square of its length, so beyond SHORT characters a rotation is a 128-bit hash
read off running sums over the word written twice, and words are fetched only where counts tie."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.llm import arrow_text as T
from zonecraft.llm import crc
from zonecraft.llm.rows import column
from zonecraft.session import store

MIN_CHARS, MIN_COUNT, TIMES, SHORT = 6, 5, 5, 64
TERMINATOR = "$"  # no letter
LETTER, CONTINUATION = T.table(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))), (np.arange(256) & 0xC0) == 0x80


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the longest runs of A-Z, a-z and the characters U+00C0 to U+00FF, which
    UTF-8 writes as the byte C3 and one more."""
    inside = LETTER[buf]
    lead = buf == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    return T.runs(inside, offsets)


def without_one(word: bytes, at: int) -> bytes:
    chars = word.decode()
    return (chars[:at % len(chars)] + chars[at % len(chars) + 1:]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n): the words of at least `min_chars` characters and `min_count` occurrences in all texts.

    A-Z is lower-cased, nothing else.  A null text has no words.  With `damage`, a trial with known
    variants: where the CRC-32 of "id:word" (a null id is empty) is divisible by it, the occurrence loses the character
    at the CRC-32 modulo the word's length.  Words are counted per block of texts, then per task, before they are shuffled."""

    def work(batches):
        for batch in batches:
            for lo, hi, buf, offsets in T.blocks(batch.column(1)):
                folded = T.FOLD[buf]
                start, end, row = words_of(folded, offsets)
                more: list[bytes] = []
                if damage:
                    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).slice(lo, hi - lo).to_pylist()], np.uint32)
                    h = crc.of_spans(folded, start, end, prefix[row])
                    hit = h % np.uint32(damage) == 0
                    more = [without_one(folded[a:b].tobytes(), x) for a, b, x in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist())]
                    start, end = start[~hit], end[~hit]
                upto = np.concatenate([[0], np.cumsum(~CONTINUATION[folded])])
                long = upto[end] - upto[start] >= min_chars
                start, end = start[long], end[long]
                _, one, n = np.unique(T.span_hash(folded, start, end), return_index=True, return_counts=True)
                words = [folded[a:b].tobytes() for a, b in zip(start[one].tolist(), end[one].tolist())]
                more = [w for w in more if len(w.decode()) >= min_chars]
                yield pa.RecordBatch.from_arrays([pa.array(words + more, pa.binary()).cast(pa.string()), pa.array(np.concatenate([n, np.ones(len(more), np.int64)]))], ["word", "n"])

    found = docs.select(column(id_col), column(text_col).cast("string")).toDF("i", "t").mapInArrow(work, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, n): every rotation of every word of (word, n) with its terminator, as a whole (`last` is
    null) and without its last character; a rotation that ends with the terminator skips no character."""
    word = F.col("word")
    at = F.explode(F.sequence(F.lit(0), F.char_length(word))).alias("at")
    turned = words.select("word", "n", at)
    behind, ahead = F.expr("substring(word, at + 1)"), F.expr("substring(word, 1, at)")
    whole = F.struct(F.concat(behind, F.lit(TERMINATOR), ahead).alias("prefix"), F.lit(None).cast("string").alias("last"))
    # the character that comes last is the one before `at`
    cut = F.struct(F.concat(behind, F.lit(TERMINATOR), F.expr("substring(word, 1, at - 1)")).alias("prefix"), F.expr("substring(word, at, 1)").alias("last"))
    return turned.select(F.explode(F.when(F.col("at") > 0, F.array(whole, cut)).otherwise(F.array(whole))).alias("r"), "n").select("r.prefix", "r.last", "n")


def _scan(group: DataFrame, more: list[str]) -> DataFrame:
    """What every member of a group's `members` has there: its fields `more`, how many neighbours
    (`n_near`), and the best of each kind (`near`).  Members sort by count, best first, and have `whole` and `first`.

    Those that have a character where the prefix skips one are each other's neighbours; a whole word is
    the neighbour of those whose character begins a run of equal ones, since a pair that differs by a
    character put into a run is seen at each place of the run."""
    changed, single, longer = (F.filter("members", f) for f in (lambda m: ~m.whole, lambda m: m.whole, lambda m: m.first))
    same = lambda a, b: all_equal([a[c] == b[c] for c in more])
    bare = lambda m: F.when(m.isNotNull(), F.struct(*[m[c].alias(c) for c in ["neg", *more]]))
    other = lambda m: F.when(same(F.get("changed", 0), m), F.get("changed", 1)).otherwise(F.get("changed", 0))
    x = group.withColumn("members", F.array_sort("members")).withColumns({"changed": changed, "single": single, "longer": longer})
    seen = F.transform("members", lambda m: F.struct(
        *[m[c].alias(c) for c in more],
        F.when(m.whole, F.size("longer")).otherwise(F.size("changed") - 1 + F.when(m.first, F.size("single")).otherwise(0)).cast("long").alias("n_near"),
        F.array_compact(F.when(m.whole, F.array(bare(F.get("longer", 0)))).otherwise(F.array(bare(other(m)), F.when(m.first, bare(F.get("single", 0)))))).alias("near")))
    return x.select(F.explode(seen).alias("s")).select("s.*").filter("n_near > 0")


def all_equal(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def short_neighbours(words: DataFrame) -> DataFrame:
    """`neighbours` among words of at most SHORT characters, by their rotations as text."""
    group = rotations(words.filter(F.char_length("word") <= SHORT)).groupBy("prefix").agg(F.collect_list(F.struct((-F.col("n")).alias("neg"), "last")).alias("found"), F.count(F.lit(1)).alias("size"))
    # the word of a prefix y$x and the character c between them is x c y; the terminator splits it
    x = group.filter("size > 1").withColumn("x", F.substring_index("prefix", TERMINATOR, -1)).withColumn("y", F.substring_index("prefix", TERMINATOR, 1))
    named = F.transform("found", lambda m: F.struct(
        m.neg.alias("neg"), F.concat("x", F.coalesce(m["last"], F.lit("")), "y").alias("word"), m["last"].isNull().alias("whole"),
        (m["last"].isNotNull() & (F.coalesce(m["last"], F.lit("")) != F.right("x", F.lit(1)))).alias("first")))
    best = F.array_min("near")
    return _scan(x.select(named.alias("members")), ["word"]).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))


def long_rotations(words: DataFrame) -> DataFrame:
    """(a, b, members): the rotations of words of more than SHORT characters by their hash, with those of SHORT
    characters as the words that lack a character of a longer one."""

    def work(batches):
        for batch in batches:
            for word, neg, wa, wb in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
                size, turned = len(codes), np.concatenate([codes, [T.U(ord(TERMINATOR))], codes])
                together = np.zeros(len(turned), np.int64)
                halves = [T.mix(turned + T.U(salt)) for salt in (1, 1 << 40)]
                whole = [T.grams(h, together, size + 1, shorter=False)[0] for h in halves]
                # the rotation behind character i, without it, begins at i + 1
                cut = [T.grams(h, together, size, shorter=False)[0][1:size + 1] for h in halves] if size > SHORT else [x[:0] for x in whole]
                n = len(cut[0])
                first = np.append(True, codes[1:] != codes[:-1])[:n]
                columns = [*(np.concatenate([c, w]).view(np.int64) for c, w in zip(cut, whole)), np.full(n + size + 1, neg),
                           np.append(codes[:n].astype(np.int64), np.zeros(size + 1, np.int64)), np.full(n + size + 1, wa), np.full(n + size + 1, wb),
                           np.append(np.zeros(n, bool), np.ones(size + 1, bool)), np.append(first, np.zeros(size + 1, bool))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "neg", "last", "wa", "wb", "whole", "first"])

    keyed = words.filter(F.char_length("word") >= SHORT).select("word", -F.col("n"), "key.a", "key.b")
    return keyed.mapInArrow(work, "a bigint, b bigint, neg bigint, last bigint, wa bigint, wb bigint, whole boolean, first boolean")


def long_neighbours(words: DataFrame) -> DataFrame:
    """`neighbours` where one of the two has more than SHORT characters."""
    words = words.withColumn("key", F.struct(F.xxhash64("word").alias("a"), F.xxhash64(F.lit("b"), "word").alias("b")))
    group = long_rotations(words).groupBy("a", "b").agg(F.collect_list(F.struct("neg", "last", "wa", "wb", "whole", "first")).alias("members"), F.count(F.lit(1)).alias("size"))
    seen = store(_scan(group.filter("size > 1").select("members"), ["wa", "wb"]).select(F.struct(F.col("wa").alias("a"), F.col("wb").alias("b")).alias("key"), "n_near", "near"))
    per = seen.groupBy("key").agg(F.sum("n_near").alias("n_near"), F.min(F.array_min("near").neg).alias("neg"))
    tied = seen.select("key", F.explode("near").alias("c")).join(per.select("key", "neg"), "key").filter("c.neg = neg").select("key", "neg", F.struct(F.col("c.wa").alias("a"), F.col("c.wb").alias("b")).alias("other")).distinct()
    names = words.filter(F.char_length("word") >= SHORT).select("key", "word")
    best = tied.join(names.select(F.col("key").alias("other"), "word"), "other").groupBy("key").agg(F.min(F.struct("neg", "word")).alias("best"))
    return per.drop("neg").join(best, "key").join(names, "key").select("word", "n_near", "best")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for the words of (word, n) that have another at one inserted, deleted or
    replaced character: how many, and of these (neg, word), -n and the word, with the largest n, then the smallest word."""
    both = short_neighbours(words).unionByName(long_neighbours(words))
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of forms, by doubling the step.

    A form is more frequent than its word, so chains end; their rounds are the logarithm of the longest."""
    x = forms.select("word", F.col("form").alias("root"))
    while True:
        x = store(x)
        ahead = x.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if x.join(ahead, "root", "left_semi").isEmpty():
            return x
        x = x.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n), whose words are distinct.

    Two words are near if one inserted, deleted or replaced character makes one the other.  A word's
    `form` is its near word of largest n (ties: the smallest by code points), if that n is at least `times`
    the word's; `root` is the last of the forms that follow, the word itself if it has none.  `times` must be above
    1.  Null words are left out; a word with the terminator in it is an error.  An empty table gives no rows."""
    if times <= 1:
        raise ValueError("a form must be more frequent than its word")
    checked = F.when(F.col("word").contains(TERMINATOR), F.raise_error(F.lit("a word holds the terminator"))).otherwise(F.col("word"))
    words = store(words.filter("word is not null").select(checked.alias("word"), F.col("n").cast("long").alias("n")))
    near = words.join(neighbours(words), "word", "left")
    formed = -F.col("best.neg") >= times * F.col("n")
    x = store(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.neg")).alias("form_n")))
    ends = roots(x.filter("form is not null").select("word", "form"))
    return x.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
