"""Document fingerprints by winnowing, on array functions alone.

Tokens are runs of at most 16 characters other than ASCII white space.  Longer runs, as texts without
spaces have them, are cut where their characters say so: every character beyond ASCII is a token, and a
stretch of ASCII ends behind a vowel or digit (or after eight characters without one), so tokens
fall in line again soon after a character was put in or taken out.  Hashes of k tokens in a row form a
rolling polynomial hash of two halves; of every `window` of them in a row the smallest, the rightmost of equals, is
selected.  Texts that share k + window - 1 tokens in a row therefore share a selected hash, and
selected positions say where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

K, WINDOW = 4, 8
CHAR, OTHER = r"[^\x20\x09-\x0D]", r"[\x21-\x2F\x3A-\x60b-df-hj-np-tv-z\x7B-\x7E]"  # OTHER: ASCII but small vowels and digits
TOKEN = rf"(?<!{CHAR}){CHAR}{{1,16}}(?!{CHAR})|[^\x09-\x0D\x20-\x7E]|{OTHER}{{0,7}}[aeiou0-9]|{OTHER}{{1,8}}"
PRIME, BASES, HALF = (1 << 31) - 1, (1_103_515_245, 1_664_525_013), 1 << 31
ROWS_PER_RANGE, MOST_RANGES = 20_000, 10_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's tokens, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def gram_hashes(h: Column, k: int = K) -> Column:
    """The hash, below 2^62, of every k tokens in a row (of all tokens, if fewer): two polynomials modulo
    PRIME, over the upper and the lower part of the tokens' hashes, side by side.  Each is what rolling it along
    gives, (previous - first * BASE^(k-1)) * BASE + next, evaluated at each position."""
    part = lambda x, n: F.pmod(F.shiftright(x, 32) if n else x, F.lit(PRIME))
    step = lambda acc, x, n: (acc * F.lit(BASES[n]) + part(x, n)) % F.lit(PRIME)

    def at(x, i):
        halves = [part(x, n) for n in (0, 1)]
        for j in range(1, k):
            halves = [step(acc, F.get(h, i + j), n) for n, acc in enumerate(halves)]
        return halves[1] * F.lit(HALF) + halves[0]

    whole = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), at)
    all_of = lambda n: F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: step(acc, x, n))
    return F.when(F.size(h) >= k, whole).when(F.size(h) > 0, F.array(all_of(1) * F.lit(HALF) + all_of(0))).otherwise(F.array().cast("array<bigint>"))


def selected(g: Column, window: int = WINDOW) -> Column:
    """Positions (from 0) of the hashes that winnowing selects.

    A hash is the rightmost smallest of some whole window if the run of hashes before it that are not
    smaller, and the run behind it that are larger, together fill one.  Fewer hashes than `window`
    are one window."""
    def whole(x, i):
        left, right = F.lit(0), F.lit(0)
        for d in range(window - 1, 0, -1):
            left = F.when(F.get(g, i - d) >= x, left + 1).otherwise(F.lit(0))
            right = F.when(F.get(g, i + d) > x, right + 1).otherwise(F.lit(0))
        return left + right >= window - 1

    spots = F.filter(F.transform(g, lambda x, i: F.when(whole(x, i), i)), lambda p: p.isNotNull())
    lone = F.array(F.size(g) - F.array_position(F.reverse(g), F.array_min(g)).cast("int"))
    return F.when(F.size(g) >= window, spots).when(F.size(g) > 0, lone).otherwise(F.array().cast("array<int>"))


def fingerprints(rows: DataFrame, text: Column, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """`rows` with the column `name`, the fingerprint of `text`: an array of the selected (hash, position),
    positions counting tokens from 0; empty for a null text and one without tokens.  Token and gram
    hashes are columns of their own in between, so each is evaluated once."""
    h, g = f"__h_{name}", f"__g_{name}"
    x = rows.withColumn(h, token_hashes(text))
    x = x.withColumn(g, gram_hashes(F.col(h), k))
    return x.withColumn(name, F.transform(selected(F.col(g), window), lambda p: F.struct(F.get(F.col(g), p).alias("hash"), p.alias("position")))).drop(h, g)


def as_text(fingerprint: Column) -> Column:
    """hash@position, blank-separated."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws("@", x.hash.cast("string"), x.position.cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints; 1 if both are empty."""
    x, y = a["hash"], b["hash"]
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(1.0))


def with_next(rows: DataFrame, order: str, pieces: int) -> DataFrame:
    """`rows` cut into `pieces` ranges of `order` (column `__range`), each followed by a copy of the first
    rows of the next range (`__guest` true; for the last range those of the first).

    The bounds are the smallest values of a range partitioning, as many numbers as there are ranges.  Rows
    of one value stay together; null sorts first."""
    ids = rows.select(order).repartitionByRange(pieces, F.col(order).asc_nulls_first()).groupBy(F.spark_partition_id().alias("p")).agg(F.min(order).alias("least"))
    bounds = sorted(r[0] for r in ids.select("least").distinct().collect() if r[0] is not None)
    if not bounds:
        return rows.withColumn("__range", F.lit(0)).withColumn("__guest", F.explode(F.array(F.lit(False), F.lit(True))))
    kind = rows.schema[order].dataType
    cuts = F.array(*[F.lit(b).cast(kind) for b in bounds[1:]]).cast(ArrayType(kind))
    own = F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col(order))), F.lit(0))
    last = len(bounds) - 1
    null_first = rows.filter(F.col(order).isNull()).limit(1).count() > 0
    opens = F.col(order).isNull() if null_first else F.col(order) == F.lit(bounds[0]).cast(kind)
    first = F.coalesce(F.array_contains(cuts, F.col(order)), F.lit(False))
    places = (F.when(first, F.array(F.struct(own.alias("r"), F.lit(False).alias("g")), F.struct((own - 1).alias("r"), F.lit(True).alias("g"))))
              .when(opens, F.array(F.struct(own.alias("r"), F.lit(False).alias("g")), F.struct(F.lit(last).alias("r"), F.lit(True).alias("g"))))
              .otherwise(F.array(F.struct(own.alias("r"), F.lit(False).alias("g")))))
    return rows.withColumn("__place", F.explode(places)).select(*rows.columns, F.col("__place.r").alias("__range"), F.col("__place.g").alias("__guest"))


def ranges_for(docs: DataFrame, least: int) -> int:
    """How many ranges of the id a table is sorted in: one per ROWS_PER_RANGE rows, between `least` and MOST_RANGES."""
    return min(MOST_RANGES, max(least, docs.count() // ROWS_PER_RANGE))


def compared(docs: DataFrame, pieces: int, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last quarter of the characters (rounded down) replaced by the first as many,
    or all, of the next text in ascending order of id; the last row's next is the first.  Rows of the
    same id follow each other by text; a null id sorts first; a single row is its own next.  A null
    text is empty.  Likenesses are between 0 and 1, and 1 between equal texts.  Texts are
    shuffled once, by ranges of id; a range is sorted in one task."""
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = with_next(x, "id", pieces)
    order = Window.partitionBy("__range").orderBy("__guest", F.col("id").asc_nulls_first(), "text")
    x = fingerprints(x.withColumn("__next", F.lead("text").over(order)), F.col("text"), "fingerprint", k, window)
    x = x.withColumn("__next_print", F.lead("fingerprint").over(order)).filter(~F.col("__guest"))
    x = x.withColumn("__n", F.char_length("text")).withColumn("__cut", F.expr("__n div 4").cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("__n") - F.col("__cut")), F.substring(F.col("__next"), F.lit(1), F.col("__cut")))
    x = x.withColumn("n_chars", F.col("__n").cast("long")).withColumn("edited", edited)
    x = fingerprints(x, F.col("edited"), "edited_fingerprint", k, window)
    return x.select("id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next_print")).alias("near_next"))
