"""Spelling variants against all pairs of plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm import brute
from zonecraft.llm import crc, plans, spelling

FOLDER = "/root/testdata/sf0.001"


def near_words(words):
    out, known, holes = defaultdict(set), set(words), defaultdict(list)
    for w in known:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].append(w)
            if (d := w[:i] + w[i + 1:]) in known:
                out[w].add(d)
                out[d].add(w)
    for same in holes.values():
        for w in same:
            out[w].update(x for x in same if x != w)
    return out


def brute_variants(counts, times=5):
    near, form = near_words(counts), {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= times * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def brute_counts(docs, damage=None, min_chars=6, min_count=5):
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = brute.fold(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


@pytest.mark.parametrize("short, letters, many", [(64, "abé", 300), (4, "abé", 300), (3, "ab", 150), (64, "abcdefgh", 200)])
def test_variants(spark, monkeypatch, short, letters, many):
    """Few letters, so most words have neighbours, also by letters put into runs; with `short` small, most are hashed."""
    monkeypatch.setattr(spelling, "SHORT", short)
    r = random.Random(short + many)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 8))): r.choice([5, 6, 25, 30, 30, 150, 1000]) for _ in range(many)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)).collect()
    assert len(got) == len(counts) and {tuple(x) for x in got} == brute_variants(counts)


def test_long_words(spark):
    x = "x" * 5000
    counts = {x: 100, x + "x": 7, x[:2500] + "y" + x[2501:]: 5, x[:2500] + "z" + x[2501:]: 100, x[:2500] + "y" + x[2500:]: 5, "q" * 64: 9, "q" * 65: 50, "q" * 63: 50}
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()} == brute_variants(counts)


def test_word_counts(spark):
    """Null, empty and very long texts, repeated rows, marks beside the letters, and columns of any name."""
    docs = [(1, "Naïve ÿÿÿÿÿÿ×÷ naïve NAÏVE_façade"), (1, "Naïve ÿÿÿÿÿÿ×÷ naïve NAÏVE_façade"), (2, None), (3, ""), (None, "façade façade naïveté Ōther Straße"), (4, "x" * 200_000), (5, "straße façade " * 20_000), (6, "日本語façade Ã")]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id bigint, text string, word string, n int").repartition(3)
    for damage in (None, 3):
        got = {r.word: r.n for r in spelling.word_counts(table, min_chars=4, min_count=2, damage=damage).collect()}
        assert got == brute_counts(docs, damage, 4, 2) and len(got) > 4
    assert spelling.word_counts(table.limit(0)).count() == 0 and spelling.variants(spelling.word_counts(table.limit(0))).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in plans.QUERIES["op12_spelling_variants"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(brute_counts(docs, 199))


def test_bad_input(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n bigint"), times=1)
    with pytest.raises(Exception, match="terminator"):
        spelling.variants(spark.createDataFrame([("a$", 1)], "word string, n bigint")).collect()
    assert spelling.variants(spark.createDataFrame([(None, 1)], "word string, n bigint")).count() == 0


def test_checksums():
    import numpy as np
    r = random.Random(1)
    raw = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 7, 40, 255, 256, 257, 2000]))) for _ in range(300)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(raw))], np.uint32)
    assert crc.of_spans(buf, at[:-1], at[1:]).tolist() == [zlib.crc32(x) for x in raw]
    assert crc.of_spans(buf, at[:-1], at[1:], before).tolist() == [zlib.crc32(f"{i}:".encode() + x) for i, x in enumerate(raw)]
