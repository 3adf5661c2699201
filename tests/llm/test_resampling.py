"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm import brute
from zonecraft.llm import plans, resampling

FOLDER = "/root/testdata/sf0.001"
R = random.Random(7)
TEXTS = ["Hello, wörld 12 foo_bar", "", None, "a", "A b  C\nd 日本 x" * 3, "!!", "x" * 1000 + " y z", "one two three " * 60_000] + [
    " ".join("".join(R.choice("abcdeé日Z9") for _ in range(R.randint(1, 3))) for _ in range(R.randint(0, 90))) for _ in range(200)]


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.fold(text))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_scored(docs, target, min_words=20, percent=5, seed=42):
    """[(id, n_features, weight, score)] of all rows, and the sorted (score, id) that are drawn."""
    cache = {}
    bucket = lambda g: cache.setdefault(g, zlib.crc32(g.encode()) % 10000)
    own = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(bucket(g) for _, _, gs in own for g in gs), Counter(bucket(g) for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows, enough = [], []
    for i, n, gs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in gs)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(gs), weight, score))
        if n >= min_words:
            enough.append((-score, i is not None, i or 0))
    return rows, sorted(enough)[:percent * len(enough) // 100]


def test_buckets_of_features(monkeypatch):
    raw = [(t or "").encode() for t in TEXTS if len(t or "") < 10_000]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for width in (1 << 18, 7, 1):
        monkeypatch.setattr(resampling, "SLICE", width)
        words, count, found = resampling.features(np.frombuffer(b"".join(raw), np.uint8), at)
        ends = np.cumsum(count)
        for x, w, a, b in zip(raw, words, ends - count, ends):
            n, gs = grams(x.decode())
            assert (w, sorted(found[a:b].tolist())) == (n, sorted(zlib.crc32(g.encode()) % 10000 for g in gs))


def test_scores_and_ranks(spark):
    docs = [(n - 3 if n else None, t) for n, t in enumerate(TEXTS)] + [(5, TEXTS[10]), (5, TEXTS[10]), (900, TEXTS[7])]
    target = [t for t in TEXTS[20:40]] + [None, ""]
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id bigint, text string, rank string, score int").repartition(4)
    got = resampling.scored(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=30).collect()
    rows, drawn = brute_scored(docs, target, percent=30)
    assert Counter((r.id, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(-r.score, r.id is not None, r.id or 0) for r in ranked] == drawn
    out = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert out.columns == [*table.columns, "rank_"] and Counter((r.doc_id, r.rank_, r["rank"]) for r in out.collect()) == Counter((r.id, r["rank"], "r") for r in ranked)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = plans.QUERIES["op13_importance_resampling"](spark, FOLDER).collect()
    rows, drawn = brute_scored(docs, target)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(rows)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [i for _, _, i in drawn] and drawn


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c " * 9), (2, None)], "doc_id bigint, text string")
    assert resampling.scored(none, some).count() == 0 and resampling.resampled(none, some).count() == 0
    got = resampling.scored(some, none, percent=100).collect()
    rows, _ = brute_scored([(1, "a b c " * 9), (2, None)], [])
    assert sorted((r.id, r.n_features, r.weight, r.score) for r in got) == rows and [r["rank"] for r in got if r.id == 1] == [1]
