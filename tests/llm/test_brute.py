"""Operators whose results SQL cannot state, and the pipeline, against plain Python versions."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.llm import brute
from zonecraft.llm import html_extract, near_dedup, plans, substring_dedup

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(plans.tokenizer_path())


def test_packing(spark, docs, tokenizer):
    got = plans.QUERIES["op2_packing"](spark, FOLDER).collect()
    want = sorted((i, *p) for i, t, *_ in docs for p in brute.pieces(t, tokenizer))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.sequence_id % 13 == r.length.bit_length() - 1 for r in got)


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in plans.QUERIES["op3_fingerprints"](spark, FOLDER).collect()}
    rows = sorted((i, t or "") for i, t, *_ in docs)
    show = lambda f: " ".join(f"{h}@{p}" for h, p in f)
    for at, (i, text) in enumerate(rows):
        follower = rows[(at + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[:len(text) - n] + follower[:n]
        own, other, after = brute.winnow(text), brute.winnow(edited), brute.winnow(follower)
        r = got.pop(i)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(other))
        assert (r.near_edited, r.near_next) == (brute.likeness(own, other), brute.likeness(own, after))
    assert not got


def test_near_duplicates_of_five_words(spark, docs):
    got = {r.id: (r.n, r.component_id) for r in near_dedup.classes(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    sets = {i: brute.shingles(t, 5) for i, t, *_ in docs}
    root = brute.near_components(sets)
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_paragraph_repeats(spark, docs):
    found = plans.QUERIES["op9_substring_dedup"](spark, FOLDER).collect()
    parts, lines = {}, {}
    for i, t, *_ in docs:
        lines[i] = split(t)
        for n, p in enumerate(lines[i]):
            if len(brute.words(p)) >= 20:
                parts[i, n] = p
    sets = {k: brute.shingles(p, 5) for k, p in parts.items()}
    root = brute.near_components(sets)
    count = Counter(root.values())
    want = sorted((*k, len(brute.words(parts[k])), *root[k], k != root[k]) for k in parts if count[root[k]] > 1)
    assert sorted(tuple(r) for r in found if r.paragraph < len(lines[r.doc_id])) == want and want

    # windows: equal words wherever they are found, and one in every run of PASSAGE words that stands twice
    words = {i: brute.words(brute.fold(t)) for i, t, *_ in docs}
    place = {(i, len(lines[i]) + n): p for i, t, *_ in docs for n, p in enumerate(window_places(t))}
    at = lambda k: words[k[0]][place[k]:place[k] + substring_dedup.WINDOW]
    groups, held = {}, {i: set() for i in words}
    for r in found:
        if r.paragraph >= len(lines[r.doc_id]):
            k, first = (r.doc_id, r.paragraph), (r.first_doc_id, r.first_paragraph)
            assert r.n_words == substring_dedup.WINDOW == len(at(k)) and at(k) == at(first) and r.removed == (k > first)
            groups.setdefault(tuple(at(k)), []).append((first, k))
            held[r.doc_id].add(place[k])
    assert all(len(g) > 1 and len({f for f, _ in g}) == 1 and min(k for _, k in g) == g[0][0] for g in groups.values())
    runs = Counter(tuple(w[n:n + substring_dedup.PASSAGE]) for w in words.values() for n in range(len(w) - substring_dedup.PASSAGE + 1))
    again = [(i, n) for i, w in words.items() for n in range(len(w) - substring_dedup.PASSAGE + 1) if runs[tuple(w[n:n + substring_dedup.PASSAGE])] > 1]
    assert again and all(held[i] & set(range(n, n + substring_dedup.PLACES)) for i, n in again)


def window_places(text):
    """The word with which each window of a text begins."""
    import numpy as np
    raw = (text or "").encode()
    start, *_ = substring_dedup.windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [len(brute.words(raw[:a].decode())) for a in start]


def split(text):
    import numpy as np
    raw = np.frombuffer((text or "").encode(), np.uint8)
    start, end, _ = substring_dedup.paragraphs(raw, np.array([0, len(raw)]), substring_dedup.CUT_WORDS)
    return [raw[a:b].tobytes().decode() for a, b in zip(start, end)]


def test_paragraphs_cover_the_text_and_cut_alike():
    r = random.Random(3)
    sentence = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(4, 14))) + "."
    passage = " ".join(sentence() for _ in range(30))
    texts = [" ".join(sentence() for _ in range(20)) + " " + passage + " " + " ".join(sentence() for _ in range(20)) for _ in range(2)]
    for t in [*texts, "one line\n\n  two\nthree ", "", "\n"]:
        assert re.sub(r"\s", "", "".join(split(t))) == re.sub(r"\s", "", t)
    a, b = (set(map(str.strip, split(t))) for t in texts)
    assert sum(len(p) for p in a & b) > len(passage) / 2


def test_pages(spark):
    """In these pages the article is <article>: its headings and paragraphs, tags apart."""
    import html
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r.page_id: r for r in plans.QUERIES["op5_html_extraction"](spark, FOLDER).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*(?:>|$)", " ", body[1])).split()) if body else ""
        assert (got[i].text, got[i].n_chars) == (want, len(want))


def test_minimum_cut_against_all_labellings():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 9)
        scores = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4]
        cost = lambda side: sum(abs(s) for s, k in zip(scores, side) if (s > 0) != k) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023,E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(scores, edges)) == pytest.approx(best)


def test_pipeline(spark, docs, tokenizer):
    import corpus_pipeline
    found = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, (quality, lines, one_of_each, mix, None)):
        out = stage(spark, found, FOLDER)
        if check is None:
            want = Counter((i, *p) for i, t, *_ in rows for p in brute.pieces(t, tokenizer))
            got = out.collect()
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
            assert len({r.sequence_id for r in got}) == len(got)
        else:
            rows = check(rows)
            assert out.columns == found.columns
            assert Counter(map(tuple, out.collect())) == Counter(rows), name
            found = spark.createDataFrame(rows, found.schema)
    final = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in final) == Counter((i, a, crc) for (i, a, _, crc, _), n in want.items() for _ in range(n))


def quality(rows):
    return [rows[i] for i in brute.kept_by_quality([(r[1], r[2], r[3]) for r in rows])]


def lines(rows):
    return [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, brute.without_boilerplate([(r[1], (r[3], r[2])) for r in rows]))]


def one_of_each(rows):
    root = brute.near_components({r[0]: brute.shingles(r[1], 5) for r in rows})
    return [r for r in rows if root[r[0]] == r[0]]


def mix(rows):
    return [r for r, n in zip(rows, brute.copies([(r[0], r[1], r[3]) for r in rows])) for _ in range(n)]
