"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from zonecraft.llm import fingerprints, html_extract, license_scan, line_dedup, mixing, near_dedup, packing, quality_rules, substring_dedup, warc_zip
from zonecraft.llm.plans import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, key string, length bigint, start string, id string, label array<int>"
R = random.Random(1)
SAY = lambda n, salt="": " ".join(salt + "".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(n))
PASSAGE = SAY(80) + "."
LONG = SAY(60_000)
TEXTS = [
    (1, SAY(120) + "\n" + PASSAGE), (2, SAY(100) + "\n" + PASSAGE), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (7, "one"),
    (8, LONG), (9, LONG + " end"), (10, "x" * 100_000), (11, "Ünïcode É 日本語テキスト " * 30), (None, SAY(50)), (None, None), (12, "licensed under CC BY-NC 4.0.\nApache License, CC BY"),
    (13, "same words here " * 40), (13, "same words here " * 40), (14, "a\x1cb \x0b c\x0cd\r\n" + SAY(30)),
]


def rows(texts=TEXTS):
    return [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"s{n % 2}", 1, 2, "k", 3, "st", "id", [n]) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(odd, none):
    got = license_scan.scanned(odd)
    assert got.columns == [*odd.columns, "__scan"] and got.count() == len(TEXTS)
    hit = [r for r in got.collect() if r.doc_id == 12][0]["__scan"]
    assert [(p.start, p.label) for p in hit.places] == [(2, "cc-by"), (7, "apache"), (9, "cc-by")] and hit.score == 1.0 and hit.n_words == 11
    assert [p.label for p in hit.passages] == ["cc-by-nc"]
    empty = [r["__scan"] for r in got.collect() if r.doc_id in (3, 4, 5)]
    assert all((s.n_words, s.places, s.passages, s.score) == (0, [], [], 0.0) for s in empty)
    assert license_scan.scanned(none).count() == 0


def test_license_notice_with_changed_words(spark):
    notice = next(p for label, p, _ in license_scan.NOTICES if label == "mit-text")
    texts = [notice, notice.replace("person", "human"), notice.replace("without restriction", "with limits"), "x y z " * 50 + notice.upper() + " " + notice]
    got = license_scan.scanned(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    found = [[(p.label, p.start, round(p.share, 2)) for p in r["__scan"].passages] for r in got]
    assert found[0] == [("mit-text", 0, 1.0)] and found[1] and found[2] == []
    assert [p[:2] for p in found[3]] == [("mit-text", 150), ("mit-text", 150 + len(notice.split()))]


def test_packing(odd, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    got = packing.packed(odd, tokenizer_path()).collect()
    want = Counter((i, *p) for i, x in TEXTS for p in brute.pieces(x, t))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got)
    body = sorted((r.start, r.ids) for r in got if r.doc_id == 8)
    assert [i for _, ids in body for i in ids] == [*t.encode(LONG, add_special_tokens=False).ids, 2]
    assert packing.packed(none, tokenizer_path()).count() == 0


def test_chunks_equal_the_whole_tokenizer():
    import numpy as np
    t = packing.ChunkTokenizer(tokenizer_path())
    assert t.short
    r = random.Random(2)
    letters = "abcXYZ019 .,'!-_\n\t\x1c\x0b\x85\xa0éÀßøÿ×÷µªºİΣςσ日本語́‍ǅﬁK½²٣😀#<|endoftext|>'s'll"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> <|startoftext|>", "don't we'll I'd 've", "ΣΑΣ ΟΔΟΣ. Σ"]
    raw = [x.encode() for x in texts]
    ids, upto = t.block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for x, a, b in zip(texts, [0, *upto], upto):
        assert ids[a:b].tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_fingerprints(odd, none, spark):
    got = fingerprints.compared(odd, 4).collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for n, (i, x) in enumerate(order):
        x, y = x or "", order[(n + 1) % len(order)][1] or ""
        edited = x[:len(x) - len(x) // 4] + y[:len(x) // 4]
        want[i, len(x), edited, tuple(brute.winnow(x)), tuple(brute.winnow(edited))] += 1
    assert Counter((r.id, r.n_chars, r.edited, tuple(map(tuple, r.fingerprint)), tuple(map(tuple, r.edited_fingerprint))) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compared(none, 4).count() == 0
    lone = fingerprints.compared(spark.createDataFrame([(5, "a b c d e f")], "doc_id bigint, text string"), 4).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_fingerprints_of_texts_without_spaces(spark):
    """One character put in or taken out early leaves nearly all of a long text's fingerprint as it was."""
    r = random.Random(5)
    han = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(3000))
    name = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789_-./") for _ in range(3000))
    texts = [t for x in (han, name, SAY(600)) for t in (x, "x" + x, x[:5] + x[6:], x[:1500] + "é" + x[1500:])]
    found = fingerprints.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), F.col("text"), "f").orderBy("id").collect()
    prints = [[tuple(x) for x in row.f] for row in found]
    assert prints == [brute.winnow(t) for t in texts]
    for n in range(0, len(texts), 4):
        assert all(brute.likeness(prints[n], prints[n + d]) > 0.95 for d in (1, 2, 3))
    assert max(h for f in prints for h, _ in f) > 1 << 60 and brute.likeness(prints[0], prints[4]) == 0


def test_near_dedup(odd, none):
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(TEXTS)
    by = {r.id: r for r in got}
    assert by[7].component_id == 6 and by[9].component_id == 8 and by[3].n == by[4].n == by[5].n == 0 and by[4].component_id == 4 and by[13].component_id == 13
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(Counter(r.doc_id for r in kept.collect()).items(), key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (8, 1), (10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (None, 2)], key=str)
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_near_dedup_of_a_chain_and_a_large_group(spark):
    """Texts that drift apart stay one group through the ones between; unlike texts of a bucket do not join."""
    base = SAY(60, "q").split()
    chain = [(n, " ".join(SAY(1, f"z{i}") if i < n else w for i, w in enumerate(base))) for n in range(40)]
    base = SAY(100, "p").split()
    group = [(1000 + n, " ".join(w if R.random() > 0.06 else SAY(1) for w in base)) for n in range(400)]
    texts = chain + group
    R.shuffle(texts)
    root = brute.near_components({i: brute.shingles(t, 2) for i, t in texts})
    got = near_dedup.classes(spark.createDataFrame(texts, "doc_id bigint, text string"), k=2).collect()
    assert {r.id: r.component_id for r in got} == root


def test_components(spark):
    from zonecraft.llm.components import components
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(900, 900)]
    key = lambda i: (i % 7, i)
    found = components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "x struct<a:bigint,b:bigint>, y struct<a:bigint,b:bigint>")).collect()
    ends = {key(i) for e in edges for i in e if e[0] != e[1]}
    assert {tuple(x.key): tuple(x.label) for x in found} == brute.smallest_reachable(ends, [(key(a), key(b)) for a, b in edges if a != b])
    assert len(found) == len(ends)


def test_html(spark):
    page = """<html><head><title>no</title></head><body class="has-sidebar"><div id="cookie-notice">We use cookies. Accept them all now, please.</div>
      <header><h1>Site</h1></header><ul class="menu"><li><a href="/">Home</a><li><a href="/x">News</a></ul>
      <div class="content"><h2>The &quot;title&quot; &amp; more</h2><p>First para&shy;graph with <b>bold</b>text,<br>a break and   spaces that go on for a while.
      <p>Second one, <a href="y">linked</a> in part &lt;here&gt;.<script>var a = "<p>no</p>";</script><blockquote>A quote that is long enough to count as content, surely.</blockquote>
      <form><label>Name</label><input name="q"><button>Send</button></form></div>
      <aside>Related things to read on this site today.</aside><section class="comments"><article><p>Reader says this was a great text, thanks a lot.</p></article></section>
      <footer>&copy; 2024 Somebody. All rights reserved.</footer>"""
    cut = "<article><p>Good text that is whole. <a hre"
    table = spark.createDataFrame([(1, None, page, 1), (2, "u", None, 2), (3, "u", "", 2), (4, "u", cut, 2), (None, "u", "plain text only, of some length and nothing else.", 3), (1, None, page, 1),
                                   (5, "u", "<p>" + "<div>" * 3000 + "<p>deep text</p>", 1), (6, "u", "<article>" + "<p>word word word.</p>" * 20_000, 1)], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extracted(table).collect()}
    first = 'The "title" & more First para­graph with boldtext, a break and spaces that go on for a while. Second one, linked in part <here>. A quote that is long enough to count as content, surely.'
    assert got[1].text == first and got[1].n_chars == len(first)
    assert got[2].text == got[3].text == "" and got[4].text == "Good text that is whole." and got[None].text.startswith("plain text only")
    assert got[6].text.count("word word word.") == 20_000
    assert html_extract.extracted(table.limit(0)).count() == 0


def test_quality(odd, none, spark):
    got = quality_rules.judged(odd)
    assert got.count() == len(TEXTS)
    for r in got.collect():
        assert tuple(r["__q"]) == brute.quality_counts(r.text)
    plain = rows()
    kept = brute.kept_by_quality([(t, lang, s) for _, t, lang, s, *_ in plain])
    assert sorted(r.label[0] for r in quality_rules.keep_good(odd).collect()) == kept and quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.keep_good(none).count() == 0


def test_mixing(odd, none, spark):
    plain = [(i, t, s) for i, t, _, s, *_ in rows()]
    want = Counter()
    for r, n in zip(plain, brute.copies(plain)):
        want[r] += n
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want
    assert mixing.mixed(none).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert mixing.mixed(empty).count() == 0 and [r["__target"] for r in mixing.drawn(empty).collect()] == [0.0, 0.0]


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(6)
    docs = [(i, "w " * int(r.lognormvariate(4, 1)), f"s{min(i % 37, 9)}") for i in range(20_000)]
    got = mixing.drawn(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), keep=["source"]).collect()
    taken, target, size = Counter(), {}, Counter()
    for x in got:
        taken[x.source] += x["__size"] * x["__copies"]
        target[x.source], size[x.source] = x["__target"], x["__source_size"]
        assert 0 <= x["__copies"] <= 2
    want = brute.targets(size)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) < 0.02 * target[s] + 500 for s in size)


def test_line_dedup(odd, none, spark):
    assert [r["__dropped"] for r in line_dedup.without_boilerplate(odd).collect()] == [0] * len(TEXTS)
    plain = [(n, ("menu\n \nown %d\n  menu \n" % n if n % 3 else None) if n < 60 else "menu", None if n % 2 else "s") for n in range(66)]
    table = spark.createDataFrame(plain, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.without_boilerplate(table, "source").collect()}
    assert got == dict(enumerate(brute.without_boilerplate([(t, s) for _, t, s in plain]))) and got[60] == "" and got[1] == " \nown 1\n"
    assert line_dedup.without_boilerplate(none).count() == 0
    two = [(n, "menü\nown %d" % n, f"s{n % 2}", "de" if n < 20 else None if n < 200 else "en") for n in range(400)]
    by = {r.doc_id: r["__dropped"] for r in line_dedup.without_boilerplate(spark.createDataFrame([(i, t if n < 20 else t[5:], s, n) for n, (i, t, s, _) in enumerate(two)], "doc_id bigint, text string, source string, lang bigint"), ["source"]).collect()}
    assert set(by.values()) == {0}  # 10 of 200 pages of a source are no more than the ratio
    by = {r.doc_id: r["__dropped"] for r in line_dedup.without_boilerplate(spark.createDataFrame([(i, t if n < 20 else t[5:], s, x) for n, (i, t, s, x) in enumerate(two)], "doc_id bigint, text string, source string, lang string")).collect()}
    assert by == {n: int(n < 20) for n in range(400)}  # but all of those in their language
    hosts = spark.createDataFrame([("HTTP://User@Www.Example.com:80/x?y#z",), ("mailto:x",), (None,)], "u string").select(line_dedup.host_of("u").alias("h")).collect()
    assert [r.h for r in hosts] == ["www.example.com", "", None]


def test_paragraph_repeats(odd, none, spark):
    found = substring_dedup.repeats(odd)
    got = {(r.id, r.paragraph): r for r in found.collect()}
    assert not got[1, 1].removed and got[2, 1].removed and (got[2, 1].first_id, got[2, 1].first_paragraph) == (1, 1)
    assert got[2, 1].n_words == 80
    out = substring_dedup.without_repeats(odd, found)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == odd.columns and out.count() == len(TEXTS)
    assert PASSAGE in texts[1] and PASSAGE not in texts[2] and texts[2].strip() == TEXTS[1][1].split("\n")[0] and texts[3] is None and texts[14] == TEXTS[-1][1]
    assert set(brute.words(texts[11])) == set(brute.words(TEXTS[11][1])) and len(texts[11]) < len(TEXTS[11][1])  # words that repeat within a text
    assert substring_dedup.repeats(none).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200_000
    pages = [(3, "http://a/é\n", "a" * 100), (1, None, "a" * 100), (2, "u", "a" * 99), (4, "u", "a" * 99), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (8, "u", big), (None, "u", big), (None, "u", "z" * 200), (9, "u", "é\r\n\r\n" * 60)]
    table = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages], "page_id bigint, url string, html string, digest string").repartition(4)
    out = warc_zip.round_trip(table, folder=str(tmp_path / "w")).collect()
    import hashlib
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        same = [j for j, _, x in pages if (x or "").encode() == raw and j is not None]
        again = len(raw) >= 100 and bool(same) and i != min(same)
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None, None if again else raw] += 1
    assert Counter((r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out) == want
    assert warc_zip.round_trip(table.limit(0), folder=str(tmp_path / "e")).count() == 0


def test_warc_with_other_ids(spark, tmp_path):
    big = "y" * 300
    pages = [("b%1 é\n", "u", big), ("a/2", "u", big), (None, "u", big), ("", "u", ""), ("c", None, "short")]
    out = warc_zip.round_trip(spark.createDataFrame(pages, "page_id string, url string, html string"), folder=str(tmp_path / "s")).collect()
    assert Counter((r.page_id, r.kind, r.refers_to, r.payload_bytes) for r in out) == Counter([("a/2", "response", None, 300), ("b%1 é\n", "revisit", "a/2", 300), (None, "revisit", "a/2", 300), ("", "response", None, 0), ("c", "response", None, 5)])


@pytest.mark.parametrize("packing", ["plain", "gzip", "deflated"])
def test_archives_of_other_writers(spark, tmp_path, packing):
    """Two data members that the index names, as strings and with a time in between, and an index of any packing."""
    import gzip
    import json
    import zipfile
    members, lines = {}, ["!meta 0 {\"format\": \"x\"}"]
    for part in ("one.warc.gz", "two.warc.gz"):
        body = b""
        for i in range(3):
            record = warc_zip.record_bytes("response", i if part == "one.warc.gz" else 10 + i, f"http://a/{i}", f"{part} {i}".encode(), "d" * 64, None, 0)
            lines.append(f"a,{i})/ 2024 " + json.dumps({"url": f"http://a/{i}", "filename": part, "offset": str(len(body)), "length": str(len(record))}))
            body += record
        members[part] = body
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        for part, body in members.items():
            z.writestr(f"archive/{part}", body)
        index = "\n".join(lines).encode()
        z.writestr("indexes/index.cdx.gz" if packing == "gzip" else "indexes/index.cdxj", gzip.compress(index) if packing == "gzip" else index, zipfile.ZIP_DEFLATED if packing == "deflated" else zipfile.ZIP_STORED)
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    rows_ = warc_zip.index_rows(spark.createDataFrame([("x.wacz",)], "archive string"), str(tmp_path))
    found = warc_zip.read_records(rows_, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in found) == sorted((i if part == "one.warc.gz" else 10 + i, f"{part} {i}") for part in members for i in range(3))
    with zipfile.ZipFile(tmp_path / "y.wacz", "w") as z:
        z.writestr("archive/one.warc.gz", members["one.warc.gz"], zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.cdxj", json.dumps({"offset": 0, "length": 5}))
    with pytest.raises(Exception, match="stored members only"):
        warc_zip.index_rows(spark.createDataFrame([("y.wacz",)], "archive string"), str(tmp_path)).collect()


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(tmp_path, zip64, monkeypatch):
    import io
    import zipfile
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data, file = {"a.bin": b"x" * 300, "dir/b.bin": b"y" * 50, "c": b""}, io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        for name, body in data.items():
            z.writestr(name, body)
        z.writestr("packed", b"q" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 with a mark"
    found = warc_zip.directory(file, len(file.getvalue()))
    assert {n: file.getvalue()[a:a + size] for n, (a, size) in found.items()} == data
    if zip64:
        assert b"PK\x06\x06" in file.getvalue()
    for bad in (b"", b"PK", file.getvalue()[:-30]):
        with pytest.raises(ValueError):
            warc_zip.directory(io.BytesIO(bad), len(bad))


def test_columns_named_like_the_operators_own(spark):
    """Every column of the input keeps its values, whatever it is called."""
    names = ["__row", "__q", "__base_failed", "__kept", "__group", "__l", "__m", "__n", "__words", "__hits", "__agree", "__whole", "__keys", "__votes", "__runs", "__passages", "__places",
             "__scan", "__text", "__site", "__left", "__dropped", "__drop", "__stay", "__id", "__size", "__source", "__copies", "__kb", "row", "key", "site", "keys", "who", "n", "a.b", "c`d", "copies"]
    own = {c: f"v-{i}" for i, c in enumerate(names)}
    texts = [(n, f"{PASSAGE}\nunder the MIT license {n} " + SAY(40)) for n in range(6)] + [(7, None)]
    quote = lambda c: "`" + c.replace("`", "``") + "`"
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{quote(c)} string" for c in names) + ", tags map<string,int>"
    table = spark.createDataFrame([(i, t, "en", "s", *own.values(), {"x": i}) for i, t in texts], schema)
    found = substring_dedup.repeats(table)
    outs = {"scan": license_scan.scanned(table), "lines": line_dedup.without_boilerplate(table), "judged": quality_rules.judged(table), "good": quality_rules.keep_good(table),
            "one": near_dedup.keep_one(table), "mixed": mixing.mixed(table), "out": substring_dedup.without_repeats(table, found)}
    for name, out in outs.items():
        assert out.columns[:len(table.columns)] == table.columns, name
        rows = [r.asDict() for r in out.collect()]
        assert rows and all(r[c] == v for r in rows for c, v in own.items()) and all(r["tags"] == {"x": r["doc_id"]} for r in rows), name
    assert outs["scan"].columns[-1] == "__scan_" and outs["lines"].columns[-1] == "__dropped_" and outs["judged"].columns[-3:] == ["__q_", "__base_failed_", "__kept_"]
    assert [r["__scan_"].score for r in outs["scan"].orderBy("doc_id").collect()] == [1.0] * 6 + [0.0] and found.filter("removed").select("id").distinct().count() == 5


def test_mixing_of_many_equal_rows(spark):
    """Equal rows share their copies; no row is lost and none comes from elsewhere."""
    rows = [(1, "same words", "a")] * 9000 + [(i, "w " * (i % 30), "a" if i % 2 else None) for i in range(2, 500)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = Counter()
    for r, n in zip(rows, brute.copies(rows)):
        want[r] += n
    assert Counter(map(tuple, mixing.mixed(table).collect())) == +want and want[rows[0]] > mixing.PIECE
