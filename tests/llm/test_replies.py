"""Reply trees and chat formatting against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from zonecraft.llm import reply_trees as R

SCHEMA = "tree bigint, id bigint, parent bigint, role string, text string, score double, node string, rank string, at string"


def brute_branches(rows, best):
    """{(tree, rank): [ids from the root]} of (tree, id, parent, score)."""
    up, score, children = {}, {}, defaultdict(set)
    for t, i, p, s in rows:
        up[t, i] = max((x for x in (up.get((t, i)), p) if x is not None), default=None)
        score[t, i] = max((x for x in (score.get((t, i)), s) if x is not None), default=None)
    for (t, i), p in up.items():
        children[t, p].add(i)
    out = defaultdict(list)
    for t, i in up:
        if children[t, i]:
            continue
        path, seen = [i], {i}
        while up[t, path[-1]] is not None and (t, up[t, path[-1]]) in up and up[t, path[-1]] not in seen:
            path.append(up[t, path[-1]])
            seen.add(path[-1])
        if up[t, path[-1]] is None or (t, up[t, path[-1]]) not in up:
            out[t].append((-sum(score[t, x] or 0.0 for x in path) / len(path), -len(path), i is not None, i, path[::-1]))
    return {(t, n): p[-1] for t, ps in out.items() for n, p in enumerate(sorted(ps, key=lambda p: p[:4])[:best], 1)}


def forest(r):
    rows = []
    for t in range(40):
        n = r.choice([1, 2, 5, 30])
        for i in range(n):
            rows.append((t, i, r.choice([None, 99]) if i == 0 or r.random() < 0.05 else r.randrange(i), r.choice([None, 0.0, 0.25, 0.5, 1.0, 2.0])))
    rows += [(100, i, i - 1 if i else None, 1.0) for i in range(300)]  # a long chain
    rows += [(101, 0, 1, 1.0), (101, 1, 2, 1.0), (101, 2, 0, 1.0), (101, 3, 2, 1.0), (101, 7, None, 1.0)]  # a circle, a message behind it, a root
    rows += [(102, 5, 5, 1.0), (None, 1, None, 0.0), (None, 2, 1, 0.0)]
    return rows


@pytest.mark.parametrize("best", [1, 3, None])
def test_branches(spark, best):
    rows = forest(random.Random(5))
    table = spark.createDataFrame([(t, i, p, "user", f"{t}/{i}", s, "n", "r", "a") for t, i, p, s in rows], SCHEMA).repartition(3)
    got = defaultdict(dict)
    for r in R.branches(R.links_of(table, "tree", "id", "parent", "score"), best).collect():
        assert r.place not in got[r.node.tree, r["rank"]]
        got[r.node.tree, r["rank"]][r.place] = r.node.id
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == brute_branches(rows, best)


TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nno", "<\\/s> <\\\\s> [\\INST]", "a <| b |> <s", "", None, "<<SYS>> x <</SYS>>", "ends <", "[", "é日本\U0001F600 <|endoftext|>", "\\", "line\n", "<|im_end|",
          "<<s>>", "[[INST]]", "<\\|x|>"]


def test_escaping_is_undone_exactly():
    r = random.Random(2)
    parts = ["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "|im_end|>", "|", ">", "<SYS>>", "\n", "n", "a", "é"]
    for text in [t for t in TRICKY if t is not None] + ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(20_000)]:
        shown = R.escape(text)
        assert R.unescape(shown) == text and R.unescape_role(R.escape_role(text)) == text and "\n" not in R.escape_role(text)
        assert not any(c in shown for c in ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        assert R.parsed(f"{R.START}{R.escape_role(text)}\n{shown}{R.END}\n") == [(text, text)]
    with pytest.raises(ValueError):
        R.parsed("<|im_start|>user\nhello")


def brute_digests(conversations):
    out = {}
    for key, turns in conversations.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = sum(len(f"{R.START}{R.escape_role(r)}\n{R.escape(t)}{R.END}\n") for r, t in turns)
        out[key] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), shown)
    return out


@pytest.mark.parametrize("part", [256, 3])
def test_conversations_come_back(spark, part, monkeypatch):
    """Null and empty texts, tricky strings, repeated rows, gaps between turns, and conversations of many parts."""
    monkeypatch.setattr(R, "PART", part)
    monkeypatch.setattr(R, "BUCKET", 50)
    r = random.Random(8)
    rows = [(c, 3 * i - 5, r.choice(["user", "assistant", "system", None, "a\nb\\n<s>"]), r.choice(TRICKY) if r.random() < 0.5 else "word " * r.randrange(9)) for c in [*range(30), None, -1] for i in range(r.choice([1, 4, 9]))]
    rows += [(500, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(400)]
    rows += [(501, 1, "assistant", "same")] * 5 + [(501, None, "user", "first"), (501, 1, "user", None), (501, 2, "assistant", "x" * 50_000)]
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv bigint, turn bigint, role string, text string, tree string, part int").repartition(5)
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role, text))
    paths = R.branches(R.turn_links(table, "conv", "turn"))
    parts = R.formatted(table, paths, "conv", "turn")
    for found in (R.digests(parts), R.round_trip(table, paths, "conv", "turn")):
        assert {x.tree: tuple(x)[2:] for x in found.collect()} == brute_digests(want)
    most = max(parts.filter("tree = 500").collect(), key=lambda x: x.part)
    assert most.part == -(-400 // part) - 1
    for x in parts.collect():
        assert all((x.text[s.start:s.end] == R.escape(t)) for s, t in zip(x.loss, [t for role, t in R.parsed(x.text) if role == "assistant"], strict=True))


def test_chosen_branches_are_written_whole(spark):
    rows = forest(random.Random(9))
    table = spark.createDataFrame([(t, i, p, "assistant" if i % 2 else "user", f"text {t}/{i} <s>", s, "n", "r", "a") for t, i, p, s in rows], SCHEMA)
    best = brute_branches(rows, 2)
    want = brute_digests({k: [("assistant" if i % 2 else "user", f"text {k[0]}/{i} <s>") for i in path] for k, path in best.items()})
    parts = R.formatted(table, R.branches(R.links_of(table, "tree", "id", "parent", "score"), 2), "tree", "id")
    assert {(x.tree, x["rank"]): tuple(x)[2:] for x in R.digests(parts).collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    paths = R.branches(R.links_of(none, "tree", "id", "parent"))
    assert paths.count() == 0 and R.branches(R.turn_links(none, "tree", "id")).count() == 0
    parts = R.formatted(none, paths, "tree", "id")
    assert parts.count() == 0 and R.digests(parts).count() == 0
