"""Dimension, vault and graph invariants on random inputs."""

import hashlib
import random

from pyspark.sql import functions as F

from tests.conftest import rows
from zonecraft.operators import dims as S
from zonecraft.operators import graph as G
from zonecraft.operators import vault as V


def deliver(spark, r, n=30):
    keys = r.sample(range(60), n)
    return spark.createDataFrame([(k, r.choice("abc"), r.choice([None, 1, 2])) for k in keys], "k long, x string, y int")


def test_scd2_over_many_loads(spark):
    r = random.Random(1)
    dim = S.scd2_first(deliver(spark, r), ["k"], "2024-01-01")
    for day in ("2024-01-02", "2024-01-03", "2024-01-04"):
        inc = deliver(spark, r)
        dim = spark.createDataFrame(
            S.versioned(inc, dim, ["k"], ["x", "y"], day, sk="sk").collect(), dim.schema)
        again = S.versioned(inc, dim, ["k"], ["x", "y"], day, sk="sk")
        assert rows(again) == rows(dim)                                    # a repeated load changes nothing
        live = {x.k: (x.x, x.y) for x in dim.filter("is_current").collect()}
        assert all(live[i.k] == (i.x, i.y) for i in inc.collect())          # the delivery is the current state
    assert all(c.passed for c in S.integrity(dim, ["k"], F.col("effective_start")).collect())
    sks = [x.sk for x in dim.collect()]
    assert sorted(sks) == list(range(1, len(sks) + 1))


def test_scd2_reopens_keys_known_only_from_history(spark):
    dim = S.scd2_first(spark.createDataFrame([(1, "a")], "k long, x string"), ["k"], "2024-01-01")
    closed = dim.withColumns({"effective_end": F.lit("2024-02-01").cast("date"), "is_current": F.lit(False)})
    out = S.versioned(spark.createDataFrame([(1, "a")], "k long, x string"), closed, ["k"], ["x"], "2024-03-01", sk="sk")
    assert [(str(x.effective_start), x.is_current, x.sk) for x in out.orderBy("sk").collect()] == [("2024-01-01", False, 1), ("2024-03-01", True, 2)]


def test_scd_types_keep_surrogate_keys(spark):
    dim = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, x string, sk long")
    inc = spark.createDataFrame([(2, "B"), (3, "c")], "k long, x string")
    assert rows(S.scd0(inc, dim, ["k"])) == [(1, "a", 10), (2, "b", 20), (3, "c", 21)]
    assert rows(S.scd1(inc, dim, ["k"])) == [(1, "a", 10), (2, "B", 20), (3, "c", 21)]
    t3 = S.scd3(inc, dim, ["k"], ["x"])
    assert rows(t3, "k", "x", "prev_x", "sk") == [(1, "a", None, 10), (2, "B", "b", 20), (3, "c", None, 21)]
    t33 = S.scd3(spark.createDataFrame([(2, "BB")], "k long, x string"), spark.createDataFrame(t3.collect(), t3.schema), ["k"], ["x"])
    assert rows(t33, "k", "x", "prev_x") == [(1, "a", None), (2, "BB", "B"), (3, "c", None)]
    hashed = S.scd0(inc, dim, ["k"], sk_mode="hash")
    assert len({x.sk for x in hashed.collect()}) == 3


def test_hub_load_is_idempotent_and_nulls_do_not_collide(spark):
    src = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (" A ", None, "b")], "x string, y string, z string")
    h = V.hub(src, None, ["x", "y", "z"], "s", "2024-01-01")
    assert h.count() == 2 and V.hub(src, h, ["x", "y", "z"], "s").count() == 0


def test_effectivity(spark):
    v = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, f int")
    assert rows(V.effectivity(v, ["k"], "f", F.col("f"))) == [("a", 1, 5, False), ("a", 5, None, True), ("b", 2, None, True)]


def edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def reach(pairs, start):
    out, todo = set(), [start]
    while todo:
        n = todo.pop()
        for a, b in pairs:
            if a == n and b not in out:
                out.add(b)
                todo.append(b)
    return out


def test_cycles_are_strongly_connected_components(spark):
    for seed in range(3):
        r = random.Random(seed)
        pairs = {(r.randint(0, 14), r.randint(0, 14)) for _ in range(18)}
        nodes = {n for p in pairs for n in p}
        far = {n: reach(pairs, n) for n in nodes}
        want = {n: min(m for m in nodes if m == n or (m in far[n] and n in far[m])) for n in nodes if n in far[n]}
        got = {x.node: x.component for x in G.cycles(edges(spark, pairs)).collect()}
        assert got == want


def test_levels_and_traversal(spark):
    r = random.Random(9)
    pairs = {(a, b) for a, b in ((r.randint(0, 12), r.randint(0, 12)) for _ in range(20)) if a < b}
    height = {}

    def level(n):
        if n not in height:
            height[n] = max((level(b) + 1 for a, b in pairs if a == n), default=0)
        return height[n]

    e = edges(spark, pairs)
    assert {x.node: x.level for x in G.levels(e).collect()} == {n: level(n) for p in pairs for n in p}
    got = {(x.start, x.node) for x in G.traverse(e, spark.createDataFrame([(0,), (1,)], "n long"), 20).collect()}
    assert got == {(s, n) for s in (0, 1) for n in reach(pairs, s)}
    assert {x.node for x in G.impact(e, spark.createDataFrame([(0,), (1,)], "n long"), 20).collect()} == (reach(pairs, 0) | reach(pairs, 1)) - {0, 1}


def test_levels_of_a_cycle_are_zero(spark):
    assert {x.node: x.level for x in G.levels(edges(spark, {(1, 2), (2, 1), (3, 4)})).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_change_detection_tells_null_empty_and_separators_apart(spark):
    from zonecraft.operators import dims, vault
    schema = "k int, a string, b string"
    old = [(1, None, "x"), (2, "a|b", "c"), (3, "same", None), (4, "q", "r")]
    new = [(1, "", "x"), (2, "a", "b|c"), (3, "same", None), (4, "q", "r2")]
    e, i = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    assert {r.k: r.change for r in dims.change_labels(i, e, ["k"], ["a", "b"]).collect()} == {1: "changed", 2: "changed", 3: "unchanged", 4: "changed"}
    first = dims.scd2_first(e, ["k"], "2024-01-01")
    out = dims.versioned(i, first, ["k"], ["a", "b"], "2024-02-01", sk="sk").collect()
    assert sorted((r.k, r.is_current) for r in out) == [(1, False), (1, True), (2, False), (2, True), (3, True), (4, False), (4, True)]
    sat = spark.createDataFrame([(str(k), a, b, None, None, "s") for k, a, b in old], "hub_hash_key string, a string, b string, load_date timestamp, load_end_date timestamp, record_source string")
    from zonecraft.functions.hashing import hash_diff
    sat = sat.withColumn("hash_diff", hash_diff(["a", "b"]))
    inc = i.select(F.col("k").cast("string").alias("hub_hash_key"), "a", "b")
    assert sorted(r.hub_hash_key for r in vault.satellite_inserts(inc, sat, ["a", "b"], "2024-02-01", "s").collect()) == ["1", "2", "4"]


def test_hub_rows_and_level_ids_are_of_real_rows(spark):
    from zonecraft.operators import dims, vault
    rows = spark.createDataFrame([("A", "b"), ("a", "B")], "x string, y string")
    hub = vault.hub(rows, None, ["x", "y"], "s").collect()
    assert [(r.x, r.y) for r in hub] == [("A", "b")]
    assert [(r.x, r.y) for r in vault.link(rows, None, ["x", "y"], "s").collect()] == [("A", "b")]
    dim = spark.createDataFrame([(1, "X", None), (2, None, "X"), (3, "X", ""), (4, "a||b", "c"), (5, "a", "b||c")], "k int, c string, d string")
    out = dims.normalise(dim, "k", [("city", ["c"]), ("state", ["d"])])
    assert out["dimension"].select("city_id").distinct().count() == 5


def test_long_chains_are_followed_to_the_end(spark):
    chain = edges(spark, {(i, i + 1) for i in range(14)})
    start = spark.createDataFrame([(0,)], "n long")
    assert G.impact(chain, start).count() == 14 and G.traverse(chain, start).count() == 14 and G.impact(chain, start, 3).count() == 3
    assert G.impact(edges(spark, {(1, 2), (2, 1)}), spark.createDataFrame([(1,)], "n long")).count() == 1


def test_as_of_ignores_versions_without_start(spark):
    from zonecraft.operators import joins
    facts = spark.createDataFrame([(1, 5), (1, 15)], "k int, t int")
    versions = spark.createDataFrame([(1, 10, "b"), (1, None, "n"), (1, 0, "a"), (2, None, "z")], "k int, s int, v string")
    out = joins.as_of(facts, versions, ["k"], "t", "s", None, ["v"], lambda c: F.floor(c / 10))
    assert sorted((r.k, r.t, r.v) for r in out.collect()) == [(1, 5, "a"), (1, 15, "b")]


def test_joined_columns_keep_their_order_and_means_skip_missing_values(spark):
    from zonecraft.operators import aggregate, drift, joins
    base = spark.createDataFrame([(1, "x")], "id int, p string")
    dep = {"table": spark.createDataFrame([(1, 7, 8, 9)], "id int, c1 int, c2 int, c3 int"), "keys": [("id", "id")], "select": ["c3", "c1", "c2"]}
    assert joins.multi_join(base, [dep]).columns == ["id", "p", "c3", "c1", "c2"]
    one = spark.createDataFrame([(10.0, 1.0), (None, 9.0)], "v double, w double").agg(aggregate.weighted_mean("v", "w").alias("m")).first()
    assert one.m == 10.0
    assert spark.range(1).select(drift.normal_type(F.lit("STR")).alias("t")).first().t == "string"


def test_place_hash_tells_rows_apart(spark):
    from zonecraft.functions import hashing as H
    values = [("a", "b", None), ("a", None, "b"), (None, "a", "b"), ("a||b", "", ""), ("a", "|b", ""), ("a|", "b", ""), ("a\\", "|b", ""), ("", None, None), (None, "", None), ("\\N", None, "")]
    found = spark.createDataFrame(values, "x string, y string, z string").select(H.hash_key(["x", "y", "z"], "place").alias("h")).collect()
    assert len({r.h for r in found}) == len(values)


def strong_parts(pairs):
    """node -> members of its strongly connected component, for nodes on cycles."""
    nodes, ahead = {n for p in pairs for n in p}, {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ahead[n] = seen
    return {n: {m for m in ahead[n] if n in ahead[m]} for n in nodes if n in ahead[n]}


def test_cycles_and_levels_with_stretches(spark):
    """Random branchings joined by stretches of chain nodes, rings, loops and stretches that hang off them."""
    r = random.Random(21)
    for _ in range(5):
        pairs, fresh = set(), 100
        for _ in range(9):
            a, b, n = r.randrange(6), r.randrange(6), r.choice([0, 0, 1, 3])
            path = [a, *range(fresh, fresh + n), b]
            fresh += n
            pairs |= set(zip(path, path[1:]))
        pairs |= {(50, 51), (51, 52), (52, 50), (60, 60), (70, 71), (71, 72)}
        parts = strong_parts(pairs)
        got = {x.node: (x.component, x.size) for x in G.cycles(edges(spark, pairs)).collect()}
        assert got == {n: (min(m), len(m)) for n, m in parts.items()}

        def level(n):
            outs = [b for a, b in pairs if a == n]
            below = [level(b) if b not in parts else None for b in outs]
            return None if n in parts or None in below else 1 + max(below, default=-1)

        assert {x.node: x.level for x in G.levels(edges(spark, pairs)).collect()} == {n: level(n) or 0 for p in pairs for n in p}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    plain = G.store
    monkeypatch.setattr(G, "store", lambda df: made.append(1) or plain(df))
    chain = spark.range(999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {x.node: x.level for x in G.levels(chain).collect()}
    assert got == {n: 999 - n for n in range(1000)}
    # ten doublings and two steps of three tables each, beside the six tables of the graph
    assert len(made) <= 10 + 2 * 3 + 6
    made.clear()
    ring = chain.union(spark.createDataFrame([(999, 0)], "src long, dst long"))
    found = G.cycles(ring).collect()
    assert {(x.component, x.size) for x in found} == {(0, 1000)} and len(found) == 1000 and len(made) <= 30


def test_many_starts_travel_as_bits(spark):
    """A hub that all starts reach: a round has a row per node and block of starts, not per pair."""
    r = random.Random(22)
    pairs = {(i, 1000) for i in range(200)} | {(1000, 2000 + i) for i in range(50)} | {(2000 + i, 3000 + i % 7) for i in range(50)} | {(r.randrange(200), r.randrange(200)) for _ in range(60)}
    e = edges(spark, pairs)
    starts = G.numbered_starts(spark.range(200).select("id"))
    assert [(x.start, 64 * x.block + x.bit) for x in starts.orderBy("start").collect()] == [(i, i) for i in range(200)]
    rows_ = G.reach(e, starts, 3).groupBy("depth").count().collect()
    nodes, blocks = len({n for p in pairs for n in p}), 4
    assert all(x["count"] <= nodes * blocks for x in rows_)
    for limit in (1, 2, None):
        want = {}
        for s in range(200):
            seen, front, depth = {s}, {s}, 0
            while front and (limit is None or depth < limit):
                depth += 1
                front = {b for a, b in pairs if a in front} - seen
                seen |= front
                want |= {(s, n): depth for n in front}
        assert {(x.start, x.node): x.depth for x in G.traverse(e, spark.range(200).select("id"), limit).collect()} == want
    assert G.traverse(e, spark.range(0).select("id")).count() == 0


def test_links_and_hubs_exchange_the_bytes_of_their_hash(spark, capsys):
    from zonecraft.operators import vault
    rows_ = spark.createDataFrame([("A", "b"), ("a", "B"), (None, "c"), ("", "C"), (None, None)], "x string, y string")
    first = vault.link(rows_, None, ["x", "y"], "s")
    assert first.columns == ["link_hash_key", "hub_0_hash_key", "hub_1_hash_key", "x", "y", "load_date", "record_source"]
    got = first.collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {(r.link_hash_key, r.hub_0_hash_key, r.hub_1_hash_key, r.x, r.y) for r in got} == {
        (digest("A|B"), digest("A"), digest("B"), "A", "b"), (digest("|C"), digest(""), digest("C"), None, "c"), (digest("|"), digest(""), digest(""), None, None)}
    known = spark.createDataFrame([(digest("A|B"),), (digest("|C").upper(),), ("no hash",), (None,)], "link_hash_key string")
    assert {r.link_hash_key for r in vault.link(rows_, known, ["x", "y"], "s").collect()} == {digest("|C"), digest("|")}
    hub = vault.hub(rows_, None, ["x"], "s", recipe="job")
    assert {r.hub_hash_key for r in hub.collect()} == {hashlib.md5(s.encode()).hexdigest() for s in ("A", "a", "")}
    capsys.readouterr()
    first.explain()
    plan = [x for x in capsys.readouterr().out.splitlines() if "partial_min" in x]
    assert plan and not any("hash_key" in x for x in plan)
