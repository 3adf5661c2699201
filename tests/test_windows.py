"""Split windows against plain windows, with NULL keys, ties and one key holding most rows."""

import contextlib
import io
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from zonecraft.operators import drift as D
from zonecraft.operators import joins as J
from zonecraft.operators import window as W


def sample(spark, n=400, seed=1):
    r = random.Random(seed)
    data = [(i, None if r.random() < .1 else "hot" if r.random() < .6 else f"k{r.randint(0, 5)}", r.randint(0, 60), r.choice([None, *range(20)])) for i in range(n)]
    return spark.createDataFrame(data, "id long, k string, t int, v int")


def test_position_running_and_ranks(spark):
    df = sample(spark)
    b = F.floor(F.col("t") / 7)
    w = Window.partitionBy("k").orderBy("t", "id")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.row_number().over(w).cast("long"), F.sum("v").over(u), F.count("v").over(u), F.min("v").over(u), F.max("v").over(u),
                     F.rank().over(Window.partitionBy("k").orderBy("t")).cast("long"), F.dense_rank().over(Window.partitionBy("k").orderBy("t")).cast("long"))
    got = W.running(W.with_ranks(W.with_position(df, ["k"], ["t", "id"], b, "p"), ["k"], ["t", "id"], ["t"], b), ["k"], ["t", "id"], b,
                    s=("sum", "v"), c=("count", "v"), lo=("min", "v"), hi=("max", "v"))
    assert rows(got, "id", "p", "s", "c", "lo", "hi", "rank", "dense_rank") == rows(want)
    assert rows(got.select("id", "p")) == rows(got.select("id", "row_num"))


def test_frames_with_small_blocks(spark):
    df = sample(spark, seed=2)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.lag("v", 3).over(w), F.lead("v", 2).over(w), F.sum("v").over(w.rowsBetween(-4, 2)), F.count("v").over(w.rowsBetween(-5, -1)))
    got = W.framed(df, ["k"], ["t", "id"], F.floor(F.col("t") / 5), 5, 2, {
        "a": lambda x: F.lag("v", 3).over(x), "b": lambda x: F.lead("v", 2).over(x), "c": lambda x: F.sum("v").over(x.rowsBetween(-4, 2)),
        "d": lambda x: F.count("v").over(x.rowsBetween(-5, -1))}, block=6)
    assert rows(got, "id", "a", "b", "c", "d") == rows(want)


def test_no_key_is_one_group(spark):
    df = sample(spark, seed=3)
    want = df.select("id", F.row_number().over(Window.orderBy("t", "id")).cast("long"))
    assert rows(W.with_position(df, [], ["t", "id"], F.col("t"), "p").select("id", "p")) == rows(want)


def test_exact_quantile(spark):
    df = sample(spark, seed=4)
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        want = df.groupBy("k").agg(F.percentile("v", q).alias("q"))
        got = W.exact_quantile(df, ["k"], "v", q, "q")
        assert [(k, round(float(x), 9)) for k, x in rows(got)] == [(k, round(float(x), 9)) for k, x in rows(want)]


def test_trailing_counts(spark):
    df = sample(spark, seed=5).withColumn("ts", F.timestamp_seconds(F.col("t") * 7))
    got = D.trailing_counts(df, ["k"], "ts", ["id"], {"a": 20, "b": 90}, {"n": F.lit(True), "low": F.col("v") < 5})
    data = df.collect()
    for r in got.collect():
        for p, sec in (("a", 20), ("b", 90)):
            near = [x for x in data if x.k == r.k and 0 <= (r.ts - x.ts).total_seconds() <= sec]
            assert r[p + "n"] == len(near) and r[p + "low"] == sum(x.v is not None and x.v < 5 for x in near)


def test_as_of(spark):
    r = random.Random(6)
    versions = {(k, s): (k, s, s + r.randint(1, 9) if r.random() < .5 else None, f"{k}{s}") for k in "ab" for s in r.sample(range(0, 100), 12)}
    v = spark.createDataFrame(list(versions.values()), "k string, s int, e int, name string")
    facts = [(i, r.choice(["a", "b", "c", None]), r.randint(-5, 110)) for i in range(200)]
    f = spark.createDataFrame(facts, "id int, k string, ts int")
    got = {x.id: x.name for x in J.as_of(f, v, ["k"], "ts", "s", "e", ["name"], lambda c: F.floor(c / 10)).collect()}
    for i, k, ts in facts:
        past = [x for x in versions.values() if x[0] == k and x[1] <= ts]
        last = max(past, key=lambda x: x[1], default=None)
        assert got[i] == (last[3] if last and (last[2] is None or ts < last[2]) else None)


def test_outside_windows(spark):
    r = random.Random(7)
    ev = [(i, r.choice(["a", "b", None]), r.randint(0, 500)) for i in range(200)]
    wi = [(r.choice(["a", "b"]), s, s + r.randint(0, 30)) for s in r.sample(range(500), 15)]
    ts = lambda c: F.timestamp_seconds(F.col(c))
    e = spark.createDataFrame(ev, "id int, k string, t int").withColumn("ts", ts("t"))
    w = spark.createDataFrame(wi, "k string, a int, b int").select("k", ts("a").alias("win_start"), ts("b").alias("win_end"))
    got = {x.id for x in D.outside_windows(e, w, ["k"], "ts", ["id"]).collect()}
    assert got == {i for i, k, t in ev if not any(k == wk and a <= t <= b for wk, a, b in wi)}


def test_greedy_suppression(spark):
    r = random.Random(8)
    ev = [(i, r.choice("ab"), r.randint(0, 40_000)) for i in range(300)]
    e = spark.createDataFrame(ev, "id int, k string, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {x.id for x in D.suppress_greedy(e, ["k"], "ts", ["id"], 30).collect()}
    want, last = set(), {}
    for i, k, t in sorted(ev, key=lambda x: (x[2], x[0])):
        if k not in last or t - last[k] >= 1800:
            want.add(i)
            last[k] = t
    assert got == want


def test_group_limit_and_no_plain_sort_of_a_key(spark):
    df = sample(spark)
    plan = W.top_per_group(df, ["k"], ["t", "id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ranges_without_a_bucket(spark):
    """The same windows, cut by the data: ties, nulls, descending order and a hot key."""
    df = sample(spark, seed=11)
    w = Window.partitionBy("k").orderBy(F.desc("t"), "id")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    order = [F.desc("t"), "id"]
    ranks = Window.partitionBy("k").orderBy(F.desc("t"))
    want = df.select("id", F.row_number().over(w).cast("long"), F.sum("v").over(u), F.max("v").over(u), F.rank().over(ranks).cast("long"), F.dense_rank().over(ranks).cast("long"), F.lag("v", 2).over(w), F.lead("v").over(w))
    x = W.with_ranks(W.with_position(df, ["k"], order, None, "p"), ["k"], order, ["t"])
    x = W.framed(W.running(x, ["k"], order, s=("sum", "v"), hi=("max", "v")), ["k"], order, None, 2, 1, {"a": lambda z: F.lag("v", 2).over(z), "b": lambda z: F.lead("v").over(z)})
    assert x.columns == [*df.columns, "p", "row_num", "rank", "dense_rank", "s", "hi", "a", "b"]
    assert rows(x, "id", "p", "s", "hi", "rank", "dense_rank", "a", "b") == rows(want)


def most_rows_of_a_task(df):
    return max(r["count"] for r in df.groupBy(W.RANGE).count().collect())


def test_quantiles_stay_bounded_per_task(spark):
    """Half of the rows have one value, the others lie in 0..1, and one key has nearly all of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 20_000
        df = spark.range(n).select(F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("k"), F.when(F.col("id") % 2 == 0, 0.25).otherwise(F.rand(3)).alias("v"))
        counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("_n"))
        dealt = W.in_ranges(counts, ["k"], ["v"])
        assert dealt.filter("v = 0.25").count() == 2 and most_rows_of_a_task(dealt) < 4 * dealt.count() / 16
        got = W.exact_quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "high": 0.99})
        want = df.groupBy("k").agg(*[F.percentile("v", q).alias(c) for c, q in (("low", 0.1), ("mid", 0.5), ("high", 0.99))])
        assert [(k, *[round(x, 9) for x in xs]) for k, *xs in rows(got)] == [(k, *[round(x, 9) for x in xs]) for k, *xs in rows(want)]
        assert W.exact_quantile(df.filter("false"), ["k"], "v").count() == 0
        one = W.exact_quantile(df, [], "v", 0.5, "m").collect()[0].m
        assert one == df.agg(F.percentile("v", 0.5).alias("m")).collect()[0].m
        # versions of one key, all with different starts
        versions = spark.range(n).select(F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("k"), F.expr("timestamp_seconds(id * 977)").alias("effective_start"))
        assert most_rows_of_a_task(W.in_ranges(versions, ["k"], ["effective_start"])) < 4 * n / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dense_numbers_of_sparse_keys(spark):
    r = random.Random(9)
    keys = [*{r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)}, None]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, a string").repartition(7)
    got = W.sequenced(df, ["k"], 100)
    assert got.columns == ["k", "a", "sk"] and [(x.k, x.sk) for x in got.orderBy("sk").collect()] == [(k, 101 + i) for i, k in enumerate([None, *sorted(k for k in keys if k is not None)])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert W.sequenced(df.filter("false"), ["k"]).count() == 0


def test_as_of_without_buckets_and_with_one_exchange_of_the_rows(spark):
    r = random.Random(16)
    versions = [("a", s, None if r.random() < .3 else s + r.randint(0, 9), f"{s}/{n}") for s in r.sample(range(100), 30) for n in range(r.choice([1, 2]))] + [("a", None, 3, "no start")]
    v = spark.createDataFrame(versions, "k string, s int, e int, name string")
    facts = [(i, r.choice(["a", "a", "b", None]), r.randint(-5, 110)) for i in range(300)]
    f = spark.createDataFrame(facts, "id int, k string, ts int")
    for bucket in (None, lambda c: F.floor(c / 7)):
        out = J.as_of(f, v, ["k"], "ts", "s", "e", ["name"], bucket)
        got = {x.id: (x.s, x.name) for x in out.collect()}
        assert len(got) == len(facts)
        for i, k, ts in facts:
            past = [x for x in versions if x[0] == k and x[1] is not None and x[1] <= ts]
            starts = max((x[1] for x in past), default=None)
            last = max((x for x in past if x[1] == starts), key=lambda x: (x[2] is None, x[2] or 0), default=None)
            if last and (last[2] is None or ts < last[2]):
                assert got[i][0] == starts and (got[i][1] == last[3] or sum(x[1:3] == last[1:3] for x in past) > 1)
            else:
                assert got[i] == (None, None)
    # with buckets, the rows of the facts, which carry `id`, are exchanged once; all other exchanges carry keys and versions
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        J.as_of(f, v, ["k"], "ts", "s", "e", ["name"], lambda c: F.floor(c / 7)).explain("formatted")
    nodes = [n for n in shown.getvalue().split("\n\n") if "Exchange\n" in n]
    rows_of = [n for n in nodes if "id#" in n.split("Input", 1)[1].split("\n")[0]]
    assert len(nodes) > 2 and len(rows_of) == 1, shown.getvalue()
