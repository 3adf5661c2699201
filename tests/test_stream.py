"""Streaming queries over file sources compared with their batch forms."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from zonecraft.operators import rules as R
from zonecraft.streaming import events as E
from zonecraft.streaming import sources as S
from zonecraft.streaming import state as T
from zonecraft.streaming import windows as W

SCHEMA = "id long, k string, ts timestamp, kind string, value double"


def make(spark, path, batches):
    """One file per batch, in order."""
    for i, rows_ in enumerate(batches):
        pd.DataFrame(rows_, columns=["id", "k", "ts", "kind", "value"]).assign(ts=lambda d: pd.to_datetime(d.ts, unit="s", utc=True).astype("datetime64[us, UTC]")).to_parquet(path / f"{i:03d}.parquet")
    return spark.read.schema(SCHEMA).parquet(str(path))


def sample(n=300, seed=1, batches=3):
    r = random.Random(seed)
    data = sorted(((i, r.choice("abc"), r.randint(0, 40_000), r.choice(["ok", "ok", "error"]), float(r.randint(0, 9))) for i in range(n)), key=lambda x: x[2])
    size = n // batches
    return [data[i * size:(i + 1) * size] for i in range(batches)]


def stream(spark, path):
    return S.read_stream(spark, "file", {"schema": SCHEMA, "path": str(path), "max_files": 1})


def drain(df, tmp, name, output="append", **kw):
    q = S.run(df, str(tmp / f"ck_{name}"), path=str(tmp / name), output=output, **kw)
    q.awaitTermination(120)
    return q


@pytest.mark.parametrize("spec", [W.WindowSpec("tumbling", "1 hour", column="ts"), W.WindowSpec("sliding", "1 hour", "30 minutes", column="ts"), W.WindowSpec("session", "20 minutes", column="ts")])
def test_windows_equal_their_batch_form(spark, tmp_path, spec):
    (tmp_path / "in").mkdir()
    end = [[(999, "zz", 900_000, "ok", 0.0)]]                     # moves the watermark past all windows
    batch = make(spark, tmp_path / "in", sample() + end)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    drain(W.windowed(stream(spark, tmp_path / "in"), spec, ["k"], *aggs), tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out"))
    want = W.windowed(batch.filter("k <> 'zz'"), spec, ["k"], *aggs)
    assert rows(got) == rows(want) and got.count() > 5


def test_split_sessions_equal_session_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = make(spark, tmp_path / "in", sample(seed=4))
    a = W.windowed(df, W.WindowSpec("session", "10 minutes", column="ts"), ["k"], F.count(F.lit(1)).alias("n"))
    b = W.sessions(df, ["k"], "ts", ["ts", "id"], 600.0, F.date_trunc("hour", "ts"), F.count(F.lit(1)).alias("n"))
    assert rows(a, "window_start", "window_end", "k", "n") == rows(b, "session_start", "session_end", "k", "n")


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(spark, tmp_path / "in", [[(1, "a", 0, "ok", 1.0)], [(2, "a", 100_000, "ok", 1.0)], [(6, "a", 100_050, "ok", 1.0)], [(3, "a", 10, "ok", 1.0), (4, "a", 100_100, "ok", 1.0)], [(5, "a", 300_000, "ok", 1.0)]])
    spec = W.WindowSpec("tumbling", "1 hour", watermark="10 minutes", column="ts")
    drain(W.windowed(stream(spark, tmp_path / "in"), spec, ["k"], F.count(F.lit(1)).alias("n")), tmp_path, "out")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_dedup_within_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(spark, tmp_path / "in", [[(1, "a", 0, "ok", 0.0), (2, "a", 60, "ok", 0.0), (3, "b", 70, "ok", 0.0)], [(4, "a", 1800, "ok", 0.0)],
                                     [(5, "c", 9000, "ok", 0.0)], [(6, "d", 9001, "ok", 0.0)], [(7, "a", 9100, "ok", 0.0)]])
    drain(E.dedup_stream(stream(spark, tmp_path / "in"), ["k"], "ts"), tmp_path, "out")
    got = [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["a", "a", "b", "c", "d"]


def test_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"k": 1}\nnot json\n{"z": 2}\n')
    src = spark.readStream.text(str(tmp_path / "in"))
    q = S.run(src, str(tmp_path / "ck"), each=E.dead_letter_batch("k int", str(tmp_path / "good"), str(tmp_path / "dead"), required=["k"]))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "good")), "k") == [(1,)]
    dead = spark.read.json(str(tmp_path / "dead"))
    assert {(r.value, r.error) for r in dead.collect()} == {("not json", "malformed"), ('{"z": 2}', "missing k")}
    df = spark.createDataFrame([("bad",)], "value string")
    assert E.split_malformed(df, "k int", handling="skip")[1] is None
    with pytest.raises(Exception, match="bad record"):
        E.split_malformed(df, "k int", handling="fail")[0].collect()


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(spark, tmp_path / "in", sample(batches=3)[:2])
    drain(stream(spark, tmp_path / "in"), tmp_path, "out")
    first = spark.read.parquet(str(tmp_path / "out")).count()
    pd.DataFrame([(7, "q", pd.Timestamp("2024-01-01", tz="UTC"), "ok", 0.0)], columns=["id", "k", "ts", "kind", "value"]).astype({"ts": "datetime64[us, UTC]"}).to_parquet(tmp_path / "in" / "z.parquet")
    drain(stream(spark, tmp_path / "in"), tmp_path, "out")
    assert spark.read.parquet(str(tmp_path / "out")).count() == first + 1


def test_auto_close_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = make(spark, tmp_path / "in", sample(seed=6)).withColumn("good", F.col("kind") == "ok")
    drain(T.auto_close_stream(stream(spark, tmp_path / "in").withColumn("good", F.col("kind") == "ok"), "k", "ts", "good", delay="0 seconds"), tmp_path, "out")
    want = T.auto_close(df, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), F.col("good")).filter("closes")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "k", "closed_at") == rows(want, "k", "ts") and got.count() > 3


@pytest.mark.parametrize("healthy,closed", [(2, 0), (3, 1)])
def test_closes_at_three_not_at_two(spark, healthy, closed):
    df = spark.createDataFrame([(i, "d", i, True) for i in range(healthy)], "id int, k string, t int, ok boolean")
    assert T.auto_close(df, ["k"], ["t"], F.col("t"), F.col("ok")).filter("closes").count() == closed


def test_transitions_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = {"ok": ["error", "ok"], "error": ["ok"]}
    df = make(spark, tmp_path / "in", sample(seed=8))
    drain(T.transitions_stream(stream(spark, tmp_path / "in").select("k", "ts", "kind"), "k", "ts", "kind", table, delay="0 seconds"), tmp_path, "out")
    want = T.transitions(df, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), "kind", table)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.groupBy("k", "is_legal").count()) == rows(want.groupBy("k", "is_legal").count())


def test_latest_state_and_merged_aggregates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = make(spark, tmp_path / "in", sample(seed=9))
    q = T.latest_stream(stream(spark, tmp_path / "in"), "k", "ts", ["id"]).writeStream.outputMode("update").format("memory").queryName("zc_latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.k: r.n_events for r in spark.table("zc_latest").groupBy("k").agg(F.max("n_events").alias("n_events")).collect()}
    assert last == {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    combine = {"value": "sum", "id": "max"}
    S.run(stream(spark, tmp_path / "in"), str(tmp_path / "ck2"), each=E.merge_batches(str(tmp_path / "gold"), ["k"], combine)).awaitTermination(120)
    assert rows(E.read_merged(spark, str(tmp_path / "gold"), ["k"], combine)) == rows(df.groupBy("k").agg(F.sum("value").alias("value"), F.max("id").alias("id")))


def event(kind, **payload):
    return (json.dumps({"event_id": "e", "event_type": kind, "timestamp": "2024-01-01 00:00:00", "correlation_id": "c", "source": "s", "version": "1", **payload}),)


@pytest.mark.parametrize("pattern,severity", [("schema_mismatch", "P2"), ("out_of_memory", "P3")])
def test_failure_events(spark, pattern, severity):
    tasks = [{"task_id": f"t{i}", "failure_pattern": pattern, "log_snippet": "x" * 300} for i in range(7)]
    df = spark.createDataFrame([event("pipeline.failed", dag_id="d", run_id="r", pipeline_id="p", failed_tasks=tasks), event("pipeline.failed", dag_id="d2", run_id="r", pipeline_id="p")], "value string")
    a, b = E.failure_incidents(E.parse(df, "pipeline.failed").withColumn("at", F.to_timestamp("timestamp")), "at", most_tasks=5, most_chars=200).orderBy("dag_id").collect()
    whole = E.failure_incidents(E.parse(df, "pipeline.failed").withColumn("at", F.to_timestamp("timestamp")), "at").orderBy("dag_id").first()
    assert len(whole.summary.split("\n")) == 7 and all(line.endswith("x" * 300) for line in whole.summary.split("\n"))
    assert (a.severity, a.n_tasks, len(a.summary.split("\n"))) == (severity, 7, 5) and a.incident_id.startswith("INC-PIPE-") and len(a.incident_id) == 21
    assert (b.pattern, b.severity, b.n_tasks, b.team) == ("unknown", "P3", 0, "data-engineering")


def test_sla_routing_and_source_options(spark):
    df = spark.createDataFrame([event("pipeline.sla_missed", dag_id="d", run_id="r", elapsed_minutes=75.04, sla_deadline_minutes=60), event("odd")], "value string")
    r = E.sla_incidents(E.parse(df, "pipeline.sla_missed").withColumn("at", F.to_timestamp("timestamp")), "at").first()
    assert r.severity == "P3" and "75.0 minutes" in r.description
    assert {k: v.count() for k, v in E.route(E.envelope(df), ["pipeline.sla_missed"]).items()} == {"pipeline.sla_missed": 1, "unhandled": 1}
    fmt, o = S.source_options("kafka", {"bootstrap.servers": "h:1", "topic": "t", "fail_on_data_loss": True})
    assert fmt == "kafka" and o == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "failOnDataLoss": "true"}
    assert S.source_options("kinesis", {"stream_name": "s"})[1]["startingPosition"] == "TRIM_HORIZON"
    assert S.trigger_of("batch") == {"availableNow": True} and S.trigger_of("micro_batch", "5 seconds") == {"processingTime": "5 seconds"}


def test_rate_source_and_rules_on_streams(spark):
    q = R.apply_rules(S.read_stream(spark, "rate", {"rowsPerSecond": 50}), [{"type": "expression", "config": {"column": "x", "expression": "value * 2"}}, {"type": "filter", "config": {"condition": "x >= 0"}}])
    assert q.isStreaming and "x" in q.columns


def test_state_waits_for_late_rows_and_survives_a_restart(spark, tmp_path):
    """Rows of a key spread over batches in any order, within the delay; the query is stopped after two of the four."""
    r = random.Random(31)
    data = sample(240, seed=31, batches=1)[0]
    # each row comes in the batch of its time or the next one
    batches = [[], [], [], []]
    for x in data:
        batches[min(3, x[2] // 12_000 + (r.random() < 0.3))].append(x)
    for b in batches:
        r.shuffle(b)
    end = [(999, "zz", 90_000, "ok", 0.0)]
    (tmp_path / "in").mkdir()
    make(spark, tmp_path / "in", batches[:2])
    query = lambda: T.transitions_stream(stream(spark, tmp_path / "in").select("k", "ts", "kind"), "k", "ts", "kind", {"ok": ["error"], "error": ["ok"]}, delay="4 hours")
    drain(query(), tmp_path, "out")
    some = spark.read.schema("k string, ts timestamp, previous_state string, kind string, is_legal boolean").parquet(str(tmp_path / "out")).count()
    df = make(spark, tmp_path / "in", [*batches, end])
    drain(query(), tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out")).filter("k <> 'zz'")
    want = T.transitions(df.filter("k <> 'zz'"), ["k"], ["ts", "kind"], F.date_trunc("hour", "ts"), "kind", {"ok": ["error"], "error": ["ok"]})
    assert 0 < some < 240 and rows(got, "k", "ts", "previous_state", "kind", "is_legal") == rows(want, "k", "ts", "previous_state", "kind", "is_legal")


def test_limits_of_a_micro_batch():
    assert S.limit_of("file", {}) == {"maxFilesPerTrigger": "1000"} and S.limit_of("kafka", {"max_offsets": 9}) == {"maxOffsetsPerTrigger": "9"}
    assert S.limit_of("kafka", {"max_offsets": None}) == S.limit_of("rate", {}) == {}
