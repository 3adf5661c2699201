"""Per-key state over event histories (batch forms; the streaming forms share their rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import all_of, any_of
from zonecraft.operators.drift import trailing_counts
from zonecraft.operators.window import framed, running, with_position


def success_streaks(df: DataFrame, keys, order, bucket: Column, ok: Column, name: str = "streak") -> DataFrame:
    """Length of the run of successes ending at each row: position minus position of the last
    failure."""
    x = with_position(df.withColumn("_ok", ok), keys, order, bucket, "_pos")
    x = running(x, keys, ["_pos"], bucket, _fail=("max", F.when(~F.col("_ok"), F.col("_pos"))))
    return x.withColumn(name, (F.col("_pos") - F.coalesce("_fail", F.lit(0))).cast("long")).drop("_ok", "_pos", "_fail")


def auto_close(df: DataFrame, keys, order, bucket: Column, ok: Column, runs: int = 3) -> DataFrame:
    """Rows at which an open incident closes: the `runs`-th consecutive success."""
    x = success_streaks(df, keys, order, bucket, ok, "_streak")
    return x.withColumn("closes", F.col("_streak") == runs).drop("_streak")


# Workflow states and the states each may move to.
INCIDENT_TRANSITIONS = {
    "new": ["received"], "received": ["enriched", "failed"], "enriched": ["plan_generated", "failed"],
    "plan_generated": ["pending_approval", "approved"], "pending_approval": ["approved", "rejected"], "approved": ["executing"],
    "executing": ["executed", "failed"], "executed": ["verified", "failed"], "verified": ["close_requested"], "close_requested": ["closed"],
}

# The same for the workflow that builds and deploys a pipeline: its working states, one after another, may fail.
PIPELINE_TRANSITIONS = {
    "requested": ["planning"], "planning": ["planned", "failed"], "planned": ["generating"], "generating": ["generated", "failed"],
    "generated": ["validating"], "validating": ["validated", "failed"], "validated": ["pending_approval", "approved"],
    "pending_approval": ["approved", "rejected"], "approved": ["deploying"], "deploying": ["deployed", "failed"],
}


def transition_ok(previous: Column, state: Column, transitions: dict, initial=None) -> Column:
    legal = any_of([(previous == a) & state.isin(*b) for a, b in transitions.items()])
    first = state.isin(*initial) if initial else F.lit(True)
    return F.when(previous.isNull(), first).otherwise(legal)


def transitions(df: DataFrame, keys, order, bucket: Column, state: str, table: dict, initial=None) -> DataFrame:
    """Previous state and legality of every step."""
    x = framed(df, keys, order, bucket, 1, 0, {"previous_state": lambda w: F.lag(state).over(w)})
    return x.withColumn("is_legal", transition_ok(F.col("previous_state"), F.col(state), table, initial))


def current_state(df: DataFrame, keys, order, columns) -> DataFrame:
    """Latest values per key by partial aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_c"), F.count(F.lit(1)).alias("n_events")).select(*keys, "_c.*", "n_events")


# ---- streaming forms -------------------------------------------------------------------------

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_time_order(df: DataFrame, key: str, ts: str, columns, state: str, output: str, step, delay: str = "10 minutes") -> DataFrame:
    """`step(state, row)` for the rows of every key in the order of `ts`: it returns the key's new state (a tuple
    of the schema `state`) and the output rows, tuples of the schema `output`; `row` has `ts` and `columns`.

    Rows wait in a list in the state store until the watermark, the newest time less `delay`, has passed
    them; an event-time timer then takes them in order, ties by their values.  So it does not matter in which
    micro-batch a row comes or in which order, and the rows of a key in a batch go into the list one by one.  A task
    holds a key's rows of one `delay` and the time since the last batch.  Rows later than `delay` are dropped.
    State and waiting rows live in the checkpoint and are there again after a restart."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import StructType

    columns = [ts, *[c for c in columns if c != ts]]
    waiting = df.select(F.lit(0).cast("long").alias("_at"), *columns).schema
    names = StructType.fromDDL(output).names

    class Ordered(StatefulProcessor):
        def init(self, handle):
            self.handle, self.rows, self.state = handle, handle.getListState("waiting", waiting), handle.getValueState("state", state)

        def handleInputRows(self, key, rows, timerValues):
            for r in rows:
                self.rows.appendValue((r["_at"], *[r[c] for c in columns]))
                self.handle.registerTimer(r["_at"] // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs()
            due, later = [], []
            for r in self.rows.get():
                (due if r[0] // 1000 <= passed else later).append(tuple(r))
            if not due:
                return
            now = tuple(self.state.get()) if self.state.exists() else None
            for r in sorted(due, key=lambda r: (r[0], tuple((x is not None, str(x)) for x in r[1:]))):
                now, out = step(now, Row(*columns)(*r[1:]))
                for x in out:
                    yield Row(*names)(key[0], *x)
            self.state.update(now)
            if later:
                self.rows.put(later)
            else:
                self.rows.clear()

        def close(self):
            pass

    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("_at", F.unix_micros(ts))
    return timed.select(key, "_at", *columns).groupBy(key).transformWithState(Ordered(), output, "append", "eventTime")


def auto_close_stream(df: DataFrame, key: str, ts: str, ok: str, runs: int = 3, delay: str = "10 minutes") -> DataFrame:
    """Close events of a stream: a key closes at its `runs`-th consecutive success after a failure
    or start.  State per key is one counter, and the rows of `in_time_order`."""
    def step(state, row):
        n = (state[0] if state else 0) + 1 if row[ok] else 0
        return (n,), [(row[ts],)] if n == runs else []

    t, w = (df.schema[c].dataType.simpleString() for c in (key, ts))
    return in_time_order(df, key, ts, [ok], "n bigint", f"{key} {t}, closed_at {w}", step, delay)


def transitions_stream(df: DataFrame, key: str, ts: str, state_col: str, table: dict, delay: str = "10 minutes") -> DataFrame:
    """Every step with its previous state and legality, in time order; state per key is the last state."""
    legal = {(a, b) for a, bs in table.items() for b in bs}

    def step(state, row):
        last = state[0] if state else None
        return (row[state_col],), [(row[ts], last, row[state_col], last is None or (last, row[state_col]) in legal)]

    kt, tt = (df.schema[c].dataType.simpleString() for c in (key, ts))
    return in_time_order(df, key, ts, [state_col], "last string", f"{key} {kt}, {ts} {tt}, previous_state string, {state_col} string, is_legal boolean", step, delay)


def latest_stream(df: DataFrame, key: str, ts: str, columns) -> DataFrame:
    """Running latest state per key (update mode)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("_c"), F.count(F.lit(1)).alias("n_events")).select(key, "_c.*", "n_events")


def rate_limit(df: DataFrame, keys, ts: str, row_id, limits) -> DataFrame:
    """Requests of the key in each trailing window `(name, seconds, most)` and whether all hold."""
    x = trailing_counts(df, keys, ts, row_id, {n: s for n, s, _ in limits}, {"": F.lit(True)})
    return x.withColumn("allowed", all_of([F.col(n) <= most for n, _, most in limits]))
