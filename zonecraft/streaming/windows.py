"""Event-time windows over streams and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import epoch
from zonecraft.operators.window import framed, running


@dataclass(frozen=True)
class WindowSpec:
    """tumbling | sliding | session; the slide of a sliding window defaults to its duration."""

    kind: str = "tumbling"
    duration: str = "5 minutes"
    slide: str | None = None
    watermark: str = "10 minutes"
    column: str = "event_time"

    def expr(self) -> Column:
        if self.kind == "session":
            return F.session_window(self.column, self.duration)
        return F.window(self.column, self.duration, self.slide or self.duration) if self.kind == "sliding" else F.window(self.column, self.duration)


def windowed(df: DataFrame, spec: WindowSpec, keys, *aggs: Column) -> DataFrame:
    """Windowed aggregation; the watermark takes effect on streams only."""
    x = df.withWatermark(spec.column, spec.watermark) if df.isStreaming else df
    g = x.groupBy(spec.expr().alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *g.columns[1:])


def sessions(df: DataFrame, keys, ts: str, order, gap_seconds: float, bucket: Column, *aggs: Column) -> DataFrame:
    """Batch sessions whose keys may be large: gaps and session numbers come from split windows,
    then sessions are aggregated by (key, number)."""
    x = framed(df, keys, order, bucket, 1, 0, {"_prev": lambda w: F.lag(ts).over(w)})
    new = F.col("_prev").isNull() | (epoch(ts) - epoch("_prev") >= gap_seconds)
    x = running(x.withColumn("_new", new.cast("long")), keys, order, bucket, _session=("sum", "_new"))
    return (x.groupBy(*keys, "_session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("_last"), *aggs)
            .withColumn("session_end", F.col("_last") + F.make_dt_interval(secs=F.lit(float(gap_seconds)))).drop("_session", "_last"))


def split_late(df: DataFrame, ts: str, batch_start: str, tolerance_hours: float) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows lie before the batch start less the tolerance."""
    cut = F.lit(batch_start).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(tolerance_hours * 3600.0))
    return df.filter(F.col(ts) >= cut), df.filter(F.col(ts) < cut)
