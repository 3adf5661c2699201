"""Aggregations beyond plain group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import money
from zonecraft.operators.window import with_position


def order_summary(orders: DataFrame, customer: str, amount: Column, when: str, status: str, labels: dict) -> DataFrame:
    """Per customer: orders, revenue, first and last date and one count per status label."""
    return (orders.groupBy(customer)
            .agg(F.count(F.lit(1)).alias("total_orders"), F.round(money(amount), 2).alias("total_revenue"),
                 F.min(when).alias("first_order"), F.max(when).alias("last_order"),
                 *[F.count_if(F.col(status) == v).alias(n) for n, v in labels.items()])
            .orderBy(F.desc("total_revenue")))


def collect_chunks(df: DataFrame, keys, value: str, order, bucket: Column | None = None, size: int = 10_000) -> DataFrame:
    """collect_list in parts of bounded length, in order: (keys, part, values)."""
    x = with_position(df.select(*keys, value, *[c for c in order if c not in (*keys, value)]), keys, order, bucket, "_p")
    part = F.floor((F.col("_p") - 1) / size).cast("long").alias("part")
    pairs = F.array_sort(F.collect_list(F.struct("_p", value)))
    return x.groupBy(*keys, part).agg(F.transform(pairs, lambda s: s[value]).alias("values"))


def rollup_facts(df: DataFrame, grains, *measures: Column) -> DataFrame:
    """Several grains in one aggregation; `grain` names the columns of each result row."""
    cols = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    label = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols])
    return df.groupingSets(sets, *[F.col(c) for c in cols]).agg(label.alias("grain"), *measures)


def reaggregate(base: DataFrame, by, additive, non_additive=()) -> DataFrame:
    """Coarser grain from a base-grain table: additive measures are summed again, others must be
    given as aggregates over base rows."""
    return base.groupBy(*by).agg(*[money(c).alias(c) for c in additive], *non_additive)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of the rows that have a value and a weight."""
    w = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.sum(F.col(value) * F.col(weight)) / F.when(w != 0, w)


def share_of_total(df: DataFrame, by, digits: int = 2) -> DataFrame:
    """Count and percentage per group; the total comes from the grouped rows."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_total"))
    return g.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("_total"), digits)).drop("_total")  # one row


def repeated_groups(df: DataFrame, cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
