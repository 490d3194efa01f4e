"""Late and out-of-order events: mergeable partial aggregates per period and arrival batch, with a cut-off.

A store holds one row per group, period and arrival batch: how many events and how much value came in time, and how
many were refused because the period was closed when they first arrived. Rows of a store only ever add up, so stores
of disjoint records merge by union and sum, in any order; a period's result is read by combining its batches, also
as it stood at an earlier batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import HOUR_MS, floor_div


def first_arrivals(events: DataFrame) -> DataFrame:
    """events(src, rec_key, t_ms, arrival_ms, value) -> one row per record with its first arrival.

    Copies of a record arrive at different times; the first counts. Rows without key, event time or arrival are
    left out. A null value counts as an event of no value.
    """
    return (
        events.where("rec_key IS NOT NULL AND t_ms IS NOT NULL AND arrival_ms IS NOT NULL")
        .groupBy("src", "rec_key")
        .agg(F.min("t_ms").alias("t_ms"), F.min("arrival_ms").alias("arrival_ms"), F.max("value").alias("value"))
    )


def judge(records: DataFrame, lateness_ms: int, period_ms: int = HOUR_MS) -> DataFrame:
    """records with their period and whether it was closed (more than lateness_ms after its end) when they arrived."""
    period = floor_div(F.col("t_ms"), period_ms)
    closed = F.col("arrival_ms") > (F.col("period") + 1) * F.lit(period_ms) + F.lit(lateness_ms)
    return records.withColumn("period", period).withColumn("refused", closed)


def partials(judged: DataFrame, batch_ms: int = HOUR_MS, period_ms: int = HOUR_MS) -> DataFrame:
    """The store of judged records: (src, period, batch, n, total, corrections, refused).

    corrections are the events in time that arrived after their period had ended.
    """
    late = F.col("arrival_ms") >= (F.col("period") + 1) * F.lit(period_ms)
    kept = ~F.col("refused")
    return (
        judged.withColumn("batch", floor_div(F.col("arrival_ms"), batch_ms))
        .groupBy("src", "period", "batch")
        .agg(
            F.count_if(kept).alias("n"),
            F.sum(F.when(kept, F.coalesce("value", F.lit(0)))).alias("total"),
            F.count_if(kept & late).alias("corrections"),
            F.count_if("refused").alias("refused"),
        )
    )


_SUMS = ("n", "total", "corrections", "refused")


def merge(*stores: DataFrame) -> DataFrame:
    """One store of several whose records are disjoint."""
    union = stores[0]
    for s in stores[1:]:
        union = union.unionByName(s)
    return union.groupBy("src", "period", "batch").agg(*(F.sum(c).alias(c) for c in _SUMS))


def combine(store: DataFrame, up_to_batch: int | None = None) -> DataFrame:
    """Results per period, as known after batch up_to_batch (by default after all)."""
    seen = store if up_to_batch is None else store.where(F.col("batch") <= up_to_batch)
    return seen.groupBy("src", "period").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _SUMS))
