"""Windowed queries on unbounded tables. Their results equal the batch forms' for all windows the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.times import HOUR_MS, millis
from millrace.operators import lateness


def _marked(df: DataFrame, time: str, delay: str) -> DataFrame:
    """df with a watermark on time, which must be an absolute time; wall-clock times are taken as UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", millis(F.col("window.start"))).drop("window")


def element_wise_counts(df: DataFrame, time: str, delay: str, groups: list[str]) -> DataFrame:
    """Counts per second and groups."""
    return _flat(_marked(df, time, delay).groupBy(F.window(time, "1 second"), *groups).agg(F.count("*").alias("n")))


def tumbling_counts(df: DataFrame, time: str, size: str, delay: str, groups: list[str]) -> DataFrame:
    return _flat(_marked(df, time, delay).groupBy(F.window(time, size), *groups).agg(F.count("*").alias("n")))


def hot_items(bids: DataFrame, size: str, hop: str, delay: str) -> DataFrame:
    """The auctions with most bids in each hopping window: counts joined with their windowed maximum."""
    counts = _marked(bids, "b_date_time", delay).groupBy(F.window("b_date_time", size, hop), "auction").agg(F.count("*").alias("num"))
    # hopping windows end a hop apart, so each has a slot of one hop of its own
    slots = counts.select(F.window(F.window_time("window"), hop).alias("slot"), millis(F.col("window.start")).alias("window_start"), "auction", "num")
    most = slots.groupBy("slot").agg(F.max("num").alias("most")).withColumnRenamed("slot", "again")
    return slots.join(most, (F.col("slot") == F.col("again")) & (F.col("num") == F.col("most"))).select("window_start", "auction", "num")


def highest_bids(bids: DataFrame, size: str, delay: str) -> DataFrame:
    """All bids with the highest price of their tumbling window: bids joined with the windowed maximum."""
    marked = _marked(bids, "b_date_time", delay)
    each = marked.select(F.window("b_date_time", size).alias("window"), "auction", "bidder", "price")
    most = marked.groupBy(F.window("b_date_time", size).alias("again")).agg(F.max("price").alias("most"))
    return _flat(each.join(most, (F.col("window") == F.col("again")) & (F.col("price") == F.col("most")))).select("window_start", "auction", "bidder", "price")


def session_counts(df: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions per key. A session window ends a gap after its last event; neighbours exactly a gap apart share one."""
    agg = _marked(df, time, delay).groupBy(F.session_window(time, gap), key).agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count("*").alias("events"))
    return agg.select(key, millis(F.col("a")).alias("start_ms"), millis(F.col("b")).alias("end_ms"), "events")


def interval_join(auctions: DataFrame, bids: DataFrame, delay: str, longest: str) -> DataFrame:
    """Bids with the auction they were made in. longest bounds an auction's length, and with it the state."""
    a = _marked(auctions, "a_date_time", delay)
    b = _marked(bids, "b_date_time", delay)
    inside = F.expr(f"auction = a_id AND b_date_time BETWEEN a_date_time AND CAST(expires AS TIMESTAMP) AND b_date_time <= a_date_time + INTERVAL {longest}")
    return b.join(a, inside)


def with_side_input(bids: DataFrame, side: DataFrame) -> DataFrame:
    """Bids with the value of a static table."""
    return bids.join(side, F.col("auction") == F.col("key"))


def once(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each record once, as long as its copies come within the delay."""
    return _marked(df, time, delay).dropDuplicatesWithinWatermark(keys)


def anchored_counts(df: DataFrame, key: str, ms: str, size_ms: int) -> DataFrame:
    """Windows that begin at a key's first event, in order of arrival; a window comes out when the next one begins.

    The state of a key is its open window: begin, last event and count.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b[ms]):
            t = int(t)
            if now is None or t - now[0] > size_ms:
                if now is not None:
                    out.append((k[0], *now))
                now = (t, t, 1)
            else:
                now = (now[0], max(now[1], t), now[2] + 1)
        state.update(now)
        yield pd.DataFrame(out, columns=[key, "window_start", "last_ms", "events"])

    rows = df.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(key, ms)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, window_start bigint, last_ms bigint, events bigint", "a bigint, b bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def store_batch(store: str, lateness_ms: int, period_ms: int = HOUR_MS):
    """A foreachBatch function that adds each batch's partial aggregates to a store, once per batch however often it is retried.

    Batches are events(src, rec_key, t_ms, arrival_ms, value), without copies of a record in different batches
    (see :func:`once`). Closed periods refuse their late records, which are counted.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = lateness.judge(lateness.first_arrivals(batch), lateness_ms, period_ms)
        lateness.partials(judged, period_ms=period_ms).write.mode("overwrite").parquet(f"{store}/part={number}")

    return write


def ranked_in_batches(rank, sink):
    """A foreachBatch function for queries that streams reject, such as those with row_number: rank runs on every batch."""

    def write(batch: DataFrame, number: int) -> None:
        sink(rank(batch), number)

    return write
