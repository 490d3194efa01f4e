"""Windows over an event stream held as a table: the assigners, and their rules on what comes out.

Every assigner takes a column of epoch milliseconds. Fixed windows come out only when complete: they begin at or after the
stream's base and end at or before its end. Session and anchored windows of a batch all come out; ``drop_open`` leaves
out those that more events could still have joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import floor_div
from millrace.operators import sessions
from millrace.session import cut_lineage


@dataclass(frozen=True)
class Window:
    """kind: element, tumbling, hopping, session, anchored or rows; size and hop in milliseconds (rows: in rows)."""

    kind: str
    size: int
    hop: int | None = None


def element_wise_window(epoch_ms: int = 1000) -> Window:
    return Window("element", epoch_ms)


def tumbling_window(seconds: int) -> Window:
    return Window("tumbling", seconds * 1000)


def hopping_window(seconds: int, hop_seconds: int) -> Window:
    if not 0 < hop_seconds <= seconds:
        raise ValueError("a hop must be positive and no longer than its window")
    return Window("hopping", seconds * 1000, hop_seconds * 1000)


sliding_window = hopping_window


def session_window(seconds: int) -> Window:
    return Window("session", seconds * 1000)


def global_window(seconds: int) -> Window:
    """Anchored at each key's first event, and again at the first event after a window."""
    return Window("anchored", seconds * 1000)


stagger_window = global_window


def row_window(rows: int) -> Window:
    return Window("rows", rows)


def epoch(ms: Column, size: int, base: int = 0) -> Column:
    """The number of the epoch that ms lies in."""
    return floor_div(ms - F.lit(base), size)


def bounds(df: DataFrame, ms: str, size: int) -> tuple[int, int]:
    """(base, end) of a stream: its first and last event rounded out to whole units of size; (0, 0) if it is empty."""
    low, high = df.agg(F.min(ms), F.max(ms)).first()
    return (0, 0) if low is None else (low - low % size, high - high % size + size)


def fixed_windows(df: DataFrame, ms: str, window: Window, base: int, end: int) -> DataFrame:
    """df with window_start, once for every complete tumbling or hopping window that a row lies in. Rows without a time lie in none."""
    hop = window.hop or window.size
    last = floor_div(F.col(ms) - F.lit(base), hop) * hop + F.lit(base)
    if hop == window.size:
        out = df.where(F.col(ms).isNotNull()).withColumn("window_start", last)
    else:
        steps = -(-window.size // hop)
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: last - i * hop), lambda s: s + window.size > F.col(ms))
        out = df.where(F.col(ms).isNotNull()).withColumn("window_start", F.explode(starts))
    return out.where((F.col("window_start") >= base) & (F.col("window_start") + window.size <= end))


def session_windows(df: DataFrame, key: str, ms: str, record: str, gap_ms: int, drop_open: int | None = None) -> DataFrame:
    """(key, start_ms, end_ms, events). drop_open: the stream's end; sessions an event at that time could join are left out."""
    tree = sessions.gap_tree(df.select(F.col(key).alias("entity"), F.col(ms).alias("ms"), F.col(record).alias("record")), [gap_ms])
    out = sessions.cut(tree, gap_ms).select(F.col("entity").alias(key), "start_ms", "end_ms", "events")
    return out if drop_open is None else out.where(F.col("end_ms") + gap_ms < drop_open)


_WINDOWS = "k bigint, window_start bigint, last_ms bigint, events bigint"


class _Anchored:
    """The sorted (key, ms, count) of a partition. after: for each row the first of its key that its own window, if it began one, wouldn't hold."""

    def __init__(self, batches: Iterator[pa.RecordBatch], size_ms: int) -> None:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        self.k, self.t, self.n = (np.concatenate(c) if held else np.zeros(0, np.int64) for c in (zip(*held, strict=True) if held else ((), (), ())))
        size = len(self.k)
        self.size_ms = size_ms
        self.first = np.flatnonzero(np.append(True, self.k[1:] != self.k[:-1])) if size else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], size)
        # keys are set apart by more than any time and window span, so that one search does for all
        rank = np.repeat(np.arange(len(self.first)), self.end - self.first)
        wide = int(self.t.max() - self.t.min()) + size_ms + 2 if size else 1
        if len(self.first) * wide < 2**62:
            line = (self.t - self.t.min() if size else self.t) + rank * wide
            self.after = np.searchsorted(line, line + size_ms, "right")
        else:
            spans = zip(self.first.tolist(), self.end.tolist(), strict=True)
            self.after = np.concatenate([a + np.searchsorted(self.t[a:b], self.t[a:b] + size_ms, "right") for a, b in spans])

    def last_start(self, low: int, high: int) -> np.ndarray:
        """For each row of a key, from low to high, where the last window begins if one begins at the row. By doubling steps."""
        to = self.after[low:high] - low
        here = np.arange(high - low)
        to = np.where(to >= high - low, here, to)
        while True:
            further = to[to]
            if (further == to).all():
                return to + low
            to = further


def _edges(size_ms: int) -> Callable:
    """Of a partition's first key, and of its last: (k, part, upto_ms, exit_ms), the begin of the last window by that of the first one.

    Where a window of the partition before ends decides where the first of this one begins. Rows are in order of upto_ms: the first with a later one than that end holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, part = _Anchored(batches, size_ms), TaskContext.get().partitionId()
        rows = []
        for at in ([0] if len(p.first) == 1 else [0, len(p.first) - 1]) if len(p.first) else []:
            low, high = int(p.first[at]), int(p.end[at])
            exits = p.last_start(low, high)
            upto = min(int(p.after[low]), high - 1) + 1 if at == 0 else low + 1  # only the first key can have a window open from before
            part_of = exits[: upto - low]
            last = np.flatnonzero(np.append(part_of[1:] != part_of[:-1], True))
            rows += [(int(p.k[low]), part, int(p.t[low + i]), int(p.t[exits[i]])) for i in last.tolist()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "part", "upto_ms", "exit_ms"])

    return run


def _open_before(size_ms: int) -> Callable:
    """(part, anchor): the window of a partition's first key that is open when it begins, from edges sorted by (k, part, upto_ms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, anchor, done = [], None, None, True
        for batch in batches:
            for k, part, upto, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != k:
                    now, anchor, done = (k, None), None, True
                if now[1] != part:
                    now, done = (k, part), False
                    entered = anchor
                    if entered is not None:
                        out.append((part, entered))
                if not done and (entered is None or upto > entered + size_ms):
                    anchor, done = leave, True
        columns = list(zip(*out, strict=True)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "anchor"])

    return run


def _parts_of_windows(size_ms: int, anchor_of: Callable[[], dict[int, int]]) -> Callable:
    """The windows of a partition, or what it holds of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Anchored(batches, size_ms)
        size = len(p.k)
        if not size:
            return
        anchor = anchor_of().get(TaskContext.get().partitionId())
        begins = np.zeros(size + 1, bool)
        # a row far behind the one before it begins a window whatever came earlier, so all such rows are followed at once
        alone = np.append(True, (p.k[1:] != p.k[:-1]) | (p.t[1:] - p.t[:-1] > size_ms))
        entry = 0
        if anchor is not None:
            entry = int(np.searchsorted(p.t[: p.end[0]], anchor + size_ms, "right"))
            alone[0] = False
            if entry < p.end[0]:
                alone[entry] = True
        begin_of_key = np.repeat(p.end, p.end - p.first)
        at = np.flatnonzero(alone)
        while len(at):
            begins[at] = True
            to = p.after[at]
            to = to[to < begin_of_key[at]]
            at = np.unique(to[~begins[to]])
        start = np.flatnonzero(begins[:size])
        rows = []
        if entry:  # what belongs to the window from before
            rows.append((p.k[:1], np.array([anchor]), p.t[entry - 1 : entry], p.n[:entry].sum(keepdims=True)))
        if len(start):
            end = np.append(start[1:], size)
            rows.append((p.k[start], p.t[start], p.t[end - 1], np.add.reduceat(p.n, start)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _WINDOWS.split(", ")])

    return run


def anchored_windows(df: DataFrame, key: str, ms: str, size_ms: int, drop_open: int | None = None) -> DataFrame:
    """(key, window_start, last_ms, events): windows that begin at a key's first event and hold all up to size_ms later.

    Where a window begins depends on where the one before it ended. Events are counted per key and millisecond and range-partitioned by
    (key, ms), so a hot key lies in many partitions. Each tells, for its first key, which begin of its first window leads to which begin of its
    last one (few rows, as windows soon fall into step); these steps are followed per key, and with the window open at its
    begin every partition makes its windows by itself. Rows without key or time are left out; an empty table gives an empty result.
    """
    counted = df.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).groupBy(F.col(key).cast("long").alias("k"), F.col(ms).alias("t")).count()
    ordered = cut_lineage(counted.repartitionByRange("k", "t").sortWithinPartitions("k", "t"))  # both passes must see the same partitions
    edges = ordered.mapInArrow(_edges(size_ms), "k bigint, part bigint, upto_ms bigint, exit_ms bigint")
    opened = edges.repartition("k").sortWithinPartitions("k", "part", "upto_ms").mapInArrow(_open_before(size_ms), "part bigint, anchor bigint")
    sent = df.sparkSession.sparkContext.broadcast({r["part"]: r["anchor"] for r in opened.collect()})  # no more than one for each partition
    parts = ordered.mapInArrow(_parts_of_windows(size_ms, lambda: sent.value), _WINDOWS)
    out = parts.groupBy(F.col("k").alias(key), "window_start").agg(F.max("last_ms").alias("last_ms"), F.sum("events").alias("events"))
    return out if drop_open is None else out.where(F.col("window_start") + size_ms < drop_open)


def row_windows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df with window_number: the first ``rows`` rows by order are window 0, the next 1, and so on.

    Rows are range-partitioned and numbered within partitions; only the partitions' sizes reach the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted(placed.groupBy("__part").count().collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    told = placed.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")), "__part")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return told.withColumn("window_number", floor_div(within + F.col("__before"), rows)).drop("__at", "__part", "__before")
