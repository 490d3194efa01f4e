"""Sessions separated by pauses, from a Cartesian tree over each entity's consecutive gaps.

The tree's node for a gap spans the longest run of events around it in which no gap is larger; events are its leaves
(gap -1). A node's parent is the next larger gap beside its run, so the sessions for any threshold are the nodes
with ``gap <= threshold < parent_gap``: one filter, whatever the threshold.

Events are range-partitioned by (entity, time, record), so partitions are even however skewed entities are, and an
entity lies in neighbouring partitions. Each partition folds its sorted events once with a stack. Only the first
and the last entity of a partition can reach into another one; of these a partition hands on its open chain: the runs
between gaps whose neighbours it can't see. The gaps of a chain rise and then fall, so over a time span of s ms
it has at most 2 * sqrt(2 * s) runs. Chains are folded by the same code, per entity, in a second and much smaller step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INF = 2**62
_TREE = "entity bigint, gap bigint, parent_gap bigint, start_ms bigint, end_ms bigint, events bigint"
_CHAIN = "entity bigint, gap bigint, start_ms bigint, end_ms bigint, events bigint"


class _Fold:
    """The stack of one entity. Runs are [gap inside, start, end, events]; before[i] is the gap in front of runs[i]."""

    def __init__(self, emit: Callable, open_left: bool) -> None:
        self.emit, self.runs, self.before = emit, [], []
        self.first = -1 if open_left else _INF  # what stands before the first run: unknown, or nothing

    def _settle(self, gap: int) -> None:
        """Join runs over gaps that are no larger than both of their neighbours."""
        runs, before, emit = self.runs, self.before, self.emit
        while len(runs) > 1 and before[-1] <= gap and before[-2] >= before[-1]:
            inner = before.pop()
            right, left = runs.pop(), runs[-1]
            emit(left, inner)
            emit(right, inner)
            # chains for given thresholds may hold larger gaps than lie between them
            runs[-1] = [max(inner, left[0], right[0]), left[1], right[2], left[3] + right[3]]

    def add(self, run: list[int]) -> None:
        runs = self.runs
        if runs:
            gap = run[1] - runs[-1][2]
            if len(runs) > 1 and self.before[-1] <= gap:
                self._settle(gap)
            self.before.append(gap)
        else:
            self.before.append(self.first)
        runs.append(run)

    def close(self) -> list[list[int]]:
        """No event follows. What is left open to the left is returned; a fold closed on both sides ends in its root."""
        self._settle(_INF)
        if self.first == _INF and self.runs:
            self.emit(self.runs[0], _INF)
            return []
        return self.runs


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


class _Nodes:
    """Collects emitted nodes, or with cuts only those that are sessions for one of them."""

    def __init__(self, cuts: Sequence[int] | None) -> None:
        self.cuts, self.rows, self.entity = cuts, [], 0

    def __call__(self, run: list[int], parent: int) -> None:
        if self.cuts is None or any(run[0] <= c < parent for c in self.cuts):
            self.rows.append((self.entity, run[0], parent, run[1], run[2], run[3]))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _TREE.split(", ")])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entity, ms) of sorted (entity, ms, record) without copies of a record."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, ms, record = _columns(batch)
        fresh = np.ones(len(entity), bool)
        fresh[1:] = (entity[1:] != entity[:-1]) | (ms[1:] != ms[:-1]) | (record[1:] != record[:-1])
        fresh[0] = last != (entity[0], ms[0], record[0])
        last = (entity[-1], ms[-1], record[-1])
        if fresh.any():
            yield entity[fresh], ms[fresh]


def _closed_nodes(cuts: Sequence[int] | None) -> Callable:
    """First step: the nodes that are final within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, fold, at = _Nodes(cuts), None, None
        for entity, ms in _distinct(batches):
            for e, t in zip(entity.tolist(), ms.tolist(), strict=True):
                if e != at:
                    if fold is not None:
                        fold.close()
                    fold = _Fold(nodes, open_left=at is None)
                    at = nodes.entity = e
                fold.add([-1, t, t, 1])
            if nodes.rows:
                yield nodes.take()
        # the last entity stays open to the right: nothing is closed here

    return run


def _open_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First step: the open chains of a partition's first and last entity."""
    ignore = _Nodes(())
    chains: list[tuple[int, list[list[int]]]] = []
    fold, at, first = None, None, True
    for entity, ms in _distinct(batches):
        tail = int(np.flatnonzero(entity != entity[-1])[-1]) + 1 if entity[0] != entity[-1] else 0
        head = int(np.searchsorted(entity, at, side="right")) if at is not None else 0
        if at is None:
            at, head = int(entity[0]), int(np.searchsorted(entity, entity[0], side="right"))
            fold = _Fold(ignore, open_left=True)
        for t in ms[:head].tolist():
            fold.add([-1, t, t, 1])
        if entity[-1] != at:
            if first:
                chains.append((at, fold.close()))
                first = False
            at, fold = int(entity[-1]), _Fold(ignore, open_left=False)
            for t in ms[tail:].tolist():
                fold.add([-1, t, t, 1])
    if fold is not None:
        chains.append((at, fold.runs))
    rows = [(e, *run) for e, runs in chains for run in runs]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _CHAIN.split(", ")])


class _Part:
    """The sorted events of a partition without copies, as arrays. Gap i lies between events i and i + 1; between entities it is _INF.

    ends: the gaps at which the open chains of the first and the last entity are cut, for the given thresholds.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], cuts: Sequence[int]) -> None:
        held = list(_distinct(batches))
        self.entity = np.concatenate([e for e, _ in held]) if held else np.zeros(0, np.int64)
        self.ms = np.concatenate([t for _, t in held]) if held else np.zeros(0, np.int64)
        self.cuts = sorted(set(cuts))
        e, n = self.entity, len(self.entity)
        self.gap = np.where(e[1:] == e[:-1], self.ms[1:] - self.ms[:-1], _INF)
        # the first entity's events end before head, the last one's begin at tail
        self.head = int(np.searchsorted(e, e[0], "right")) if n else 0
        self.tail = int(np.searchsorted(e, e[-1], "left")) if n else 0
        ends = []
        if n:
            ends.append(self._records(self.gap[: self.head - 1], 0))
            ends.append(n - 2 - self._records(self.gap[self.tail :][::-1], 0))
        self.ends = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)

    def _records(self, gaps: np.ndarray, at: int) -> np.ndarray:
        """Gaps larger than all before them, from the least threshold on up to the first beyond the largest."""
        if not len(gaps) or not self.cuts:
            return np.zeros(0, np.int64)
        most = np.maximum.accumulate(gaps)
        fresh = np.append(True, most[1:] > most[:-1]) & (gaps > self.cuts[0])
        beyond = int(np.searchsorted(most, self.cuts[-1], "right"))
        return np.flatnonzero(fresh[: beyond + 1]) + at

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Columns (entity, gap inside, start, end, events) of the runs from events first to last."""
        inner = np.full(len(first), -1, np.int64)
        long = np.flatnonzero(last > first)
        if len(long):
            # reduceat takes pairs (from, to) of gaps; every second result lies between runs
            bounds = np.stack([first[long], last[long]], axis=1).ravel()
            inner[long] = np.maximum.reduceat(np.append(self.gap, -1), bounds)[::2]
        return np.stack([self.entity[first], inner, self.ms[first], self.ms[last], last - first + 1])


def _cut_nodes(cuts: Sequence[int]) -> Callable:
    """First step for given thresholds: the sessions that are final within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = _Part(batches, cuts), -2
        n = len(part.ms)
        in_chain = np.zeros(n + 1, bool)
        in_chain[part.ends] = True
        # a chain also ends where its entity does
        closed = np.zeros(n + 1, bool)
        if n:
            closed[[part.head - 1, part.tail - 1]] = True
        for c in part.cuts:
            edge = np.flatnonzero(part.gap > c)
            first, last = edge[:-1] + 1, edge[1:]  # neither the run that begins nor the one that ends the partition
            left, right = part.gap[edge[:-1]], part.gap[edge[1:]]
            rows = part.runs(first, last)
            mine = (last < part.head) | (first >= part.tail)
            chain = mine & (in_chain | closed)[edge[:-1]] & (in_chain | closed)[edge[1:]]
            ok = ~chain & (rows[1] > before)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (rows[0], rows[1], np.minimum(left, right), rows[2], rows[3], rows[4])], names=[x.split()[0] for x in _TREE.split(", ")])
            before = c

    return run


def _cut_chains(cuts: Sequence[int]) -> Callable:
    """First step for given thresholds: the open chains of a partition's first and last entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(batches, cuts)
        n = len(part.ms)
        if not n:
            return
        spans = [(0, part.head)] if part.tail == 0 else [(0, part.head), (part.tail, n)]
        for low, high in spans:
            inside = part.ends[(part.ends >= low) & (part.ends < high - 1)]
            first, last = np.append(low, inside + 1), np.append(inside, high - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part.runs(first, last)], names=[x.split()[0] for x in _CHAIN.split(", ")])

    return run


def _joined_chains(cuts: Sequence[int] | None) -> Callable:
    """Second step: chains sorted by (entity, start, end) folded to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, fold, at = _Nodes(cuts), None, None
        for batch in batches:
            for e, *run in zip(*(c.tolist() for c in _columns(batch)), strict=True):
                if e != at:
                    if fold is not None:
                        fold.close()
                    fold, at = _Fold(nodes, open_left=False), e
                    nodes.entity = e
                fold.add(run)
            if nodes.rows:
                yield nodes.take()
        if fold is not None:
            fold.close()
        yield nodes.take()

    return run


def gap_tree(events: DataFrame, cuts: Sequence[int] | None = None) -> DataFrame:
    """The gap tree of events(entity bigint, ms bigint, record bigint): (entity, gap, parent_gap, start_ms, end_ms, events).

    Copies of a record (equal in all three columns) count once; a null record is a value like any other. Rows without
    entity or time are left out; other columns are ignored; an empty table gives an empty tree. An only event has
    the single node (gap -1, parent_gap 2**62). Events at one time are 0 ms apart.

    With cuts, only nodes that are sessions for one of these thresholds are made.
    """
    rows = events.where("entity IS NOT NULL AND ms IS NOT NULL").select("entity", "ms", F.coalesce("record", F.lit(-_INF)).alias("record"))
    ordered = rows.repartitionByRange("entity", "ms", "record").sortWithinPartitions("entity", "ms", "record")
    inside = ordered.mapInArrow(_closed_nodes(None) if cuts is None else _cut_nodes(cuts), _TREE)
    chains = ordered.mapInArrow(_open_chains if cuts is None else _cut_chains(cuts), _CHAIN).repartition("entity").sortWithinPartitions("entity", "start_ms", "end_ms")
    return inside.unionByName(chains.mapInArrow(_joined_chains(cuts), _TREE))


def cut(tree: DataFrame, threshold_ms: int) -> DataFrame:
    """Sessions of a gap tree: (entity, start_ms, end_ms, duration_ms, events). Events at most threshold_ms apart share one."""
    node = tree.where((F.col("gap") <= threshold_ms) & (F.col("parent_gap") > threshold_ms))
    return node.select("entity", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "events")
