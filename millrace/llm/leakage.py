"""Evaluation texts leaking into training texts.

Texts become words. Every window of ``window`` words of an item is looked for among the windows of all documents:

1. Lossless screen: a window within ``edits`` word edits of an item's window has at most ``edits`` words outside the
   items' vocabulary; a running count leaves only such windows. Of equal windows, of a document as of the items, one goes on.
2. CGK embedding: a random walk over a window writes one word per step and moves on or stays by a random bit of that word and
   step. Windows at edit distance k come out at Hamming distance O(k * k) with high probability, equal ones equal.
3. Bit-sampling LSH: each repetition makes a walk of its own and compares hashes of a few sampled steps. The number of
   repetitions follows from the target recall; for equal windows one is enough.
4. Exact verification of every candidate: equality for no edits, else the least edit distance of the item's window to the
   spans of ``window - edits`` to ``window + edits`` words that begin at the document's, so a dropped or inserted word costs one.

Items whose texts are seen to be small become an index that goes to every task, and documents aren't shuffled. Items of any
other size become a table of signatures, which is joined with the documents' signatures that pass filters of a fixed size.
Either way documents are read once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import Words, mixed, words_of

WINDOW = 20
#: Where repetitions_for gives up and says so.
MOST_REPETITIONS = 400
#: Candidates that are worked on at once.
_PAIRS = 500_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """window: words of a passage; edits: word edits allowed in it; recall: target for passages with that many edits.

    samples: steps compared in one repetition. The number of repetitions is the least that reaches the recall on made-up
    windows with that many edits (see :func:`repetitions_for`).
    """

    window: int = WINDOW
    edits: int = 0
    recall: float = 0.99
    samples: int = 6
    seed: int = 11

    @property
    def steps(self) -> int:
        return 3 * self.window

    @property
    def repetitions(self) -> int:
        return repetitions_for(self) if self.edits else 1


def _walk(code: np.ndarray, bits: np.ndarray, starts: np.ndarray, end: np.ndarray, sampled: list[int]) -> np.ndarray:
    """Hashes of the sampled steps of the walks over windows from starts to end. Behind its window a walk writes a pad.

    code and bits have one entry more than there are words: the pad's.
    """
    at, pad = starts.copy(), len(code) - 1
    out = np.zeros(len(starts), np.uint64)
    for step in range(sampled[-1] + 1):
        inside = at < end
        here = np.where(inside, at, pad)
        if step in sampled:
            out = mixed(out * _GOLDEN + code[here] + np.uint64(step + 1))
        at = at + (inside & ((bits[here] >> np.uint64(step % 64)) & np.uint64(1)).astype(bool))
    return out


class Embedding:
    """One random walk and one sample of its steps for each repetition; every process makes the same from the seed."""

    def __init__(self, settings: Settings, repetitions: int | None = None) -> None:
        rng = np.random.default_rng(settings.seed)
        self.s = settings
        # equal windows agree in every step, so without edits the walk may stop early
        steps = settings.steps if settings.edits else settings.window
        n = settings.repetitions if repetitions is None else repetitions
        self.each = [(rng.integers(1, 2**63, dtype=np.uint64), sorted(rng.choice(steps, settings.samples, replace=False).tolist())) for _ in range(n)]

    def signatures(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """For each repetition, hashes of the windows of words, given by their numbers, at starts; ends tells where they end if some are shorter."""
        ends = starts + self.s.window if ends is None else ends
        code = np.append(mixed((ids + 2).astype(np.uint64) * _GOLDEN), np.uint64(0))
        for salt, sampled in self.each:
            bits = mixed(code ^ salt)
            yield _walk(code, bits, starts, ends, sampled)


@functools.lru_cache
def repetitions_for(s: Settings, pairs: int = 400, walks: int = 200) -> int:
    """The least number of repetitions that finds a share s.recall of windows with s.edits words changed, dropped or put in.

    How often walks over a window and its edited copy agree in the sample depends on where the edits are, so it is measured for
    every pair over many walks.
    """
    rng = np.random.default_rng(s.seed + 1)
    one = np.arange(pairs * s.window).reshape(pairs, s.window)
    two = []
    for row in one:
        words = row.tolist()
        for _ in range(s.edits):
            at, fresh = int(rng.integers(0, len(words))), int(rng.integers(10**6, 10**9))
            kind = rng.integers(0, 3)
            words[at : at + (kind != 2)] = [] if kind == 1 else [fresh]
        two.append((words + rng.integers(10**6, 10**9, s.window).tolist())[: s.window])
    starts = np.arange(pairs) * s.window
    embedding = Embedding(s, walks)
    a, b = embedding.signatures(one.ravel(), starts), embedding.signatures(np.array(two).ravel(), starts)
    hit = np.mean([x == y for x, y in zip(a, b, strict=True)], axis=0)
    for n in range(1, MOST_REPETITIONS + 1):
        if np.mean(1 - (1 - hit) ** n) >= s.recall:
            return n
    raise ValueError(f"more than {MOST_REPETITIONS} repetitions needed for a recall of {s.recall} at {s.edits} edits; take fewer samples")


def within_edits(a: np.ndarray, b: np.ndarray, most: int, free_end: bool = False) -> np.ndarray:
    """Whether rows of a and b, words of equal length, are at most ``most`` word edits apart; a negative word equals none.

    With free_end, b has ``most`` words more, and a is held against each of its beginnings; behind the end of a text b
    has negative words, which never bring a closer. A band of the distance table, 2 * most + 1 wide, for all rows at once.
    """
    n, width, size = len(a), 2 * most + 1, a.shape[1]
    far = most + 1
    row = np.full((n, width), far, np.int64)  # row[:, d] is the cell (i, i + d - most)
    for d in range(most, width):
        row[:, d] = d - most
    for i in range(1, size + 1):
        new = np.full((n, width), far, np.int64)
        for d in range(width):
            j = i + d - most
            if not 0 <= j <= b.shape[1]:
                continue
            best = row[:, d + 1] + 1 if d + 1 < width else np.full(n, far)
            if j == 0:
                new[:, d] = np.minimum(best, i)
                continue
            x, y = a[:, i - 1], b[:, j - 1]
            best = np.minimum(best, row[:, d] + ((x != y) | (x < 0)))
            if d:
                best = np.minimum(best, new[:, d - 1] + 1)
            new[:, d] = np.minimum(best, far)
        row = new
    return (row.min(axis=1) if free_end else row[:, most]) <= most


def _numbers(words: Words) -> np.ndarray:
    """A number that isn't negative for each word: the same everywhere for the same word."""
    return (words.hashes >> np.uint64(1)).astype(np.int64)


def _bodies(numbers: np.ndarray, starts: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """The size words from each of starts on, -1 from stop on."""
    at = starts[:, None] + np.arange(size)
    return np.where(at < stop[:, None], numbers[np.minimum(at, max(len(numbers) - 1, 0))], -1)


def _prints(bodies: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    out = np.zeros(len(bodies), np.uint64)
    for column in bodies.T:
        out = mixed(out * _GOLDEN + column.astype(np.uint64))
    return out


def _near(items: np.ndarray, spans: np.ndarray, edits: int) -> np.ndarray:
    """Whether an item's window (a row of items) is near the row of spans, its words and edits more."""
    return within_edits(items, spans, edits, free_end=True) if edits else (items == spans).all(axis=1)


class Windows:
    """The different windows of texts that may lie near an item's, those of each text: text, words (edits more than a window), where they begin and end."""

    def __init__(self, words: Words, settings: Settings, known: Callable[[np.ndarray], np.ndarray]) -> None:
        s, self.numbers = settings, _numbers(words)
        # a passage that lost words may end its text, so windows there may be shorter
        starts, stop = _windows(words.text, s.window - s.edits), np.cumsum(words.counts)
        ends = np.minimum(starts + s.window, stop[words.text[starts]])
        outside = np.concatenate(([0], np.cumsum(~known(words.hashes))))
        likely = outside[ends] - outside[starts] <= s.edits
        starts = starts[likely]
        bodies = _bodies(self.numbers, starts, stop[words.text[starts]], s.window + s.edits)
        _, one = np.unique(mixed(_prints(bodies) ^ mixed(words.text[starts].astype(np.uint64))), return_index=True)
        self.text, self.bodies, self.starts, self.ends = words.text[starts[one]], bodies[one], starts[one], ends[likely][one]


class Index:
    """Items in memory: their vocabulary, different windows, whose they are, and signatures."""

    def __init__(self, items: list[tuple[int, bytes]], settings: Settings) -> None:
        self.s, self.embedding = settings, Embedding(settings)
        words = words_of(pa.array([text for _, text in items], pa.binary()))
        self.vocabulary = np.unique(words.hashes)
        numbers, starts = _numbers(words), _windows(words.text, settings.window)
        bodies = _bodies(numbers, starts, starts + settings.window, settings.window)
        _, one, which = np.unique(_prints(bodies), return_index=True, return_inverse=True)
        self.bodies = bodies[one]
        owner = np.array([item for item, _ in items], np.int64)[words.text[starts]]
        pairs = np.unique(np.stack([which, owner], axis=1), axis=0)
        self.owner, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        self.table = []
        for signature in self.embedding.signatures(numbers, starts[one]):
            order = np.argsort(signature, kind="stable")
            self.table.append((signature[order], order))

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), bool)
        return self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)] == hashes

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in column, item) of every text with a window near one of an item's."""
        mine = Windows(words_of(column), self.s, self._known)
        found = np.zeros((0, 2), np.int64)
        for signature, (keys, order) in zip(self.embedding.signatures(mine.numbers, mine.starts, mine.ends), self.table, strict=True):
            lo, hi = np.searchsorted(keys, signature, "left"), np.searchsorted(keys, signature, "right")
            hit = np.flatnonzero(hi > lo)
            many = (hi - lo)[hit]
            last = np.cumsum(many)
            at = 0
            while at < len(hit):  # pairs of different windows, in slices of bounded size
                upto = max(at + 1, int(np.searchsorted(last, last[at] - many[at] + _PAIRS)))
                n = many[at:upto]
                d = np.repeat(hit[at:upto], n)
                w = order[np.repeat(lo[hit[at:upto]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                near = _near(self.bodies[w], mine.bodies[d], self.s.edits)
                d, w = d[near], w[near]
                owners = (self.first[w + 1] - self.first[w]).astype(np.int64)
                theirs = self.owner[np.repeat(self.first[w], owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)]
                found = np.unique(np.concatenate([found, np.stack([mine.text[np.repeat(d, owners)], theirs], axis=1)]), axis=0)
                at = upto
        return found[:, 0], found[:, 1]


def _windows(text: np.ndarray, size: int) -> np.ndarray:
    """Where windows of size words of one text begin."""
    if len(text) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1])


def _scan(index_of: Callable[[], Index]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place, item = index.search(part.column(1))
                if len(place):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place)), pa.array(item, pa.int64())], names=["doc_id", "item_id"])

    return run


#: Bits of the filters of words and signatures; bounds what is broadcast to a quarter of a byte for each.
FILTER_BITS = 1 << 27


class _Filter:
    """A bitmap of hashes: tells surely which hashes aren't in a set."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))
        return (self.bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame) -> _Filter:
        """Of hashes(h), put together where they are; FILTER_BITS / 64 rows at most reach the driver."""
        cell = F.shiftrightunsigned("h", 64 - (FILTER_BITS.bit_length() - 1))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        got = hashes.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        return cls(bits)


def _rows(columns: list[pa.Array], bodies: np.ndarray, names: list[str]) -> pa.RecordBatch:
    body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bodies.shape[1] * 8), len(bodies), [None, pa.py_buffer(np.ascontiguousarray(bodies))])
    return pa.RecordBatch.from_arrays([*columns, body.cast(pa.binary())], names=names)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(words_of(batch.column(1)).hashes).view(np.int64))], names=["h"])


def _item_windows(settings: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = Embedding(settings)
        for batch in batches:
            words = words_of(batch.column(1))
            numbers, starts = _numbers(words), _windows(words.text, settings.window)
            bodies = _bodies(numbers, starts, starts + settings.window, settings.window)
            owner = batch.column(0).take(pa.array(words.text[starts]))
            for r, signature in enumerate(embedding.signatures(numbers, starts)):
                key = mixed(signature + np.uint64(r) * _GOLDEN)
                yield _rows([pa.array(key.view(np.int64)), owner], bodies, ["h", "item_id", "item"])

    return run


def _document_windows(settings: Settings, filters: Callable[[], tuple[_Filter, _Filter]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding, (words, signatures) = Embedding(settings), filters()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                mine = Windows(words_of(part.column(1)), settings, words)
                for r, signature in enumerate(embedding.signatures(mine.numbers, mine.starts, mine.ends)):
                    key = mixed(signature + np.uint64(r) * _GOLDEN)
                    on = np.flatnonzero(signatures(key))
                    if len(on):
                        yield _rows([pa.array(key[on].view(np.int64)), part.column(0).take(pa.array(mine.text[on]))], mine.bodies[on], ["h", "doc_id", "span"])

    return run


def _verified(settings: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = settings.window
            spans, items = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(batch.num_rows, n) for c, n in ((2, size + settings.edits), (3, size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_id", "item_id"]).filter(pa.array(_near(items, spans, settings.edits)))

    return run


def _joined(docs: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """Leaks by a join of signature tables, for items of any number."""
    context = docs.sparkSession.sparkContext
    windows = held.mapInArrow(_item_windows(settings), "h bigint, item_id bigint, item binary").distinct()
    sent = context.broadcast((_Filter.of(held.mapInArrow(_vocabulary, "h bigint")).bits, _Filter.of(windows.select("h")).bits))
    spans = docs.mapInArrow(_document_windows(settings, lambda: tuple(_Filter(b) for b in sent.value)), "h bigint, doc_id bigint, span binary")
    pairs = spans.join(windows, "h").select("doc_id", "item_id", "span", "item")
    return pairs.mapInArrow(_verified(settings), "doc_id bigint, item_id bigint").distinct()


def leaks(documents: DataFrame, items: DataFrame, settings: Settings | None = None, index_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id), all different: documents(doc_id, text) that hold a passage of items(item_id, text).

    Null texts, items with fewer words than a window, documents with fewer than a window less the edits, and empty tables give no rows; whole texts are searched, however
    long. An item_id with several texts leaks if one of them does. Items with no more than index_bytes of text are read by the
    driver and sent to the tasks as an index; others aren't, but are joined by signature. Results are the same.
    """
    settings = settings or Settings()
    settings.repetitions  # fails here if the recall can't be reached  # noqa: B018
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    if (held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > index_bytes:
        return _joined(docs, held, settings)
    rows = [(r["item_id"], bytes(r["text"])) for r in held.collect()]
    if not rows:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    sent = documents.sparkSession.sparkContext.broadcast(rows)
    return docs.mapInArrow(_scan(lambda: Index(sent.value, settings)), "doc_id bigint, item_id bigint").distinct()
