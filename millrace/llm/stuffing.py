"""Keyword-stuffed and link-list pages: incoherent word salad and excessively repeated collocations.

Neighbouring words are judged by their pointwise mutual information in the whole corpus. That two words of one subject
stand side by side says nothing about their order, however many pages on that subject there are; so of a pair's PMI that of
the pair turned round is taken away, and what is left, its bond, is near 0 in salad and high in sentences and statements. Three passes:

1. Families of near-copies. Each text gives SKETCHES minimum hashes of its shingles of five words; two texts that share at least 80 % of
   these agree in two of four with a probability of 97 %. A family is as large as the second most frequent of a text's sketches,
   and its texts count for one by that, so a family counts about once.
2. Corpus counts of words and pairs, exact, added up by hash; kept if they make up one of SUPPORT words, so there are at
   most SUPPORT of each, whatever the corpus.
3. Judgement. A line's plain words are a sentence if enough of its pairs have a bond beyond that which the text itself makes. A word is repeated
   excessively if it, or a collocation with a neighbour, returns within the text. Spam are repeated words, salad (longer
   lines almost without a bond), entries of links and tags without a sentence about them. A text is spam if these are more
   than half of its words and hardly any lines are code or data (:mod:`millrace.llm.pages` tells these by what stands between words).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pages import Lines, line_of, lines_of, neighbours
from millrace.llm.words import Words, mixed, words_of
from millrace.session import cut_lineage

SKETCHES = 4
SHINGLE = 5
#: One of so many words (pairs) is the least share of the corpus that is kept; bounds what is broadcast to 16 bytes for each.
SUPPORT = 1 << 20
#: The least bond of a pair that ties (natural logarithm), and the share of a line's pairs that makes it a sentence, or keeps it from being salad.
BOND = 1.0
SENTENCE, SALAD = 0.3, 0.1
#: The fewest words of a line that is a sentence, or salad.
SENTENCE_WORDS, SALAD_WORDS = 4, 5
#: Salad's words, unlike those of a language, hardly come twice: fewer than this share of a text's plain words, of which there must be enough to tell.
#: Or they stand in entries, at least this share of a line's neighbours being parted by more than blanks, around a word in excess.
TWICE, ENOUGH, PARTED = 0.2, 40, 1 / 3
#: How often a word, or a pair, of a text returns in excess.
WORD_RETURNS, PAIR_RETURNS = 4, 3
#: A word returns in excess if its share of the text is so many times that of the corpus.
EXCESS = 10
#: Counts that a task holds before it hands on their sums.
_HELD = 8_000_000
_ROWS = 1024
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _GOLDEN)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of words."""
    return mixed(left * _GOLDEN + (right ^ (right >> np.uint64(29))))


def sketches(w: Words) -> np.ndarray:
    """SKETCHES minimum hashes of each text's shingles; a text of fewer words is one shingle. One row per text."""
    n, size = len(w.counts), len(w.hashes)
    rolling = np.zeros(size, np.uint64)
    for i in range(min(SHINGLE, size)):  # a text's last words make shorter shingles
        inside = np.zeros(size, bool)
        inside[: size - i] = w.text[i:] == w.text[: size - i]
        rolling[inside] = rolling[inside] * _GOLDEN + w.hashes[np.flatnonzero(inside) + i]
    position = np.arange(size) - (np.cumsum(w.counts) - w.counts)[w.text]
    whole = (position + SHINGLE <= w.counts[w.text]) | (position == 0)
    rolling, text = rolling[whole], w.text[whole]
    out = np.zeros((n, SKETCHES), np.uint64)
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    for k, salt in enumerate(_SALTS):
        if len(begin):
            out[text[begin], k] = np.minimum.reduceat(mixed(rolling ^ salt), begin)
    return out


@dataclass
class Table:
    """Sorted 64-bit hashes and a number for each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of hashes, 0 for unknown ones."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(len(hashes))
        order = np.argsort(hashes)  # searching in order is much faster than at random
        at = np.minimum(np.searchsorted(self.keys, hashes[order]), len(self.keys) - 1)
        out = np.empty(len(hashes))
        out[order] = np.where(self.keys[at] == hashes[order], self.values[at], 0.0)
        return out


@dataclass
class Corpus:
    """families: sizes of families by sketch. words, pairs: weighted counts. n: words of the corpus, each family counted once; least: the least count that is kept."""

    families: Table
    words: Table
    pairs: Table
    n: float = 0.0
    least: float = 1.0

    def weight(self, w: Words) -> np.ndarray:
        """What a word of each text counts: one by the size of its family, the second largest group of texts with which it shares a sketch."""
        return 1 / np.maximum(np.sort(self.families.get(sketches(w).ravel()).reshape(-1, SKETCHES), axis=1)[:, -2], 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and their summed counts; a hash may come twice, once from counts of 1 and once from others."""
    one = counts == 1
    keys, n = np.unique(hashes[one], return_counts=True)
    if one.all():
        return keys, n.astype(float)
    others, back = np.unique(hashes[~one], return_inverse=True)
    return np.append(keys, others), np.append(n, np.bincount(back, counts[~one], len(others)))


def _summed(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    """One or two rows per kind and hash, of parts by kind."""
    kinds, keys, counts = [np.zeros(0, np.int8)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for kind, parts in held.items():
        h, n = _added(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        kinds.append(np.full(len(h), kind, np.int8))
        keys.append(h)
        counts.append(n)
    columns = [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "h", "n"])


_COUNTS = "kind tinyint, h bigint, n double"


def _partial(parts: Callable[[Words], list[tuple[int, np.ndarray, np.ndarray]]]) -> Callable:
    """A task that adds up what parts(words) gives: (kind, hashes, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for part in _slices(batches):
            for kind, hashes, counts in parts(words_of(part.column(0), wide=True)):
                held.setdefault(kind, []).append((hashes, counts))
                size += len(hashes)
            if size > _HELD:
                yield _summed(held)
                held, size = {}, 0
        if held:
            yield _summed(held)

    return run


def _sketch_counts(w: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
    there = w.counts > 0
    hashes = sketches(w)[there].ravel()
    return [(0, hashes, np.ones(len(hashes))), (1, np.zeros(1, np.uint64), np.array([float(len(w.hashes))]))]


def word_and_pair_counts(w: Words, weight: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(0, hashes of words, counts), (1, hashes of pairs of neighbours, counts)."""
    at = neighbours(line_of(w)) if len(w.hashes) else np.zeros(0, np.int64)
    out = []
    for kind, text, hashes in ((0, w.text, w.hashes), (1, w.text[at], pair_hashes(w.hashes[at], w.hashes[at + 1]))):
        one, often = _per_text(text, hashes)
        out.append((kind, hashes[one], damped(often) * weight[text[one]]))
    return out


def _table(rows: DataFrame) -> Table:
    """rows(h, n) at the driver; the caller bounds their number."""
    got = rows.select("h", "n").toArrow()
    return Table.of(got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(float))


def corpus_counts(texts: DataFrame, support: int = SUPPORT) -> Corpus:
    """Counts over all rows of texts(text binary).

    Families smaller than one of support words can't by themselves lift a pair of theirs to where it is kept, so they needn't be
    known; the others are fewer than SKETCHES * support.
    """
    spark = texts.sparkSession
    seen = cut_lineage(texts.mapInArrow(_partial(_sketch_counts), _COUNTS).groupBy("kind", "h").agg(F.sum("n").alias("n")).where("n > 1 OR kind = 1"))
    total = seen.where("kind = 1").agg(F.sum("n")).first()[0] or 0.0
    least = max(2.0, total / support)
    corpus = Corpus(_table(seen.where(f"kind = 0 AND n >= {least}")), Table.of(*_NOTHING), Table.of(*_NOTHING), least=max(1.0, total / support))
    sent = spark.sparkContext.broadcast((corpus.families.keys, corpus.families.values))

    def parts(w: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        weight = Corpus(Table(*sent.value), Table(*_NOTHING), Table(*_NOTHING)).weight(w)
        counts = word_and_pair_counts(w, weight)
        return [*counts, (2, np.zeros(1, np.uint64), np.array([counts[0][2].sum()]))]

    counts = texts.mapInArrow(_partial(parts), _COUNTS).groupBy("kind", "h").agg(F.sum("n").alias("n")).where(f"n >= {max(1.5, corpus.least)} OR kind = 2")
    counts = cut_lineage(counts)
    corpus.words, corpus.pairs = _table(counts.where("kind = 0")), _table(counts.where("kind = 1"))
    corpus.n = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0.0
    return corpus


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0))


def _runs(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal hashes of a text together, and where its runs of these begin."""
    keys = mixed(hashes + text.astype(np.uint64) * _GOLDEN)
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _per_text(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different hash of each text, and how often it occurs there."""
    order, begin = _runs(text, hashes)
    return order[begin], np.diff(np.append(begin, len(order)))


def _in_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each hash occurs in its own text."""
    order, begin = _runs(text, hashes)
    size = np.diff(np.append(begin, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(size, size)
    return out


def damped(often: np.ndarray) -> np.ndarray:
    """What a word counts that occurs so often in a text: less each time, or one huge text would make the corpus its own."""
    return np.log2(1.0 + often)


def bonds(w: Words, at: np.ndarray, weight: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bond, PMI) of the pairs that begin at words at, and which words return in their text in excess, by the corpus without the text itself.

    A text takes away what it gave, and a family counts once, so none vouches for itself. Pairs that the corpus doesn't know have 0.
    """
    text, left, right = w.text[at], w.hashes[at], w.hashes[at + 1]
    ahead, back = pair_hashes(left, right), pair_hashes(right, left)
    own = weight[text]
    both = _in_text(np.concatenate([text, text]), np.concatenate([ahead, back]))
    own_ahead = _in_text(text, ahead)
    n_ahead = np.maximum(corpus.pairs.get(ahead) - damped(own_ahead) * own, 0)
    n_back = np.maximum(corpus.pairs.get(back) - damped(both[len(text) :] - _in_text(text, back)) * own, 0)
    often = _in_text(w.text, w.hashes)
    words = np.maximum(corpus.words.get(w.hashes) - damped(often) * weight[w.text], 0)
    excess = (often >= WORD_RETURNS) & (often * corpus.n >= EXCESS * words * w.counts[w.text])
    least = corpus.least
    pmi = np.log((n_ahead + 1e-9) * corpus.n / (np.maximum(words[at], least) * np.maximum(words[at + 1], least)) + 1e-9)
    known = n_ahead >= least
    bond = np.where(known, np.log((n_ahead + least) / (n_back + least)), 0.0)
    return np.where(known & (pmi > 0), np.minimum(bond, pmi), 0.0), np.where(known, np.maximum(pmi, 0), 0.0), excess


@dataclass
class Judged:
    """Per text: all its words; those of links, tags, repetitions, salad, code or data, and sentences; the mean PMI and bond of its pairs."""

    words: np.ndarray
    links: np.ndarray
    tags: np.ndarray
    repeated: np.ndarray
    salad: np.ndarray
    code: np.ndarray
    sentences: np.ndarray
    pmi: np.ndarray
    bond: np.ndarray

    @property
    def spam(self) -> np.ndarray:
        """More than half of the words are links, tags, repetitions or salad, and fewer than a fifth code or data."""
        return (2 * (self.links + self.tags + self.repeated + self.salad) > self.words) & (5 * self.code < self.words)


def _ties(p: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line: its words that are plain, those of them that are numbers, neighbours tied hard, and whether it is code or data by that alone."""
    lines, plain = len(p.text), ~(p.link | p.markup)
    rest, numbers = np.bincount(p.line, plain, lines), np.bincount(p.line, plain & p.number, lines)
    pairs, hard = np.bincount(p.line[p.pairs], minlength=lines), np.bincount(p.line[p.pairs[p.hard]], minlength=lines)
    ties = hard - p.tags  # the colon behind a label
    code = p.keyed | (ties > 0) & (6 * ties >= pairs) | (p.links == 0) & (rest >= 3) & (2 * numbers > rest)
    return rest, numbers, hard, code


def code_words(p: Lines) -> np.ndarray:
    """Per text, words of lines that are code or data by how their words are tied."""
    return np.bincount(p.text, np.where(_ties(p)[3], np.bincount(p.line, minlength=len(p.text)), 0), len(p.words.counts))


def judge(p: Lines, corpus: Corpus) -> Judged:
    w, n = p.words, len(p.words.counts)
    lines = len(p.text)
    weight = corpus.weight(w)
    size = np.bincount(p.line, minlength=lines)
    plain = ~(p.link | p.markup)
    rest, numbers, hard, code = _ties(p)
    named = rest - numbers
    soft = p.pairs[~p.hard]
    soft = soft[~(p.number[soft] | p.number[soft + 1])]
    bond, pmi, excess = bonds(w, soft, weight, corpus)
    of = p.line[soft]
    # a keyword ties nothing: pages on it all put the same words before and behind it
    ties = (bond >= BOND) & ~(excess[soft] | excess[soft + 1])
    pairs, tied = np.bincount(of, minlength=lines), np.bincount(of, ties, lines)
    sentence = (named >= SENTENCE_WORDS) & (tied >= SENTENCE * pairs) & (tied >= 2)
    link = (p.links > 0) & ~code & ~sentence
    entry = link & (rest <= 6 * p.links)
    tag = p.tags & ~link & ~code
    open_ = ~(code | link | tag)
    sentence &= open_ | (p.links > 0) & ~code
    code |= open_ & ~sentence & p.imports
    loose = open_ & ~sentence & ~code
    spoken = loose[p.line] & plain & ~p.number
    # repeated words and collocations of what is left
    often = _in_text(w.text[np.flatnonzero(spoken)], w.hashes[spoken])
    returns = np.zeros(len(w.hashes), bool)
    returns[spoken] = often >= WORD_RETURNS
    keyword = np.bincount(p.line, spoken & excess, lines) > 0
    inner = soft[loose[of]]
    again = inner[_in_text(w.text[inner], pair_hashes(w.hashes[inner], w.hashes[inner + 1])) >= PAIR_RETURNS]
    returns[again] = returns[again + 1] = True
    repeated = np.bincount(p.line, returns, lines)
    of_text = lambda flag: np.bincount(w.text[flag], minlength=n)
    place = np.flatnonzero(spoken)
    once = (of_text(place) >= ENOUGH) & (of_text(place[often > 1]) < TWICE * of_text(place))
    salad = loose & (named >= SALAD_WORDS) & (tied < SALAD * pairs)
    salad &= once[p.text] | (np.bincount(p.line[p.pairs[p.parted]], minlength=lines) >= PARTED * np.bincount(p.line[p.pairs], minlength=lines)) & keyword
    add = lambda flag, what: np.bincount(p.text, np.where(flag, what, 0), n)
    mean = lambda x: np.bincount(w.text[soft], x, n) / np.maximum(np.bincount(w.text[soft], minlength=n), 1)
    return Judged(w.counts, add(entry, size), add(tag, size), add(loose & ~salad, repeated), add(salad, size), add(code, size), add(sentence, size), mean(pmi), mean(bond))


def _judge(corpus_of: Callable[[], Corpus], features: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = corpus_of()
        for part in _slices(batches):
            read = lines_of(part.column(1))
            if not features:  # a text with too much code or data can't be spam, whatever its words
                part = part.take(pa.array(np.flatnonzero(5 * code_words(read) < read.words.counts)))
                read = lines_of(part.column(1))
            found = judge(read, corpus)
            spam = found.spam
            if features:
                share = lambda x: pa.array(x / np.maximum(found.words, 1))  # noqa: B023, E731
                columns = [part.column(0), pa.array(found.words), pa.array(found.pmi), pa.array(found.bond), share(found.repeated), share(found.salad), share(found.links + found.tags), share(found.code), pa.array(spam)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FEATURES.split(", ")])
            elif spam.any():
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(spam))], names=["doc_id"])

    return run


FEATURES = "doc_id bigint, words bigint, pmi double, bond double, repeated double, salad double, links double, code double, spam boolean"


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def stuffed(documents: DataFrame, features: bool = False, support: int = SUPPORT) -> DataFrame:
    """(doc_id) of documents(doc_id, text) that are spam; with features, FEATURES of all with a text (mean PMI and bond, shares of words).

    Null texts and ids give no row; a text without words is never spam; whole texts are read, however
    long, and all count in the corpus. Repeated rows give repeated results. No document is shuffled.
    """
    texts = _texts(documents)
    corpus = corpus_counts(texts.select("text"), support)
    tables = [(t.keys, t.values) for t in (corpus.families, corpus.words, corpus.pairs)]
    sent = documents.sparkSession.sparkContext.broadcast((tables, corpus.n, corpus.least))

    def corpus_of() -> Corpus:
        held, n, least = sent.value
        return Corpus(*(Table(*t) for t in held), n, least)

    return texts.mapInArrow(_judge(corpus_of, features), FEATURES if features else "doc_id bigint")


def text_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, words, pairs, returning_words, returning_pairs): of each text its words and pairs of neighbours, and those of
    them that occur WORD_RETURNS, or PAIR_RETURNS, times or more in it. Null texts and ids give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            w = words_of(part.column(1), wide=True)
            at = neighbours(line_of(w)) if len(w.hashes) else np.zeros(0, np.int64)
            n = len(w.counts)
            words = _in_text(w.text, w.hashes) >= WORD_RETURNS
            pairs = _in_text(w.text[at], pair_hashes(w.hashes[at], w.hashes[at + 1])) >= PAIR_RETURNS
            columns = [w.counts, np.bincount(w.text[at], minlength=n), np.bincount(w.text[words], minlength=n), np.bincount(w.text[at[pairs]], minlength=n)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "words", "pairs", "returning_words", "returning_pairs"])

    return _texts(documents).mapInArrow(run, "doc_id bigint, words bigint, pairs bigint, returning_words bigint, returning_pairs bigint")


def count_spectrum(documents: DataFrame) -> DataFrame:
    """(kind, times, different): how many different words, and pairs of neighbours, occur so many times in all texts."""
    def parts(w: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        at = neighbours(line_of(w)) if len(w.hashes) else np.zeros(0, np.int64)
        return [(0, w.hashes, np.ones(len(w.hashes))), (1, pair_hashes(w.hashes[at], w.hashes[at + 1]), np.ones(len(at)))]

    counts = _texts(documents).select("text").mapInArrow(_partial(parts), _COUNTS).groupBy("kind", "h").agg(F.sum("n").cast("long").alias("times"))
    kind = F.when(F.col("kind") == 0, "word").otherwise("pair").alias("kind")
    return counts.groupBy(kind, "times").agg(F.count("*").alias("different"))
