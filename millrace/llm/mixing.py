"""Mixing sources to target weights, in tokens, with capped repetition.

Sources that have documents get their target, rescaled to a sum of 1. A source that would have to repeat more often than
allowed gets what its limit holds, and the others share the rest in proportion to their targets, until none is over its limit: a source
with too few documents is the same case as one with none. Without targets the weights are ``share**t``, where share is a
source's own share of tokens, and t is bisected to reach a target entropy, held back by the same limits.

A source's token budget becomes whole copies of all its documents and a rest. The rest is taken from a random
permutation by blocks: documents fall into blocks by hash, blocks are taken in permuted order while they fit, and
the block in which the budget ends is cut into blocks in the same way, until it has few documents, which are put in order. So the budget
is met to within one document, and what reaches the driver at once is one number per source and block, however large the corpus.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.normal import source_name
from millrace.session import cut_lineage

#: Ranks of a public byte-level vocabulary, and the fixed pattern by which it splits texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS = 1024
#: The most documents that are put in order in one task.
LEAF = 50_000
#: The most sources of a mix; each has BLOCKS numbers at the driver.
MOST_SOURCES = 1000
_PIECE = 1_000_000


def load_tokenizer(path: str) -> Callable[[str], int]:
    """The function that counts a text's tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(text: str) -> int:
        if len(text) <= _PIECE:
            return len(encode(text))
        # Tokens don't cross from a letter to a following blank, so a very long text is cut there.
        n = start = 0
        while start < len(text):
            end = start + _PIECE
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
                end += 1
            n += len(encode(text[start:end]))
            start = end
        return n

    return count


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents(doc_id, source, text) with an id, a source and at least one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(tokenizer)
        for batch in batches:
            tokens = pa.array([count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["doc_id", "source", "tokens"])

    rows = documents.where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text != ''")
    named = rows.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return named.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def tempered(shares: np.ndarray, exponent: float, targets: np.ndarray | None = None) -> np.ndarray:
    """shares**exponent, or shares**(1 - exponent) * targets**exponent, normalised."""
    logs = exponent * np.log(shares) if targets is None else (1 - exponent) * np.log(shares) + exponent * np.log(targets)
    weights = np.exp(logs - logs.max())
    return weights / weights.sum()


def entropy(weights: np.ndarray) -> float:
    return float(-(weights * np.log(weights)).sum())


def _bisect(holds: Callable[[float], bool], low: float, high: float) -> float:
    """The largest value from low to high at which holds, which is true at low, is still true."""
    if holds(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


@dataclass
class Mix:
    """Per source: tokens available, target weight (None: no target), the most copies of a document, and the budget in tokens.

    exponent: with targets, the largest a at which ``share**(1 - a) * target**a`` keeps within all limits, 1 if all targets can be
    met; it tells how far off they are and doesn't make the budgets. Without targets, the exponent of the shares.
    """

    sources: list[str]
    tokens: dict[str, int]
    targets: dict[str, float | None]
    repeats: dict[str, int]
    exponent: float = 1.0
    budget: int = 0
    budgets: dict[str, int] = field(default_factory=dict)


def solve(tokens: dict[str, int], targets: dict[str, float] | None, repeats: dict[str, int], budget: int | None = None, target_entropy: float | None = None) -> Mix:
    """Budgets per source.

    tokens: of every source with documents. targets: weights of the listed sources; only these are mixed. A listed source
    without documents gets nothing, one with too few what its limit holds, and the others share the rest in proportion. Without targets all sources of repeats are
    mixed, towards target_entropy (by default: all alike). budget: tokens of the output, by default those available.
    A budget beyond what all copies together hold is cut down to that.
    """
    listed = sorted(targets if targets is not None else repeats)
    mix = Mix(listed, {s: tokens.get(s, 0) for s in listed}, {s: targets[s] if targets is not None else None for s in listed}, {s: repeats[s] for s in listed})
    there = [s for s in listed if mix.tokens[s] > 0 and repeats[s] > 0 and (targets is None or targets[s] > 0)]
    mix.budgets = dict.fromkeys(listed, 0)
    if not there:
        return mix
    own = np.array([mix.tokens[s] for s in there], float)
    limit = own * np.array([repeats[s] for s in there], float)
    shares = own / own.sum()
    mix.budget = int(min(own.sum() if budget is None else budget, limit.sum()))
    fits = lambda w: bool((w * mix.budget <= limit * (1 + 1e-12)).all())
    if targets is not None:
        wanted = np.array([targets[s] for s in there], float)
        wanted /= wanted.sum()
        weights = lambda a: tempered(shares, a, wanted)
        mix.exponent = _bisect(lambda a: fits(weights(a)), 0.0, 1.0)
        final = _filled(wanted * mix.budget, limit) / mix.budget
    else:
        aim = math.log(len(there)) if target_entropy is None else target_entropy
        weights = lambda a: tempered(shares, 1 - a)
        a = _bisect(lambda a: entropy(weights(a)) <= aim + 1e-12 and fits(weights(a)), 0.0, 1.0)
        mix.exponent, final = 1 - a, weights(a)
    if not fits(final):  # the budget exceeds what the corpus as it is can fill: full sources stay full, the others share the rest
        final = _filled(final * mix.budget, limit) / mix.budget
    mix.budgets |= {s: round(w * mix.budget) for s, w in zip(there, final, strict=True)}
    return mix


def _filled(wanted: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """wanted with what exceeds its limit handed to the others in proportion."""
    total, full = wanted.sum(), np.zeros(len(wanted), bool)
    while True:
        out = np.where(full, limit, wanted * (total - limit[full].sum()) / max(wanted[~full].sum(), 1e-300))
        over = ~full & (out > limit)
        if not over.any():
            return out
        full |= over


def _permuted(sizes: dict[int, tuple[int, int]], rest: int, rng: np.random.Generator) -> tuple[list[int], int | None, int]:
    """(blocks taken whole, the block in which rest ends, what is left of rest there), of sizes block -> (tokens, documents), in permuted order."""
    whole = []
    for b in rng.permutation(sorted(sizes)).tolist():
        if rest <= 0:
            break
        if sizes[b][0] > rest:
            return whole, b, rest
        whole.append(b)
        rest -= sizes[b][0]
    return whole, None, 0


def realise(counted: DataFrame, mix: Mix, seed: int = 0, leaf: int = LEAF) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents drawn, from counted(doc_id, source, tokens)."""
    spark, bits = counted.sparkSession, BLOCKS.bit_length() - 1
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)
    level_of = lambda n: F.shiftright(h, n * bits).bitwiseAND(F.lit(BLOCKS - 1).cast("long")).cast("int")
    base, rest = {}, {}
    for s in mix.sources:
        if mix.budgets[s]:
            base[s], rest[s] = divmod(mix.budgets[s], mix.tokens[s])
            if base[s] >= mix.repeats[s]:
                base[s], rest[s] = mix.repeats[s], 0
    schema = "source string, block int, copies int, cut bigint"
    table = lambda rows: F.broadcast(spark.createDataFrame(rows, schema))
    # documents still undecided, at first all of the sources drawn from; at each level all but those of one block a source are decided
    open_ = counted.where(F.col("source").isin([s for s in base]))
    out = None
    for level in range(63 // bits):
        placed = open_.withColumn("block", level_of(level))
        sizes: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in base}
        for r in placed.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect():
            sizes[r["source"]][r["block"]] = (r["n"], r["docs"])
        decided, ends, deeper = [], [], []
        for k, s in enumerate(base):
            if not sizes[s]:
                continue
            whole, end, left = _permuted(sizes[s], rest[s], np.random.default_rng([seed, level, k]))
            taken = set(whole)
            decided += [(s, b, base[s] + (b in taken), None) for b in sizes[s] if b != end]
            if end is not None:
                last = sizes[s][end][1] <= leaf or level + 1 == 63 // bits
                (ends if last else deeper).append((s, end, base[s], left))
                rest[s] = left
        part = placed.join(table(decided), ["source", "block"]).drop("cut", "block")
        if ends:
            running = F.sum("tokens").over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
            edge = placed.join(table(ends), ["source", "block"]).withColumn("running", running)
            # the document on the edge is taken if more than half of it fits
            edge = edge.withColumn("copies", F.col("copies") + (2 * F.col("running") - F.col("tokens") <= 2 * F.col("cut")).cast("int"))
            part = part.unionByName(edge.drop("cut", "block", "running"))
        out = part if out is None else out.unionByName(part)
        if not deeper:
            break
        open_ = placed.join(table(deeper), ["source", "block"]).drop("block", "copies", "cut")
    return out.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def mixed(documents: DataFrame, targets: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER, seed: int = 0, towards_targets: bool = True) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) of documents mixed to targets(source, weight, max_repeats).

    drawn: (doc_id, source, tokens, copies), one row per document drawn, copies from 1 to max_repeats. shares: per listed
    source the target, what is there, what was drawn, the share reached, and whether it meets the target to within 0.5 %
    of the whole. With towards_targets off, weights only bound the entropy: the mix is as even as they are.

    Documents with a null id, source or text, or without a token, aren't drawn; sources not listed have no weight.
    Source names agree ignoring case, surrounding blanks, and hyphens for underscores; of a source listed twice the larger weight counts.
    Each row of documents is a document: repeated rows are drawn alike. Tokens are counted once and written.
    """
    listed = _listed(targets).limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    counted = cut_lineage(token_counts(documents, tokenizer))
    totals = {r["source"]: (r["n"], r["docs"]) for r in counted.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).where(F.col("source").isin([r["source"] for r in listed])).collect()}
    wanted, repeats = {}, {}
    for r in listed:
        wanted[r["source"]], repeats[r["source"]] = float(r["weight"]), int(r["max_repeats"])
    tokens = {s: n for s, (n, _) in totals.items()}
    if towards_targets:
        mix = solve(tokens, wanted, repeats, budget)
    else:
        given = np.array([w for w in wanted.values() if w > 0], float)
        mix = solve(tokens, None, repeats, budget, entropy(given / given.sum()) if len(given) else None)
    drawn = realise(counted, mix, seed)
    spark = documents.sparkSession
    asked = [(s, wanted[s], repeats[s], totals.get(s, (0, 0))[1], mix.tokens[s], mix.budgets[s]) for s in mix.sources]
    table = spark.createDataFrame(asked, "source string, weight double, max_repeats int, documents bigint, tokens bigint, budget bigint")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most_copies"))
    both = table.join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    share = F.col("drawn") / F.greatest(F.sum("drawn").over(Window.partitionBy()), F.lit(1))
    shares = both.withColumn("share", share).withColumn("met", F.abs(F.col("share") - F.col("weight")) <= 0.005).withColumn("exponent", F.lit(float(mix.exponent)))
    return drawn, shares.withColumn("most_copies", F.coalesce("most_copies", F.lit(0)))


def _listed(targets: DataFrame) -> DataFrame:
    named = targets.where("source IS NOT NULL AND weight IS NOT NULL").select(source_name(F.col("source")).alias("source"), "weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    return named.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
