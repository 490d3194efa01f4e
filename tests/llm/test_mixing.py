import random

import numpy as np
import pytest

from millrace.llm import mixing


def _documents(spark):
    rng = random.Random(3)
    names = ["Big-Source", "big_source ", "small", "SMALL", "tiny", None, "other"]
    rows = [(i, names[rng.choices(range(7), [40, 40, 8, 8, 2, 1, 5])[0]], rng.choice([None, "", "x"]) if rng.random() < 0.03 else "word " * rng.randrange(1, 60)) for i in range(3000)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, source string, text string, tokens int, block int, copies int")


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_meet_their_targets(spark):
    drawn, shares = mixing.mixed(_documents(spark), _targets(spark, [("big_source", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.05, 4), ("absent", 0.05, 2)]), budget=60_000)
    got = {r["source"]: r for r in shares.collect()}
    assert got["absent"]["drawn"] == 0 and not got["absent"]["met"]
    for name, want in (("big_source", 0.6), ("small", 0.3), ("tiny", 0.05)):
        assert abs(got[name]["share"] - want / 0.95) < 0.002 and got[name]["exponent"] == 1.0
        assert abs(got[name]["drawn"] - got[name]["budget"]) < 100
    rows = drawn.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    limit = {"big_source": 1, "small": 3, "tiny": 4}
    assert all(1 <= r["copies"] <= limit[r["source"]] and r["tokens"] > 0 for r in rows)


def test_short_sources_temper_the_mix(spark):
    _, shares = mixing.mixed(_documents(spark), _targets(spark, [("big_source", 0.1, 1), ("small", 0.1, 2), ("tiny", 0.8, 2)]))
    got = {r["source"]: r for r in shares.collect()}
    assert 0 <= got["tiny"]["exponent"] < 1 and not got["tiny"]["met"]
    assert got["tiny"]["most_copies"] <= 2 and got["tiny"]["drawn"] >= 1.9 * got["tiny"]["tokens"]


def test_empty_inputs(spark):
    docs = _documents(spark)
    targets = _targets(spark, [("small", 1.0, 1), (None, 0.5, 1)])
    drawn, shares = mixing.mixed(docs.limit(0), targets)
    assert drawn.count() == 0 and [r["drawn"] for r in shares.collect()] == [0]
    drawn, shares = mixing.mixed(docs, targets.limit(0))
    assert drawn.count() == 0 and shares.count() == 0


def test_solved_weights_respect_limits_and_entropy():
    tokens, repeats = {"a": 1000, "b": 100, "c": 10}, {"a": 1, "b": 5, "c": 50}
    mix = mixing.solve(tokens, {"a": 0.4, "b": 0.3, "c": 0.3}, repeats)
    assert all(mix.budgets[s] <= tokens[s] * repeats[s] + 1 for s in tokens) and abs(sum(mix.budgets.values()) - 1110) <= 2
    even = mixing.solve(tokens, None, dict.fromkeys(tokens, 1000), target_entropy=0.9)
    w = np.array([even.budgets[s] for s in tokens]) / sum(even.budgets.values())
    assert mixing.entropy(w) == pytest.approx(0.9, abs=0.01)
    beyond = mixing.solve(tokens, {"a": 0.5, "b": 0.5, "c": 0.0}, {"a": 1, "b": 1, "c": 1}, budget=10**9)
    assert beyond.budgets == {"a": 1000, "b": 100, "c": 0}


def test_a_source_with_few_documents_leaves_the_others_their_targets():
    tokens, targets, repeats = {"a": 6000, "b": 2999, "c": 1000, "d": 1}, {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}, {"a": 4, "b": 4, "c": 4, "d": 4}
    mix = mixing.solve(tokens, targets, repeats)
    assert mix.budgets["d"] == 4 and mix.budget == 10_000 and 0 <= mix.exponent < 1
    for s in "abc":
        assert abs(mix.budgets[s] - targets[s] / 0.8 * 9996) <= 1
    none = mixing.solve(tokens | {"d": 0}, targets, repeats, budget=10_000)
    assert all(abs(mix.budgets[s] - none.budgets[s]) <= 4 for s in tokens)
    two = mixing.solve(tokens, targets, repeats | {"c": 1, "b": 1})  # one limit brings others to theirs
    assert two.budgets == {"a": 5997, "b": 2999, "c": 1000, "d": 4}


def test_long_texts_are_counted_whole():
    count = mixing.load_tokenizer(mixing.TOKENIZER)
    text = "some words of text\n" * 90_000
    assert abs(count(text) - 90_000 * count("some words of text\n")) <= 5
    old, mixing._PIECE = mixing._PIECE, 1000
    try:
        assert mixing.load_tokenizer(mixing.TOKENIZER)(text) == count(text)
    finally:
        mixing._PIECE = old


def test_cut_blocks_are_cut_again(spark):
    counted = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 'a', 'b') AS source", "id % 7 + 1 AS tokens").cache()
    tokens = {r["source"]: r["n"] for r in counted.groupBy("source").agg({"tokens": "sum"}).toDF("source", "n").collect()}
    mix = mixing.solve(tokens, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}, budget=30_000)
    for leaf in (mixing.LEAF, 3, 1):
        rows = mixing.realise(counted, mix, seed=4, leaf=leaf).collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        for s in "ab":
            assert abs(sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s) - mix.budgets[s]) <= 7
            assert {r["copies"] for r in rows if r["source"] == s} <= {mix.budgets[s] // tokens[s], mix.budgets[s] // tokens[s] + 1}


def test_too_many_sources(spark):
    targets = spark.range(mixing.MOST_SOURCES + 5).selectExpr("concat('s', id) AS source", "0.001D AS weight", "1 AS max_repeats")
    with pytest.raises(ValueError, match="sources"):
        mixing.mixed(_documents(spark), targets)
