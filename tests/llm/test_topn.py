import random

import pytest

from millrace.llm import topn

ORDER = [("price", True), ("at", False), ("item", False)]


def _want(rows, n):
    groups = {}
    for g, p, at, i in set(r[:4] for r in rows):
        if g is not None and p is not None:
            groups.setdefault(g, []).append((-p, at is None, at or 0, i))
    return {(g, k + 1, x[3]) for g, xs in groups.items() for k, x in enumerate(sorted(xs)[:n])}


@pytest.mark.parametrize("max_large", [20_000, 3])
def test_top_n_matches_brute_force(spark, max_large):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, rng.randrange(50)]), rng.choice([None, 7, 7, 100, -3, 0, rng.randrange(10**9), 2**62]), rng.choice([None, *range(5)]), i, "a", "b", "c", "d") for i in range(4000)]
    rows += rows[:1500]
    df = spark.createDataFrame(rows, "g bigint, price bigint, at int, item bigint, place string, threshold string, __row string, bucket string")
    for n in (1, 3, 10):
        got = topn.top_n(df, "g", "price", ORDER, "item", n, max_large=max_large, shards=5)
        assert sorted(got.columns) == sorted(df.columns)
        found = [(r["g"], r["place"], r["item"]) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == _want(rows, n)


def test_equal_scores_in_a_large_group(spark):
    df = spark.range(9000).selectExpr("1L AS g", "5L AS price", "CAST(NULL AS INT) AS at", "id AS item")
    got = topn.top_n(df, "g", "price", ORDER, "item", 4)
    assert sorted((r["place"], r["item"]) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_copies_cannot_raise_the_threshold(spark):
    rows = [(1, 1000, 1, 1)] * 500 + [(1, 900, 1, 2)] * 500 + [(1, i, 1, 10 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g bigint, price bigint, at int, item bigint")
    assert sorted((r["place"], r["item"]) for r in topn.top_n(df, "g", "price", ORDER, "item", 3).collect()) == [(1, 1), (2, 2), (3, 309)]


def test_buckets_never_fall(spark):
    values = sorted({0, 1, -1, 2**62, -(2**62), *(random.Random(1).randrange(-(10**6), 10**6) for _ in range(3000))})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").coalesce(1).select(topn.bucket(topn.F.col("v"))).collect()]
    assert got == sorted(got)


def test_empty_and_bad_input(spark):
    df = spark.createDataFrame([], "g bigint, price bigint, at int, item bigint")
    assert topn.top_n(df, "g", "price", ORDER, "item", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "price", ORDER[1:], "item", 3)
