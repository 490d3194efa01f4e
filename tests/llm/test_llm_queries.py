import random

import oracle
import pytest

from millrace.llm import queries


@pytest.fixture(scope="module")
def con():
    return oracle.duck()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, con, name):
    got, want = oracle.both(spark, con, queries.QUERIES[name], queries.SQL[name])
    assert got == want


def test_distinct_ids_are_within_their_error(spark, con):
    rows = queries.p1_distinct_ids(spark, oracle.FOLDER).collect()
    estimate = {tuple(r)[:6]: r["estimate"] for r in rows}
    assert len(estimate) == len(rows)
    uuid = lambda c: f"translate(lower({c}), '-{{}} ', '')"
    checks = {
        ("bid.bidder", "*", "*", "*", "*", "*"): "SELECT count(DISTINCT bidder) FROM bid WHERE b_date_time IS NOT NULL",
        ("bid.auction", "*", "10", "*", "*", "*"): "SELECT count(DISTINCT auction) FROM bid WHERE b_date_time IS NOT NULL AND auction IN (SELECT a_id FROM auction WHERE category = 10)",
        ("bid.bidder", "2015-07-16", "*", "*", "*", "*"): "SELECT count(DISTINCT bidder) FROM bid WHERE CAST(b_date_time AS DATE) = DATE '2015-07-16'",
        ("ad_event.user_id", "*", "*", "banner", "view", "*"): f"SELECT count(DISTINCT {uuid('user_id')}) FROM ad_event WHERE event_time IS NOT NULL AND lower(trim(ad_type)) = 'banner' AND event_type = 'view'",
        ("ad_event.user_id", "*", "*", "*", "*", "*"): f"SELECT count(DISTINCT {uuid('user_id')}) FROM ad_event WHERE event_time IS NOT NULL",
    }
    for key, sql in checks.items():
        exact = con.execute(sql).fetchall()[0][0]
        assert abs(estimate[key] - exact) <= max(1, 4 * queries.distinct.STANDARD_ERROR * exact), key


def test_best_bids_of_a_category_with_few_auctions(spark, tmp_path):
    rng = random.Random(5)
    prices = {1: [100, 95], 2: [90], 3: [80, 50, 40, 30, 20, 10, 9], 4: [10**6, *(rng.randrange(1, 10**6) for _ in range(3000))], 5: [7, -3, 0]}
    prices |= {100 + i: [rng.randrange(1, 10**6) for _ in range(5)] for i in range(200)}
    category = {1: 10, 2: 10, 3: 10, 4: 11, 5: 12} | {a: 13 for a in prices if a >= 100}
    bids = [(i, a, p) for i, (a, p) in enumerate((a, p) for a, own in prices.items() for p in own)]
    spark.createDataFrame(bids + bids[:500], "bid_id bigint, auction bigint, price bigint").selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) AS b_date_time").write.parquet(f"{tmp_path}/bid.parquet")
    spark.createDataFrame(list(category.items()), "a_id bigint, category bigint").write.parquet(f"{tmp_path}/auction.parquet")
    want = set()
    for c in set(category.values()):
        best = sorted((-p, i) for i, a, p in bids if category[a] == c)[:10]
        want |= {(c, place, i) for place, (_, i) in enumerate(best, 1)}
    got = [(r["group_key"], r["place"], r["bid_id"]) for r in queries.p7_found(spark, str(tmp_path)).where("level = 'category'").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 33
