"""The record operators against brute force on small and awkward inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import balance, deliveries, lateness, references, sessions, windows

HOUR, DAY = 3_600_000, 86_400_000


# references


def _orphans(refs, parents, removals):
    born, gone, known = {}, {}, set()
    for rel, k, t in parents:
        if k is not None:
            known.add((rel, k))
            if t is not None:
                born[rel, k] = min(born.get((rel, k), t), t)
    for rel, k, t in removals:
        if k is not None:
            known.add((rel, k))
            if t is not None:
                gone[rel, k] = min(gone.get((rel, k), t), t)
    out = set()
    for rel, k, t in refs:
        if k is None or t is None:
            continue
        if (rel, k) in gone and gone[rel, k] <= t:
            kind = "deleted"
        elif (rel, k) not in known:
            kind = "missing"
        elif (rel, k) in born and born[rel, k] > t:
            kind = "later"
        else:
            continue
        out.add((rel, k, t // DAY, kind))
    return out


def test_orphans_match_brute_force(spark):
    rng = random.Random(3)
    key = lambda: rng.choice([None, rng.randrange(-130, 400), rng.randrange(10**15)]) if rng.random() < 0.3 else rng.randrange(200)
    time = lambda: None if rng.random() < 0.05 else rng.randrange(-2 * DAY, 5 * DAY) if rng.random() < 0.7 else rng.randrange(5) * HOUR
    refs = [(rng.randrange(3), key(), time()) for _ in range(4000)] * 2
    parents = [(rng.randrange(3), key(), time()) for _ in range(300)]
    removals = [(rng.randrange(3), key(), time()) for _ in range(80)] * 2
    make = lambda rows, c: spark.createDataFrame([(*r, 7, "x") for r in rows], f"rel int, key bigint, {c} bigint, word int, refs string")
    found = references.orphans(make(refs, "t_ms"), make(parents, "born_ms"), make(removals, "gone_ms"))
    rows = [tuple(r) for r in found.select("rel", "key", "day", "kind").collect()]
    assert len(rows) == len(set(rows))
    want = _orphans(refs, parents, removals)
    assert set(rows) == want and len(want) > 100


def test_orphans_of_empty_tables(spark):
    make = lambda rows, c: spark.createDataFrame(rows, f"rel int, key bigint, {c} bigint")
    none = [make([], c) for c in ("t_ms", "born_ms", "gone_ms")]
    assert references.orphans(*none).count() == 0
    one = make([(0, 5, 10), (0, None, 10), (0, 5, None)], "t_ms")
    assert [tuple(r) for r in references.orphans(one, *none[1:]).collect()] == [(0, 5, 0, "missing")]


def test_dictionary_numbers_every_id_once(spark):
    ids = [f"id{i % 300}" for i in range(900)] + [None]
    rows = references.dictionary(spark.createDataFrame([(i,) for i in ids], "id string")).collect()
    assert len(rows) == 300 == len({r["code"] for r in rows}) == len({r["id"] for r in rows})


# deliveries


def _split(spark, rows, **options):
    df = spark.createDataFrame(rows, "delivery_id bigint, at int, qid string, n int, __key0 string, __rank int")
    out = deliveries.split_deliveries(df, [F.lower(F.trim("qid")), F.col("n")], ["at"], "delivery_id", **options)
    assert out.kept.columns == df.columns
    return [sorted(r["delivery_id"] for r in part.collect()) for part in out]


def test_deliveries_keep_the_first_of_each(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(5)]), rng.choice([None, "a", " A", "b ", f"c{rng.randrange(60)}"]), rng.choice([None, 1, 1, 1, 2]), "k", 0) for i in range(3000)]
    groups = {}
    for r in rows:
        key = (r[2].strip().lower(), r[3]) if r[2] is not None and r[3] is not None else r[0]
        groups.setdefault(key, []).append((r[1] is None, r[1] or 0, r[0]))
    first = {min(g)[2] for g in groups.values()}
    for hot in (400, 5, 1):
        singles, kept, again = _split(spark, rows, hot_keys=hot)
        assert set(singles) == {g[0][2] for g in groups.values() if len(g) == 1}
        assert set(singles) | set(kept) == first and not set(singles) & set(kept)
        assert len(again) == len(set(again)) and set(again) == {r[0] for r in rows} - first


def test_deliveries_of_an_empty_table(spark):
    assert _split(spark, []) == [[], [], []]


# balance


def test_layout_spreads_a_hot_key(spark):
    df = spark.createDataFrame([(1, i) for i in range(5000)] + [(i, i) for i in range(2, 5002)] + [(None, 1)], "k bigint, i bigint")
    layout = balance.plan_layout(df, "k", tasks=8)
    assert layout.total == 10_001 and sum(layout.loads) >= 10_000 and layout.imbalance < 1.15
    assert len(layout.large[1]) == 4 == len(set(layout.large[1]))
    sizes = [r["count"] for r in balance.fragment(df, "k", layout, ["i"]).groupBy("__task").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 1.3 * 10_000 / 8


def test_balanced_results_match_plain_ones(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(40)]), i // 2, rng.choice([None, 5])) for i in range(2000)]
    rows = [(k, i, v) for k, i, v in rows]
    df = spark.createDataFrame(rows, "k bigint, id bigint, v bigint")
    parts = balance.partial_counts(df.repartition(6), {"one": "k", "two": "v"})
    total, counts = balance.balanced_counts(parts.where("field = 'one'"), tasks=5)
    assert total == len(rows) and parts.groupBy("field", "key", "part").count().where("count > 1").count() == 0
    assert {r["key"]: r["n"] for r in balance.balanced_counts(parts.where("field = 'two'"), tasks=5)[1].collect()} == {5: sum(v == 5 for _, _, v in rows)}
    want = {}
    for k, _, _ in rows:
        if k is not None:
            want[k] = want.get(k, 0) + 1
    assert {r["key"]: r["n"] for r in counts.collect()} == want

    match = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "z")], "m bigint, total string")
    got = balance.balanced_join_totals(df, "k", "id", "v", match.withColumnRenamed("total", "name"), "m", ["name"], tasks=5)
    records = {}
    for k, i, v in rows:
        if k is not None:
            records[k, i] = max(records.get((k, i), 0), v or 0)
    for r in got.collect():
        mine = [v for (k, _), v in records.items() if k == r["key_value"]]
        assert r["n"] == len(mine) and (r["total"] or 0) == sum(mine)
        assert r["name"] == {1: "a", 3: "c"}.get(r["key_value"])
    assert got.count() == len(want)


def test_balanced_results_of_empty_tables(spark):
    df = spark.createDataFrame([], "k bigint, id bigint, v bigint")
    total, counts = balance.balanced_counts(balance.partial_counts(df, {"k": "k"}))
    assert (total, counts.count()) == (0, 0)
    assert balance.balanced_join_totals(df, "k", "id", "v", df.select(F.col("k").alias("m"), "v").withColumnRenamed("v", "w"), "m", ["w"]).count() == 0


# lateness


def _judged(spark, rows):
    return lateness.judge(lateness.first_arrivals(spark.createDataFrame(rows, "src string, rec_key string, t_ms bigint, arrival_ms bigint, value bigint")), 30 * 60_000)


def test_the_cut_off_is_exact_and_the_first_arrival_counts(spark):
    edge = HOUR + 30 * 60_000
    rows = [("s", "in", 0, edge, 5), ("s", "out", 0, edge + 1, 7), ("s", "again", 5, edge + 9, 1), ("s", "again", 5, edge - 1, 1), ("s", None, 1, 1, 1), ("s", "untimed", None, 1, 1), ("s", "lost", 1, None, 1), ("s", "early", HOUR - 1, -5, None), ("s", "old", -1, 0, 2)]
    judged = _judged(spark, rows)
    assert {r["rec_key"] for r in judged.where("refused").collect()} == {"out"}
    got = {r["period"]: (r["n"], r["total"], r["corrections"], r["refused"]) for r in lateness.combine(lateness.partials(judged)).collect()}
    assert got == {0: (3, 6, 2, 1), -1: (1, 2, 1, 0)}


def test_stores_merge_in_any_order(spark):
    rng = random.Random(2)
    rows = [("s", str(i), rng.randrange(5 * HOUR), rng.randrange(8 * HOUR), rng.randrange(9)) for i in range(600)]
    whole = {tuple(r) for r in lateness.partials(_judged(spark, rows)).collect()}
    parts = [lateness.partials(_judged(spark, rows[i::3])) for i in (2, 0, 1)]
    merged = lateness.merge(parts[0], lateness.merge(parts[1], parts[2]))
    assert {tuple(r) for r in merged.select("src", "period", "batch", "n", "total", "corrections", "refused").collect()} == whole
    early = sum(r["n"] for r in lateness.combine(lateness.partials(_judged(spark, rows)), up_to_batch=2).collect())
    assert early == sum(1 for r in rows if r[3] < 3 * HOUR and r[3] <= (r[2] // HOUR + 1) * HOUR + 30 * 60_000)


# sessions


def _sessions(rows, gap):
    by = {}
    for e, t, r in set(rows):
        if e is not None and t is not None:
            by.setdefault(e, []).append(t)
    out = []
    for e, times in by.items():
        times.sort()
        start, n, last = times[0], 0, times[0]
        for t in times:
            if t - last > gap:
                out.append((e, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((e, start, last, n))
    return sorted(out)


def test_one_tree_serves_every_threshold(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, rng.randrange(30)]), rng.choice([None, rng.randrange(40), int(rng.expovariate(1 / 3000)), rng.randrange(20_000)]), rng.choice([None, i, i, 1])) for i in range(3000)]
    rows += rows[:500]
    df = spark.createDataFrame([(*r, "x") for r in rows], "entity bigint, ms bigint, record bigint, gap string").repartition(7)
    tree = sessions.gap_tree(df).cache()
    for gap in (0, 1, 2, 5, 17, 100, 999, 10**6):
        got = sorted((r["entity"], r["start_ms"], r["end_ms"], r["events"]) for r in sessions.cut(tree, gap).collect())
        assert got == _sessions(rows, gap), gap
    whole = {tuple(r) for r in tree.collect()}
    for cuts in ([5, 100], [100], [0, 1, 17, 999, 10**6], [10**9]):
        few = sessions.gap_tree(df, cuts=cuts).cache()
        for gap in cuts:
            assert sorted((r["entity"], r["start_ms"], r["end_ms"], r["events"]) for r in sessions.cut(few, gap).collect()) == _sessions(rows, gap), (cuts, gap)
        found = [tuple(r) for r in few.collect()]
        assert len(found) == len(set(found)) and set(found) <= whole


def test_one_entity_over_many_partitions(spark):
    rng = random.Random(4)
    for spread in (5, 300):
        rows = [(1, t, i) for i, t in enumerate(sorted(rng.choices(range(spread * 400), k=1500)))]
        df = spark.createDataFrame(rows, "entity bigint, ms bigint, record bigint").repartition(3)
        for cuts in ([3], [0, 40, 200], [2, 700]):
            tree = sessions.gap_tree(df, cuts=cuts).cache()
            for gap in cuts:
                assert sorted((r["entity"], r["start_ms"], r["end_ms"], r["events"]) for r in sessions.cut(tree, gap).collect()) == _sessions(rows, gap)


def test_chains_for_one_threshold_have_three_runs(spark):
    rows = [(1, t * t, t) for t in range(4000)]
    part = sessions._Part(iter([sessions.pa.RecordBatch.from_arrays([sessions.pa.array(c, sessions.pa.int64()) for c in zip(*rows, strict=True)], names=["e", "t", "r"])]), [600])
    assert len(part.ends) <= 2


def test_sessions_of_few_events(spark):
    make = lambda rows: spark.createDataFrame(rows, "entity bigint, ms bigint, record bigint")
    assert sessions.gap_tree(make([])).count() == 0
    assert [tuple(r) for r in sessions.cut(sessions.gap_tree(make([(4, 9, 1), (4, 9, 1), (4, 9, 2)])), 0).collect()] == [(4, 9, 9, 0, 2)]


def test_chains_of_growing_gaps_stay_within_their_bound():
    times = np.cumsum(np.arange(400)).tolist()
    fold = sessions._Fold(lambda *a: None, open_left=True)
    for t in times:
        fold.add([-1, t, t, 1])
    assert len(fold.runs) <= 2 * (2 * (times[-1] - times[0])) ** 0.5 + 1


# windows


def test_fixed_windows_are_complete(spark):
    df = spark.createDataFrame([(t,) for t in (-1, 0, 4, 5, 9, 10, 14, 15, 19, 24, None)], "ms bigint").withColumn("ms", F.col("ms") * 1000)
    tumbled = windows.fixed_windows(df, "ms", windows.tumbling_window(10), 0, 25_000).groupBy("window_start").count()
    assert {r[0]: r[1] for r in tumbled.collect()} == {0: 4, 10_000: 4}
    hopped = windows.fixed_windows(df, "ms", windows.hopping_window(10, 5), 0, 25_000).groupBy("window_start").count()
    assert {r[0]: r[1] for r in hopped.collect()} == {0: 4, 5_000: 4, 10_000: 4, 15_000: 3}


def test_anchored_windows_begin_at_their_first_event(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 5, 10, 11, 30, 31)] + [(2, 7), (None, 3), (2, None)], "k bigint, ms bigint")
    got = sorted(tuple(r) for r in windows.anchored_windows(df, "k", "ms", 10).collect())
    assert got == [(1, 0, 10, 3), (1, 11, 11, 1), (1, 30, 31, 2), (2, 7, 7, 1)]
    assert sorted(tuple(r) for r in windows.anchored_windows(df, "k", "ms", 10, drop_open=32).collect()) == got[:2] + got[3:]


def _anchored(rows, size):
    out = {}
    for k in {r[0] for r in rows}:
        start = None
        for t in sorted(r[1] for r in rows if r[0] == k):
            if start is None or t > start + size:
                start = t
            last, n = out.get((k, start), (t, 0))
            out[k, start] = (max(last, t), n + 1)
    return {(k, a, last, n) for (k, a), (last, n) in out.items()}


def test_anchored_windows_of_a_hot_key(spark):
    rng = random.Random(8)
    for size, span, hot in ((10, 3000, 0.9), (100, 1500, 1.0), (3, 40_000, 0.6), (5000, 3000, 0.9), (7, 200_000, 0.95)):
        rows = [(1 if rng.random() < hot else rng.randrange(60), rng.randrange(span)) for _ in range(3000)]
        df = spark.createDataFrame(rows, "k bigint, ms bigint").repartition(5)
        got = [tuple(r) for r in windows.anchored_windows(df, "k", "ms", size).collect()]
        assert len(got) == len(set(got)) and set(got) == _anchored(rows, size), size
    assert windows.anchored_windows(df.limit(0), "k", "ms", 10).count() == 0


def test_row_windows_number_across_partitions(spark):
    df = spark.range(103).withColumn("__x", F.lit(1)).repartition(5)
    got = {r[0]: r[1] for r in windows.row_windows(df, ["id"], 10).groupBy("window_number").count().collect()}
    assert got == {**{i: 10 for i in range(10)}, 10: 3}
