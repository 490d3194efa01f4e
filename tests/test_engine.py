"""Catalog, sources, sinks, specifications, command line, and streams against their batch twins."""

import base64
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import __main__ as cli
from millrace import catalog, runner
from millrace.functions.normal import bare_uuid, dashed_uuid, label, source_name
from millrace.functions.times import floor_div, millis
from millrace.operators import lateness, sessions, windows
from millrace.plans import auctions, flows
from millrace.sinks import Sink, from_name, with_log_partitions
from millrace.sources import envelopes, files, generators
from millrace.spec import QuerySpec, contains, statements
from millrace.streaming import queries as streams

TEST_ROWS = list(
    zip(
        [90, 90, 91, 101, 92, 102, 93, 103],
        [92.1, 93.2, 95.3, 96.4, 98.5, 99.6, 100.7, 101.8],
        ["a", "a", "d", "b", "b", "d", "c", "c"],
        [33, 1, 54, 33, 12, 75, 2, 87],
        ["rapport", "pedantic", "mimesis", "haptic", "baksheesh", "amok", "devious", "c"],
        [-90, -90, -91, -101, -92, -102, -93, -103],
        strict=True,
    )
)


@pytest.fixture
def test_table(spark):
    return spark.createDataFrame(TEST_ROWS, "c1 bigint, c2 double, c3 string, c4 bigint, c5 string, neg bigint")


# golden results


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT min(c1), avg(c4), count(c3) FROM test_table", [(90, 37.125, 8)]),
        ("SELECT max(c1), min(c2), c3 FROM test_table WHERE c2 < 99 GROUP BY c3 ORDER BY c3", [(90, 92.1, "a"), (101, 96.4, "b"), (91, 95.3, "d")]),
        ("SELECT count(DISTINCT c3) FROM test_table", [(4,)]),
        ("SELECT c1 AS col_1 FROM test_table WHERE c2 < 101 AND c1 > 91 ORDER BY c1 LIMIT 2", [(92,), (93,)]),
    ],
)
def test_golden(spark, test_table, sql, want):
    assert [tuple(r) for r in runner.run_batch(spark, QuerySpec("q", sql, {"test_table": test_table})).collect()] == want


def test_golden_join(spark):
    one = spark.createDataFrame([("a", 1), ("b", 10), ("c", 10), ("d", 100)], "a string, b int")
    spec = QuerySpec("q", "SELECT a, b, d FROM t1 JOIN t2 ON a = c ORDER BY a ASC LIMIT 3", {"t1": one, "t2": one.toDF("c", "d")})
    assert [tuple(r) for r in spec.plan(spark).collect()] == [("a", 1, 1), ("b", 10, 10), ("c", 10, 10)]
    assert contains(spec.explain(spark), "join") and contains(spec.explain(spark), "sort")
    assert spark.range(1, 501).agg(F.sum("id")).first()[0] == 125_250


def test_scripts_split_outside_quotes(spark):
    assert statements("SELECT ';' AS a; -- no; \nSELECT 2;") == ["SELECT ';' AS a", "-- no; \nSELECT 2"]
    script = "CREATE OR REPLACE TEMP VIEW v (n) AS SELECT 41; SELECT n + 1 AS m FROM v;"
    assert QuerySpec("s", script).plan(spark).first()["m"] == 42


# catalog, expressions


def test_catalog(spark):
    catalog.register(spark, "tpch")
    catalog.register(spark, "nexmark", {"bid": spark.createDataFrame([(1, 2, 3, None)], catalog.schema("bid"))})
    assert spark.table("lineitem").count() == 0 and spark.table("bid").count() == 1
    assert set(catalog.SUITES) == {"nexmark", "ysb", "tpch"}
    with pytest.raises(KeyError):
        catalog.schema("nothing")


def test_normal_forms(spark):
    digits = "0123456789abcdef0123456789abcdef"
    forms = [digits, digits.upper(), "{01234567-89ab-cdef-0123-456789ABCDEF}", "  01234567-89ab-cdef-0123-456789abcdef\t"]
    rows = spark.createDataFrame([(f,) for f in [*forms, "short", "", None]], "u string").select(bare_uuid(F.col("u")).alias("b")).collect()
    assert [r["b"] for r in rows] == [digits] * 4 + [None] * 3
    one = spark.range(1).select(dashed_uuid(F.lit(digits)), label(F.lit(" Sponsored_Search ")), source_name(F.lit("\tForge-Mirror "))).first()
    assert tuple(one) == ("01234567-89ab-cdef-0123-456789abcdef", "sponsored-search", "forge_mirror")
    got = spark.createDataFrame([(-1,), (0,), (9,), (10,), (2**62 + 1,)], "v bigint").select(floor_div(F.col("v"), 10)).collect()
    assert [r[0] for r in got] == [-1, 0, 0, 1, (2**62 + 1) // 10]


# sources


def test_generated_stream_keeps_its_mix_and_order(spark):
    s = generators.Stream(seconds=10, events_per_second=1000, out_of_order_group=10)
    made = generators.nexmark(spark, s)
    assert {k: v.count() for k, v in made.items()} == {"person": 200, "auction": 600, "bid": 9200}
    again = generators.nexmark(spark, s)
    for name in made:
        assert made[name].exceptAll(again[name]).count() == 0
        declared = {f.name for f in catalog.schema(name)}
        assert declared <= set(made[name].columns)
    hot = made["bid"].groupBy("auction").count().orderBy(F.desc("count")).limit(6).agg(F.sum("count")).first()[0]
    assert hot > 3500
    assert made["person"].select("p_id").distinct().count() == 200 and made["auction"].select("a_id").distinct().count() == 600
    sold = made["auction"].where("expires <= a_date_time OR reserve < initial_bid OR category NOT BETWEEN 10 AND 14").count()
    assert sold == 0
    raw = [r["n"] for r in generators.events(spark, s).limit(20).collect()]
    assert raw != sorted(raw) and sorted(raw) == list(range(20))


@pytest.mark.parametrize("shape", ["constant", "square", "sine"])
def test_rates_keep_times_in_order(spark, shape):
    s = generators.Stream(seconds=60, events_per_second=50, shape=shape, period_seconds=20)
    ms = [r["ms"] - generators.BASE_TIME_MS for r in generators.events(spark, s).orderBy("n").collect()]
    assert ms == sorted(ms) and 0 <= ms[0] and ms[-1] < 60_000
    first, second = sum(m < 10_000 for m in ms), sum(10_000 <= m < 20_000 for m in ms)
    assert first + second == 1000 and (first > 1.2 * second) == (shape == "square")


def test_unknown_rate(spark):
    with pytest.raises(ValueError):
        generators.events(spark, generators.Stream(shape="saw"))


def test_ad_stream(spark):
    made = generators.ysb(spark, generators.Stream(seconds=5, events_per_second=200))
    assert made["ad_event"].count() == 1000 and made["campaign"].count() == 1000
    assert made["campaign"].select("campaign_id").distinct().count() == 100
    assert made["ad_event"].join(made["campaign"], F.col("ad_id") == F.col("c_ad_id")).count() == 1000


def test_file_sources(spark, tmp_path):
    (tmp_path / "n.tbl").write_text("0|ALGERIA|0|quick words|\n1|PERU|1||\n")
    rows = [tuple(r) for r in files.delimited(spark, str(tmp_path / "n.tbl"), catalog.schema("nation")).collect()]
    assert rows == [(0, "ALGERIA", 0, "quick words"), (1, "PERU", 1, None)]
    (tmp_path / "b.json").write_text('{"a": 1, "b": 2.0, "c": false, "d": "4"}\n{"a": -10, "b": -3.5, "c": true, "d": "5"}\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "b.json"), "a double, b double, c boolean, d string").collect()] == [(1.0, 2.0, False, "4"), (-10.0, -3.5, True, "5")]
    (tmp_path / "s.csv").write_text("key,value\n1,10\n2,20\n")
    assert files.csv(spark, str(tmp_path / "s.csv"), catalog.schema("side_input")).agg(F.sum("value")).first()[0] == 30
    assert dict(files.csv(spark, str(tmp_path / "s.csv")).dtypes) == {"key": "int", "value": "int"}


def _b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode()


def test_envelopes(spark):
    shape = "cust_id int, month int, amount_paid double"
    one = {"cust_id": 123, "month": 9, "amount_paid": 456.78}
    kinesis = spark.createDataFrame([([((_b64(one),),), ((_b64(b"{"),),)],)], "Records array<struct<kinesis:struct<data:string>>>")
    assert [tuple(r) for r in envelopes.kinesis_rows(kinesis, shape).collect()] == [(123, 9, 456.78), (None, None, None)]
    kafka = spark.createDataFrame([({"topic-0": [(_b64(one),)], "topic-1": [(_b64(one),)]},)], "records map<string,array<struct<value:string>>>")
    assert envelopes.kafka_rows(kafka, shape).count() == 2
    assert set(envelopes.infer_payload_schema(spark, _b64(one)).fieldNames()) == set(one)


def test_json_bids(spark):
    at = {"n": 1436918427834, "t": "1436918427834", "iso": "2015-07-15T02:00:27.834+02:00", "z": "2015-07-15T00:00:27.834Z"}
    data = [_b64({"price": 5, "b_date_time": v, "auction": 1}) for v in at.values()]
    bad = [_b64(b'{"b_date_time":1436918427834,"auct'), _b64({"b_date_time": None}), _b64({"b_date_time": "unknown"}), _b64({}), "!!", "", None, _b64([1]), _b64({"b_date_time": "9" * 30})]
    rows = envelopes.json_bids(spark.createDataFrame([(d,) for d in data + bad], "data string"), "data").collect()
    assert [r["bid_ms"] for r in rows] == [1436918427834] * 4 + [None] * len(bad)
    assert rows[0]["bid"]["price"] == 5 and rows[4]["bid"] is None


# sinks


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_file_sinks_read_back(spark, test_table, tmp_path, kind):
    sink = from_name(kind.upper(), str(tmp_path / "out"))
    sink.write(test_table)
    sink.write(test_table)
    assert sorted(tuple(r) for r in sink.read(spark).select(*test_table.columns).collect()) == sorted(TEST_ROWS)


def test_other_sinks(spark, test_table, tmp_path):
    Sink().write(test_table)
    assert Sink().read(spark).count() == 0
    Sink("memory", "kept").write(test_table)
    assert Sink("memory", "kept").read(spark).count() == 8
    bids = generators.nexmark(spark, generators.Stream(seconds=130, events_per_second=10))["bid"]
    log = Sink("partitioned_csv", str(tmp_path / "log"))
    log.write(with_log_partitions(bids, "b_date_time"))
    assert sorted(p.name for p in (tmp_path / "log" / "dt=2015-07-15").iterdir()) == ["hm=00%3A00", "hm=00%3A01", "hm=00%3A02"]
    assert log.read(spark).count() == bids.count()
    for bad in (("nothing", "x"), ("parquet", None)):
        with pytest.raises(ValueError):
            Sink(*bad)


def test_log_has_a_file_for_each_minute(spark, tmp_path):
    bids = generators.nexmark(spark, generators.Stream(seconds=130, events_per_second=10))["bid"].repartition(4)
    for name, rows, minutes in (("even", bids, 3), ("hot", bids.where("minute(b_date_time) = 1"), 1)):
        log = Sink("partitioned_csv", str(tmp_path / name))
        log.write(with_log_partitions(rows, "b_date_time"))
        files = list((tmp_path / name).rglob("part-*.csv"))
        assert max(minutes, 2) <= len(files) <= minutes + 3  # four tasks meet at three places, which may lie inside a minute
        assert sorted(log.read(spark).select("auction", "bidder", "price").collect()) == sorted(rows.select("auction", "bidder", "price").collect())


def test_log_of_q10_is_read_by_few_tasks(spark, tmp_path):
    for name in ("bid", "auction", "person"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(100).write.parquet(str(tmp_path / f"{name}.parquet"))
    listing = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    read = flows.snk_q10(spark, str(tmp_path))
    assert len(read.inputFiles()) > 50 and read.rdd.getNumPartitions() <= 4
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == listing
    assert sorted(map(str, read.collect())) == sorted(map(str, auctions.QUERIES["nexmark_q10"](spark, str(tmp_path)).collect()))


# streams: files of a bounded stream in time order, run through, equal the batch result as far as the watermark has come


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    made = generators.nexmark(spark, generators.Stream(seconds=60, events_per_second=100))
    for name, df in made.items():
        time = {"bid": "b_date_time", "auction": "a_date_time", "person": "p_date_time"}[name]
        for i in range(6):
            part = df.where((F.col("epoch") >= 10 * i) & (F.col("epoch") < 10 * i + 10)).drop("epoch")
            part.coalesce(1).sortWithinPartitions(time).write.parquet(str(root / f"{name}{i}"))
            source = next((root / f"{name}{i}").glob("*.parquet"))
            (root / name).mkdir(exist_ok=True)
            source.rename(root / name / f"part{i}.parquet")
    return root


def _stream(spark, folder, name):
    path = str(folder / name)
    return files.stream(spark, path, spark.read.parquet(path).schema)


def _run(spark, df, tmp_path, name):
    query = Sink("memory", name).start(df, str(tmp_path / name))
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


LAST = generators.BASE_TIME_MS + 60_000


def test_tumbling_stream_equals_batch(spark, folder, tmp_path):
    got = _run(spark, streams.tumbling_counts(_stream(spark, folder, "bid"), "b_date_time", "10 seconds", "0 seconds", ["auction"]).select("window_start", "auction", "n"), tmp_path, "tumbling")
    bids = spark.read.parquet(str(folder / "bid")).withColumn("ms", millis(F.col("b_date_time")))
    want = windows.fixed_windows(bids, "ms", windows.tumbling_window(10), generators.BASE_TIME_MS, LAST).groupBy("window_start", "auction").count()
    done = max(r[0] for r in got)
    assert done >= LAST - 20_000 and sorted(got) == sorted(tuple(r) for r in want.where(F.col("window_start") <= done).collect())


def test_session_stream_equals_batch(spark, folder, tmp_path):
    got = _run(spark, streams.session_counts(_stream(spark, folder, "bid"), "bidder", "b_date_time", "2 seconds", "0 seconds"), tmp_path, "sessions")
    events = spark.read.parquet(str(folder / "bid")).select(F.col("bidder").alias("entity"), millis(F.col("b_date_time")).alias("ms"), F.col("bid_id").alias("record"))
    # events exactly the gap apart share a session in both
    want = {tuple(r) for r in sessions.cut(sessions.gap_tree(events), 2000).select("entity", "start_ms", "end_ms", "events").collect()}
    assert got and set(got) <= want and {w for w in want if w[2] + 2000 < LAST - 12_000} <= set(got)


def test_hot_items_and_highest_bids_in_a_stream(spark, folder, tmp_path):
    bids = spark.read.parquet(str(folder / "bid")).withColumn("ms", millis(F.col("b_date_time")))
    hot = _run(spark, streams.hot_items(_stream(spark, folder, "bid"), "10 seconds", "5 seconds", "0 seconds").select("window_start", "auction", "num"), tmp_path, "hot")
    counts = windows.fixed_windows(bids, "ms", windows.hopping_window(10, 5), generators.BASE_TIME_MS - 10_000, LAST).groupBy("window_start", "auction").count().collect()
    most = {}
    for w, _, n in counts:
        most[w] = max(most.get(w, 0), n)
    assert hot and set(hot) <= {(w, a, n) for w, a, n in counts if most[w] == n}
    high = _run(spark, streams.highest_bids(_stream(spark, folder, "bid"), "10 seconds", "0 seconds"), tmp_path, "high")
    best = {r[0]: r[1] for r in windows.fixed_windows(bids, "ms", windows.tumbling_window(10), generators.BASE_TIME_MS, LAST).groupBy("window_start").agg(F.max("price")).collect()}
    assert len(high) >= 4 and all(best[w] == price for w, _, _, price in high)


def test_bids_tied_for_the_highest_price_all_come_out(spark, tmp_path):
    rows = [(i % 7, i % 5, 100 + (i % 10 if i % 10 < 8 else 8), 500 * i) for i in range(120)]  # two of each ten share the highest price
    (tmp_path / "bid").mkdir()
    for i in range(3):
        df = spark.createDataFrame(rows[40 * i : 40 * i + 40], "auction bigint, bidder bigint, price bigint, ms bigint")
        df = df.withColumn("b_date_time", F.timestamp_millis(F.col("ms") + generators.BASE_TIME_MS).cast("timestamp_ntz")).drop("ms")
        df.coalesce(1).write.parquet(str(tmp_path / f"bid{i}"))
        next((tmp_path / f"bid{i}").glob("*.parquet")).rename(tmp_path / "bid" / f"part{i}.parquet")
    got = _run(spark, streams.highest_bids(_stream(spark, tmp_path, "bid"), "10 seconds", "0 seconds"), tmp_path, "tied")
    want = [(generators.BASE_TIME_MS + ms // 10_000 * 10_000, a, b, p) for a, b, p, ms in rows if p == 108]
    done = max(r[0] for r in got)
    assert done >= generators.BASE_TIME_MS + 40_000 and sorted(got) == sorted(w for w in want if w[0] <= done)


def test_joins_in_a_stream(spark, folder, tmp_path):
    a, b = (spark.read.parquet(str(folder / n)) for n in ("auction", "bid"))
    want = b.join(a, F.expr("auction = a_id AND b_date_time BETWEEN a_date_time AND expires")).select("bid_id", "a_id")
    joined = streams.interval_join(_stream(spark, folder, "auction"), _stream(spark, folder, "bid"), "1 minute", "10 minutes").select("bid_id", "a_id")
    assert sorted(_run(spark, joined, tmp_path, "joined")) == sorted(tuple(r) for r in want.collect())
    side = spark.range(1000, 1100).selectExpr("id AS key", "id * 2 AS value")
    got = _run(spark, streams.with_side_input(_stream(spark, folder, "bid"), side).select("bid_id", "value"), tmp_path, "side")
    assert sorted(got) == sorted(tuple(r) for r in b.join(side, F.col("auction") == F.col("key")).select("bid_id", "value").collect())


def test_anchored_stream_equals_batch(spark, folder, tmp_path):
    with_ms = _stream(spark, folder, "bid").withColumn("ms", millis(F.col("b_date_time")))
    got = _run(spark, streams.anchored_counts(with_ms, "bidder", "ms", 3000), tmp_path, "anchored")
    bids = spark.read.parquet(str(folder / "bid")).withColumn("ms", millis(F.col("b_date_time")))
    want = {tuple(r) for r in windows.anchored_windows(bids, "bidder", "ms", 3000).collect()}
    # a stream holds each bidder's last window back
    assert set(got) < want and len(want) - len(got) == len({w[0] for w in want})


def test_copies_in_a_stream(spark, folder, tmp_path):
    df = _stream(spark, folder, "bid")
    twice = df.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    got = _run(spark, streams.once(twice, ["bid_id"], "b_date_time", "10 seconds").select("bid_id"), tmp_path, "once")
    assert len(got) == len(set(got)) == spark.read.parquet(str(folder / "bid")).count()


def test_a_store_fed_by_a_stream(spark, folder, tmp_path):
    def events(df):
        return df.select(F.lit("bid").alias("src"), F.col("bid_id").cast("string").alias("rec_key"), millis(F.col("b_date_time")).alias("t_ms"), (millis(F.col("p_time")) + F.col("bid_id") % 7 * 2000).alias("arrival_ms"), F.col("price").alias("value"))

    store = str(tmp_path / "store")
    write = streams.store_batch(store, 4000, 10_000)
    query = events(_stream(spark, folder, "bid")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events(spark.read.parquet(str(folder / "bid")))
    write(events(spark.read.parquet(str(folder / "bid" / "part0.parquet"))), 0)  # a retry changes nothing
    whole = lateness.partials(lateness.judge(lateness.first_arrivals(batch), 4000, 10_000), period_ms=10_000)
    rows = lambda df: sorted(tuple(r) for r in lateness.combine(df).collect())
    got = rows(spark.read.parquet(store).drop("part"))
    assert got == rows(whole) and any(r[-1] for r in got)


def test_ranking_inside_batches(spark, folder, tmp_path):
    seen = []
    rank = lambda df: df.orderBy(F.desc("price"), "bid_id").limit(1)
    write = streams.ranked_in_batches(rank, lambda df, n: seen.append((n, df.first()["price"])))
    query = _stream(spark, folder, "bid").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert len(seen) == 6 and max(p for _, p in seen) == spark.read.parquet(str(folder / "bid")).agg(F.max("price")).first()[0]


# command line


def test_command_line(spark, capsys, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "local_session", lambda *a, **k: spark)
    for q in ("0", "3", "5", "9", "12", "13"):
        cli.main(["nexmark", "run", "-q", q, "-s", "20", "-e", "100", "--show", "2"])
    cli.main(["nexmark", "-q", "10", "-s", "3", "-e", "50", "--sink", "partitioned_csv", "--path", str(tmp_path / "log"), "--show", "0"])
    cli.main(["ysb", "-s", "20", "-e", "50", "--sink", "parquet", "--path", str(tmp_path / "ysb"), "--show", "1"])
    cli.main(["ops", "-s", "2", "-e", "50", "--times", "1"])
    cli.main(["tpch", "-q", "6", "--data", "/root/testdata/sf0.001", "--show", "1"])
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT 40 +\n 2 AS answer;\nSELECT nothing;\nquit\n"))
    cli.main(["sql"])
    out = capsys.readouterr().out
    assert "nexmark q5" in out and "op_sort" in out and "42" in out and "error:" in out
    with pytest.raises(SystemExit):
        cli.main(["nexmark", "-q", "99"])


def test_schema_types():
    assert isinstance(catalog.schema("bid")["price"].dataType, T.LongType)
