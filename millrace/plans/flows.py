"""Queries through readers, envelopes, sinks and streams: what goes through comes out as SQL over the tables says.

What is written on the way lies in the session's shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import catalog, runner
from millrace.catalog import table
from millrace.functions.times import HOUR_MS, millis
from millrace.operators import lateness, windows
from millrace.plans import auctions
from millrace.plans.auctions import ANCHORED, GAP, SIZE
from millrace.session import scratch
from millrace.sinks import Sink, from_name, with_log_partitions
from millrace.sources import envelopes, files
from millrace.spec import QuerySpec, contains
from millrace.streaming import queries as streams

LATENESS_MS = 30 * 60_000

# readers


def src_memory(spark: SparkSession, d: str) -> DataFrame:
    """Rows held by the driver, registered as a stream's table."""
    rows = [(k, 10 * k) for k in range(5)]
    catalog.register(spark, "nexmark", {"side_input": spark.createDataFrame(rows, catalog.schema("side_input"))})
    return spark.sql("SELECT key, value FROM side_input WHERE key > 1")


def src_empty(spark: SparkSession, d: str) -> DataFrame:
    """A registered stream without rows is an empty relation with its schema."""
    catalog.register(spark, "ysb")
    return spark.sql("SELECT count(*) AS n FROM ad_event JOIN campaign ON c_ad_id = ad_id")


def _nation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"), F.concat(F.lit("of "), "n_name").alias("n_comment"))


def src_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-delimited rows that end with a pipe."""
    path = scratch(spark)
    _nation(spark, d).select(F.concat(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", "n_comment"), F.lit("|")).alias("line")).write.text(path)
    return files.delimited(spark, path, catalog.schema("nation"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"


def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV with a header and a declared schema."""
    path = scratch(spark)
    _orders(spark, d).write.csv(path, header=True)
    return files.csv(spark, path, _ORDERS)


def src_csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """CSV whose schema is inferred."""
    path = scratch(spark)
    _orders(spark, d).write.csv(path, header=True)
    return files.csv(spark, path).select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_orderpriority")


def src_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts, one a line."""
    path = scratch(spark)
    _orders(spark, d).select(F.to_json(F.struct("*")).alias("line")).write.text(path)
    return files.json_lines(spark, path, _ORDERS)


_PAYLOAD = "event_id bigint, user_id bigint, event_type string"


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.base64(F.to_json(F.struct("event_id", "user_id", "event_type")).cast("binary")).alias("data"))


def src_kinesis(spark: SparkSession, d: str) -> DataFrame:
    """Records of batch events, each with a base64 payload."""
    record = F.array(F.struct(F.struct("data").alias("kinesis")))
    return envelopes.kinesis_rows(_payloads(spark, d).select(record.alias("Records")), _PAYLOAD)


def src_kafka(spark: SparkSession, d: str) -> DataFrame:
    """Records of topic events, by partition of the topic."""
    records = F.create_map(F.lit("topic-0"), F.array(F.struct(F.col("data").alias("value"))), F.lit("topic-1"), F.array(F.struct(F.col("data").alias("value"))))
    return envelopes.kafka_rows(_payloads(spark, d).select(records.alias("records")), _PAYLOAD)


def src_kinesis_bids(spark: SparkSession, d: str) -> DataFrame:
    """Bids in the records of a stream, with their times in any form; a record that can't be read has none."""
    return envelopes.json_bids(table(spark, d, "kinesis_record"), "data").select("sequence_number", "bid_ms", F.col("bid.price").alias("price")).where("bid_ms IS NOT NULL").distinct()


# sinks


def snk_blackhole(spark: SparkSession, d: str) -> DataFrame:
    Sink().write(_orders(spark, d))
    return Sink().read(spark)


def _through(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        sink = Sink(kind, scratch(spark))
        sink.write(_orders(spark, d).where("o_orderstatus = 'F'"))
        sink.write(_orders(spark, d))  # the last writer wins
        return sink.read(spark).select(*(F.col(c).cast(t) for c, t in (x.split() for x in _ORDERS.split(", "))))

    run.__doc__ = f"Rows written twice to {kind} and read back."
    return run


def snk_memory(spark: SparkSession, d: str) -> DataFrame:
    sink = Sink("memory", "kept_orders")
    sink.write(_orders(spark, d))
    return sink.read(spark)


def snk_log(spark: SparkSession, d: str) -> DataFrame:
    """Bids written into a log by day and minute, and read back."""
    sink = Sink("partitioned_csv", scratch(spark))
    bids = table(spark, d, "bid").where("b_date_time IS NOT NULL").select("bid_id", "auction", "price", "b_date_time").distinct()
    sink.write(with_log_partitions(bids, "b_date_time"))
    read = sink.read(spark, "bid_id bigint, auction bigint, price bigint, b_date_time timestamp_ntz, dt string, hm string")
    return read.groupBy("dt", "hm").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


def snk_q10(spark: SparkSession, d: str) -> DataFrame:
    """The log that q10 keeps: its projection written by day and minute, and read back whole."""
    sink = Sink("partitioned_csv", scratch(spark))
    sink.write(auctions.QUERIES["nexmark_q10"](spark, d))
    return sink.read(spark, "bid_id bigint, auction bigint, bidder bigint, price bigint, b_date_time timestamp_ntz, dt string, hm string")


# the interface


def api_sql(spark: SparkSession, d: str) -> DataFrame:
    """A specification of SQL with its table, run into a sink named by text."""
    spec = QuerySpec("golden", "SELECT max(c1) AS high, min(c2) AS low, c3 FROM test_table WHERE c2 < 99 GROUP BY c3 ORDER BY c3", {"test_table": _golden(spark)}, sink=from_name("BlackHole"))
    return runner.run_batch(spark, spec)


def _golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(90, 92.1, "a"), (90, 93.2, "a"), (91, 95.3, "d"), (101, 96.4, "b"), (92, 98.5, "b"), (102, 99.6, "d"), (93, 100.7, "c"), (103, 101.8, "c")], "c1 bigint, c2 double, c3 string")


def api_code(spark: SparkSession, d: str) -> DataFrame:
    """A specification of DataFrame code, with a window its body assumes."""
    spec = QuerySpec("code", lambda s: s.table("golden").where("c1 > 91").groupBy("c3").agg(F.count("*").alias("n")), {"golden": _golden(spark)}, windows.tumbling_window(10))
    return spec.plan(spark)


def api_plans(spark: SparkSession, d: str) -> DataFrame:
    """What plans are told to contain."""
    texts = {"scan": "SELECT * FROM golden", "grouped": "SELECT c3, count(*) AS n FROM golden GROUP BY c3", "sorted": "SELECT * FROM golden ORDER BY c1", "joined": "SELECT a.c1 FROM golden a JOIN golden b ON a.c1 = b.c1"}
    kinds = ("sort", "join", "aggregate")
    rows = [(k, *(contains(QuerySpec(k, t, {"golden": _golden(spark)}).plan(spark)._jdf.queryExecution().optimizedPlan().toString(), w) for w in kinds)) for k, t in texts.items()]
    return spark.createDataFrame(rows, "text string, sort boolean, join boolean, aggregate boolean")


def api_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the suites and how many columns they declare."""
    return spark.createDataFrame([(suite, t, len(catalog.schema(t))) for suite, tables in catalog.SUITES.items() for t in tables], "suite string, relation string, columns bigint")


def api_windows(spark: SparkSession, d: str) -> DataFrame:
    made = [windows.element_wise_window(), windows.tumbling_window(10), windows.hopping_window(10, 5), windows.sliding_window(10, 5), windows.session_window(10), windows.global_window(10), windows.stagger_window(10), windows.row_window(10)]
    return spark.createDataFrame([(i, w.kind, w.size, w.hop) for i, w in enumerate(made)], "n bigint, kind string, size bigint, hop bigint")


# streams: all input there is, in one run; results that the watermark has closed


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isfile(path):  # a stream of files reads a folder
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return stream.parquet(path)


def _bids(spark: SparkSession, d: str) -> DataFrame:
    return _source(spark, d, "bid").where("b_date_time IS NOT NULL")


def _run(spark: SparkSession, df: DataFrame, kind: str = "parquet") -> DataFrame:
    sink = Sink(kind, scratch(spark))
    sink.start(df, scratch(spark)).awaitTermination()
    return spark.read.schema(df.schema).format(kind).option("header", "true").load(sink.path)


def st_element_wise(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, streams.element_wise_counts(_bids(spark, d), "b_date_time", "0 seconds", ["auction"]).select("window_start", "auction", "n"))


def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, streams.tumbling_counts(_bids(spark, d), "b_date_time", "1 hour", "0 seconds", ["auction"]).select("window_start", "auction", "n"))


def st_csv(spark: SparkSession, d: str) -> DataFrame:
    """A stream into CSV files, read back with their header."""
    return _run(spark, streams.tumbling_counts(_bids(spark, d), "b_date_time", "1 hour", "0 seconds", ["auction"]).select("window_start", "auction", "n"), "csv")


def st_session(spark: SparkSession, d: str) -> DataFrame:
    bids = streams.once(_bids(spark, d).where("bidder IS NOT NULL"), ["bid_id"], "b_date_time", "0 seconds")
    counts = bids.groupBy(F.session_window("b_date_time", f"{GAP} milliseconds"), "bidder").agg(F.min("b_date_time").alias("a"), F.max("b_date_time").alias("b"), F.count("*").alias("events"))
    return _run(spark, counts.select("bidder", millis(F.col("a")).alias("start_ms"), millis(F.col("b")).alias("end_ms"), "events"))


def st_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Bids with their auction, both streams."""
    auctions = streams.once(_source(spark, d, "auction").where("a_date_time IS NOT NULL"), ["a_id"], "a_date_time", "0 seconds")
    bids = streams.once(_bids(spark, d), ["bid_id"], "b_date_time", "0 seconds")
    inside = F.expr("auction = a_id AND b_date_time BETWEEN a_date_time AND CAST(expires AS TIMESTAMP)")
    return _run(spark, bids.join(auctions, inside).select("bid_id", "a_id", "category"))


def st_side_input(spark: SparkSession, d: str) -> DataFrame:
    side = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("key"), F.col("p_size").cast("bigint").alias("value"))
    return _run(spark, streams.with_side_input(streams.once(_bids(spark, d), ["bid_id"], "b_date_time", "0 seconds"), side).select("bid_id", "value"))


def st_once(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, streams.once(_bids(spark, d), ["bid_id"], "b_date_time", "0 seconds").select("bid_id", "price"))


def st_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Anchored windows of each bidder but the last, which is still open."""
    bids = streams.once(_bids(spark, d), ["bid_id"], "b_date_time", "0 seconds").select("bidder", millis(F.col("b_date_time")).alias("ms"))
    return _run(spark, streams.anchored_counts(bids, "bidder", "ms", SIZE))


def st_late_store(spark: SparkSession, d: str) -> DataFrame:
    """Hourly results of a store that a stream feeds batch by batch."""
    store = scratch(spark)
    first = table(spark, d, "bid").groupBy("bid_id").agg(F.min("p_time").alias("first_at"))
    bids = streams.once(_source(spark, d, "bid"), ["bid_id"], "p_time", "0 seconds").drop("p_time").join(first, "bid_id")
    events = bids.select(F.lit("bid").alias("src"), F.col("bid_id").cast("string").alias("rec_key"), millis(F.col("b_date_time")).alias("t_ms"), millis(F.col("first_at")).alias("arrival_ms"), F.col("price").alias("value"))
    query = events.writeStream.foreachBatch(streams.store_batch(store, LATENESS_MS)).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    hours = lateness.combine(spark.read.parquet(store))
    return hours.select(F.timestamp_millis(F.col("period") * HOUR_MS).cast("timestamp_ntz").alias("hour_start"), "n", "total", "corrections", "refused")


def _last_batch(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What a stream's state tells in mode complete or update, each key's last row."""
    path = scratch(spark)
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return streams.tumbling_counts(_bids(spark, d), "b_date_time", "1 hour", "0 seconds", []).select("window_start", "n")


def st_throttled(spark: SparkSession, d: str) -> DataFrame:
    """A stream that starts a batch at fixed times."""
    sink = Sink("parquet", scratch(spark))
    query = sink.start(_bids(spark, d).select("bid_id", "price"), scratch(spark), every="200 milliseconds")
    query.processAllAvailable()
    query.stop()
    return sink.read(spark)


def st_complete(spark: SparkSession, d: str) -> DataFrame:
    """Complete mode: the last batch holds every window, closed or not."""
    told = _last_batch(spark, _hourly(spark, d), "complete")
    return told.join(told.agg(F.max("batch").alias("batch")), "batch").select("window_start", "n")


def st_update(spark: SparkSession, d: str) -> DataFrame:
    """Update mode: a window's last row stands."""
    return _last_batch(spark, _hourly(spark, d), "update").groupBy("window_start").agg(F.max_by("n", "batch").alias("n"))


def st_late_drops(spark: SparkSession, d: str) -> DataFrame:
    """Rows behind the watermark are dropped and counted: a second run brings the same rows again, after every window has closed."""
    source, out, state = scratch(spark), scratch(spark), scratch(spark)
    bids = table(spark, d, "bid").where("b_date_time IS NOT NULL").select("auction", "b_date_time")
    dropped = []
    for mode in ("errorifexists", "append"):
        bids.write.mode(mode).parquet(source)
        stream = spark.readStream.schema(bids.schema).parquet(source)
        query = Sink("parquet", out).start(streams.tumbling_counts(stream, "b_date_time", "1 hour", "0 seconds", []).select("window_start", "n"), state)
        query.awaitTermination()
        dropped.append(sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]))
    closed = spark.read.parquet(out).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return closed.select(F.col("n").alias("counted"), F.lit(dropped[0]).cast("bigint").alias("dropped_first"), (F.lit(dropped[1]) > 0).alias("dropped_later"))


QUERIES = {
    f.__name__: f
    for f in (
        src_memory, src_empty, src_delimited, src_csv, src_csv_inferred, src_json_lines, src_kinesis, src_kafka, src_kinesis_bids,
        snk_blackhole, snk_memory, snk_log, snk_q10,
        st_element_wise, st_tumbling, st_csv, st_session, st_interval_join, st_side_input, st_once, st_anchored, st_late_store, st_throttled, st_complete, st_update, st_late_drops,
        api_sql, api_code, api_plans, api_schemas, api_windows,
    )
} | {f"snk_{kind}": _through(kind) for kind in ("parquet", "csv", "json", "orc")}

_ALL_ORDERS = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_orderpriority FROM orders"
_EVENTS = "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, event_type FROM events"
_STREAM = "WITH b AS (SELECT bid_id, auction, bidder, price, b_date_time, epoch_ms(b_date_time) AS ms FROM bid WHERE b_date_time IS NOT NULL), one AS (SELECT DISTINCT * FROM b), m AS (SELECT max(ms) AS mark FROM b)"


def _windows(size: int, keys: str) -> str:
    at = f"ms - ms % {size}"
    return _STREAM + f" SELECT {at} AS window_start{keys}, count(*) AS n FROM b WHERE {at} + {size} <= (SELECT mark FROM m) GROUP BY ALL"


SQL = {
    "src_memory": "SELECT k AS key, 10 * k AS value FROM range(5) r(k) WHERE k > 1",
    "src_empty": "SELECT 0 AS n",
    "src_delimited": "SELECT n_nationkey, n_name, n_regionkey, 'of ' || n_name AS n_comment FROM nation",
    "src_kinesis": _EVENTS,
    "src_kafka": f"{_EVENTS} UNION ALL {_EVENTS}",
    "src_kinesis_bids": """WITH texts AS (SELECT sequence_number, CASE WHEN json_valid(decode(TRY(from_base64(data)))) THEN decode(TRY(from_base64(data))) END AS j FROM kinesis_record),
parsed AS (SELECT sequence_number, j ->> '$.b_date_time' AS s, TRY_CAST(j ->> '$.price' AS BIGINT) AS price FROM texts WHERE j IS NOT NULL),
timed AS (SELECT sequence_number, CASE WHEN regexp_full_match(s, '-?[0-9]{1,18}') THEN CAST(s AS BIGINT) WHEN s LIKE '____-__-__T%' THEN epoch_ms(TRY_CAST(s AS TIMESTAMPTZ)) END AS bid_ms, price FROM parsed)
SELECT DISTINCT * FROM timed WHERE bid_ms IS NOT NULL""",
    "snk_blackhole": "SELECT CAST(NULL AS VARCHAR) AS nothing WHERE FALSE",
    "snk_log": "SELECT strftime(b_date_time, '%Y-%m-%d') AS dt, strftime(b_date_time, '%H:%M') AS hm, count(*) AS n, CAST(sum(price) AS BIGINT) AS price FROM (SELECT DISTINCT bid_id, auction, price, b_date_time FROM bid WHERE b_date_time IS NOT NULL) GROUP BY 1, 2",
    "snk_q10": auctions.SQL["nexmark_q10"],
    "api_sql": "SELECT * FROM (VALUES (90, 92.1::DOUBLE, 'a'), (101, 96.4, 'b'), (91, 95.3, 'd')) t(high, low, c3)",
    "api_code": "SELECT * FROM (VALUES ('b', 2), ('d', 1), ('c', 2)) t(c3, n)",
    "api_plans": "SELECT text, text = 'sorted' AS sort, text = 'joined' AS \"join\", text = 'grouped' AS aggregate FROM (VALUES ('scan'), ('grouped'), ('sorted'), ('joined')) t(text)",
    "api_schemas": """SELECT * FROM (VALUES ('nexmark', 'person', 7), ('nexmark', 'auction', 9), ('nexmark', 'bid', 4), ('nexmark', 'side_input', 2), ('ysb', 'ad_event', 7), ('ysb', 'campaign', 2),
  ('tpch', 'part', 9), ('tpch', 'supplier', 7), ('tpch', 'partsupp', 5), ('tpch', 'customer', 8), ('tpch', 'orders', 9), ('tpch', 'lineitem', 16), ('tpch', 'nation', 4), ('tpch', 'region', 3)) t(suite, relation, columns)""",
    "api_windows": """SELECT * FROM (VALUES (0, 'element', 1000, NULL), (1, 'tumbling', 10000, NULL), (2, 'hopping', 10000, 5000), (3, 'hopping', 10000, 5000), (4, 'session', 10000, NULL),
  (5, 'anchored', 10000, NULL), (6, 'anchored', 10000, NULL), (7, 'rows', 10, NULL)) t(n, kind, size, hop)""",
    "st_throttled": "SELECT bid_id, price FROM bid WHERE b_date_time IS NOT NULL",
    "st_element_wise": _windows(1000, ", auction"),
    "st_tumbling": _windows(HOUR_MS, ", auction"),
    "st_csv": _windows(HOUR_MS, ", auction"),
    "st_session": _STREAM
    + f""", s AS (SELECT bidder, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY bidder ORDER BY ms, bid_id ROWS UNBOUNDED PRECEDING) AS part FROM (
    SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY bidder ORDER BY ms, bid_id) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM one WHERE bidder IS NOT NULL)) GROUP BY bidder, part)
SELECT * FROM s WHERE end_ms + {GAP} <= (SELECT max(ms) FROM one WHERE bidder IS NOT NULL)""",
    "st_interval_join": _STREAM + " SELECT bid_id, a_id, category FROM one JOIN (SELECT DISTINCT a_id, category, a_date_time, expires FROM auction WHERE a_date_time IS NOT NULL) a ON a_id = auction AND b_date_time BETWEEN a_date_time AND expires",
    "st_side_input": _STREAM + " SELECT bid_id, CAST(p_size AS BIGINT) AS value FROM one JOIN part ON p_partkey = auction",
    "st_once": _STREAM + " SELECT bid_id, price FROM one",
    "st_anchored": f"SELECT bidder, window_start, last_ms, events FROM (SELECT *, row_number() OVER (PARTITION BY bidder ORDER BY window_start DESC) AS back FROM ({ANCHORED})) WHERE back > 1",
    "st_late_store": f"""WITH one AS (SELECT bid_id, epoch_ms(min(b_date_time)) AS t, epoch_ms(min(p_time)) AS arr, max(price) AS value FROM bid GROUP BY 1 HAVING t IS NOT NULL),
late AS (SELECT *, t - t % {HOUR_MS} AS h, arr > h + {HOUR_MS} + {LATENESS_MS} AS refused FROM one)
SELECT make_timestamp(h * 1000) AS hour_start, count(*) FILTER (NOT refused) AS n, CAST(coalesce(sum(value) FILTER (NOT refused), 0) AS BIGINT) AS total,
  count(*) FILTER (NOT refused AND arr >= h + {HOUR_MS}) AS corrections, count(*) FILTER (refused) AS refused FROM late GROUP BY h""",
    "st_complete": _STREAM + f" SELECT ms - ms % {HOUR_MS} AS window_start, count(*) AS n FROM b GROUP BY 1",
    "st_update": _STREAM + f" SELECT ms - ms % {HOUR_MS} AS window_start, count(*) AS n FROM b GROUP BY 1",
    "st_late_drops": _STREAM + f" SELECT count(*) AS counted, 0 AS dropped_first, TRUE AS dropped_later FROM b WHERE ms - ms % {HOUR_MS} + {HOUR_MS} <= (SELECT mark FROM m)",
} | dict.fromkeys(("src_csv", "src_csv_inferred", "src_json_lines", "snk_memory", "snk_parquet", "snk_csv", "snk_json", "snk_orc"), _ALL_ORDERS)
