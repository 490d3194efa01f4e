"""The auction stream suite (q0 to q13) and the ad stream query, over their tables read as bounded streams.

Repeated rows are one event (see the reading rules of the data). A query that runs once per epoch or window carries the epoch
or window start in its result and in every join and grouping, since nothing outlives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions.times import millis
from millrace.operators import windows
from millrace.plans.dialect import OTHER, Dialect, query, render

#: The stream's base time (2015-07-15T00:00:00Z) and the sizes the suite is run with here.
BASE = 1_436_918_400_000
EPOCH = 3_600_000
SIZE = 600_000
GAP = 600_000


def _clean(x: Dialect, bid: str = "auction, bidder, price") -> str:
    """Records without copies. bid: the columns of bids that are used besides their number and time; fewer make copies cheaper to tell."""
    e = lambda c: f"CAST({x.floor_to(x.ms(c), x.epoch)} AS BIGINT) AS epoch"
    return f"""
WITH bids AS (SELECT *, {x.ms("b_date_time")} AS b_ms, {e("b_date_time")} FROM (SELECT DISTINCT bid_id, {bid}, b_date_time FROM bid) raw),
auctions AS (SELECT DISTINCT a_id, item_name, a_date_time, expires, seller, category, {x.ms("a_date_time")} AS a_ms, {e("a_date_time")} FROM auction),
persons AS (SELECT DISTINCT p_id, name, city, lower(trim(state)) AS state, {x.ms("p_date_time")} AS p_ms, {e("p_date_time")} FROM person),
whole AS (SELECT {x.floor_to("max(b_ms)", x.hop)} + {x.hop} AS stream_end FROM bids)"""


def _with(body, bid: str = "auction, bidder, price"):
    return lambda x: _clean(x, bid) + body(x)


def _inside(x: Dialect) -> str:
    return "b.auction = a.a_id AND b.epoch = a.epoch AND b.b_date_time BETWEEN a.a_date_time AND a.expires"


def _q4(x: Dialect) -> str:
    return f""", best AS (SELECT a.epoch, a.a_id, a.category, max(b.price) AS final FROM auctions a JOIN bids b ON {_inside(x)} GROUP BY a.epoch, a.a_id, a.category)
SELECT epoch, category, round(avg(final), 4) AS avg_final FROM best WHERE category IS NOT NULL GROUP BY epoch, category"""


def _q5(x: Dialect) -> str:
    return f""", placed AS (SELECT auction, {x.hops("b_ms", BASE, x.size, x.hop)} AS window_start FROM bids WHERE auction IS NOT NULL AND b_ms IS NOT NULL),
counted AS (SELECT window_start, auction, count(*) AS num FROM placed GROUP BY window_start, auction),
top AS (SELECT window_start, max(num) AS most FROM counted GROUP BY window_start)
SELECT c.window_start, c.auction, c.num FROM counted c JOIN top t ON t.window_start = c.window_start AND t.most = c.num
WHERE c.window_start >= {BASE} AND c.window_start + {x.size} <= (SELECT stream_end FROM whole)"""


def _won(x: Dialect) -> str:
    return f""", ordered AS (SELECT a.epoch, a.seller, a.a_id, b.price, b.b_date_time, b.bid_id,
  row_number() OVER (PARTITION BY a.epoch, a.a_id ORDER BY b.price DESC NULLS LAST, b.b_date_time, b.bid_id) AS nth
  FROM auctions a JOIN bids b ON {_inside(x)} WHERE b.price IS NOT NULL AND a.seller IS NOT NULL),
recent AS (SELECT epoch, seller, price, row_number() OVER (PARTITION BY epoch, seller ORDER BY b_date_time DESC, a_id DESC) AS back FROM ordered WHERE nth = 1)"""


def _tumbled(x: Dialect, ms: str, columns: str, source: str, size: int | None = None) -> str:
    return f"SELECT {columns}, {x.floor_to(f'({ms} - {BASE})', size or x.size)} + {BASE} AS window_start FROM {source} WHERE {ms} IS NOT NULL"


def _q7(x: Dialect) -> str:
    return f""", placed AS ({_tumbled(x, "b_ms", "auction, bidder, price, b_date_time", "bids")}),
top AS (SELECT window_start, max(price) AS most FROM placed GROUP BY window_start)
SELECT p.window_start, p.auction, p.price, p.bidder, p.b_date_time FROM placed p JOIN top t ON t.window_start = p.window_start AND t.most = p.price
WHERE p.window_start >= {BASE} AND p.window_start + {x.size} <= (SELECT stream_end FROM whole)"""


def _q8(x: Dialect) -> str:
    return f""", newcomers AS (SELECT DISTINCT p_id, name, window_start FROM ({_tumbled(x, "p_ms", "p_id, name", "persons", x.long)}) p),
sellers AS (SELECT DISTINCT seller, window_start FROM ({_tumbled(x, "a_ms", "seller", "auctions", x.long)}) a)
SELECT n.p_id, n.name, n.window_start FROM newcomers n JOIN sellers s ON s.seller = n.p_id AND s.window_start = n.window_start"""


def _q9(x: Dialect) -> str:
    return f""", best AS (SELECT a.epoch, a.a_id, max(b.price) AS final FROM auctions a JOIN bids b ON {_inside(x)} GROUP BY a.epoch, a.a_id)
SELECT b.epoch, b.auction, b.bidder, b.price, b.b_date_time FROM best w JOIN bids b ON b.auction = w.a_id AND b.price = w.final AND b.epoch = w.epoch"""


def _q9_first(x: Dialect) -> str:
    return _won(x) + " SELECT epoch, a_id AS auction, bid_id, price, b_date_time FROM ordered WHERE nth = 1"


def _ads(x: Dialect) -> str:
    return f"""
WITH ads AS (SELECT DISTINCT {x.uuid("c_ad_id")} AS ad, {x.uuid("campaign_id")} AS campaign FROM campaign),
views AS (SELECT DISTINCT {x.uuid("user_id")} AS u, {x.uuid("page_id")} AS pg, {x.uuid("ad_id")} AS ad, lower(trim(ad_type)) AS kind, lower(trim(event_type)) AS event_type, event_time, ip_address FROM ad_event WHERE event_time IS NOT NULL)
SELECT a.campaign AS campaign_id, {x.floor_to(x.ms("v.event_time") + f" - {BASE}", x.size)} + {BASE} AS window_start, count(*) AS n
FROM views v JOIN ads a ON a.ad = v.ad WHERE v.event_type = 'view' GROUP BY 1, 2"""


TEXTS = {
    "nexmark_q0": _with(lambda x: " SELECT bid_id, auction, bidder, price, b_date_time FROM bids"),
    "nexmark_q1": _with(lambda x: " SELECT bid_id, auction, bidder, round(CAST(0.908 AS DOUBLE) * price, 3) AS price, b_date_time FROM bids"),
    "nexmark_q2": _with(lambda x: " SELECT bid_id, auction, price FROM bids WHERE auction % 123 = 0", "auction, price"),
    "nexmark_q3": _with(lambda x: f" SELECT p.name, p.city, p.state, a.a_id, a.epoch FROM auctions a JOIN persons p ON p.p_id = a.seller AND {x.floor_to('p.epoch', x.long)} = {x.floor_to('a.epoch', x.long)} WHERE a.category = 10 AND p.state IN ('or', 'id', 'ca')"),
    "nexmark_q4": _with(_q4, "auction, price"),
    "nexmark_q5": _with(_q5, "auction"),
    "nexmark_q6": _with(lambda x: _won(x) + " SELECT epoch, seller, round(avg(price), 4) AS avg_price FROM recent WHERE back <= 10 GROUP BY epoch, seller", "auction, price"),
    "nexmark_q6_running": _with(
        lambda x: _won(x)
        + """ SELECT seller, a_id, round(avg(price) OVER (PARTITION BY seller ORDER BY b_date_time, a_id, epoch ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 4) AS avg_price FROM ordered WHERE nth = 1"""
    ),
    "nexmark_q6_latest": _with(
        lambda x: f""", sold AS (SELECT a.epoch, a.seller, a.a_id, max(b.price) AS final, max(b.b_date_time) AS last_at FROM auctions a JOIN bids b ON {_inside(x)} WHERE a.seller IS NOT NULL GROUP BY a.epoch, a.seller, a.a_id),
recent AS (SELECT *, row_number() OVER (PARTITION BY epoch, seller ORDER BY last_at DESC NULLS LAST, a_id DESC) AS back FROM sold)
SELECT epoch, seller, round(avg(final), 4) AS avg_final FROM recent WHERE back <= 10 GROUP BY epoch, seller"""
    ),
    "nexmark_q7": _with(_q7),
    "nexmark_q8": _with(_q8),
    "nexmark_q9": _with(_q9),
    "nexmark_q9_first": _with(_q9_first, "auction, price"),
    "nexmark_q10": _with(lambda x: f" SELECT bid_id, auction, bidder, price, b_date_time, {x.text('b_date_time', 'yyyy-MM-dd')} AS dt, {x.text('b_date_time', 'HH:mm')} AS hm FROM bids"),
    "nexmark_q12_aligned": _with(lambda x: f" SELECT bidder, window_start, count(*) AS bids FROM ({_tumbled(x, 'b_ms', 'bidder', 'bids')}) w WHERE bidder IS NOT NULL GROUP BY bidder, window_start", "bidder"),
    "nexmark_q13": _with(lambda x: " SELECT b.bid_id, b.auction, b.bidder, b.price, b.b_date_time, CAST(s.p_size AS BIGINT) AS value FROM bids b JOIN part s ON s.p_partkey = b.auction"),
    "nexmark_q13_mod": _with(lambda x: " SELECT b.bid_id, b.auction, b.bidder, b.price, b.b_date_time, CAST(s.p_size AS BIGINT) AS value FROM bids b JOIN part s ON s.p_partkey = mod(b.auction, 10000)"),
    "ysb": _ads,
}


def _bids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bid").select("bid_id", "bidder", millis(F.col("b_date_time")).alias("ms"))


def nexmark_q11(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each bidder."""
    return windows.session_windows(_bids(spark, d), "bidder", "ms", "bid_id", GAP)


def nexmark_q12(spark: SparkSession, d: str) -> DataFrame:
    """Windows by processing time, the time a bid first arrives: they begin at a bidder's first arrival."""
    first = table(spark, d, "bid").groupBy("bid_id").agg(F.max("bidder").alias("bidder"), F.min(millis(F.col("p_time"))).alias("ms"))
    return windows.anchored_windows(first, "bidder", "ms", SIZE)


def nexmark_q12_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Windows that begin at a bidder's first bid."""
    return windows.anchored_windows(_bids(spark, d).distinct(), "bidder", "ms", SIZE)


_SESSIONS = f"""
SELECT bidder, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY bidder ORDER BY ms, bid_id) AS part FROM (
    SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY bidder ORDER BY ms, bid_id) <= {GAP} THEN 0 ELSE 1 END AS fresh
    FROM (SELECT DISTINCT bid_id, bidder, epoch_ms(b_date_time) AS ms FROM bid WHERE bidder IS NOT NULL AND b_date_time IS NOT NULL)))
GROUP BY bidder, part"""

ANCHORED = f"""
WITH RECURSIVE t AS (SELECT bidder, ms, count(*) AS n FROM (SELECT DISTINCT bid_id, bidder, epoch_ms(b_date_time) AS ms FROM bid WHERE bidder IS NOT NULL AND b_date_time IS NOT NULL) GROUP BY 1, 2),
anchors AS (
  SELECT bidder, min(ms) AS window_start FROM t GROUP BY 1
  UNION ALL
  SELECT a.bidder, (SELECT min(t.ms) FROM t WHERE t.bidder = a.bidder AND t.ms > a.window_start + {SIZE}) FROM anchors a
  WHERE EXISTS (SELECT 1 FROM t WHERE t.bidder = a.bidder AND t.ms > a.window_start + {SIZE}))
SELECT a.bidder, a.window_start, max(t.ms) AS last_ms, CAST(sum(t.n) AS BIGINT) AS events FROM anchors a JOIN t ON t.bidder = a.bidder AND t.ms BETWEEN a.window_start AND a.window_start + {SIZE} GROUP BY 1, 2"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", millis(F.col("ts")).alias("ms"))


def sw_elementwise(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(windows.epoch(F.col("ms"), EPOCH).alias("epoch"), "event_type").agg(F.count("*").alias("n"))


def sw_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    base, end = windows.bounds(e, "ms", EPOCH)
    return windows.fixed_windows(e, "ms", windows.tumbling_window(7 * 3600), base, end).groupBy("window_start", "event_type").agg(F.count("*").alias("n"))


def sw_hopping(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    base, end = windows.bounds(e, "ms", EPOCH)
    return windows.fixed_windows(e, "ms", windows.hopping_window(7 * 3600, 3 * 3600), base, end).groupBy("window_start").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def sw_session(spark: SparkSession, d: str) -> DataFrame:
    return windows.session_windows(_events(spark, d), "user_id", "ms", "event_id", 6 * 3_600_000)


def sw_session_drop_open(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return windows.session_windows(e, "user_id", "ms", "event_id", 6 * 3_600_000, drop_open=windows.bounds(e, "ms", EPOCH)[1])


def sw_anchored(spark: SparkSession, d: str) -> DataFrame:
    return windows.anchored_windows(_events(spark, d), "user_id", "ms", 24 * 3_600_000)


def sw_anchored_drop_open(spark: SparkSession, d: str) -> DataFrame:
    """Anchored windows that were over when the stream ended."""
    e = _events(spark, d)
    return windows.anchored_windows(e, "user_id", "ms", 24 * 3_600_000, drop_open=windows.bounds(e, "ms", EPOCH)[1])


def sw_rows(spark: SparkSession, d: str) -> DataFrame:
    return windows.row_windows(_events(spark, d), ["ms", "event_id"], 1000).groupBy("window_number").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("event_id").alias("max_id"))


_E = f"WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), b AS (SELECT min(ms) - min(ms) % {EPOCH} AS base, max(ms) - max(ms) % {EPOCH} + {EPOCH} AS fin FROM e)"
_USER_SESSIONS = _E + f"""
, s AS (SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS part FROM (
    SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) <= {6 * EPOCH} THEN 0 ELSE 1 END AS fresh FROM e)) GROUP BY user_id, part)
SELECT user_id, start_ms, end_ms, events FROM s"""

_USER_WINDOWS = ANCHORED.replace("(SELECT DISTINCT bid_id, bidder, epoch_ms(b_date_time) AS ms FROM bid WHERE bidder IS NOT NULL AND b_date_time IS NOT NULL)", "(SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events)").replace("bidder", "user_id").replace(f"+ {SIZE}", f"+ {24 * EPOCH}")

QUERIES = {k: query(v) for k, v in TEXTS.items()} | {
    f.__name__: f for f in (nexmark_q11, nexmark_q12, nexmark_q12_anchored, sw_elementwise, sw_tumbling, sw_hopping, sw_session, sw_session_drop_open, sw_anchored, sw_anchored_drop_open, sw_rows)
}

SQL = {k: render(v, OTHER) for k, v in TEXTS.items()} | {
    "nexmark_q11": _SESSIONS,
    "nexmark_q12": ANCHORED.replace("(SELECT DISTINCT bid_id, bidder, epoch_ms(b_date_time) AS ms FROM bid WHERE bidder IS NOT NULL AND b_date_time IS NOT NULL)", "(SELECT bid_id, bidder, epoch_ms(min(p_time)) AS ms FROM bid WHERE bidder IS NOT NULL GROUP BY 1, 2)"),
    "nexmark_q12_anchored": ANCHORED,
    "sw_elementwise": _E + f" SELECT ms // {EPOCH} AS epoch, event_type, count(*) AS n FROM e GROUP BY 1, 2",
    "sw_tumbling": _E + f" SELECT base + (ms - base) // {7 * EPOCH} * {7 * EPOCH} AS window_start, event_type, count(*) AS n FROM e, b WHERE base + (ms - base) // {7 * EPOCH} * {7 * EPOCH} + {7 * EPOCH} <= fin GROUP BY 1, 2",
    "sw_hopping": _E + f""", g AS (SELECT unnest(range(base, fin - {7 * EPOCH} + 1, {3 * EPOCH})) AS window_start FROM b)
SELECT window_start, count(*) AS n, count(DISTINCT user_id) AS users FROM g JOIN e ON ms >= window_start AND ms < window_start + {7 * EPOCH} GROUP BY 1""",
    "sw_session": _USER_SESSIONS,
    "sw_session_drop_open": _USER_SESSIONS + f" WHERE end_ms + {6 * EPOCH} < (SELECT fin FROM b)",
    "sw_anchored_drop_open": _E + ", w AS (" + _USER_WINDOWS + f") SELECT * FROM w WHERE window_start + {24 * EPOCH} < (SELECT fin FROM b)",
    "sw_anchored": _USER_WINDOWS,
    "sw_rows": _E + " SELECT (row_number - 1) // 1000 AS window_number, count(*) AS n, min(ms) AS first_ms, max(event_id) AS max_id FROM (SELECT *, row_number() OVER (ORDER BY ms, event_id) AS row_number FROM e) GROUP BY 1",
}
