"""Queries of the record problems (references, deliveries, skew, lateness, sessions) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions.normal import bare_uuid, dashed_uuid, stripped
from millrace.functions.times import HOUR_MS, day_text, floor_div, millis
from millrace.operators import balance, deliveries, lateness, references, sessions
from millrace.session import cut_lineage
from millrace.sources.envelopes import json_bids

LATENESS_MS = 30 * 60_000
PAUSE_MS = 600_000
HEAVY_PERCENT = 4

_RELATIONS = {0: ("bid", "auction"), 1: ("auction", "seller"), 2: ("ad_event", "ad_id")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    bid, auction, person, ad, campaign, removal = (table(spark, d, t) for t in ("bid", "auction", "person", "ad_event", "campaign", "removal"))
    rel = lambda n: F.lit(n).alias("rel")
    ads = cut_lineage(  # written once, as it is both numbered and read twice
        ad.select(bare_uuid(F.col("ad_id")).alias("id"), millis(F.col("event_time")).alias("t_ms"))
        .where("id IS NOT NULL AND t_ms IS NOT NULL")
        .groupBy("id", floor_div(F.col("t_ms"), HOUR_MS).alias("hour"))
        .agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    )
    known_ads = campaign.select(bare_uuid(F.col("c_ad_id")).alias("id"))
    gone_ads = removal.where("entity = 'ad'").select(bare_uuid(F.col("entity_key")).alias("id"), millis(F.col("removed_at")).alias("gone_ms"))
    codes = references.dictionary(ads.select("id").unionByName(known_ads).unionByName(gone_ads.select("id")))
    code = F.col("code").alias("key")

    refs = (
        bid.select(rel(0), F.col("auction").alias("key"), millis(F.col("b_date_time")).alias("t_ms"))
        .unionByName(auction.select(rel(1), F.col("seller").alias("key"), millis(F.col("a_date_time")).alias("t_ms")))
        .unionByName(ads.join(codes, "id").select(rel(2), code, F.explode(F.array("a", "b")).alias("t_ms")))
    )
    parents = (
        auction.select(rel(0), F.col("a_id").alias("key"), millis(F.col("a_date_time")).alias("born_ms"))
        .unionByName(person.select(rel(1), F.col("p_id").alias("key"), millis(F.col("p_date_time")).alias("born_ms")))
        .unionByName(known_ads.join(codes, "id").select(rel(2), code, F.lit(None).cast("long").alias("born_ms")))
    )
    number = F.expr("try_cast(entity_key AS BIGINT)")
    removals = removal.where("entity IN ('auction', 'person')").select(
        F.when(F.col("entity") == "auction", 0).otherwise(1).alias("rel"), number.alias("key"), millis(F.col("removed_at")).alias("gone_ms")
    ).unionByName(gone_ads.join(codes, "id").select(rel(2), code, "gone_ms"))

    found = references.orphans(refs, parents, removals)
    src, field = (F.element_at(F.array(*(F.lit(_RELATIONS[n][i]) for n in _RELATIONS)), F.col("rel") + 1) for i in (0, 1))
    numbers = found.where("rel != 2").withColumn("ref_key", F.col("key").cast("string"))
    texts = found.where("rel = 2").join(codes.withColumnRenamed("code", "key"), "key").withColumn("ref_key", dashed_uuid(F.col("id"))).drop("id")
    return numbers.unionByName(texts).select(src.alias("src"), field.alias("field"), "ref_key", day_text(F.col("day")).alias("ref_day"), "kind")


def p2_orphans_by_day(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("src", "field", "ref_day", "kind").agg(F.count("*").alias("n_keys"))


_UUID = "translate(lower({}), '-{{}} ' || chr(9) || chr(10) || chr(13), '')"


def _uuid(column: str) -> str:
    return f"CASE WHEN length({_UUID.format(column)}) = 32 THEN {_UUID.format(column)} END"


_P2 = f"""
WITH refs AS (
  SELECT 'bid' AS src, 'auction' AS field, CAST(auction AS VARCHAR) AS k, b_date_time AS t, 'auction' AS entity FROM bid
  UNION ALL SELECT 'auction', 'seller', CAST(seller AS VARCHAR), a_date_time, 'person' FROM auction
  UNION ALL SELECT 'ad_event', 'ad_id', {_uuid("ad_id")}, event_time, 'ad' FROM ad_event),
target AS (
  SELECT entity, k, min(t) AS born FROM (
    SELECT 'auction' AS entity, CAST(a_id AS VARCHAR) AS k, a_date_time AS t FROM auction
    UNION ALL SELECT 'person', CAST(p_id AS VARCHAR), p_date_time FROM person
    UNION ALL SELECT 'ad', {_uuid("c_ad_id")}, NULL FROM campaign) GROUP BY 1, 2),
gone AS (
  SELECT entity, CASE WHEN entity = 'ad' THEN {_uuid("entity_key")} ELSE CAST(TRY_CAST(entity_key AS BIGINT) AS VARCHAR) END AS k, min(removed_at) AS gone
  FROM removal GROUP BY 1, 2),
judged AS (
  SELECT r.src, r.field, r.k, strftime(r.t, '%Y-%m-%d') AS ref_day,
    CASE WHEN g.gone <= r.t THEN 'deleted' WHEN x.k IS NULL AND g.k IS NULL THEN 'missing' WHEN x.born > r.t THEN 'later' END AS kind
  FROM refs r LEFT JOIN target x ON x.entity = r.entity AND x.k = r.k LEFT JOIN gone g ON g.entity = r.entity AND g.k = r.k
  WHERE r.k IS NOT NULL AND r.t IS NOT NULL),
found AS (
  SELECT DISTINCT src, field, CASE WHEN field = 'ad_id' THEN k[1:8] || '-' || k[9:12] || '-' || k[13:16] || '-' || k[17:20] || '-' || k[21:32] ELSE k END AS ref_key, ref_day, kind
  FROM judged WHERE kind IS NOT NULL)
"""


def _payload(spark: SparkSession, d: str) -> deliveries.Deliveries:
    payload = table(spark, d, "payload")
    return deliveries.split_deliveries(payload, [F.lower(stripped(F.col("qid"))), F.col("seq_num"), F.col("seq_len")], ["received_at"], "delivery_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _payload(spark, d).again.select("delivery_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return _payload(spark, d).kept.select("delivery_id", "batch_id", "qid", "seq_num", "seq_len", "shuffle_id", "row_count", "body_crc")


_P3 = """
WITH ranked AS (
  SELECT *, CASE WHEN qid IS NULL OR seq_num IS NULL OR seq_len IS NULL THEN 1 ELSE
    row_number() OVER (PARTITION BY lower(trim(qid, ' ' || chr(9) || chr(10) || chr(13))), seq_num, seq_len ORDER BY received_at NULLS LAST, delivery_id) END AS rn
  FROM payload)
"""


_SKEWED = (("bid", {"bid.auction": "auction", "bid.bidder": "bidder"}), ("auction", {"auction.seller": "seller"}))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, keys in _SKEWED:
        parts = balance.partial_counts(table(spark, d, name), keys)
        for field in keys:
            total, counts = balance.balanced_counts(parts.where(F.col("field") == field))
            heavy = counts.where(F.col("n") * 100 >= HEAVY_PERCENT * total).select(F.lit(field).alias("field"), F.col("key").alias("key_value"))
            out = heavy if out is None else out.unionByName(heavy)
    return out


def p4_auction_totals(spark: SparkSession, d: str) -> DataFrame:
    return balance.balanced_join_totals(table(spark, d, "bid"), "auction", "bid_id", "price", table(spark, d, "auction"), "a_id", ["seller", "category"])


def p4_bidder_totals(spark: SparkSession, d: str) -> DataFrame:
    return balance.balanced_join_totals(table(spark, d, "bid"), "bidder", "bid_id", "price", table(spark, d, "person"), "p_id", ["state"])


def p4_seller_totals(spark: SparkSession, d: str) -> DataFrame:
    return balance.balanced_join_totals(table(spark, d, "auction"), "seller", "a_id", "reserve", table(spark, d, "person"), "p_id", ["state"])


def _totals_sql(name: str, key: str, record: str, value: str, match: str, match_key: str, attributes: list[str]) -> str:
    one = ", ".join(f"max({a}) AS {a}" for a in attributes)
    return f"""
WITH r AS (SELECT {key} AS key_value, {record} AS id, max({value}) AS v FROM {name} WHERE {key} IS NOT NULL GROUP BY 1, 2),
s AS (SELECT key_value, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY 1),
m AS (SELECT {match_key} AS mk, {one} FROM {match} GROUP BY 1)
SELECT s.key_value, s.n, s.total, {", ".join(attributes)} FROM s LEFT JOIN m ON m.mk = s.key_value"""


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    bid, record = table(spark, d, "bid"), table(spark, d, "kinesis_record")
    bids = bid.select(F.lit("bid").alias("src"), F.col("bid_id").alias("rec_key"), millis(F.col("b_date_time")).alias("t_ms"), millis(F.col("p_time")).alias("arrival_ms"), F.col("price").alias("value"))
    arrival = F.round(F.col("approximate_arrival_timestamp") * 1000).cast("long")
    json = json_bids(record, "data").select(
        F.lit("kinesis_record").alias("src"), F.col("sequence_number").alias("rec_key"), F.col("bid_ms").alias("t_ms"), arrival.alias("arrival_ms"), F.col("bid.price").alias("value")
    )
    one = lateness.first_arrivals(bids).withColumn("rec_key", F.col("rec_key").cast("string"))
    return lateness.judge(one.unionByName(lateness.first_arrivals(json)), LATENESS_MS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _arrivals(spark, d).where("refused").select("src", "rec_key")


def p5_hourly(spark: SparkSession, d: str) -> DataFrame:
    hours = lateness.combine(lateness.partials(_arrivals(spark, d)))
    start = F.timestamp_millis(F.col("period") * HOUR_MS).cast("timestamp_ntz")
    return hours.select("src", start.alias("hour_start"), "n", "total", "corrections", "refused")


_P5 = """
WITH texts AS (
  SELECT sequence_number AS rec_key, approximate_arrival_timestamp AS a,
    CASE WHEN json_valid(decode(TRY(from_base64(data)))) THEN decode(TRY(from_base64(data))) END AS j FROM kinesis_record),
parsed AS (SELECT rec_key, a, j ->> '$.b_date_time' AS s, TRY_CAST(j ->> '$.price' AS BIGINT) AS value FROM texts WHERE j IS NOT NULL),
events AS (
  SELECT 'bid' AS src, CAST(bid_id AS VARCHAR) AS rec_key, epoch_ms(b_date_time) AS t, epoch_ms(p_time) AS arr, price AS value FROM bid
  UNION ALL
  SELECT 'kinesis_record', rec_key, CASE WHEN regexp_full_match(s, '-?[0-9]{1,18}') THEN CAST(s AS BIGINT) WHEN s LIKE '____-__-__T%' THEN epoch_ms(TRY_CAST(s AS TIMESTAMPTZ)) END,
    CAST(round(a * 1000) AS BIGINT), value FROM parsed),
one AS (
  SELECT src, rec_key, min(t) AS t, min(arr) AS arr, max(value) AS value FROM events WHERE rec_key IS NOT NULL AND t IS NOT NULL AND arr IS NOT NULL GROUP BY 1, 2),
judged AS (SELECT *, (t - ((t % 3600000) + 3600000) % 3600000) AS h FROM one),
late AS (SELECT *, arr > h + 3600000 + 1800000 AS refused, arr >= h + 3600000 AS after_end FROM judged)
"""


def _bid_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bid").select(F.col("bidder").alias("entity"), millis(F.col("b_date_time")).alias("ms"), F.col("bid_id").alias("record"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tree = sessions.gap_tree(_bid_times(spark, d), cuts=[PAUSE_MS])
    return sessions.cut(tree, PAUSE_MS).select(F.col("entity").alias("bidder"), "start_ms", "end_ms")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions for three pauses, cut from one tree."""
    pauses = [60_000, PAUSE_MS, 3_600_000]
    tree = sessions.gap_tree(_bid_times(spark, d), cuts=pauses)
    out = None
    for pause in pauses:
        part = sessions.cut(tree, pause).withColumn("pause_ms", F.lit(pause).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("entity", "bidder")


def _sessions_sql(pause: int) -> str:
    return f"""
SELECT bidder, min(ms) AS start_ms, max(ms) AS end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS events, CAST({pause} AS BIGINT) AS pause_ms FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY bidder ORDER BY ms, bid_id ROWS UNBOUNDED PRECEDING) AS part FROM (
    SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY bidder ORDER BY ms, bid_id) <= {pause} THEN 0 ELSE 1 END AS fresh FROM (
      SELECT DISTINCT bidder, epoch_ms(b_date_time) AS ms, bid_id FROM bid WHERE bidder IS NOT NULL AND b_date_time IS NOT NULL)))
GROUP BY bidder, part"""


QUERIES = {
    f.__name__: f for f in (p2_found, p2_orphans_by_day, p3_found, p3_kept, p4_found, p4_auction_totals, p4_bidder_totals, p4_seller_totals, p5_found, p5_hourly, p6_found, p6_sessions)
}

SQL = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_orphans_by_day": _P2 + "SELECT src, field, ref_day, kind, count(*) AS n_keys FROM found GROUP BY ALL",
    "p3_found": _P3 + "SELECT delivery_id FROM ranked WHERE rn > 1",
    "p3_kept": _P3 + "SELECT delivery_id, batch_id, qid, seq_num, seq_len, shuffle_id, row_count, body_crc FROM ranked WHERE rn = 1",
    "p4_found": " UNION ALL ".join(
        f"SELECT '{f}' AS field, {k} AS key_value FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) * 100 >= {HEAVY_PERCENT} * (SELECT count(*) FROM {t})" for t, keys in _SKEWED for f, k in keys.items()
    ),
    "p4_auction_totals": _totals_sql("bid", "auction", "bid_id", "price", "auction", "a_id", ["seller", "category"]),
    "p4_bidder_totals": _totals_sql("bid", "bidder", "bid_id", "price", "person", "p_id", ["state"]),
    "p4_seller_totals": _totals_sql("auction", "seller", "a_id", "reserve", "person", "p_id", ["state"]),
    "p5_found": _P5 + "SELECT src, rec_key FROM late WHERE refused",
    "p5_hourly": _P5
    + """SELECT src, make_timestamp(h * 1000) AS hour_start, count(*) FILTER (NOT refused) AS n, CAST(coalesce(sum(value) FILTER (NOT refused), 0) AS BIGINT) AS total,
      count(*) FILTER (NOT refused AND after_end) AS corrections, count(*) FILTER (refused) AS refused FROM late GROUP BY src, h""",
    "p6_found": f"SELECT bidder, start_ms, end_ms FROM ({_sessions_sql(PAUSE_MS)})",
    "p6_sessions": " UNION ALL ".join(_sessions_sql(p) for p in (60_000, PAUSE_MS, 3_600_000)),
}
