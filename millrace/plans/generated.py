"""Queries over generated streams, which need no data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import prepare
from millrace.sources import generators

_STREAM = generators.Stream(seconds=20, events_per_second=1000)


def gen_nexmark_mix(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and epoch: of 1000 events, 20 persons, 60 auctions and 920 bids."""
    return generators.events(prepare(spark), _STREAM).groupBy("epoch", F.col("kind").cast("bigint").alias("kind")).agg(F.count("*").alias("n"))


def gen_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Each group's numbers are the group's own, in another order."""
    rows = generators.events(prepare(spark), generators.Stream(seconds=2, out_of_order_group=50))
    return rows.groupBy("epoch").agg(F.count_distinct("n").alias("numbers"), F.min("n").alias("low"), F.max("n").alias("high"))


def gen_ysb_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a campaign per epoch: all of them."""
    made = generators.ysb(prepare(spark), _STREAM)
    joined = made["ad_event"].join(F.broadcast(made["campaign"]), F.col("ad_id") == F.col("c_ad_id"))
    return joined.groupBy("epoch").agg(F.count("*").alias("n"), (F.count_distinct("campaign_id") <= 100).alias("known"))


def gen_rates(spark: SparkSession, d: str) -> DataFrame:
    """A period's events by its half: evenly, three quarters in the first half, or slowly up and down."""
    out = None
    for shape in ("constant", "square", "sine"):
        rows = generators.events(prepare(spark), generators.Stream(seconds=60, events_per_second=50, shape=shape, period_seconds=20))
        half = F.floor((F.col("ms") - generators.BASE_TIME_MS) % 20_000 / 10_000).cast("bigint").alias("half")
        part = rows.groupBy(F.lit(shape).alias("shape"), half).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def gen_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """Shares of hot keys: one auction in a hundred has half of the bids, one person in a hundred three quarters of bids and auctions, to within two points."""
    made = generators.nexmark(prepare(spark), generators.Stream(seconds=60, events_per_second=1000))
    near = lambda df, key, share: df.agg((F.abs(F.avg(((F.col(key) - generators.FIRST_ID) % generators.HOT_BUCKET == 0).cast("double")) - share) < 0.02).alias("near"))
    out = None
    for name, key, share in (("bid", "auction", 1 / 2), ("bid", "bidder", 3 / 4), ("auction", "seller", 3 / 4)):
        part = near(made[name], key, share).select(F.lit(f"{name}.{key}").alias("field"), "near")
        out = part if out is None else out.unionByName(part)
    return out


def gen_columns(spark: SparkSession, d: str) -> DataFrame:
    """Rules that generated columns keep: numbers follow the event's, auctions end after they begin, bids name what exists."""
    made = generators.nexmark(prepare(spark), _STREAM)
    person, auction, bid = made["person"], made["auction"], made["bid"]
    rules = [
        person.agg(F.min("p_id").alias("low"), F.max("p_id").alias("high"), F.count_if(F.expr("name IS NULL OR state NOT RLIKE '^[a-z]{2}$' OR credit_card NOT RLIKE '^([0-9]{4} ){3}[0-9]{4}$'")).alias("bad")).withColumn("relation", F.lit("person")),
        auction.agg(F.min("a_id").alias("low"), F.max("a_id").alias("high"), F.count_if(F.expr("expires <= a_date_time OR reserve < initial_bid OR category NOT BETWEEN 10 AND 14 OR seller < 1000")).alias("bad")).withColumn("relation", F.lit("auction")),
        bid.agg(F.min("auction").alias("low"), F.min("bidder").alias("high"), F.count_if(F.expr("price <= 0 OR auction > 2200 OR bidder > 1400 OR p_time < CAST(b_date_time AS TIMESTAMP)")).alias("bad")).withColumn("relation", F.lit("bid")),
    ]
    return rules[0].unionByName(rules[1]).unionByName(rules[2])


QUERIES = {f.__name__: f for f in (gen_nexmark_mix, gen_out_of_order, gen_rates, gen_hot_keys, gen_columns, gen_ysb_events)}
SQL = {
    "gen_nexmark_mix": "SELECT epoch, kind, CASE kind WHEN 0 THEN 20 WHEN 1 THEN 60 ELSE 920 END AS n FROM range(20) e(epoch), range(3) k(kind)",
    "gen_out_of_order": "SELECT epoch, 1000 AS numbers, epoch * 1000 AS low, epoch * 1000 + 999 AS high FROM range(2) e(epoch)",
    "gen_rates": "SELECT shape, half, CASE shape WHEN 'square' THEN CASE half WHEN 0 THEN 2250 ELSE 750 END ELSE 1500 END AS n FROM (VALUES ('constant'), ('square'), ('sine')) s(shape), range(2) h(half)",
    "gen_hot_keys": "SELECT field, TRUE AS near FROM (VALUES ('bid.auction'), ('bid.bidder'), ('auction.seller')) f(field)",
    "gen_columns": "SELECT * FROM (VALUES ('person', 1000, 1399, 0), ('auction', 1000, 2199, 0), ('bid', 1000, 1000, 0)) r(relation, low, high, bad)",
    "gen_ysb_events": "SELECT epoch, 1000 AS n, TRUE AS known FROM range(20) e(epoch)",
}
