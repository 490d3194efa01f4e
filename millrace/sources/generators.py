"""Event generators of the auction and the ad stream: bounded, partitioned, and the same for the same seed.

Every column is an expression of the event's number, so any part of a stream can be made anywhere and in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import floor_div

#: Fixed values of the auction stream: its base time, the mix of 50 events, first ids, categories, hot ratios and states.
BASE_TIME_MS = 1_436_918_400_000
PERSONS, AUCTIONS, BIDS = 1, 3, 46
FIRST_ID = 1000
FIRST_CATEGORY, CATEGORIES = 10, 5
HOT_SELLER, HOT_AUCTION, HOT_BIDDER = 4, 2, 4
HOT_BUCKET = 100
STATES = ("az", "ca", "id", "or", "wa", "wy")
#: Fixed values of the ad stream.
AD_TYPES = ("banner", "modal", "sponsored-search", "mail", "mobile")
EVENT_TYPES = ("view", "click", "purchase")


@dataclass(frozen=True)
class Stream:
    """seconds of events at events_per_second; shape constant, square or sine (which swings by half around the rate within period_seconds)."""

    seconds: int = 20
    events_per_second: int = 1000
    out_of_order_group: int = 1
    active_people: int = 1000
    in_flight_auctions: int = 100
    shape: str = "constant"
    period_seconds: int = 60
    seed: int = 0

    @property
    def events(self) -> int:
        return self.seconds * self.events_per_second


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


class _Draw:
    """Hash-based draws for the event in column n."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def below(self, salt: str, bound: Column | int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(salt), "n"), (F.lit(bound) if isinstance(bound, int) else bound).cast("long"))

    def unit(self, salt: str) -> Column:
        return self.below(salt, 1 << 40) / F.lit(float(1 << 40))

    def price(self, salt: str) -> Column:
        """Cents, log-uniform over six decades."""
        return F.round(F.pow(F.lit(10.0), self.unit(salt) * 6) * 100).cast("long")


def _number(s: Stream) -> Column:
    """The event's number with events shuffled within out-of-order groups."""
    n, g = F.col("id"), s.out_of_order_group
    return n if g <= 1 else n - F.pmod(n, F.lit(g)) + F.pmod(n * 953, F.lit(g))


def _ms(s: Stream) -> Column:
    """The event's time. The square and sine shapes bend the even spacing within each period; they keep the period's count."""
    even = F.col("n") * 1000 / F.lit(s.events_per_second)
    if s.shape != "constant":
        period = float(s.period_seconds * 1000)
        phase = F.pmod(even, F.lit(period)) / period
        if s.shape == "square":  # the first half of a period has three quarters of its events
            bent = F.when(phase < 0.75, phase * 2 / 3).otherwise(0.5 + (phase - 0.75) * 2)
        elif s.shape == "sine":
            bent = phase - F.sin(phase * 6.283185307179586) / (4 * 3.141592653589793)
        else:
            raise ValueError(f"unknown shape: {s.shape}")
        even = even - phase * period + bent * period
    return F.floor(even).cast("long") + BASE_TIME_MS


def events(spark: SparkSession, s: Stream) -> DataFrame:
    """(n, kind, ms, epoch): kind is 0 for a person, 1 for an auction, 2 for a bid."""
    slot = F.pmod(F.col("n"), F.lit(PERSONS + AUCTIONS + BIDS))
    kind = F.when(slot < PERSONS, 0).when(slot < PERSONS + AUCTIONS, 1).otherwise(2)
    rows = spark.range(s.events).select(_number(s).cast("long").alias("n"), floor_div(F.col("id"), s.events_per_second).alias("epoch"))
    return rows.withColumn("kind", kind).withColumn("ms", _ms(s))


def _time(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def nexmark(spark: SparkSession, s: Stream) -> dict[str, DataFrame]:
    """person, auction and bid of a stream, each with its epoch (second of arrival)."""
    all_, draw = events(spark, s), _Draw(s.seed)
    block = floor_div(F.col("n"), PERSONS + AUCTIONS + BIDS)
    last_person = block
    slot = F.pmod(F.col("n"), F.lit(PERSONS + AUCTIONS + BIDS))
    last_auction = F.greatest(block * AUCTIONS + F.least(slot - PERSONS, F.lit(AUCTIONS - 1)), F.lit(0))

    def someone(salt: str, ratio: int) -> Column:
        """A hot person ratio - 1 times out of ratio, else one of the active."""
        hot = last_person - F.pmod(last_person, F.lit(HOT_BUCKET))
        active = F.least(last_person + 1, F.lit(s.active_people))
        return FIRST_ID + F.when(draw.below(salt + "?", ratio) > 0, hot).otherwise(last_person - draw.below(salt, active))

    person = all_.where("kind = 0").select(
        (FIRST_ID + last_person).alias("p_id"),
        F.concat(F.lit("given"), draw.below("given", 11), F.lit(" family"), draw.below("family", 9)).alias("name"),
        F.concat(F.lit("u"), (FIRST_ID + last_person).cast("string"), F.lit("@mail.example")).alias("email_address"),
        F.concat_ws(" ", *(F.lpad(draw.below(f"card{i}", 10_000).cast("string"), 4, "0") for i in range(4))).alias("credit_card"),
        F.concat(F.lit("city"), draw.below("city", 10)).alias("city"),
        _pick(STATES, draw.below("state", len(STATES))).alias("state"),
        _time(F.col("ms")).alias("p_date_time"),
        "epoch",
    )
    horizon = max(1, s.in_flight_auctions * (PERSONS + AUCTIONS + BIDS) * 1000 // (AUCTIONS * s.events_per_second))
    initial = draw.price("initial")
    auction = all_.where("kind = 1").select(
        (FIRST_ID + last_auction).alias("a_id"),
        F.concat(F.lit("item "), draw.below("item", 1 << 20)).alias("item_name"),
        F.concat(F.lit("lot of "), draw.below("lot", 1000), F.lit(" pieces")).alias("description"),
        initial.alias("initial_bid"),
        (initial + draw.price("reserve")).alias("reserve"),
        _time(F.col("ms")).alias("a_date_time"),
        _time(F.col("ms") + 1 + draw.below("length", 2 * horizon)).alias("expires"),
        someone("seller", HOT_SELLER).alias("seller"),
        (FIRST_CATEGORY + draw.below("category", CATEGORIES)).alias("category"),
        "epoch",
    )
    hot_auction = last_auction - F.pmod(last_auction, F.lit(HOT_BUCKET))
    open_ = F.least(last_auction + 1, F.lit(s.in_flight_auctions))
    bid = all_.where("kind = 2").select(
        F.col("n").alias("bid_id"),
        (FIRST_ID + F.when(draw.below("auction?", HOT_AUCTION) > 0, hot_auction).otherwise(last_auction - draw.below("auction", open_))).alias("auction"),
        someone("bidder", HOT_BIDDER).alias("bidder"),
        draw.price("price").alias("price"),
        _time(F.col("ms")).alias("b_date_time"),
        F.timestamp_millis(BASE_TIME_MS + (F.col("epoch") + 1) * 1000).alias("p_time"),
        "epoch",
    )
    return {"person": person, "auction": auction, "bid": bid}


def _uuid(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws(":", *parts))
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(digits, a, n) for a, n in cut))


def ysb(spark: SparkSession, s: Stream, campaigns: int = 100, ads: int = 10) -> dict[str, DataFrame]:
    """ad_event, and the campaign table of campaigns * ads ads."""
    draw, seed = _Draw(s.seed), F.lit(str(s.seed))
    ad = lambda i: _uuid(seed, F.lit("ad"), i.cast("string"))
    campaign = spark.range(campaigns * ads).select(ad(F.col("id")).alias("c_ad_id"), _uuid(seed, F.lit("campaign"), floor_div(F.col("id"), ads).cast("string")).alias("campaign_id"))
    rows = spark.range(s.events).select(F.col("id").alias("n"), floor_div(F.col("id"), s.events_per_second).alias("epoch")).withColumn("ms", _ms(s))
    event = rows.select(
        _uuid(seed, F.lit("user"), draw.below("user", 1000).cast("string")).alias("user_id"),
        _uuid(seed, F.lit("page"), draw.below("page", 1000).cast("string")).alias("page_id"),
        ad(draw.below("ad", campaigns * ads)).alias("ad_id"),
        _pick(AD_TYPES, draw.below("type", len(AD_TYPES))).alias("ad_type"),
        _pick(EVENT_TYPES, draw.below("event", len(EVENT_TYPES))).alias("event_type"),
        _time(F.col("ms")).alias("event_time"),
        F.concat_ws(".", F.lit("192.0.2"), draw.below("ip", 256).cast("string")).alias("ip_address"),
        "epoch",
    )
    return {"ad_event": event, "campaign": campaign}
