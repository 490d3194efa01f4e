"""Messages delivered more than once: exactly one delivery of each is kept."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage


class Deliveries(NamedTuple):
    """singles: deliveries of messages that came once. first, again: of repeated ones, the kept one and the others."""

    singles: DataFrame
    first: DataFrame
    again: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.singles.unionByName(self.first)


def _hashed(parts: list[str]) -> Column:
    return F.xxhash64(*parts)


def _cell(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits))


def _mask(cell: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _filter_words(repeated: DataFrame, most_bits: int) -> tuple[int, DataFrame]:
    """A bitmap of the hashes repeated(h) as rows (word, mask), no more than most_bits / 64, and its number of bits: eight for a hash if that isn't too much."""
    bits = 1 << 12
    keys = repeated.count()
    while bits < min(8 * keys, most_bits):
        bits *= 2
    cell = _cell(F.col("h"), bits)
    return bits, repeated.groupBy(F.shiftright(cell, 6).alias("__word")).agg(F.bit_or(_mask(cell)).alias("__mask"))


def split_deliveries(messages: DataFrame, key: list[Column], order: list[str], delivery: str, hot_keys: int = 400, most_bits: int = 1 << 26) -> Deliveries:
    """Split deliveries by how often their identifier occurs, and rank only repeated groups.

    messages: all deliveries, stored and new ones together. key: expressions that together identify a message.
    order: columns of which the smallest values (nulls last) stay; delivery: a column unique to each row, which
    decides ties and spreads hot groups. A null in any part of the key equals nothing, so that row is a single.
    All columns of messages come through, whatever their names; an empty table gives three empty results.

    Frequencies are aggregated by the identifiers' hashes, and those of repeated ones written once. A bitmap of the repeated
    hashes goes to every task (most_bits / 64 rows at most): rows outside it are singletons and pass where they are read. The
    rest are shuffled by their whole key and counted again, so neither the bitmap's nor the hash's collisions matter. Hashes that hold
    more than 1/hot_keys of all rows, of which there can't be more than hot_keys, are broadcast: their rows are ranked in
    shards first, so no task ever receives a whole hot group.
    """
    parts = [f"__key{i}" for i in range(len(key))]
    rows = messages.select(F.struct(*(F.col(f"`{c}`") for c in messages.columns)).alias("__row"), *(k.alias(p) for k, p in zip(key, parts, strict=True)))
    whole = " AND ".join(f"{p} IS NOT NULL" for p in parts)
    keyed, loose = rows.where(whole).withColumn("__h", _hashed(parts)), rows.where(f"NOT ({whole})")

    repeated = cut_lineage(keyed.groupBy(F.col("__h").alias("h")).agg(F.count("*").alias("n")).where("n > 1"))
    limit = max(1, messages.count() // hot_keys)
    hot = F.broadcast(repeated.where(F.col("n") > limit).select(F.col("h").alias("__h"), F.col("n").alias("__hot")))
    bits, words = _filter_words(repeated.where(F.col("n") <= limit), most_bits)

    keyed = keyed.join(hot, "__h", "left")
    cell = _cell(F.col("__h"), bits)
    cold = keyed.where("__hot IS NULL").withColumn("__word", F.shiftright(cell, 6)).join(F.broadcast(words), "__word", "left")
    maybe = F.coalesce(F.col("__mask").bitwiseAND(_mask(cell)) != 0, F.lit(False))

    by = [F.col(f"__row.`{c}`").asc_nulls_last() for c in (*order, delivery)]
    group = Window.partitionBy(*parts)
    ranked = cold.where(maybe).withColumn("__rank", F.row_number().over(group.orderBy(*by)))
    few = ranked.withColumn("__n", F.count("*").over(group))

    shard = F.pmod(F.xxhash64(F.col(f"__row.`{delivery}`")), F.ceil(F.col("__hot") / F.lit(limit)))
    sharded = keyed.where("__hot IS NOT NULL").withColumn("__shard", shard)
    within = sharded.withColumn("__in", F.row_number().over(Window.partitionBy(*parts, "__shard").orderBy(*by)))
    heads = within.where("__in = 1").withColumn("__rank", F.row_number().over(group.orderBy(*by)))

    singles = cold.where(~maybe).select("__row.*").unionByName(loose.select("__row.*")).unionByName(few.where("__n = 1").select("__row.*"))
    first = few.where("__n > 1 AND __rank = 1").select("__row.*").unionByName(heads.where("__rank = 1").select("__row.*"))
    again = ranked.where("__rank > 1").select("__row.*")
    for part in (heads.where("__rank > 1"), within.where("__in > 1")):
        again = again.unionByName(part.select("__row.*"))
    return Deliveries(singles, first, again)
