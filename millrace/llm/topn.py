"""The N highest-scoring items of every group, in one fixed order, however large a group is.

Per group a histogram over score buckets tells a lower threshold with at least N different items at or above it. A
histogram cell is a 64-bit mask of hashed item ids: its number of set bits never exceeds the number of different
items, so copies of an item can't make the threshold unsafe. Rows below it are dropped where they are read; the
survivors of a large group are ranked in shards by item, then the shards' best are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 64


def bucket(score: Column) -> Column:
    """A bucket that never decreases as the integer score increases; widths grow with the score."""
    up = F.floor(F.log2(score.cast("double")) * BUCKETS_PER_OCTAVE)
    down = F.floor(F.log2((1 - score).cast("double")) * BUCKETS_PER_OCTAVE)
    return F.when(score > 0, up).otherwise(-1 - down).cast("int")


#: Below every bucket.
_BELOW = -1 - 64 * BUCKETS_PER_OCTAVE


def thresholds(cells: DataFrame, group: str, n: int, partial: bool = False) -> DataFrame:
    """(group, threshold): the highest bucket with at least n different items at or above it, or the lowest one.

    cells(group, bucket, mask) is a histogram, with at most 2 * 63 * BUCKETS_PER_OCTAVE buckets for a group. A partial one doesn't
    hold all items of a group; where it has fewer than n, items may lie below its lowest bucket, so all buckets are let through.
    """
    above = Window.partitionBy(group).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    higher = cells.withColumn("higher", F.coalesce(F.sum(F.bit_count("mask")).over(above), F.lit(0)))
    lowest = F.min("bucket")
    if partial:
        lowest = F.when(F.sum(F.bit_count("mask")) >= n, lowest).otherwise(F.lit(_BELOW))
    return higher.where(F.col("higher") < n).groupBy(group).agg(lowest.alias("threshold"))


def histogram(df: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """(group, bucket, mask) of df."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(item), F.lit(64)).cast("int"))
    return df.groupBy(group, bucket(F.col(score)).alias("bucket")).agg(F.bit_or(mask).alias("mask"))


Order = list[tuple[str, bool]]


def _named(df: DataFrame, group: str, item: str, order: Order) -> tuple[DataFrame, str, str, Order]:
    """df with its columns renamed by their place, so they can't clash with those that ranking adds, and the names that follow."""
    place = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*place.values()), place[group], place[item], [(place[c], down) for c, down in order]


def _best(rows: DataFrame, group: str, order: Order, item: str, n: int, shards: int) -> DataFrame:
    """The first n different items of each group.

    Where rows are read, each task keeps those of its own first n items of a group (the planner limits groups below a rank before the
    shuffle), so no group, however large, sends more than n items and their copies from a task.
    """
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    shard = F.pmod(F.xxhash64(item), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    some = rows.withColumn("__shard", shard)
    some = some.withColumn("__place", F.dense_rank().over(Window.partitionBy(group, "__shard").orderBy(*by))).where(F.col("__place") <= n)
    best = some.dropDuplicates([group, "__shard", *(c for c, _ in order)])
    best = best.withColumn("__place", F.row_number().over(Window.partitionBy(group, "__shard").orderBy(*by))).where(F.col("__place") <= n)
    if shards > 1:
        best = best.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("__place") <= n)
    return best.drop("__shard")


def _renamed(best: DataFrame, columns: list[str]) -> DataFrame:
    return best.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(columns) if c != "place"), F.col("__place").alias("place"))


def rank(df: DataFrame, group: str, order: Order, item: str, n: int, shards: int = 1) -> DataFrame:
    """The first n different items of each group with their place; copies of an item are dropped.

    Copies (rows that agree in the group and in all columns of order) share a shard, so with shards > 1 no task holds a whole group and the last step sees at most n * shards rows of one.
    """
    rows, g, i, by = _named(df, group, item, order)
    return _renamed(_best(rows, g, by, i, n, shards), df.columns)


def top_n(df: DataFrame, group: str, score: str, order: Order, item: str, n: int, max_large: int = 20_000, shards: int = 64) -> DataFrame:
    """df's rows of the first n items of each group by order, with column place (from 1).

    order lists (column, descending), nulls last; it starts with the score, descending, and ends with item, so it is total. Rows
    with a null group or score are left out, copies of an item count once, a group with fewer than n items comes out
    whole, an empty table gives an empty result. A column of df that is called place is replaced; other names are free.
    Scores are integers. Copies are rows that agree in the group and in all columns of order: an item that comes with several
    scores has a place for each.

    Groups with more than 1 / max_large of all rows are large; there are fewer than max_large of them, which bounds what is
    broadcast: their thresholds. All others are ranked directly.
    """
    if n <= 0 or order[0] != (score, True) or order[-1][0] != item:
        raise ValueError("n must be positive, and order must begin with the score, descending, and end with the item")
    rows, g, i, by = _named(df, group, item, order)
    score_ = by[0][0]
    base = rows.where(F.col(g).isNotNull() & F.col(score_).isNotNull())
    limit = max(64 * n, df.count() // max_large)
    large = base.groupBy(g).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(g)
    cut = F.broadcast(thresholds(histogram(base.join(F.broadcast(large), g, "left_semi"), g, score_, i), g, n))
    small = base.join(cut, g, "left_anti")
    high = base.join(cut, g).where(bucket(F.col(score_)) >= F.col("threshold")).drop("threshold")
    return _renamed(_best(small, g, by, i, n, 1).unionByName(_best(high, g, by, i, n, shards)), df.columns)
