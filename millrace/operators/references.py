"""References to records that do not exist: bitmaps of referenced keys AND-NOT bitmaps of live parents.

A key is an integer (other keys are numbered first, see :func:`dictionary`). 64 neighbouring keys are one bitmap
word; words without a bit are not stored. References form one word per key range and period. Parents form, per key
range, the short list of periods in which bits are born or go: the OR of the births before a period without the
removals up to it is the parents' word of that period, so an unchanged word costs nothing however many periods it
spans. A bit of ``references & ~parents`` survives unless its parent stood through the whole period; the
survivors are decoded, and only their references are read again, with exact times. So what is shuffled are words, combined where
they are read, and the survivors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import DAY_MS, HOUR_MS, floor_div
from millrace.session import cut_lineage

_ALWAYS = -(2**62)
#: The most survivors that go to every task.
MOST_BROADCAST = 200_000


def dictionary(ids: DataFrame) -> DataFrame:
    """ids(id) -> (id, code): every different id with an integer.

    Ids are range-partitioned and numbered in order within their range, so neighbours share bitmap words. The
    table is written once, as encoding and decoding must see the same numbers. Null ids are left out.
    """
    numbered = ids.where("id IS NOT NULL").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return cut_lineage(numbered.withColumn("code", F.monotonically_increasing_id()))


def _word_and_bit(df: DataFrame) -> DataFrame:
    return df.withColumn("word", F.shiftright("key", 6)).withColumn("bit", F.col("key").bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _mask(bit: str = "bit") -> Column:
    return F.expr(f"shiftleft(1L, {bit})")


def orphans(refs: DataFrame, parents: DataFrame, removals: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """Orphan references per relation, key, day and kind.

    refs(rel, key bigint, t_ms), parents(rel, key bigint, born_ms), removals(rel, key bigint, gone_ms); rel names
    the relation between two tables. Result: (rel, key, day bigint, kind), all different.

    kind is ``deleted`` if the key was removed at or before the reference's time, else ``later`` if the parent's
    time is after it, and ``missing`` if neither parents nor removals know the key. References with a null key or
    time are no case; a parent without a time always stood; a removal without a time only makes its key known.
    Repeated rows change nothing, and empty tables are allowed on every side. Other columns are ignored.

    A hot key collapses to one word per period before the first shuffle, and again to one row where its exact times are read.
    Survivors are broadcast only if they are counted to be few, else joined. period_ms must divide a day.
    """
    if DAY_MS % period_ms:
        raise ValueError("period_ms must divide a day")
    mine = refs.where("key IS NOT NULL AND t_ms IS NOT NULL").select("rel", "key", "t_ms", floor_div(F.col("t_ms"), period_ms).alias("period"))
    words = _word_and_bit(mine).groupBy("rel", "word", "period").agg(F.bit_or(_mask()).alias("refs"))
    known = (
        parents.where("key IS NOT NULL")
        .select("rel", "key", F.col("born_ms").alias("born_ms"), F.lit(None).cast("long").alias("gone_ms"))
        .unionByName(removals.where("key IS NOT NULL").select("rel", "key", F.lit(None).cast("long").alias("born_ms"), "gone_ms"))
        .groupBy("rel", "key")
        .agg(F.coalesce(F.min("born_ms"), F.lit(_ALWAYS)).alias("born_ms"), F.min("gone_ms").alias("gone_ms"))
    )
    changes = (
        _word_and_bit(known)
        .repartition("rel", "word")
        .select(
            "rel",
            "word",
            F.explode(
                F.array(
                    F.struct(floor_div(F.col("born_ms"), period_ms).alias("at"), _mask().alias("born"), F.lit(0).cast("long").alias("gone")),
                    F.struct(floor_div(F.col("gone_ms"), period_ms).alias("at"), F.lit(0).cast("long").alias("born"), _mask().alias("gone")),
                )
            ).alias("c"),
        )
        .where("c.at IS NOT NULL")
        .groupBy("rel", "word", F.col("c.at").alias("at"))
        .agg(F.expr("bit_or(c.born)").alias("born"), F.expr("bit_or(c.gone)").alias("gone"))
        .groupBy("rel", "word")
        .agg(F.collect_list(F.struct("at", "born", "gone")).alias("changes"))
    )
    standing = "aggregate(changes, 0L, (a, c) -> a | if(c.at < period, c.born, 0L)) & ~aggregate(changes, 0L, (a, c) -> a | if(c.at <= period, c.gone, 0L))"
    bits = "filter(sequence(0, 63), x -> (left_over & shiftleft(1L, x)) != 0)"
    surviving = (
        words.join(changes, ["rel", "word"], "left")
        .withColumn("left_over", F.expr(f"refs & ~coalesce({standing}, 0L)"))
        .where("left_over != 0")
        .select("rel", "word", "period", F.explode(F.expr(bits)).alias("bit"))
        .select("rel", F.shiftleft("word", 6).bitwiseOR(F.col("bit").cast("long")).alias("key"), "period")
    )
    surviving, at = cut_lineage(surviving), ["rel", "key", "period"]
    spans = lambda df: df.groupBy(*at).agg(F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))
    if surviving.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        times = spans(mine.join(F.broadcast(surviving), at, "left_semi"))
    else:
        times = spans(mine).join(surviving, at, "left_semi")  # combined before they are shuffled
    exact = times.join(known.select("rel", "key", "born_ms", "gone_ms"), ["rel", "key"], "left")
    kinds = F.array(
        F.when(F.col("born_ms").isNull(), "missing"),
        F.when(F.col("last_ms") >= F.col("gone_ms"), "deleted"),
        F.when(F.col("first_ms") < F.least("born_ms", "gone_ms"), "later"),
    )
    return (
        exact.select(
            "rel",
            "key",
            floor_div(F.col("period"), DAY_MS // period_ms).alias("day"),
            F.explode(kinds).alias("kind"),
        )
        .where("kind IS NOT NULL")
        .distinct()
    )
