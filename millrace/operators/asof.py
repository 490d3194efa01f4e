"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import HOUR_MS, floor_div


def asof_join(left: DataFrame, right: DataFrame, key: str, ms: str, order: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """left with column match: of right's rows with the same key and a time ms no later, the last, as a struct; null without one.

    order decides among right's rows of one time (the largest is last). Both sides have columns key, ms and order. A left row
    with a null key or time has no match; right rows with one are no match; repeated rows change nothing on the right and stay
    on the left; an empty right gives nulls.

    Rows meet per key and bucket of time; the last right row of each bucket is carried to the later ones, so what one task
    holds of a key at once is a bucket, or one row per bucket, however hot the key.
    """
    at = floor_div(F.col(ms), bucket_ms)
    mine = left.select(F.struct(*left.columns).alias("__row"), F.col(key).alias("__k"), F.col(ms).alias("__t"), at.alias("__b"))
    held = F.struct(*right.columns)
    theirs = right.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(held.alias("__m"), F.col(key).alias("__k"), F.col(ms).alias("__t"), F.col(order).alias("__o"), at.alias("__b"))
    last = theirs.groupBy("__k", "__b").agg(F.max_by("__m", F.struct("__t", "__o")).alias("__m"))
    buckets = mine.where("__k IS NOT NULL AND __b IS NOT NULL").select("__k", "__b").distinct().join(last, ["__k", "__b"], "full")
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("__k", "__b", F.last("__m", ignorenulls=True).over(before).alias("__c")).where("__c IS NOT NULL")
    both = mine.select("__k", "__b", "__t", F.lit(1).alias("__side"), "__row", F.lit(None).cast(theirs.schema["__m"].dataType).alias("__m"), F.lit(None).cast(theirs.schema["__o"].dataType).alias("__o")).unionByName(
        theirs.select("__k", "__b", "__t", F.lit(0).alias("__side"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), "__m", "__o")
    )
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__m", F.last("__m", ignorenulls=True).over(inside)).where("__side = 1")
    told = told.withColumn("__m", F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.col("__m")))
    return told.join(carried, ["__k", "__b"], "left").select("__row.*", F.coalesce("__m", "__c").alias("match"))
