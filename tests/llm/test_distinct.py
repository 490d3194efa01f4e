from pyspark.sql import functions as F

from millrace.llm import distinct


def _estimate(df, groups):
    return distinct.estimates(df, groups)


def test_estimates_at_every_size(spark):
    sizes = [1, 2, 10, 100, 1000, 5000, 16_000, 40_000, 150_000, 600_000]
    ids = spark.range(max(sizes)).withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).where("id < size")
    # every identifier several times, under other names of the same columns
    df = distinct.with_cell(ids.select("size", F.explode(F.array(F.col("id"), F.col("id"))).alias("slice")), F.col("slice"))
    got = {r["size"]: r["estimate"] for r in _estimate(distinct.bitmaps(df, ["size"]), ["size"]).collect()}
    assert sorted(got) == sizes
    for size in sizes:
        assert abs(got[size] - size) <= max(0.5, 4 * distinct.STANDARD_ERROR * size), (size, got[size])


def test_the_stated_error_holds_on_average(spark):
    n, trials = 30_000, 40
    df = distinct.with_cell(spark.range(n * trials).withColumn("g", (F.col("id") / n).cast("int")), F.concat(F.lit("t"), "id"))
    got = [r["estimate"] for r in _estimate(distinct.bitmaps(df, ["g"]), ["g"]).collect()]
    root_mean_square = (sum((x / n - 1) ** 2 for x in got) / trials) ** 0.5
    assert len(got) == trials and root_mean_square <= 1.3 * distinct.STANDARD_ERROR


def test_merged_parts_equal_the_whole(spark):
    df = distinct.with_cell(spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("h"), "id"), F.col("id") % 9000)
    whole = distinct.bitmaps(df, ["g", "h"])
    parts = distinct.bitmaps(df.where("h < 2"), ["g", "h"]).unionByName(distinct.bitmaps(df.where("h >= 1"), ["g", "h"]))
    assert {tuple(r) for r in distinct.merge(parts, ["g", "h"]).collect()} == {tuple(r) for r in whole.collect()}
    rolled = distinct.roll_up(whole, ["g", "h"], distinct.combinations(["g", "h"]))
    only_g = {tuple(r) for r in rolled.where("h IS NULL AND g IS NOT NULL").select("g", "slice", "word", "mask").collect()}
    assert only_g == {tuple(r) for r in distinct.bitmaps(df, ["g"]).collect()}


def test_nulls_and_empty_tables(spark):
    df = distinct.with_cell(spark.createDataFrame([(1, None), (1, "a"), (2, None)], "g int, id string"), F.col("id"))
    assert [tuple(r) for r in _estimate(distinct.bitmaps(df, ["g"]), ["g"]).collect()] == [(1, 1)]
    assert _estimate(distinct.bitmaps(df.limit(0), ["g"]), ["g"]).count() == 0
