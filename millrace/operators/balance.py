"""Per-key results when a few keys hold most rows: fragment and replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage
from millrace.session import tasks as shuffle_tasks


@dataclass(frozen=True)
class Layout:
    """Which task carries which keys.

    large: key -> the tasks that carry its shards; place: bucket of all other keys -> task; loads: rows per task.
    """

    tasks: int
    buckets: int
    total: int
    large: dict[int, list[int]]
    place: list[int]
    loads: list[int]

    @property
    def imbalance(self) -> float:
        """Load of the fullest task as a multiple of the mean."""
        return max(self.loads) * self.tasks / sum(self.loads) if sum(self.loads) else 1.0


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def plan_layout(df: DataFrame, key: str, tasks: int | None = None, buckets_per_task: int = 16, rows: str | None = None) -> Layout:
    """Estimate loads and bin-pack them. total counts df's rows, or, where a row stands for several, adds up column rows.

    Loads of hash buckets come first; within buckets above half a task's fair share, keys above half a share are
    told apart (there are at most 2 * tasks such keys, so what reaches the driver is bounded by the number of tasks,
    not by data). A large key is cut into as many shards as it has shares; shards and remaining buckets go to the
    least loaded task, largest first. Null keys count in total but have no place.
    """
    tasks = tasks or shuffle_tasks(df.sparkSession)
    buckets = tasks * buckets_per_task
    stands_for = (F.sum(rows) if rows else F.count("*")).alias("rows")
    counts = df.groupBy(F.when(F.col(key).isNotNull(), _bucket(F.col(key), buckets)).alias("b")).agg(F.count("*").alias("count"), stands_for).collect()
    total = sum(r["rows"] for r in counts)
    weight = [0] * buckets
    for r in counts:
        if r["b"] is not None:
            weight[r["b"]] = r["count"]
    share = max(1, -(-sum(weight) // tasks))
    full = [b for b, w in enumerate(weight) if 2 * w > share]
    large: dict[int, int] = {}
    if full:
        found = df.where(F.col(key).isNotNull() & _bucket(F.col(key), buckets).isin(full)).groupBy(key).agg(F.count("*").alias("count")).where(F.col("count") * 2 > share)
        for r in found.withColumn("b", _bucket(F.col(key), buckets)).collect():
            large[r[key]] = r["count"]
            weight[r["b"]] -= r["count"]
    items: list[tuple[int, int, int | None, int]] = [(w, i, None, b) for i, (b, w) in enumerate(enumerate(weight))]
    for k, n in large.items():
        cuts = -(-n // share)
        items += [(-(-n // cuts), len(items) + i, k, i) for i in range(cuts)]
    loads, free = [0] * tasks, [(0, t) for t in range(tasks)]
    place, of = [0] * buckets, {k: [] for k in large}
    for w, _, k, b in sorted(items, key=lambda x: (-x[0], x[1])):
        load, t = heapq.heappop(free)
        loads[t] = load + w
        heapq.heappush(free, (load + w, t))
        if k is None:
            place[b] = t
        else:
            of[k].append(t)
    return Layout(tasks, buckets, total, of, place, loads)


def _tables(df: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    large = spark.createDataFrame([(k, t) for k, t in layout.large.items()], "__k bigint, __shards array<int>")
    place = spark.createDataFrame(list(enumerate(layout.place)), "__b int, __place int")
    return F.broadcast(large), F.broadcast(place)


def fragment(df: DataFrame, key: str, layout: Layout, spread: list[str]) -> DataFrame:
    """df without null keys, with the task of each row in column __task; rows of a large key are spread by the hash of spread.

    Rows that agree in spread stay together, so copies can be told within a task.
    """
    large, place = _tables(df, layout)
    told = df.where(F.col(key).isNotNull()).join(large, F.col(key) == F.col("__k"), "left").withColumn("__b", _bucket(F.col(key), layout.buckets)).join(place, "__b", "left")
    shard = F.expr("__shards[cast(pmod(__h, size(__shards)) as int)]")
    return told.withColumn("__h", F.xxhash64(*spread)).withColumn("__task", F.coalesce(F.when(F.col("__shards").isNotNull(), shard), F.col("__place"))).drop("__k", "__shards", "__b", "__place", "__h")


def replicate(df: DataFrame, key: str, layout: Layout) -> DataFrame:
    """df, the matching side, once for every task that carries a shard of its key."""
    large, place = _tables(df, layout)
    told = df.where(F.col(key).isNotNull()).join(large, F.col(key) == F.col("__k"), "left").withColumn("__b", _bucket(F.col(key), layout.buckets)).join(place, "__b", "left")
    return told.withColumn("__task", F.explode(F.coalesce(F.array_distinct("__shards"), F.array("__place")))).drop("__k", "__shards", "__b", "__place")


def partial_counts(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(field, key, part, n): how many rows of each part of df have each key, for several key columns (field -> column) at once.

    df is read once, and a part is what one task reads, so a key comes at most once from each; the result is written once.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).cast("long").alias("key")) for f, c in keys.items())))
    told = df.select(F.spark_partition_id().alias("part"), each.alias("x")).select("x.field", "x.key", "part")
    return cut_lineage(told.groupBy("field", "key", "part").agg(F.count("*").alias("n")))


def balanced_counts(parts: DataFrame, tasks: int | None = None) -> tuple[int, DataFrame]:
    """(all rows, (key, n)) of parts(key, part, n): rows of each key, a null key aside.

    Parts go to the tasks that a layout of their loads names: large keys, which nearly every part has, are cut into shards, whose sums
    are put together at the end.
    """
    layout = plan_layout(parts, "key", tasks, rows="n")
    placed = fragment(parts.select("key", "part", "n"), "key", layout, ["part"]).repartitionById(layout.tasks, "__task")
    return layout.total, placed.groupBy("__task", "key").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))


def balanced_join_totals(df: DataFrame, key: str, record: str, value: str | None, match: DataFrame, match_key: str, attributes: list[str], tasks: int | None = None) -> DataFrame:
    """Per key of df: n records, total value and the attributes of its match (null without one).

    record identifies a record: its copies count once, and a null is a record of its own row only if record is the
    key's own unique column. match has one row per match_key after its copies are dropped. Rows go straight to the
    task that the layout names; the match goes to every task with a shard of its key; each task joins and adds up
    what it has, and the shards' sums are put together at the end. Null keys are left out; empty tables give an
    empty result.
    """
    layout = plan_layout(df, key, tasks)
    columns = [F.col(key).alias("__key"), F.col(record).alias("__id"), (F.col(value) if value else F.lit(0)).cast("long").alias("__v")]
    rows = fragment(df.select(*columns), "__key", layout, ["__id"])
    rows = rows.repartitionById(layout.tasks, "__task").groupBy("__task", "__key", "__id").agg(F.max("__v").alias("__v"))
    sums = rows.groupBy("__task", "__key").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    one = match.where(F.col(match_key).isNotNull()).groupBy(F.col(match_key).alias("__key")).agg(*(F.max(a).alias(a) for a in attributes))
    other = replicate(one, "__key", layout).repartitionById(layout.tasks, "__task")
    joined = sums.join(other, ["__task", "__key"], "left")
    return joined.groupBy(F.col("__key").alias("key_value")).agg(F.sum("__n").alias("n"), F.sum("__s").alias("total"), *(F.max(a).alias(a) for a in attributes))
