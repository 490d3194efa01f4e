"""Where results go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.session import tasks

FILES = ("parquet", "csv", "json", "orc")
NAMES = ("blackhole", "memory", "partitioned_csv", *FILES)


@dataclass(frozen=True)
class Sink:
    """kind: one of NAMES; path: a folder, or the name of the table in memory."""

    kind: str = "blackhole"
    path: str | None = None
    mode: str = "overwrite"

    def __post_init__(self) -> None:
        if self.kind not in NAMES:
            raise ValueError(f"unknown sink: {self.kind}")
        if self.kind != "blackhole" and not self.path:
            raise ValueError(f"sink {self.kind} needs a path")

    def write(self, df: DataFrame) -> None:
        if self.kind == "blackhole":
            df.write.format("noop").mode("overwrite").save()
        elif self.kind == "memory":
            df.createOrReplaceTempView(self.path)
        elif self.kind == "partitioned_csv":
            by_log(df).write.mode(self.mode).partitionBy("dt", "hm").csv(self.path, header=True)
        else:
            df.write.mode(self.mode).format(self.kind).option("header", "true").save(self.path)

    def start(self, df: DataFrame, checkpoint: str, output_mode: str = "append", every: str | None = None) -> StreamingQuery:
        """Run a streaming df over what is there now, or with every (such as "1 second") again and again; exactly once for each checkpoint."""
        writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        if self.kind == "blackhole":
            return writer.format("noop").start()
        if self.kind == "memory":
            return writer.format("memory").queryName(self.path).start()
        writer = writer.option("header", "true")
        if self.kind == "partitioned_csv":
            return writer.format("csv").partitionBy("dt", "hm").start(self.path)
        return writer.format(self.kind).start(self.path)

    def read(self, spark, schema: str | None = None) -> DataFrame:
        """schema: what a log holds, else it is inferred."""
        if self.kind == "memory":
            return spark.table(self.path)
        if self.kind == "blackhole":
            return spark.createDataFrame([], "nothing string")
        if self.kind == "partitioned_csv":
            return _read_log(spark, self.path, schema)
        if self.kind == "csv":
            return spark.read.csv(self.path, header=True, inferSchema=True)
        return spark.read.format(self.kind).load(self.path)


def from_name(name: str, path: str | None = None) -> Sink:
    return Sink(name.lower(), path)


def with_log_partitions(df: DataFrame, time: str) -> DataFrame:
    """df with the day and minute of time as partition columns of a log."""
    return df.withColumn("dt", F.date_format(time, "yyyy-MM-dd")).withColumn("hm", F.date_format(time, "HH:mm"))


def by_log(df: DataFrame) -> DataFrame:
    """df in the order of its log, in equal parts: a log gets a file for each minute, and one more for each task, instead of one for each minute and task."""
    return df.repartitionByRange(tasks(df.sparkSession), "dt", "hm", F.xxhash64(*df.columns))


#: What a task has read of a file stays in its memory until it ends.
FILES_A_TASK = 64


def _read_log(spark, path: str, schema: str | None) -> DataFrame:
    """A log is many small folders: they are listed by as many tasks as a shuffle has, not by one for each, and a task reads FILES_A_TASK files or more."""
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, tasks(spark))
    try:
        read = spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None)
    finally:
        spark.conf.set(listing, before)
    return read.coalesce(max(tasks(spark), len(read.inputFiles()) // FILES_A_TASK))
