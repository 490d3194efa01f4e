"""Run query specifications."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from millrace.spec import QuerySpec


def run_batch(spark: SparkSession, spec: QuerySpec) -> DataFrame:
    """Write the result to the spec's sink and return it."""
    df = spec.plan(spark)
    spec.sink.write(df)
    return df


def run_stream(spark: SparkSession, spec: QuerySpec, checkpoint: str, output_mode: str = "append", timeout: int | None = None) -> None:
    """Run the spec, of which at least one table is a stream, over all input there is now."""
    query = spec.sink.start(spec.plan(spark), checkpoint, output_mode)
    query.awaitTermination(timeout)
    if query.exception():
        raise RuntimeError(str(query.exception()))


def timed(spark: SparkSession, spec: QuerySpec, times: int = 10) -> float:
    """Mean seconds of several runs into the spec's sink."""
    began = time.perf_counter()
    for _ in range(times):
        run_batch(spark, spec)
    return (time.perf_counter() - began) / times
