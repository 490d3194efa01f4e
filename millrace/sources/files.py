"""Files as tables: delimited text, JSON lines, CSV with a header, Parquet; each also as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-delimited rows that end with a pipe, without a header."""
    wide = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    return spark.read.csv(path, sep="|", schema=wide).drop("_end")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON texts, one a line. Without a schema it is inferred from the whole input."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema) if schema is not None else spark.read.csv(path, header=True, inferSchema=True)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as an unbounded table."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


READERS = {"tbl": delimited, "json": json_lines, "csv": csv, "parquet": parquet}
