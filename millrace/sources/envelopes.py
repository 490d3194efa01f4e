"""Stream envelopes: records whose payload is base64 of a JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A bid as JSON; its time comes as a number or as text, so it is read as text.
_BID = "auction bigint, bidder bigint, price bigint, b_date_time string, _corrupt string"


def base64_text(column: Column) -> Column:
    """The UTF-8 text in base64; null where it can't be decoded."""
    return F.try_to_binary(column, F.lit("base64")).cast("string")


def any_time_ms(column: Column) -> Column:
    """Epoch milliseconds of a time written as epoch milliseconds or in ISO-8601; null for anything else."""
    number = F.when(column.rlike(r"^-?[0-9]{1,18}$"), column.try_cast("bigint"))
    text = F.when(column.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.unix_millis(column.try_cast("timestamp")))
    return F.coalesce(number, text)


def json_bids(records: DataFrame, data: str) -> DataFrame:
    """records with bid (a struct; null where data can't be read) and bid_ms (null without a usable time)."""
    parsed = F.from_json(base64_text(F.col(data)), T._parse_datatype_string(_BID), {"columnNameOfCorruptRecord": "_corrupt"})
    read = records.withColumn("bid", parsed)
    read = read.withColumn("bid", F.when(F.col("bid._corrupt").isNull(), F.col("bid")))
    return read.withColumn("bid_ms", any_time_ms(F.col("bid.b_date_time")))


def decode_envelope(records: DataFrame, data: str, schema: T.StructType | str) -> DataFrame:
    """The JSON payloads of records as rows of schema; payloads that can't be read become rows of nulls."""
    return records.select(F.from_json(base64_text(F.col(data)), schema).alias("r")).select("r.*")


def kinesis_rows(records: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of a record batch event: records(Records array of struct(kinesis struct(data string)))."""
    each = records.select(F.explode("Records").alias("r")).select(F.col("r.kinesis.data").alias("data"))
    return decode_envelope(each, "data", schema)


def kafka_rows(records: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of a topic event: records(records map of topic-partition to array of struct(value string))."""
    each = records.select(F.explode(F.flatten(F.map_values("records"))).alias("r")).select(F.col("r.value").alias("data"))
    return decode_envelope(each, "data", schema)


def infer_payload_schema(spark, sample: str) -> T.StructType:
    """The schema of one base64 JSON payload, for streams whose first record declares their shape."""
    text = spark.range(1).select(base64_text(F.lit(sample)).alias("t")).first()["t"]
    return T.StructType.fromDDL(spark.range(1).select(F.schema_of_json(F.lit(text)).alias("s")).first()["s"].removeprefix("STRUCT<").removesuffix(">"))
