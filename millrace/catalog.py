"""Tables by name: schemas of the streaming suites, and readers of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table name of a data folder (one file, or a folder of part files)."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def exists(folder: str, name: str) -> bool:
    return os.path.exists(f"{folder}/{name}.parquet")



def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_L, _S, _I, _D, _TS = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

#: Schemas of the auction stream, the ad stream and the decision-support suite. 32-bit identifiers are widened.
SCHEMAS: dict[str, T.StructType] = {
    "person": _schema(p_id=_L, name=_S, email_address=_S, credit_card=_S, city=_S, state=_S, p_date_time=_TS),
    "auction": _schema(a_id=_L, item_name=_S, description=_S, initial_bid=_L, reserve=_L, a_date_time=_TS, expires=_TS, seller=_L, category=_L),
    "bid": _schema(auction=_L, bidder=_L, price=_L, b_date_time=_TS),
    "side_input": _schema(key=_L, value=_L),
    "ad_event": _schema(user_id=_S, page_id=_S, ad_id=_S, ad_type=_S, event_type=_S, event_time=_TS, ip_address=_S),
    "campaign": _schema(c_ad_id=_S, campaign_id=_S),
    "part": _schema(p_partkey=_I, p_name=_S, p_mfgr=_S, p_brand=_S, p_type=_S, p_size=_I, p_container=_S, p_retailprice=_D, p_comment=_S),
    "supplier": _schema(s_suppkey=_I, s_name=_S, s_address=_S, s_nationkey=_I, s_phone=_S, s_acctbal=_D, s_comment=_S),
    "partsupp": _schema(ps_partkey=_I, ps_suppkey=_I, ps_availqty=_I, ps_supplycost=_D, ps_comment=_S),
    "customer": _schema(c_custkey=_I, c_name=_S, c_address=_S, c_nationkey=_I, c_phone=_S, c_acctbal=_D, c_mktsegment=_S, c_comment=_S),
    "orders": _schema(o_orderkey=_I, o_custkey=_I, o_orderstatus=_S, o_totalprice=_D, o_orderdate=T.DateType(), o_orderpriority=_S, o_clerk=_S, o_shippriority=_I, o_comment=_S),
    "lineitem": _schema(
        l_orderkey=_I, l_partkey=_I, l_suppkey=_I, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S,
        l_shipdate=T.DateType(), l_commitdate=T.DateType(), l_receiptdate=T.DateType(), l_shipinstruct=_S, l_shipmode=_S, l_comment=_S,
    ),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I, n_comment=_S),
    "region": _schema(r_regionkey=_I, r_name=_S, r_comment=_S),
}

SUITES: dict[str, tuple[str, ...]] = {
    "nexmark": ("person", "auction", "bid", "side_input"),
    "ysb": ("ad_event", "campaign"),
    "tpch": ("part", "supplier", "partsupp", "customer", "orders", "lineitem", "nation", "region"),
}


def schema(name: str) -> T.StructType:
    """The declared schema of a suite table; KeyError for an unknown name."""
    return SCHEMAS[name]


def register(spark: SparkSession, suite: str, tables: dict[str, DataFrame] | None = None) -> None:
    """Register a suite's tables as temporary views: the given frames, and empty relations for the rest."""
    for name in SUITES[suite]:
        df = (tables or {}).get(name)
        (spark.createDataFrame([], SCHEMAS[name]) if df is None else df).createOrReplaceTempView(name)
