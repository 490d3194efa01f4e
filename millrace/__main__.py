"""python -m millrace nexmark|ysb|tpch|ops|sql ...: run the suites on generated streams or a data folder, or SQL interactively."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Config
from millrace.errors import engine_error
from millrace.functions.times import millis
from millrace.operators import windows
from millrace.plans import auctions, relational, tpch
from millrace.plans.dialect import SECONDS, SPARK, register_tables, render
from millrace.runner import run_batch, timed
from millrace.session import local_session
from millrace.sinks import NAMES, Sink, with_log_partitions
from millrace.sources import generators
from millrace.spec import QuerySpec, statements


def _sink(args: argparse.Namespace) -> Sink:
    return Sink(args.sink, args.path)


def _show(spark: SparkSession, spec: QuerySpec, limit: int) -> None:
    began = time.perf_counter()
    df = run_batch(spark, spec)
    print(f"{spec.name}: {time.perf_counter() - began:.2f} s into {spec.sink.kind}")
    if limit:
        df.show(limit, truncate=False)


def query_text(number: str) -> str:
    """The SQL text of a query of the auction suite."""
    names = [n for n in (f"nexmark_q{number}", f"nexmark_q{number}_aligned") if n in auctions.TEXTS]
    if not names:
        raise SystemExit(f"no SQL text for q{number}; have {sorted(auctions.TEXTS)}")
    return render(auctions.TEXTS[names[0]], SECONDS)


def _timed(time: str):
    return lambda spark: spark.table("bid").select("bid_id", "bidder", millis(F.col(time)).alias("ms"))


#: Queries whose windows SQL doesn't have: sessions, and windows from each bidder's first arrival.
_OPERATORS = {
    "11": lambda spark: windows.session_windows(_timed("b_date_time")(spark), "bidder", "ms", "bid_id", SECONDS.size),
    "12": lambda spark: windows.anchored_windows(_timed("p_time")(spark), "bidder", "ms", SECONDS.size),
}


def _streams(args: argparse.Namespace) -> generators.Stream:
    return generators.Stream(seconds=args.seconds, events_per_second=args.events_per_second * args.generators, out_of_order_group=args.out_of_order, shape=args.shape)


def nexmark(spark: SparkSession, args: argparse.Namespace) -> None:
    tables: dict[str, DataFrame] = generators.nexmark(spark, _streams(args))
    tables["part"] = spark.range(1000, 2000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    spec = QuerySpec(f"nexmark q{args.query}", _OPERATORS.get(args.query) or query_text(args.query), tables, sink=_sink(args))
    if spec.sink.kind == "partitioned_csv":
        text = spec.body
        spec = QuerySpec(spec.name, lambda s: with_log_partitions(s.sql(text).drop("dt", "hm"), "b_date_time"), tables, sink=spec.sink)
    _show(spark, spec, args.show)


def ysb(spark: SparkSession, args: argparse.Namespace) -> None:
    _show(spark, QuerySpec("ysb", render(auctions.TEXTS["ysb"], SECONDS), generators.ysb(spark, _streams(args)), sink=_sink(args)), args.show)


def run_tpch(spark: SparkSession, args: argparse.Namespace) -> None:
    register_tables(spark, args.data)
    _show(spark, QuerySpec(f"tpch q{args.query}", render(tpch.TEXTS[f"tpch_q{int(args.query):02d}"], SPARK), sink=_sink(args)), args.show)


def ops(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = generators.nexmark(spark, _streams(args))
    for name in ("op_filter", "op_join", "op_groupby", "op_sort"):
        print(f"{name}: {timed(spark, QuerySpec(name, render(relational.TEXTS[name], SPARK), tables), args.times):.3f} s")


def sql(spark: SparkSession, args: argparse.Namespace) -> None:
    """Statements end with a semicolon; quit or exit ends."""
    if args.data:
        register_tables(spark, args.data)
    held = ""
    for line in sys.stdin:
        if not held and line.strip().rstrip(";").lower() in ("quit", "exit"):
            return
        held += line
        if ";" not in line:
            continue
        for text in statements(held):
            try:
                spark.sql(text).show(args.show, truncate=False)
            except PySparkException as e:
                failed = engine_error(e)
                print(f"error: {failed} ({failed.kind})")
        held = ""


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, run in (("nexmark", nexmark), ("ysb", ysb), ("tpch", run_tpch), ("ops", ops), ("sql", sql)):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("action", nargs="?", choices=["run"], default="run")
        p.add_argument("-q", "--query", default="5" if name == "nexmark" else "1")
        p.add_argument("-s", "--seconds", type=int, default=20)
        p.add_argument("-g", "--generators", type=int, default=1)
        p.add_argument("-e", "--events-per-second", type=int, default=1000)
        p.add_argument("--out-of-order", type=int, default=1)
        p.add_argument("--shape", choices=["constant", "square", "sine"], default="constant")
        p.add_argument("--sink", choices=NAMES, default="blackhole")
        p.add_argument("--path")
        p.add_argument("--data")
        p.add_argument("--times", type=int, default=10)
        p.add_argument("--show", type=int, default=20)
        p.add_argument("--cores", default="*")
        p.add_argument("--config", help="a file whose section [spark] holds settings of the session")
    args = top.parse_args(argv)
    settings = Config.load(args.config).section("spark") if args.config else {}
    args.run(local_session(args.cores, **settings), args)


if __name__ == "__main__":
    main()
