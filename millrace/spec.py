"""A query as one declarative unit, run as a batch or as a stream."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.windows import Window
from millrace.session import prepare
from millrace.sinks import Sink

Body = str | Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    """body: SQL (statements separated by semicolons, the last a query), or a function of the session.

    tables are registered as views under their names before body runs; window is what body assumes of its input.
    """

    name: str
    body: Body
    tables: dict[str, DataFrame] = field(default_factory=dict)
    window: Window | None = None
    sink: Sink = field(default_factory=Sink)

    def plan(self, spark: SparkSession) -> DataFrame:
        """The result, not yet computed."""
        prepare(spark)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        if callable(self.body):
            return self.body(spark)
        *before, last = statements(self.body)
        for text in before:
            spark.sql(text)
        return spark.sql(last)

    def explain(self, spark: SparkSession) -> str:
        return self.plan(spark)._jdf.queryExecution().toString()


def statements(script: str) -> list[str]:
    """The statements of a script, split at semicolons outside quotes and comments."""
    out, start, quote, i = [], 0, "", 0
    while i < len(script):
        c = script[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else len(script)
            continue
        elif c == ";":
            out.append(script[start:i])
            start = i + 1
        i += 1
    return [s.strip() for s in (*out, script[start:]) if s.strip()]


_NODES = {"sort": r"Sort|TakeOrderedAndProject", "join": r"\w*Join|CartesianProduct", "aggregate": r"\w*Aggregate", "exchange": r"\w*Exchange", "window": r"Window"}


def contains(plan: str, what: str) -> bool:
    """Whether a plan text has a sort, join, aggregate, exchange or window among its nodes."""
    nodes = re.findall(r"^[\s:|+\-]*(?:\*?\(\d+\)\s*)?(\w+)", plan, re.M)
    return any(re.fullmatch(_NODES[what], n) for n in nodes)
