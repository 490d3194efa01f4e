"""SQL texts that Spark and the reference engine of the tests both run, apart from the few functions that differ."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog import exists, table

TABLES = (
    "region nation customer supplier part orders lineitem events person auction bid ad_event campaign".split()
)


class Dialect:
    """Functions as Spark SQL writes them, and the sizes in milliseconds of a suite's epochs and windows."""

    def __init__(self, epoch: int = 3_600_000, size: int = 600_000, hop: int = 300_000, long: int = 86_400_000) -> None:
        self.epoch, self.size, self.hop, self.long = epoch, size, hop, long

    def ms(self, column: str) -> str:
        return f"unix_millis(CAST({column} AS TIMESTAMP))"

    def us(self, column: str) -> str:
        return f"unix_micros(CAST({column} AS TIMESTAMP))"

    def stamp(self, ms: str) -> str:
        return f"CAST(timestamp_millis({ms}) AS TIMESTAMP_NTZ)"

    def floor_to(self, value: str, by: int) -> str:
        return f"({value} - pmod({value}, {by}))"

    def text(self, column: str, pattern: str) -> str:
        """Date text by one of the patterns yyyy-MM-dd and HH:mm."""
        return f"date_format({column}, '{pattern}')"

    def uuid(self, column: str) -> str:
        return f"translate(lower({column}), '-{{}} \\t\\r\\n', '')"

    def now(self) -> str:
        """The time at which the query began: processing time."""
        return "CAST(current_timestamp() AS TIMESTAMP_NTZ)"

    def joined(self, column: str) -> str:
        """All values of a group in order, as text."""
        return f"array_join(sort_array(collect_list({column})), ',')"

    def regex_replace(self, column: str, pattern: str) -> str:
        return f"regexp_replace({column}, '{pattern}', '')"

    def tumble(self, time: str, hours: int) -> str:
        """Rows with the bounds of their tumbling window."""
        return f"SELECT window.start AS window_start, window.end AS window_end FROM (SELECT window({time}, '{hours} hours') AS window FROM events)"

    def hop_windows(self, time: str, hours: int, step: int) -> str:
        """Rows with the bounds of each of their hopping windows."""
        return f"SELECT window.start AS window_start, window.end AS window_end FROM (SELECT window({time}, '{hours} hours', '{step} hours') AS window FROM events)"

    def session(self, source: str, key: str, time: str, hours: int) -> str:
        """Sessions with their bounds; one ends the gap after its last row."""
        return f"SELECT {key}, session_window({time}, '{hours} hours').start AS session_start, session_window({time}, '{hours} hours').end AS session_end, count(*) AS n FROM {source} GROUP BY {key}, session_window({time}, '{hours} hours')"

    def hops(self, ms: str, base: int, size: int, hop: int) -> str:
        """The starts of the windows that ms lies in, one row each."""
        last = f"({ms} - pmod({ms} - {base}, {hop}))"
        return f"explode(filter(transform(sequence(0, {-(-size // hop) - 1}), i -> {last} - i * {hop}), s -> s + {size} > {ms}))"


class Other(Dialect):
    """Functions as DuckDB writes them."""

    def ms(self, column: str) -> str:
        return f"epoch_ms({column})"

    def us(self, column: str) -> str:
        return f"epoch_us({column})"

    def stamp(self, ms: str) -> str:
        return f"make_timestamp(({ms}) * 1000)"

    def floor_to(self, value: str, by: int) -> str:
        return f"({value} - (({value} % {by}) + {by}) % {by})"

    def text(self, column: str, pattern: str) -> str:
        return f"strftime({column}, '{ {'yyyy-MM-dd': '%Y-%m-%d', 'HH:mm': '%H:%M'}[pattern] }')"

    def uuid(self, column: str) -> str:
        return f"translate(lower({column}), '-{{}} ' || chr(9) || chr(10) || chr(13), '')"

    def now(self) -> str:
        return "CAST(now() AS TIMESTAMP)"

    def joined(self, column: str) -> str:
        return f"string_agg(CAST({column} AS VARCHAR), ',' ORDER BY {column})"

    def regex_replace(self, column: str, pattern: str) -> str:
        return f"regexp_replace({column}, '{pattern}', '', 'g')"

    def tumble(self, time: str, hours: int) -> str:
        at = f"time_bucket(INTERVAL {hours} HOUR, {time}, TIMESTAMP '1970-01-01')"
        return f"SELECT {at} AS window_start, {at} + INTERVAL {hours} HOUR AS window_end FROM events"

    def hop_windows(self, time: str, hours: int, step: int) -> str:
        at = f"time_bucket(INTERVAL {step} HOUR, {time}, TIMESTAMP '1970-01-01') - to_hours(k * {step})"
        return f"SELECT {at} AS window_start, {at} + INTERVAL {hours} HOUR AS window_end FROM events, range({hours // step}) r(k)"

    def session(self, source: str, key: str, time: str, hours: int) -> str:
        return f"""SELECT {key}, min({time}) AS session_start, max({time}) + INTERVAL {hours} HOUR AS session_end, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY {time} ROWS UNBOUNDED PRECEDING) AS part FROM (
    SELECT {key}, {time}, CASE WHEN {time} <= lag({time}) OVER (PARTITION BY {key} ORDER BY {time}) + INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY {key}, part"""

    def hops(self, ms: str, base: int, size: int, hop: int) -> str:
        last = f"({ms} - ((({ms} - {base}) % {hop}) + {hop}) % {hop})"
        return f"unnest(list_filter(list_transform(range(0, {-(-size // hop)}), lambda i: {last} - i * {hop}), lambda s: s + {size} > {ms}))"


SPARK, OTHER = Dialect(), Other()
#: The sizes of the suites on generated streams: epochs of a second, windows of ten, hops of five.
SECONDS = Dialect(1000, 10_000, 5_000, 10_000)
Text = str | Callable[[Dialect], str]


def render(text: Text, dialect: Dialect) -> str:
    return text if isinstance(text, str) else text(dialect)


def relations(spark: SparkSession, text: str) -> list[str]:
    """The relations that a query reads, in any part of it, by its parsed plan; its own named steps are none."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    return sorted({name.split(",")[0].strip() for name in re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan)})


def register_tables(spark: SparkSession, folder: str, text: str | None = None) -> None:
    """Views over the tables of a data folder, or only over those that text reads."""
    read = None if text is None else set(relations(spark, text))
    for name in [t for t in TABLES if read is None or t in read]:
        if os.path.isdir(folder) and exists(folder, name) or "://" in folder:
            table(spark, folder, name).createOrReplaceTempView(name)


def query(text: Text) -> Callable[[SparkSession, str], DataFrame]:
    """The Spark query of a text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        shown = render(text, SPARK)
        register_tables(spark, folder, shown)
        return spark.sql(shown)

    return run
