"""Normal forms under which differently written values are one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may surround a value without meaning.
BLANKS = " \t\r\n\f\v"


def bare_uuid(column: Column) -> Column:
    """The 32 hexadecimal digits of a UUID in lower case, without hyphens, braces and blanks; null where there aren't 32."""
    digits = F.translate(F.lower(column), "-{}" + BLANKS, "")
    return F.get(F.filter(F.array(digits), lambda x: F.length(x) == 32), F.lit(0))  # evaluates digits once


def dashed_uuid(digits: Column) -> Column:
    """8-4-4-4-12 form of 32 digits."""
    return F.concat_ws("-", *(F.substring(digits, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def stripped(column: Column) -> Column:
    """column without surrounding blanks of any kind."""
    return F.btrim(column, F.lit(BLANKS))


def label(column: Column) -> Column:
    """A label in one spelling: no surrounding blanks, lower case, hyphens for underscores and inner blanks."""
    return F.translate(F.lower(stripped(column)), "_ ", "--")


def source_name(column: Column) -> Column:
    """A source's name in one spelling: no surrounding blanks, lower case, underscores for hyphens."""
    return F.translate(F.lower(stripped(column)), "-", "_")
