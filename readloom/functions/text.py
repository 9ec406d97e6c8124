"""Spelling rules shared by all tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters stripped from both ends of a value.
WHITE = " \t\n\r\x0b\x0c"
#: The same set as a DuckDB expression.
WHITE_SQL = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def value_of(column: str | Column) -> Column:
    """A barcode or sequence value: upper case, white space removed at both ends; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(F.btrim(c, F.lit(WHITE)))


def value_sql(expr: str) -> str:
    return f"upper(trim({expr}, {WHITE_SQL}))"


def label_of(column: str | Column) -> Column:
    """A label such as a source name: lower case, trimmed."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.btrim(c, F.lit(WHITE)))


def label_sql(expr: str) -> str:
    return f"lower(trim({expr}, {WHITE_SQL}))"
