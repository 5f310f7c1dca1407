"""Column helpers where the PostgreSQL-flavoured surface differs from Spark's functions of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_skip_nulls(*cols: Column | str) -> Column:
    """concat(...) and ||: nulls count as empty texts, other types are written as text."""
    return F.concat_ws("", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def substr(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start below 1 counts as 1, a start past the end gives an empty text."""
    start = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    length = F.lit(2147483647) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(text, start, length)


def trim_space(text: Column) -> Column:
    """trim(): all white space, not blanks alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def int_div(a: Column, b: Column) -> Column:
    """Integers divide without a rest, towards zero. Division by zero raises in ANSI mode."""
    return F.call_function("div", a, b)


def to_char(value: Column) -> Column:
    """to_char(timestamp, any format): YYYY-MM-DD HH:MM:SS."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def sum_double(col: Column) -> Column:
    """sum(): a double, whatever the input's type; null where there is no value."""
    return F.sum(col.cast("double"))


def text_to_bool(text: Column) -> Column:
    """Texts as booleans: true, 1 and yes are true, all others false."""
    return F.lower(text).isin("true", "1", "yes")


def text_to_int(text: Column) -> Column:
    """The integer that a text begins with; null where there is none."""
    found = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(found != "", found.cast("long"))


def format_type(oid: Column) -> Column:
    """The name of a type by its wire number; '-' for null, '???' for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.when(oid.isNull(), "-").otherwise(F.coalesce(F.try_element_at(known, oid.cast("int")), F.lit("???")))


#: Wire numbers of types and their names.
TYPE_NAMES = {
    16: "boolean",
    20: "bigint",
    21: "smallint",
    23: "integer",
    25: "text",
    700: "real",
    701: "double precision",
    1043: "character varying",
    1114: "timestamp without time zone",
    1184: "timestamp with time zone",
    1700: "numeric",
}
