"""SQL type names and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Accepted spellings.
_NAMES = {
    "int": "int",
    "int4": "int",
    "integer": "int",
    "serial": "int",
    "smallserial": "int",
    "int8": "bigint",
    "int2": "bigint",
    "smallint": "bigint",
    "bigint": "bigint",
    "bigserial": "bigint",
    "float4": "float",
    "real": "float",
    "float8": "double",
    "double": "double",
    "double precision": "double",
    "float": "double",
    "numeric": "double",
    "decimal": "double",
    "text": "string",
    "name": "string",
    "varchar": "string",
    "character varying": "string",
    "character": "string",
    "char": "string",
    "bpchar": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "timestamp": "timestamp",
    "timestamptz": "timestamp",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamp",
    "date": "timestamp",
}
_SHAPE = re.compile(r"^\s*([a-z0-9_]+(?: [a-z]+)*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?((?: [a-z]+)*)\s*$")


def spark_type(name: str) -> T.DataType:
    """The Spark type of a declared SQL type. numeric(p, s) is an exact decimal; unknown names are text."""
    m = _SHAPE.match(name.lower())
    if not m:
        return T.StringType()
    base = (m[1] + (m[4] or "")).strip()
    if base in ("numeric", "decimal") and m[2]:
        return T.DecimalType(int(m[2]), int(m[3] or 0))
    kind = _NAMES.get(base, "string")
    return {
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "float": T.FloatType(),
        "double": T.DoubleType(),
        "string": T.StringType(),
        "boolean": T.BooleanType(),
        "timestamp": T.TimestampType(),
    }[kind]


def is_serial(name: str) -> bool:
    return name.lower().strip() in ("serial", "bigserial", "smallserial")


def varchar_length(name: str) -> int | None:
    """The declared length of a character type."""
    m = re.match(r"^\s*(?:varchar|character varying|character|char|bpchar)\s*\(\s*(\d+)\s*\)", name.lower())
    return int(m[1]) if m else None
