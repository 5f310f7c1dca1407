"""Values as the text that clients read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wire_text(value: Column, kind: T.DataType) -> Column:
    """t and f for booleans, whole floats without a point, timestamps in UTC with a zone and no needless zeros; null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    if isinstance(kind, T.FractionalType):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("+00"))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    return value.cast("string")
