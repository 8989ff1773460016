"""Estimated storage of a column: fixed width times rows, octets for text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.names import col, dtype, is_nested, is_text

# fixed values: bytes per cell of the fixed-width types
WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def fixed_width(t: T.DataType) -> int | None:
    return next((w for kind, w in WIDTH.items() if isinstance(t, kind)), None)


def column_bytes(df: DataFrame, name: str) -> Column:
    """Bytes of one cell; missing text takes none."""
    t = dtype(df, name)
    width = fixed_width(t)
    if width is not None:
        return F.lit(width).cast("bigint")
    if is_text(t) or isinstance(t, T.BinaryType):
        return F.octet_length(col(name)).cast("bigint")
    if is_nested(t) and not isinstance(t, T.VariantType):
        return F.octet_length(F.to_json(F.struct(col(name)))).cast("bigint")
    return F.lit(8).cast("bigint")
