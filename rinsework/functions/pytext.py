"""Text of a value as Python would print it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_text(c: Column, t: T.DataType) -> Column:
    """Text form; null stays null. Whole floats keep ``.0`` and large ones use an exponent."""
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return _float_text(c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _float_text(c: Column) -> Column:
    short = c.cast("string")
    size = F.abs(c.cast("double"))
    plain = F.regexp_replace(
        F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.regexp_extract(short, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(short, r"E(-?[0-9]+)$", 1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    exponent = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.regexp_replace(power, "^-", ""), 2, "0"))
    long_exponent = F.concat(mantissa, F.lit("e"), sign, F.regexp_replace(power, "^-", ""))
    return (
        F.when(c.isNull() | F.isnan(c), None)
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain)
        .when(F.length(power) > F.when(power.startswith("-"), 3).otherwise(2), long_exponent)
        .otherwise(exponent)
    )
