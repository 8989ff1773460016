"""Column roles and type tests shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, also when it holds dots or blanks."""
    return F.col(quoted(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, INTEGRAL)


def is_fractional(t: T.DataType) -> bool:
    return isinstance(t, FRACTIONAL)


def is_numeric(t: T.DataType) -> bool:
    """Numbers only: booleans are not numeric."""
    return isinstance(t, INTEGRAL + FRACTIONAL)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, TEXT)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, TIMES)


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, NESTED)


def is_category(field: T.StructField) -> bool:
    return field.metadata.get("logical") == "category"


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row identity."""
    return [c for c in df.columns if c != ROW_ID]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_numeric(dtype(df, c))]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_text(dtype(df, c))]


def known(df: DataFrame, columns: list[str], strict: bool = False) -> list[str]:
    """The requested columns that exist; unknown ones are skipped unless strict."""
    missing = [c for c in columns if c not in df.columns]
    if missing and strict:
        raise ValueError(f"unknown columns: {missing}")
    return [c for c in columns if c in df.columns]


def value(df: DataFrame, name: str) -> Column:
    """Column with NaN read as missing and -0.0 as 0.0."""
    c = col(name)
    if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), None).otherwise(c + F.lit(0.0).cast(dtype(df, name)))
    return c


def present(df: DataFrame, name: str) -> Column:
    """Is the cell there? Written so that the null test reaches the file scan."""
    c = col(name)
    if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def number(df: DataFrame, name: str) -> Column:
    """Numeric column as a double with NaN read as missing."""
    return value(df, name).cast("double")


def put(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place and append new ones in one projection."""
    kept = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    added = [e.alias(n) for n, e in new.items() if n not in df.columns]
    return df.select(*kept, *added)
