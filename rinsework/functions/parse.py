"""Lenient parsing of numbers, booleans and dates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions.text import strip

# fixed values: number texts, boolean words and date formats that are understood
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY = r"^(?i)[+-]?inf(inity)?$"
TRUE_WORDS = ("true", "1", "1.0", "yes", "t", "y")
FALSE_WORDS = ("false", "0", "0.0", "no", "f", "n")
BOOLEAN_WORDS = ("0", "1", "True", "False", "true", "false", "T", "F", "Yes", "No", "yes", "no")
DATE_FORMATS = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m-%d-%Y",
    "%d-%m-%Y",
    "%d-%b-%Y",
    "%d %b %Y",
    "%d %B %Y",
    "%b %d, %Y",
    "%B %d, %Y",
    "%b %d %Y",
    "%B %d %Y",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y-%m-%d %H:%M:%S%z",
    "%Y-%m-%dT%H:%M:%S.%f%z",
    "%Y-%m-%d %H:%M:%S.%f%z",
    "%Y%m%d",
)
SPARK_PATTERN = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "M",
    "%d": "d",
    "%H": "H",
    "%I": "h",
    "%M": "m",
    "%S": "s",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
}
# parts that come in several lengths: one to six digits of a second, offsets with or without a colon
LENIENT_PATTERN = {"%f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "%z": "[XXX][XX]"}


def to_number(c: Column, t: T.DataType) -> Column:
    """Double, or null where the text is no number."""
    if not isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    s = strip(c)
    sign = F.when(s.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(s.rlike(NUMBER), s.try_cast("double")).when(s.rlike(INFINITY), sign)


def to_boolean(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def spark_date_pattern(date_format: str) -> str:
    """Spark datetime pattern of a strptime format; single digits are accepted, as strptime does."""
    out, i, quoted = "", 0, ""

    def flush(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if text else ""

    while i < len(date_format):
        token = date_format[i : i + 2]
        if token in SPARK_PATTERN:
            out += flush(quoted) + SPARK_PATTERN[token]
            quoted = ""
            i += 2
        elif token in LENIENT_PATTERN:
            out += flush(quoted) + LENIENT_PATTERN[token]
            quoted = ""
            i += 2
        elif token.startswith("%"):
            raise ValueError(f"date format part {token!r} is not supported")
        elif date_format[i].isalpha() or date_format[i] in "'[]{}#":
            quoted += date_format[i]
            i += 1
        else:
            out += flush(quoted) + date_format[i]
            quoted = ""
            i += 1
    return out + flush(quoted)


def to_datetime(c: Column, date_format: str) -> Column:
    """Zone-free timestamp, or null where the text does not have the format; offsets are turned to session time."""
    if date_format == "%Y%m%d":  # digits without marks between them need fixed widths
        return F.when(strip(c).rlike("^[0-9]{8}$"), F.try_to_timestamp(strip(c), F.lit("yyyyMMdd"))).cast("timestamp_ntz")
    return F.try_to_timestamp(strip(c), F.lit(spark_date_pattern(date_format))).cast("timestamp_ntz")


def guess_date_format(text: str) -> str | None:
    """First known format that reads the text; month first where both orders fit."""
    for date_format in DATE_FORMATS:
        try:
            datetime.strptime(text.strip(), date_format)
            return date_format
        except ValueError:
            continue
    return None
