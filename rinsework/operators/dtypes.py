"""Detect, convert and narrow column types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import parse
from rinsework.functions.pytext import python_text
from rinsework.names import (
    ROW_ID,
    col,
    data_columns,
    dtype,
    is_category,
    is_integral,
    is_text,
    is_time,
    put,
    value,
)
from rinsework.operators.sizes import column_bytes, fixed_width
from rinsework.plans.counts import decisive_counts
from rinsework.plans.onerow import measure
from rinsework.streaming.guard import require_batch

# fixed values: type labels
TARGETS = ("Integer", "Float", "Boolean", "Category", "Object", "Datetime")
CATEGORY = {"logical": "category"}


def detect_types(df: DataFrame, order_by: str = ROW_ID) -> DataFrame:
    """Logical type label per column."""
    require_batch(df, "detect_types")
    columns = data_columns(df)
    text = [c for c in columns if is_text(dtype(df, c)) and not is_category(df.schema[c])]
    dated = _dated_columns(df, text, order_by)
    rest = [
        c
        for c in columns
        if c not in dated and not is_time(dtype(df, c)) and not isinstance(dtype(df, c), T.BooleanType)
    ]
    n = measure(df, {"rows": F.count(F.lit(1))})["rows"]
    distinct = decisive_counts(df, rest, n, [2, 20, n * 0.1])
    wanted = {}
    for c in [c for c in rest if distinct.get(c) == 2]:
        v = value(df, c)
        words = parse.BOOLEAN_WORDS if is_text(dtype(df, c)) else (0, 1)
        if is_text(dtype(df, c)) or not isinstance(dtype(df, c), T.BinaryType):
            wanted[c] = F.count_if(v.isNotNull() & ~v.isin(*words))
    got = measure(df, wanted)
    labels = []
    for c in columns:
        t, d = dtype(df, c), distinct.get(c, 0)
        if is_time(t) or c in dated:
            label = "Datetime"
        elif isinstance(t, T.BooleanType) or (d == 2 and got.get(c) == 0):
            label = "Boolean"
        elif is_integral(t):
            label = "Integer"
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            label = "Float"
        elif is_category(df.schema[c]):
            label = "Category"
        elif is_text(t):
            label = "Category" if 0 < d < 20 or d < n * 0.1 else "Text/Object"
        else:
            label = t.simpleString()
        labels.append((c, label))
    return df.sparkSession.createDataFrame(labels, "column_name string, logical_type string")


def _dated_columns(df: DataFrame, text: list[str], order_by: str) -> set[str]:
    """Columns of which every value has the format of the very first one.

    One aggregate finds every column's first value, a second one holds all values of the columns that may
    be dates to it.
    """
    by = col(order_by) if order_by in df.columns else F.monotonically_increasing_id()
    firsts = measure(df, {c: F.min_by(col(c), F.when(col(c).isNotNull(), by)) for c in text})
    guesses = {c: parse.guess_date_format(firsts[c]) for c in text if firsts[c] is not None}
    guesses = {c: guess for c, guess in guesses.items() if guess is not None}
    unread = measure(
        df, {c: F.count_if(col(c).isNotNull() & parse.to_datetime(col(c), f).isNull()) for c, f in guesses.items()}
    )
    return {c for c in guesses if unread[c] == 0}


def convert_type(
    df: DataFrame,
    column: str,
    target: str,
    date_format: str | None = None,
    formats: list[str] | None = None,
    order_by: str = ROW_ID,
) -> DataFrame:
    """Convert one column; what cannot be read becomes null.

    ``Datetime`` without a format takes the format of the first value in table order and holds all
    rows to it; if that value is no known date, every row is tried with all known formats. ``formats``
    tries several per row from the start and stays row-local.
    """
    if column not in df.columns:
        return df
    if target not in TARGETS:
        raise ValueError(f"unknown target type: {target}")
    c, t = col(column), dtype(df, column)
    if target == "Integer":
        if is_integral(t):
            new = c.cast("bigint")
        elif isinstance(t, T.BooleanType):
            new = c.cast("int").cast("bigint")
        else:
            new = F.bround(parse.to_number(c, t)).cast("bigint")
    elif target == "Float":
        new = (c.cast("int") if isinstance(t, T.BooleanType) else parse.to_number(c, t)).cast("double")
    elif target == "Boolean":
        new = c if isinstance(t, T.BooleanType) else parse.to_boolean(python_text(c, t))
    elif target == "Category":
        new = c.alias(column, metadata=CATEGORY)
        return df.select(*[new if n == column else col(n) for n in df.columns])
    elif target == "Object":
        text = python_text(value(df, column), t)
        new = F.when(text != "nan", text)
    else:
        new = _datetime(df, column, date_format, formats, order_by)
    return put(df, {column: new})


def _datetime(df: DataFrame, column: str, date_format, formats, order_by: str):
    c, t = col(column), dtype(df, column)
    if is_time(t):
        return c.cast("timestamp_ntz")
    if not is_text(t):
        raise ValueError(f"column {column!r} holds numbers, not dates")
    if date_format:
        return parse.to_datetime(c, date_format)
    if formats:
        return F.coalesce(*[parse.to_datetime(c, f) for f in formats])
    require_batch(df, "convert_type to Datetime without a format")
    first = first_value(df, column, order_by)
    if first is None:
        return F.lit(None).cast("timestamp_ntz")
    guessed = parse.guess_date_format(first)
    if guessed is None:
        return F.coalesce(*[parse.to_datetime(c, f) for f in parse.DATE_FORMATS])
    return parse.to_datetime(c, guessed)


def first_value(df: DataFrame, column: str, order_by: str = ROW_ID):
    """First non-null value in table order: one aggregate, nothing sorted."""
    v = col(column)
    by = col(order_by) if order_by in df.columns else F.monotonically_increasing_id()
    return measure(df, {"first": F.min_by(v, F.when(v.isNotNull(), by))})["first"]


def as_dates(df: DataFrame, column: str, order_by: str = ROW_ID):
    """Timestamp column for the date operators: typed columns as they are, text by its first format."""
    return _datetime(df, column, None, None, order_by)


@dataclass(frozen=True)
class NarrowModel:
    """New type per column, and the columns that get the category mark."""

    types: dict[str, T.DataType]
    marks: frozenset[str]

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            e = _narrow_cast(df, c, self.types[c]) if c in self.types else col(c)
            out.append(e.alias(c, metadata=CATEGORY) if c in self.marks else e.alias(c))
        return df.select(*out)


def narrow_from(
    df: DataFrame, ranges: dict[str, tuple], distinct: dict[str, int], rows: int, narrow_floats: bool = True
) -> NarrowModel:
    """Choose types from known ranges (smallest, largest) and distinct counts of the text columns."""
    types, marks = {}, set()
    for c in data_columns(df):
        t = dtype(df, c)
        low, high = ranges.get(c, (None, None))
        if is_integral(t):
            types[c] = _narrow_int(low, high, t)
        elif isinstance(t, T.DoubleType) and narrow_floats and low is not None:
            types[c] = T.FloatType()
        elif 0 < distinct.get(c, 0) < 100 and distinct[c] < rows * 0.3:
            marks.add(c)
    return NarrowModel(types, frozenset(marks))


def narrow_types(df: DataFrame, narrow_floats: bool = True) -> tuple[DataFrame, DataFrame]:
    """Smallest integer width by range, single-precision floats, category mark for low-cardinality text.

    Returns the narrowed table and a one-row table with estimated megabytes before and after.
    """
    require_batch(df, "narrow_types")
    columns = data_columns(df)
    wanted = {"rows": F.count(F.lit(1))}
    for c in columns:
        if is_integral(dtype(df, c)) or isinstance(dtype(df, c), T.DoubleType):
            wanted[(c, "lo")], wanted[(c, "hi")] = F.min(value(df, c)), F.max(value(df, c))
        if fixed_width(dtype(df, c)) is None:
            wanted[(c, "bytes")] = F.sum(column_bytes(df, c))
    got = measure(df, wanted)
    text = [c for c in columns if is_text(dtype(df, c)) and not is_category(df.schema[c])]
    distinct = decisive_counts(df, text, got["rows"], [100, got["rows"] * 0.3])
    ranges = {c: (got[(c, "lo")], got[(c, "hi")]) for c in columns if (c, "lo") in got}
    model = narrow_from(df, ranges, distinct, got["rows"], narrow_floats)
    return model.apply(df), _size_report(df, model, got, distinct)


def _size_report(df: DataFrame, model: NarrowModel, got: dict, distinct: dict[str, int]) -> DataFrame:
    n, before, after = got["rows"], 0, 0
    for c in data_columns(df):
        width = fixed_width(dtype(df, c))
        size = (got[(c, "bytes")] or 0) if width is None else width * n
        before += size
        if c in model.marks:
            # one byte per row for the code, plus the dictionary
            after += n + (size * distinct[c]) // max(1, n)
        else:
            after += size if width is None else fixed_width(model.types.get(c, dtype(df, c))) * n
    mega, saved = 1024.0**2, before - after
    figures = (
        round(before / mega, 2),
        round(after / mega, 2),
        round(saved / mega, 2),
        round(saved / before * 100, 1) if before else 0.0,
    )
    return df.sparkSession.createDataFrame(
        [figures], "start_mb double, end_mb double, saved_mb double, saved_pct double"
    )


def _narrow_cast(df: DataFrame, name: str, t: T.DataType):
    return col(name) if t == dtype(df, name) else col(name).cast(t)


def _narrow_int(low, high, t: T.DataType) -> T.DataType:
    """Strict bounds; unsigned widths take the next wider signed type."""
    if low is None:
        return t
    if low >= 0:
        # fixed values: largest unsigned numbers of 8, 16 and 32 bits
        steps = ((255, T.ShortType()), (65_535, T.IntegerType()), (4_294_967_295, T.LongType()))
        return next((narrow for top, narrow in steps if high < top), T.LongType())
    # fixed values: ends of the signed ranges of 8, 16 and 32 bits
    steps = (
        (-128, 127, T.ByteType()),
        (-32_768, 32_767, T.ShortType()),
        (-2_147_483_648, 2_147_483_647, T.IntegerType()),
    )
    return next((narrow for bottom, top, narrow in steps if low > bottom and high < top), T.LongType())
