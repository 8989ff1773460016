"""Derived columns: arithmetic, conditions, dates, logarithm, bins."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.functions.pytext import python_text
from rinsework.functions.text import quote
from rinsework.names import ROW_ID, col, dtype, is_numeric, number, put, value
from rinsework.operators.dtypes import as_dates
from rinsework.plans.onerow import measure
from rinsework.plans.quantiles import column_quantiles
from rinsework.streaming.guard import require_batch

DAY = 86_400_000_000
HOUR = 3_600_000_000


def math_column(df: DataFrame, column: str, op: str, operand: str | float, new_name: str) -> DataFrame:
    """add, subtract, multiply or divide by a column or a constant; division by zero gives null."""
    if column not in df.columns:
        return df
    a = value(df, column)
    if isinstance(operand, str) and operand in df.columns:
        b = value(df, operand)
    else:
        try:
            b = F.lit(float(operand))
        except ValueError as e:
            raise ValueError(f"{operand!r} is neither a column nor a number") from e
    if op == "add":
        new = a + b
    elif op == "subtract":
        new = a - b
    elif op == "multiply":
        new = a * b
    elif op == "divide":
        new = F.try_divide(a.cast("double"), b.cast("double"))
    else:
        raise ValueError(f"unknown operation: {op}")
    return put(df, {new_name: new})


def conditional_column(
    df: DataFrame,
    new_column: str,
    column: str,
    op: str,
    compared: Any,
    true_value: Any,
    false_value: Any,
    literal: bool = False,
) -> DataFrame:
    """``true_value`` where the condition holds. A missing cell fails every test but ``!=``."""
    if column not in df.columns:
        return df
    c, t = value(df, column), dtype(df, column)
    if op == "contains":
        pattern = quote(str(compared)) if literal else str(compared)
        test = F.regexp_like(python_text(c, t), F.lit(pattern))
    else:
        if is_numeric(t):
            try:
                compared = float(compared)
            except ValueError as e:
                raise ValueError(f"{compared!r} cannot be compared with numeric column {column!r}") from e
        tests = {
            "==": lambda: c == F.lit(compared),
            "!=": lambda: c != F.lit(compared),
            ">": lambda: c > F.lit(compared),
            "<": lambda: c < F.lit(compared),
            ">=": lambda: c >= F.lit(compared),
            "<=": lambda: c <= F.lit(compared),
        }
        if op not in tests:
            raise ValueError(f"unknown comparison: {op}")
        test = tests[op]()
    held = F.coalesce(test, F.lit(op == "!="))
    return put(df, {new_column: F.when(held, F.lit(true_value)).otherwise(F.lit(false_value))})


# fixed values: date part names
PARTS = {
    "Year": F.year,
    "Month": F.month,
    "Day": F.dayofmonth,
    "DayOfWeek": lambda c: F.date_format(c, "EEEE"),
    "Quarter": F.quarter,
    "Hour": F.hour,
}


def date_parts(df: DataFrame, column: str, parts: list[str], order_by: str = ROW_ID) -> DataFrame:
    """Append ``{column}_{part}`` for each known part; DayOfWeek is the English name."""
    if column not in df.columns:
        return df
    moment = as_dates(df, column, order_by)
    return put(df, {f"{column}_{p.lower()}": PARTS[p](moment) for p in parts if p in PARTS})


def age(
    df: DataFrame, birth_column: str, new_name: str, as_of: datetime | None = None, order_by: str = ROW_ID
) -> DataFrame:
    """Whole years from birth to ``as_of``."""
    if birth_column not in df.columns:
        return df
    now = F.lit(as_of or datetime.now()).cast("timestamp_ntz")
    born = as_dates(df, birth_column, order_by)
    early = F.struct(F.month(now), F.dayofmonth(now)) < F.struct(F.month(born), F.dayofmonth(born))
    return put(df, {new_name: (F.year(now) - F.year(born) - early.cast("int")).cast("bigint")})


def date_difference(
    df: DataFrame, start: str, end: str, new_name: str, unit: str = "days", order_by: str = ROW_ID
) -> DataFrame:
    """``end - start``; days are floored, weeks and years derive from whole days."""
    if start not in df.columns or end not in df.columns:
        return df

    def micros(name: str) -> Column:
        # zone-free on both sides: elapsed time, no daylight-saving jumps
        return F.timestamp_diff(
            "MICROSECOND",
            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
            as_dates(df, name, order_by),
        )

    gap = micros(end) - micros(start)
    days = F.floor(gap / DAY)
    units = {
        "days": lambda: days.cast("bigint"),
        "weeks": lambda: days / F.lit(7.0),
        "years": lambda: days / F.lit(365.25),
        "hours": lambda: gap / F.lit(float(HOUR)),
    }
    if unit not in units:
        raise ValueError(f"unknown unit: {unit}")
    return put(df, {new_name: units[unit]()})


@dataclass(frozen=True)
class LogModel:
    column: str
    new_name: str
    shift: float

    def apply(self, df: DataFrame) -> DataFrame:
        return put(df, {self.new_name: F.log1p(number(df, self.column) + F.lit(self.shift))})


def fit_log(df: DataFrame, column: str, new_name: str) -> LogModel:
    require_batch(df, "log_transform")
    low = measure(df, {"low": F.min(number(df, column))})["low"]
    return LogModel(column, new_name, -low if low is not None and low < 0 else 0.0)


def log_transform(df: DataFrame, column: str, new_name: str) -> DataFrame:
    """log(1 + x), after a shift that lifts a negative minimum to zero."""
    if column not in df.columns or not is_numeric(dtype(df, column)):
        return df
    return fit_log(df, column, new_name).apply(df)


@dataclass(frozen=True)
class BinModel:
    """Right-closed bins given by their edges."""

    column: str
    new_name: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]
    include_lowest: bool

    def index(self, df: DataFrame) -> Column:
        """0-based bin of each row: the number of inner edges below the value; null outside."""
        x = number(df, self.column)
        low, high = self.edges[0], self.edges[-1]
        inside = ((x >= F.lit(low)) if self.include_lowest else (x > F.lit(low))) & (x <= F.lit(high))
        below = F.lit(0)
        for edge in self.edges[1:-1]:
            below = below + (x > F.lit(edge)).cast("int")
        return F.when(inside, below)

    def apply(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(text) for text in self.labels])
        return put(df, {self.new_name: F.try_element_at(names, self.index(df) + 1)})


def fit_bins(
    df: DataFrame,
    column: str,
    bins: int,
    labels: list[str] | None,
    new_name: str,
    strategy: str = "uniform",
) -> BinModel | None:
    """Equal-width or equal-frequency bins; None where the column has no value."""
    require_batch(df, "bin_column")
    if strategy not in ("uniform", "quantile"):
        raise ValueError(f"unknown binning strategy: {strategy}")
    if strategy == "uniform":
        got = measure(df, {"lo": F.min(number(df, column)), "hi": F.max(number(df, column))})
        if got["lo"] is None:
            return None
        edges = _even_edges(got["lo"], got["hi"], bins)
    else:
        cuts = column_quantiles(df, {column: [float(q) for q in np.linspace(0, 1, bins + 1)]})[column]
        if cuts[0] is None:
            return None
        edges = sorted(set(cuts))
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins need as many labels, got {len(labels)}")
    names = labels or _interval_names(edges, strategy == "quantile")
    return BinModel(column, new_name, tuple(edges), tuple(names), strategy == "quantile")


def bin_column(
    df: DataFrame,
    column: str,
    bins: int,
    labels: list[str] | None,
    new_name: str,
    strategy: str = "uniform",
) -> DataFrame:
    """Append the bin label of each row, ``(low, high]`` unless labels are given."""
    if column not in df.columns or not is_numeric(dtype(df, column)):
        return df
    model = fit_bins(df, column, bins, labels, new_name, strategy)
    return df if model is None else model.apply(df)


def _even_edges(low: float, high: float, bins: int) -> list[float]:
    """Equal widths; the lowest edge moves down by 0.1 % of the range, a single value gets 0.1 % room."""
    if low == high:
        room_low = 0.001 * abs(low) if low else 0.001
        room_high = 0.001 * abs(high) if high else 0.001
        return [float(e) for e in np.linspace(low - room_low, high + room_high, bins + 1)]
    edges = [float(e) for e in np.linspace(low, high, bins + 1)]
    edges[0] -= (high - low) * 0.001
    return edges


def _rounded(x: float, digits: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    part, whole = math.modf(x)
    places = digits if whole else digits - 1 - math.floor(math.log10(abs(part)))
    return float(np.around(x, places))


def _interval_names(edges: list[float], include_lowest: bool, digits: int = 3) -> list[str]:
    """Interval texts with as many digits as keep the edges apart."""
    places = next((p for p in range(digits, 20) if len({_rounded(e, p) for e in edges}) == len(edges)), digits)
    shown = [_rounded(e, places) for e in edges]
    if include_lowest:
        shown[0] = _rounded(shown[0] - 10.0**-places, places)
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]
