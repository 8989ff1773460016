"""Column and dataset profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rinsework.names import is_numeric
from rinsework.plans.tablestats import TableStats, gather

PROFILE = (
    "column_name string, data_type string, n_rows bigint, non_null bigint, missing bigint, "
    "missing_pct double, n_distinct bigint, mean double, median double, min double, max double, "
    "var double, std double, mode string, skew double, kurtosis double"
)
SUMMARY = (
    "n_rows bigint, n_cols bigint, n_numeric bigint, n_categorical bigint, n_boolean bigint, "
    "n_datetime bigint, n_object bigint, missing_cells bigint, missing_pct double, "
    "duplicates bigint, memory_mb double"
)


def _r(x: float | None, places: int = 4) -> float | None:
    return None if x is None else round(float(x), places)


def _skew(s: TableStats, c: str) -> float | None:
    """Bias-corrected skewness; 0 for a constant column, null below three values."""
    n, g = s.count(c), s.basics[(c, "skew")]
    if n < 3:
        return None
    if s.is_constant(c) or g is None or g != g:
        return 0.0
    return g * (n * (n - 1)) ** 0.5 / (n - 2)


def _kurtosis(s: TableStats, c: str) -> float | None:
    """Bias-corrected excess kurtosis; 0 for a constant column, null below four values."""
    n, k = s.count(c), s.basics[(c, "kurtosis")]
    if n < 4:
        return None
    if s.is_constant(c) or k is None or k != k:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)


def _column(s: TableStats, c: str) -> tuple:
    n, present = s.rows, s.count(c)
    pct = round(s.missing(c) / n * 100, 2) if n else 0.0
    head = (c, s.types[c].simpleString(), n, present, s.missing(c), pct, s.distinct(c))
    if not is_numeric(s.types[c]):
        return (*head, None, None, None, None, None, None, s.mode(c), None, None)
    if not present:
        return (*head, *[None] * 9)
    b = s.basics
    var = b[(c, "var")]
    mode = repr(round(float(s.mode(c)), 4))
    return (
        *head,
        _r(b[(c, "mean")]),
        _r(s.quartiles[c][1]),
        _r(b[(c, "min")]),
        _r(b[(c, "max")]),
        _r(var),
        _r(None if var is None else var**0.5),
        mode,
        _r(_skew(s, c)),
        _r(_kurtosis(s, c)),
    )


def profile_columns(table: DataFrame | TableStats, columns: list[str] | None = None) -> DataFrame:
    """One row per column, from jobs that serve all columns together. Unknown statistics are null."""
    s = gather(table)
    if columns is not None:
        kept = [c for c in columns if c in s.columns]
        if kept != s.columns:
            s = gather(s.df.select(*[s.df[f"`{c}`"] for c in kept]))
    return s.df.sparkSession.createDataFrame([_column(s, c) for c in s.columns], PROFILE)


def summarise(table: DataFrame | TableStats) -> DataFrame:
    """One row of dataset figures."""
    s = gather(table)
    kinds = {
        "numeric": len(s.numeric),
        "categorical": len(s.category),
        "boolean": sum(isinstance(t, T.BooleanType) for t in s.types.values()),
        "datetime": len(s.timed),
    }
    cells = s.rows * len(s.columns)
    row = (
        s.rows,
        len(s.columns),
        *kinds.values(),
        len(s.columns) - sum(kinds.values()),
        s.missing_cells,
        round(s.missing_cells / cells * 100, 2) if cells else 0.0,
        s.duplicates,
        round(s.bytes / 1024.0**2, 2),
    )
    return s.df.sparkSession.createDataFrame([row], SUMMARY)
