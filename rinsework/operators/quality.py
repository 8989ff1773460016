"""Data quality score and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rinsework.plans.tablestats import TableStats, gather

SCORE = (
    "score double, completeness double, uniqueness double, regularity double, "
    "consistency double, efficiency double"
)
SUGGESTION = (
    "category string, column_name string, affected bigint, pct double, detail string, "
    "severity string, message string, action string"
)
# fixed values: weights of the parts, and limits of the storage test
WEIGHTS = {
    "completeness": 0.25,
    "uniqueness": 0.20,
    "regularity": 0.20,
    "consistency": 0.15,
    "efficiency": 0.20,
}
SMALL_NUMBER = 32_000
OUTLIER_FACTOR = 150
STORAGE_FLOOR = 50


def _efficiency(s: TableStats) -> float:
    penalty = 0
    for c in s.columns:
        t = s.types[c]
        if s.is_reusable_text(c):
            penalty += 10
        elif isinstance(t, T.DoubleType) and s.count(c):
            penalty += 5 * (s.basics[(c, "max")] < SMALL_NUMBER)
        elif isinstance(t, T.LongType) and s.count(c):
            inside = -SMALL_NUMBER < s.basics[(c, "min")] and s.basics[(c, "max")] < SMALL_NUMBER
            penalty += 5 * inside
    return max(STORAGE_FLOOR, 100 - penalty)


def score_parts(s: TableStats) -> dict[str, float]:
    """Unrounded parts of the score, 0 to 100 each."""
    cells = s.rows * len(s.columns)
    if not cells:
        return dict.fromkeys(WEIGHTS, 0.0)
    numeric_cells = sum(s.count(c) for c in s.numeric)
    outlier_share = sum(s.outliers.values()) / numeric_cells if numeric_cells else 0.0
    variants = [c for c, t in s.types.items() if isinstance(t, T.VariantType)]
    text = s.text + variants
    mixed = sum(s.is_mixed(c) for c in text)
    return {
        "completeness": max(0.0, 100 - s.missing_cells / cells * 100),
        "uniqueness": max(0.0, 100 - s.duplicates / s.rows * 100),
        "regularity": max(0.0, 100 - outlier_share * OUTLIER_FACTOR),
        "consistency": max(0.0, 100 - mixed / len(text) * 100) if text else 100.0,
        "efficiency": float(_efficiency(s)),
    }


def quality_score(table: DataFrame | TableStats) -> DataFrame:
    """One row: weighted score and its five parts, to one decimal."""
    s = gather(table)
    parts = score_parts(s)
    total = sum(WEIGHTS[k] * v for k, v in parts.items())
    row = tuple(round(v, 1) for v in (total, *parts.values()))
    return s.df.sparkSession.createDataFrame([row], SCORE)


def suggest_improvements(table: DataFrame | TableStats) -> DataFrame:
    """One row per finding."""
    s = gather(table)
    rows = [*_gaps(s), *_copies(s), *_static(s), *_extremes(s), *_mixtures(s), *_reusable(s)] if s.rows else []
    return s.df.sparkSession.createDataFrame(rows, SUGGESTION)


def _gaps(s: TableStats):
    for c in s.columns:
        n = s.missing(c)
        if n:
            pct = n / s.rows * 100
            yield (
                "Missing Values", c, n, round(pct, 1), None, "danger" if pct > 40 else "warning",
                f"{n} of {s.rows} cells in {c} are missing", "impute or drop",
            )


def _copies(s: TableStats):
    if s.duplicates:
        pct = round(s.duplicates / s.rows * 100, 1)
        yield (
            "Duplicates", None, s.duplicates, pct, None, "warning",
            f"{s.duplicates} rows repeat an earlier row", "remove duplicates",
        )


def _static(s: TableStats):
    for c in s.columns:
        if not s.count(c):
            yield "Column Check", c, s.rows, 100.0, None, "danger", f"{c} is empty", "drop the column"
        elif s.is_constant(c):
            only = s.only_values[c]
            yield (
                "Column Check", c, s.rows, 100.0, only, "info",
                f"{c} holds the single value {only!r}", "drop the column",
            )


def _extremes(s: TableStats):
    for c, n in s.outliers.items():
        pct = n / s.count(c) * 100 if s.count(c) else 0.0
        if n and pct > 1.0:
            yield (
                "Outliers", c, n, round(pct, 1), None, "info",
                f"{n} values of {c} lie outside 1.5 interquartile ranges", "cap, replace or remove",
            )


def _mixtures(s: TableStats):
    for c in s.columns:
        if s.is_mixed(c):
            kinds = ", ".join(sorted(s.basics.get((c, "kinds")) or ())) or None
            yield (
                "Data Types", c, None, None, kinds, "warning",
                f"{c} mixes kinds of values", "convert to one type",
            )


def _reusable(s: TableStats):
    for c in s.text:
        if s.is_reusable_text(c):
            yield (
                "Optimization", c, s.sizes[c], None, None, "info",
                f"{c} has only {s.sizes[c]} different texts", "convert to Category",
            )
