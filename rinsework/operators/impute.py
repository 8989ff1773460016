"""Fill missing values."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.names import ROW_ID, dtype, is_fractional, is_integral, is_numeric, known, number, put, value
from rinsework.plans.heavy import modes
from rinsework.plans.onerow import measure
from rinsework.plans.ordered import carry_fill
from rinsework.plans.quantiles import column_quantiles
from rinsework.streaming.guard import require_batch

# fixed values: strategy names
STRATEGIES = ("mean", "median", "mode", "ffill", "bfill", "constant")


@dataclass(frozen=True)
class FillModel:
    """Fill value per column; row-local to apply, so it also serves new batches and streams."""

    fills: dict[str, Any] = field(default_factory=dict)
    as_double: frozenset[str] = frozenset()

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in known(df, list(self.fills)):
            t = T.DoubleType() if c in self.as_double else dtype(df, c)
            new[c] = F.coalesce(value(df, c).cast(t), F.lit(self.fills[c]).cast(t))
        return put(df, new)


def fit_fill(df: DataFrame, columns: list[str], strategy: str, custom_value: Any = None) -> FillModel:
    """Learn fill values. An integer column with gaps becomes double for mean and median."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    columns = known(df, columns)
    if strategy == "constant":
        if custom_value is None:
            return FillModel()
        return FillModel({c: _as_type(custom_value, dtype(df, c), c) for c in columns})
    require_batch(df, f"impute_missing({strategy})")
    if strategy == "mode":
        got = modes(df, columns, distinct=False)
        return FillModel({c: m[0] for c, m in got.items()})
    columns = [c for c in columns if is_numeric(dtype(df, c))]
    wanted = {"rows": F.count(F.lit(1)), **{(c, "n"): F.count(value(df, c)) for c in columns}}
    if strategy == "mean":
        wanted.update({(c, "fill"): F.avg(number(df, c)) for c in columns})
    got = measure(df, wanted)
    gaps = [c for c in columns if got[(c, "n")] < got["rows"]]
    if strategy == "mean":
        fills = {c: got[(c, "fill")] for c in gaps}
    else:
        counts = {c: got[(c, "n")] for c in gaps}
        fills = {c: v[0] for c, v in column_quantiles(df, {c: [0.5] for c in gaps}, counts=counts).items()}
    whole = frozenset(c for c in gaps if is_integral(dtype(df, c)))
    return FillModel({c: v for c, v in fills.items() if v is not None}, whole)


def _as_type(given: Any, t: T.DataType, name: str) -> Any:
    try:
        if is_integral(t):
            return int(given)
        if is_fractional(t):
            return float(given)
    except (TypeError, ValueError) as e:
        raise ValueError(f"constant {given!r} does not fit numeric column {name!r}") from e
    return given if isinstance(given, (bool, int, float)) else str(given)


def impute_missing(
    df: DataFrame,
    columns: list[str],
    strategy: str,
    custom_value: Any = None,
    order_by: str = ROW_ID,
) -> DataFrame:
    """mean and median (numeric columns), mode, ffill and bfill (table order), constant."""
    if strategy in ("ffill", "bfill"):
        require_batch(df, f"impute_missing({strategy})")
        columns = known(df, columns)
        return carry_fill(df, columns, order_by, backward=strategy == "bfill") if columns else df
    return fit_fill(df, columns, strategy, custom_value).apply(df)
