"""Find and treat outliers in one numeric column."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.names import ROW_ID, col, dtype, fresh, is_numeric, number, put
from rinsework.operators import density, forest
from rinsework.plans.lookup import attach
from rinsework.plans.onerow import measure
from rinsework.plans.quantiles import column_quantiles
from rinsework.streaming.guard import require_batch

# fixed values: method and action names
METHODS = (
    "IQR",
    "Z Score",
    "Modified Z Score",
    "Isolation Forest",
    "Local Outlier Factor",
    "DBSCAN",
)
ACTIONS = ("Remove", "Replace", "Cap")
NORMAL_MAD = 0.6745


@dataclass(frozen=True)
class OutlierModel:
    """Fitted detector of one column.

    Interval methods carry a row-local test. The density methods judge each distinct value by its
    neighbours and carry the flagged values as a table.
    """

    column: str
    method: str
    meta: dict[str, float] = field(default_factory=dict)
    test: Any = None
    flagged_values: DataFrame | None = None
    fill: float | None = None
    any_flagged: bool = False

    def flag(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        """Append the outlier mark; a missing cell is marked only where the detector fills it."""
        x = number(df, self.column)
        if self.fill is not None:
            x = F.coalesce(x, F.lit(self.fill))
        if self.flagged_values is not None and self.any_flagged:
            key, hit = fresh("x", df.columns), fresh("hit", df.columns)
            flagged = self.flagged_values.withColumnRenamed("hit", hit)
            found = attach(df.withColumn(key, x), flagged, {key: "value"}, [hit], "n")
            return found.select(*[col(c) for c in df.columns], F.coalesce(col(hit), F.lit(False)).alias(name))
        mark = F.lit(False) if self.test is None else F.coalesce(self.test(x), F.lit(False))
        return df.select(*[col(c) for c in df.columns], mark.alias(name))


def fit_outliers(df: DataFrame, column: str, method: str, **params: float) -> OutlierModel:
    if method not in METHODS:
        raise ValueError(f"unknown outlier method: {method}")
    require_batch(df, f"outliers ({method})")
    if column not in df.columns or not is_numeric(dtype(df, column)):
        return OutlierModel(column, method)
    x = number(df, column)
    if method == "IQR":
        return _iqr(df, column, params.get("threshold", 1.5))
    if method == "Z Score":
        return _z_score(df, column, x, params.get("threshold", 3.0))
    if method == "Modified Z Score":
        return _modified_z(df, column, params.get("threshold", 3.5))
    middle = column_quantiles(df, {column: [0.5]})[column][0]
    if middle is None:
        return OutlierModel(column, method)
    filled = df.select(F.coalesce(x, F.lit(middle)).alias("value"))
    if method == "Isolation Forest":
        share = params.get("contamination", 0.05)
        draw = df.select(
            F.coalesce(x, F.lit(middle)).alias("value"),
            (col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()).alias(ROW_ID),
        )
        test, hits = forest.fit(draw, share, int(params.get("seed", 42)))
        return OutlierModel(column, method, {"contamination": share}, test, None, middle, hits)
    if method == "Local Outlier Factor":
        share, k = params.get("contamination", 0.05), int(params.get("n_neighbors", 20))
        present = measure(df, {"n": F.count(x)})["n"]
        flagged = density.local_outlier_values(filled, min(k, present - 1), share) if present > 1 else None
        meta = {"contamination": share, "n_neighbors": k}
    else:
        eps, least = params.get("eps", 0.5), int(params.get("min_samples", 5))
        flagged = density.noise_values(filled, eps, least)
        meta = {"eps": eps, "min_samples": least}
    hits = flagged is not None and bool(flagged.head(1))
    return OutlierModel(column, method, meta, None, flagged, middle, hits)


def _outside(low: float, high: float):
    return lambda x: (x < F.lit(low)) | (x > F.lit(high))


def _iqr(df: DataFrame, column: str, k: float) -> OutlierModel:
    q1, q3 = column_quantiles(df, {column: [0.25, 0.75]})[column]
    if q1 is None:
        return OutlierModel(column, "IQR")
    spread = q3 - q1
    low, high = q1 - k * spread, q3 + k * spread
    meta = {"lower_bound": low, "upper_bound": high, "q1": q1, "q3": q3, "iqr": spread}
    return _interval(df, column, "IQR", meta, _outside(low, high))


def _z_score(df: DataFrame, column: str, x: Column, threshold: float) -> OutlierModel:
    got = measure(df, {"mean": F.avg(x), "std": F.stddev_samp(x)})
    mean, std = got["mean"], got["std"]
    if not std or not std > 0:
        return OutlierModel(column, "Z Score")
    meta = {
        "mean": mean,
        "std": std,
        "lower_bound": mean - threshold * std,
        "upper_bound": mean + threshold * std,
    }
    test = lambda v: F.abs((v - F.lit(mean)) / F.lit(std)) > threshold
    return _interval(df, column, "Z Score", meta, test)


def _modified_z(df: DataFrame, column: str, threshold: float) -> OutlierModel:
    middle = column_quantiles(df, {column: [0.5]})[column][0]
    if middle is None:
        return OutlierModel(column, "Modified Z Score")
    gaps = df.select(F.abs(number(df, column) - F.lit(middle)).alias("gap"))
    mad = column_quantiles(gaps, {"gap": [0.5]})["gap"][0]
    if not mad > 0:
        return OutlierModel(column, "Modified Z Score")
    reach = threshold * mad / NORMAL_MAD
    meta = {"median": middle, "mad": mad, "lower_bound": middle - reach, "upper_bound": middle + reach}
    test = lambda v: F.abs(F.lit(NORMAL_MAD) * (v - F.lit(middle)) / F.lit(mad)) > threshold
    return _interval(df, column, "Modified Z Score", meta, test)


def _interval(df: DataFrame, column: str, method: str, meta: dict, test) -> OutlierModel:
    rounded = {k: round(v, 4) for k, v in meta.items()}
    hit = measure(df, {"hit": F.bool_or(test(number(df, column)))})["hit"]
    return OutlierModel(column, method, rounded, test, None, None, bool(hit))


def detect_outliers(
    df: DataFrame, column: str, method: str, name: str = "is_outlier", **params: float
) -> tuple[DataFrame, dict[str, float]]:
    """The table with an outlier mark, and the fitted bounds rounded to four places."""
    model = fit_outliers(df, column, method, **params)
    return model.flag(df, name), model.meta


def handle_outliers(df: DataFrame, column: str, method: str, action: str, **params: float) -> DataFrame:
    """Remove flagged rows, replace flagged cells by the median of the others, or cap the column.

    Cap clips to the rounded bounds, or to the 1 % and 99 % quantiles for methods without bounds. When
    nothing is flagged the table stays as it is, also for Cap.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown outlier action: {action}")
    if column not in df.columns:
        return df
    model = fit_outliers(df, column, method, **params)
    if not model.any_flagged:
        return df
    x = number(df, column)
    if action == "Cap":
        if "lower_bound" in model.meta:
            low, high = model.meta["lower_bound"], model.meta["upper_bound"]
        else:
            low, high = column_quantiles(df, {column: [0.01, 0.99]})[column]
        clipped = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))
        return put(df, {column: clipped})
    marked = model.flag(df, "__hit")
    names = [col(c) for c in df.columns]
    if action == "Remove":
        return marked.filter(~F.col("__hit")).select(*names)
    kept = marked.filter(~F.col("__hit"))
    middle = column_quantiles(kept, {column: [0.5]})[column][0]
    swapped = F.when(F.col("__hit"), F.lit(middle).cast("double")).otherwise(number(marked, column))
    return marked.select(*[swapped.alias(c) if c == column else col(c) for c in df.columns])


def outlier_metrics(df: DataFrame, column: str, method: str, **params: float) -> DataFrame:
    """One row: flagged rows and their share of all rows."""
    flagged = fit_outliers(df, column, method, **params).flag(df, "__hit")
    hits, n = F.count_if(F.col("__hit")), F.count(F.lit(1))
    pct = F.coalesce(F.try_divide(hits * F.lit(100.0), n), F.lit(0.0))
    return flagged.agg(hits.alias("n_outliers"), n.alias("n_rows"), pct.alias("outlier_pct"))
