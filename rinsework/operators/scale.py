"""Scale numeric columns; gaps take the column median first."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import dtype, is_numeric, known, number, put
from rinsework.plans.onerow import measure
from rinsework.plans.quantiles import column_quantiles
from rinsework.streaming.guard import require_batch

# fixed values: scaler names
SCALERS = ("StandardScaler", "MinMaxScaler", "RobustScaler", "Normalizer", "MaxAbsScaler")


@dataclass(frozen=True)
class ScaleModel:
    """(x - centre) / width per column, or division by the row norm."""

    fills: dict[str, float | None]
    centre: dict[str, float] = field(default_factory=dict)
    width: dict[str, float] = field(default_factory=dict)
    by_row: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        columns = known(df, list(self.fills))
        filled = {
            c: F.coalesce(number(df, c), F.lit(self.fills[c]).cast("double")) for c in columns
        }
        if self.by_row:
            squares = F.lit(0.0)
            for e in filled.values():
                squares = squares + e * e
            norm = F.sqrt(squares)
            return put(df, {c: e / F.when(norm == 0, 1.0).otherwise(norm) for c, e in filled.items()})
        return put(
            df, {c: (filled[c] - F.lit(self.centre[c])) / F.lit(self.width[c]) for c in columns if c in self.width}
        )


def fit_scaler(df: DataFrame, columns: list[str], scaler: str) -> ScaleModel:
    """Statistics refer to the column after its gaps are filled; a zero width becomes 1."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler: {scaler}")
    require_batch(df, "scale_features")
    columns = [c for c in known(df, columns) if is_numeric(dtype(df, c))]
    wanted = {}
    for c in columns:
        x = number(df, c)
        wanted[(c, "n")] = F.count(x)
        wanted[(c, "nulls")] = F.count_if(x.isNull())
        if scaler == "StandardScaler":
            wanted.update({(c, "mean"): F.avg(x), (c, "var"): F.var_pop(x)})
        elif scaler in ("MinMaxScaler", "MaxAbsScaler"):
            wanted.update({(c, "lo"): F.min(x), (c, "hi"): F.max(x)})
    got = measure(df, wanted)
    probs = [0.25, 0.5, 0.75] if scaler == "RobustScaler" else [0.5]
    with_quantiles = columns if scaler == "RobustScaler" else [c for c in columns if got[(c, "nulls")]]
    counts = {c: got[(c, "n")] for c in columns}
    quantiles = column_quantiles(df, {c: probs for c in with_quantiles}, counts=counts)
    fills = {c: (quantiles[c][len(probs) // 2] if c in quantiles else 0.0) for c in columns}
    if scaler == "Normalizer":
        return ScaleModel(fills, by_row=True)
    centre, width = {}, {}
    refit = {}
    if scaler == "RobustScaler":
        gaps = [c for c in columns if got[(c, "nulls")] and fills[c] is not None]
        if gaps:
            # the fill adds copies of the median, which moves the quartiles
            padded = df.select(*[F.coalesce(number(df, c), F.lit(fills[c])).alias(c) for c in gaps])
            totals = {c: got[(c, "n")] + got[(c, "nulls")] for c in gaps}
            refit = column_quantiles(padded, {c: probs for c in gaps}, counts=totals)
    for c in columns:
        if fills[c] is None:
            continue
        if scaler == "StandardScaler":
            n, gap = got[(c, "n")], got[(c, "nulls")]
            share = gap / (n + gap) if n else 0.0
            drift = fills[c] - got[(c, "mean")] if gap and n else 0.0
            centre[c] = (got[(c, "mean")] or 0.0) + share * drift
            spread = ((1 - share) * (got[(c, "var")] or 0.0) + share * (1 - share) * drift * drift) ** 0.5
        elif scaler == "MinMaxScaler":
            centre[c], spread = got[(c, "lo")] or 0.0, (got[(c, "hi")] or 0.0) - (got[(c, "lo")] or 0.0)
        elif scaler == "MaxAbsScaler":
            centre[c], spread = 0.0, max(abs(got[(c, "lo")] or 0.0), abs(got[(c, "hi")] or 0.0))
        else:
            q1, middle, q3 = refit.get(c, quantiles[c])
            centre[c], spread = middle, q3 - q1
        width[c] = spread or 1.0
    return ScaleModel(fills, centre, width)


def scale_features(df: DataFrame, columns: list[str], scaler: str) -> DataFrame:
    """Overwrite the numeric columns with their scaled values."""
    return fit_scaler(df, columns, scaler).apply(df)
