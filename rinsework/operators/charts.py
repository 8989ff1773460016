"""The aggregate behind each chart, as a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.functions.normal import probit
from rinsework.names import ROW_ID, col, known, number, numeric_columns, present, value
from rinsework.operators.rows import random_sample
from rinsework.plans.cut import cut
from rinsework.plans.gram import pair_sums
from rinsework.plans.lookup import attach
from rinsework.plans.onerow import measure
from rinsework.plans.ordered import positions
from rinsework.plans.quantiles import group_quantiles
from rinsework.streaming.guard import require_batch

# fixed values: aggregate names
AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
PAIRS_PER_JOB = 120


def group_aggregate(df: DataFrame, key: str, name: str, func: str) -> DataFrame:
    """sum, mean, median, min, max or count of a column per non-missing key: columns key, value.

    ``count`` counts the rows of a key, whatever the column holds; the sum of no values is 0.
    """
    require_batch(df, "group_aggregate")
    keyed = df.filter(present(df, key))
    if func == "median":
        found = group_quantiles(keyed, key, name, [0.5])
        return found.select(col(key).alias("key"), F.col("q").getItem(0).alias("value"))
    if func not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {func}")
    result = F.count(F.lit(1)) if func == "count" else AGGREGATES[func](value(df, name))
    if func == "sum":
        result = F.coalesce(result, F.lit(0))
    return keyed.groupBy(value(df, key).alias("key")).agg(result.alias("value"))


def count_values(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-missing value, most frequent first: columns key, count."""
    v = value(df, key)
    counted = df.filter(present(df, key)).groupBy(v.alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), F.asc("key"))


def path_totals(df: DataFrame, path: list[str], values: str | None = None) -> DataFrame:
    """Sum of a column, or row count, for every prefix of a path of columns.

    Columns level (1 is the outermost), the path columns (null below the level) and total. Rows are
    combined to full paths first, so only those are expanded to prefixes.
    """
    path = known(df, path)
    if not path:
        raise ValueError("at least one known path column is needed")
    amount = F.count(F.lit(1)) if values is None else F.sum(number(df, values))
    leaves = df.groupBy(*[col(c) for c in path]).agg(amount.alias("total"))
    rolled = leaves.rollup(*[col(c) for c in path]).agg(
        F.sum("total").alias("total"), F.grouping_id().alias("__above")
    )
    # grouping_id of a prefix of length k is 2^(m-k) - 1
    level = F.lit(len(path)) - F.round(F.log2(F.col("__above") + 1)).cast("int")
    out = rolled.withColumn("level", level).filter("level > 0")
    return out.select("level", *[col(c) for c in path], "total")


def shares(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """Share of each name in the total: columns name, total, share."""
    v = value(df, names)
    amount = F.count(F.lit(1)) if values is None else F.sum(number(df, values))
    kept = df.filter(present(df, names))
    whole = measure(kept, {"all": amount})["all"]
    grouped = kept.groupBy(v.alias("name")).agg(amount.alias("total"))
    return grouped.withColumn("share", F.try_divide(F.col("total").cast("double"), F.lit(whole)))


#: Share of the squares below which a sum of squared deviations may be rounding only.
NO_SPREAD = 1e-9


def _pairs(table: pa.Table, names: list[str]) -> pa.Table:
    """Correlations of one column with all others, and whether rounding may have eaten the spread of either."""
    i = table["i"][0].as_py()
    n, s, t, q, r, p = (np.array(table[c][0].as_py()) for c in ("n", "s", "t", "q", "r", "p"))
    with np.errstate(all="ignore"):
        of_x, of_y = q - s * s / n, r - t * t / n
        corr = (p - s * t / n) / np.sqrt(of_x * of_y)
        thin = ((of_x <= NO_SPREAD * q) & (q > 0)) | ((of_y <= NO_SPREAD * r) & (r > 0)) | ~np.isfinite(of_x) | ~np.isfinite(of_y)
    thin &= n > 1
    known = np.isfinite(corr) & (of_x > 0) & (of_y > 0) & (n > 1)
    cells = [round(min(1.0, max(-1.0, float(c))), 3) + 0.0 if ok else None for c, ok in zip(corr, known)]
    cells[i] = 1.0 if known[i] else None
    return pa.table([pa.array([names[i]] * len(names)), pa.array(names), pa.array(cells, pa.float64()), pa.array(thin)], names=["x", "y", "corr", "thin"])


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present: columns x, y, corr.

    Needs two numeric columns, otherwise empty. A column without spread has no correlation (null). One scan, whatever the
    number of columns; pairs whose spread is so small beside their values that sums of squares cannot show it are looked at
    again by central moments.
    """
    require_batch(df, "correlations")
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in numeric_columns(df)]
    schema = "x string, y string, corr double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    found = cut(pair_sums(df, columns).groupBy("i").applyInArrow(lambda t: _pairs(t, columns), schema + ", thin boolean"))
    if found.isEmpty():  # no value in any column
        return df.sparkSession.createDataFrame([(a, b, None) for a in columns for b in columns], schema)
    pairs = [(r["x"], r["y"]) for r in found.filter("thin and x <= y").collect()]
    if not pairs:
        return found.select("x", "y", "corr")
    again = []
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        wanted = {}
        for a, b in pairs[start : start + PAIRS_PER_JOB]:
            x, y = number(df, a), number(df, b)
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            spread = F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
            wanted[a, b] = F.try_divide(F.covar_samp(x, y), spread)
        for (a, b), r in measure(df, wanted).items():
            r = None if r is None else 1.0 if a == b else round(r, 3) + 0.0
            again += [(a, b, r)] + [(b, a, r)] * (a != b)
    return found.filter("not thin").select("x", "y", "corr").unionByName(df.sparkSession.createDataFrame(again, schema))


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width counts: columns bin, low, high, n, and the ``by`` column; empty bins are left out."""
    require_batch(df, "histogram")
    x = number(df, column)
    got = measure(df, {"lo": F.min(x), "hi": F.max(x)})
    low, width = got["lo"], ((got["hi"] - got["lo"]) / bins if got["lo"] is not None else 0.0)
    place = F.lit(0) if not width else F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    keys = [place.cast("int").alias("bin")] + ([col(by)] if by else [])
    counted = df.filter(present(df, column)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    edge = F.lit(low).cast("double") + F.col("bin") * F.lit(width)
    return counted.select(
        "bin", *([col(by)] if by else []), edge.alias("low"), (edge + F.lit(width)).alias("high"), "n"
    )


def _fences(df: DataFrame, column: str, by: str | None, color: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Rows with a group column, and the quartile table per group with its row counts.

    Groups of two columns are named by a JSON list of both.
    """
    require_batch(df, "box_summary")
    key = "__group"
    names = [value(df, c).cast("string") for c in (by, color) if c is not None]
    name = F.lit("all") if not names else names[0] if len(names) == 1 else F.to_json(F.array(*names))
    there = F.lit(True)
    for n in names:
        there = there & n.isNotNull()
    grouped = df.filter(there).withColumn(key, name)
    q = group_quantiles(grouped, key, column, [0.25, 0.5, 0.75])
    found = cut(
        q.filter("n > 0").select(
            F.col(key).alias("g"),
            "n",
            *[F.col("q").getItem(i).alias(f"q{i + 1}") for i in range(3)],
        )
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    fenced = found.withColumn("floor", F.col("q1") - reach).withColumn("ceiling", F.col("q3") + reach)
    x = number(grouped, column)
    slim = grouped.select(*[col(c) for c in known(df, [ROW_ID])], F.col(key), x.alias("__x"))
    payload = ["n", "q1", "q2", "q3", "floor", "ceiling"]
    joined = attach(slim.filter("__x is not null"), fenced, {key: "g"}, payload, "n")
    return joined, fenced, key


def box_summary(df: DataFrame, column: str, by: str | None = None, color: str | None = None) -> DataFrame:
    """Quartiles, whiskers at the last value inside 1.5 interquartile ranges, and outlier count per group.

    ``by`` and ``color`` group by two columns: columns name and color. Rows without a group are left out.
    """
    joined, _, key = _fences(df, column, by, color)
    x = F.col("__x")
    inside = (x >= F.col("floor")) & (x <= F.col("ceiling"))
    found = joined.groupBy(F.col(key).alias("name"), "n", "q1", "q2", "q3").agg(
        F.min(F.when(inside, x)).alias("low_whisker"),
        F.max(F.when(inside, x)).alias("high_whisker"),
        F.count_if(~inside).alias("n_outliers"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    if by is None or color is None:
        return found
    both = F.from_json("name", "array<string>")
    rest = [c for c in found.columns if c != "name"]
    return found.select(F.get(both, F.lit(0)).alias("name"), F.get(both, F.lit(1)).alias("color"), *rest)


def box_outliers(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """The points beyond the whiskers."""
    joined, _, key = _fences(df, column, by)
    x = F.col("__x")
    beyond = joined.filter((x < F.col("floor")) | (x > F.col("ceiling")))
    return beyond.select(*[col(c) for c in known(df, [ROW_ID])], F.col(key).alias("name"), x.alias("value"))


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    size: str | None = None,
    max_points: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Points with optional colour and size; sizes are shifted to start at 1 when any is not positive."""
    cells = [col(x).alias("x"), col(y).alias("y")]
    if color:
        cells.append(col(color).alias("color"))
    if size and size in df.columns:
        s = value(df, size)
        low = measure(df, {"low": F.min(s)})["low"]
        cells.append((s - F.lit(low) + F.lit(1) if low is not None and low <= 0 else s).alias("size"))
    shown = df if max_points is None else random_sample(df, n=max_points, seed=seed)
    return shown.select(*[col(c) for c in known(df, [ROW_ID])], *cells)


def line_points(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    order_by: str = ROW_ID,
    max_points: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Points in table order."""
    shown = df if max_points is None else random_sample(df, n=max_points, seed=seed)
    cells = [col(order_by), col(x).alias("x"), col(y).alias("y")] + ([col(color).alias("color")] if color else [])
    return shown.select(*cells).orderBy(col(order_by))


def normal_order(df: DataFrame, column: str) -> DataFrame:
    """Ordered values with their 1-based rank and Filliben plotting position: rank, p, value."""
    require_batch(df, "normal_order")
    x = number(df, column)
    tie = [col(ROW_ID).alias("tie")] if ROW_ID in df.columns else [F.monotonically_increasing_id().alias("tie")]
    slim = df.filter(present(df, column)).select(x.alias("value"), *tie)
    ranked = positions(slim, ["value", "tie"], "pos")
    n = measure(ranked, {"n": F.count(F.lit(1))})["n"]
    if n < 3:
        ranked = ranked.filter(F.lit(False))
    rank = F.col("pos") + 1
    last = 0.5 ** (1.0 / n) if n else 0.0
    p = (
        F.when(rank == n, F.lit(last))
        .when(rank == 1, F.lit(1.0 - last))
        .otherwise((rank - F.lit(0.3175)) / F.lit(n + 0.365))
    )
    return ranked.select(rank.alias("rank"), p.alias("p"), "value")


def normal_plot(df: DataFrame, column: str) -> DataFrame:
    """Theoretical normal quantile of every ordered value: rank, theoretical, value."""
    return normal_order(df, column).select("rank", probit(F.col("p")).alias("theoretical"), "value")


def normal_line(df: DataFrame, column: str) -> DataFrame:
    """Least-squares line through the points of ``normal_plot``: slope, intercept, r."""
    points = normal_plot(df, column)
    t, v = F.col("theoretical"), F.col("value")
    spread = F.nullif(F.stddev_samp(t) * F.stddev_samp(v), F.lit(0.0))
    return points.agg(
        F.regr_slope(v, t).alias("slope"),
        F.regr_intercept(v, t).alias("intercept"),
        F.try_divide(F.covar_samp(t, v), spread).alias("r"),
    )
