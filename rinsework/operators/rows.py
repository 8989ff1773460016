"""Delete, sort, filter and sample rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import ROW_ID, col, data_columns, fresh, known, present, value
from rinsework.operators.columns import drop_empty_columns
from rinsework.plans.cut import cut
from rinsework.plans.onerow import measure
from rinsework.plans.quantiles import rank_value
from rinsework.streaming.guard import require_batch

LISTED_ROWS = 10_000
TOP_ROWS = 10_000


def delete_rows(df: DataFrame, labels: Sequence | DataFrame) -> DataFrame:
    """Drop rows by ``row_id``; unknown labels are ignored.

    A list becomes a filter. A table of labels (first column) joins instead, and Spark decides from its
    size whether to broadcast it.
    """
    if isinstance(labels, DataFrame):
        ids = labels.select(labels[labels.columns[0]].cast("bigint").alias("__label")).distinct()
        return df.join(ids, col(ROW_ID) == F.col("__label"), "left_anti")
    whole = [int(x) for x in labels if re.fullmatch(r"\s*[+-]?\d+\s*", str(x))]
    if not whole:
        return df
    if len(whole) > LISTED_ROWS:
        table = df.sparkSession.createDataFrame([(x,) for x in whole], "label bigint")
        return delete_rows(df, table)
    return df.filter(~col(ROW_ID).isin(whole))


def sort_rows(df: DataFrame, columns: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    """Nulls last in both directions; ``row_id`` breaks ties."""
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(columns):
        raise ValueError("give one sort direction per column")
    keys = []
    for c, up in zip(columns, flags):
        v = value(df, c)
        keys.append(v.asc_nulls_last() if up else v.desc_nulls_last())
    if ROW_ID in df.columns and ROW_ID not in columns:
        keys.append(col(ROW_ID))
    return df.orderBy(*keys)


# fixed values: spellings of the comparison and logic operators in filter texts
SPELLINGS = (
    (r"&&|&", " AND "),
    (r"\|\||\|", " OR "),
    (r"~", " NOT "),
    (r"==", " = "),
    (r"\.isnull\(\)|\.isna\(\)", " IS NULL"),
    (r"\.notnull\(\)|\.notna\(\)", " IS NOT NULL"),
)


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Keep rows where a boolean expression holds; Spark SQL text, with ``== & | ~`` also understood."""
    # quoted text and names are left as they are
    pieces = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)", expression)
    for i in range(0, len(pieces), 2):
        for pattern, spelling in SPELLINGS:
            pieces[i] = re.sub(pattern, spelling, pieces[i])
    try:
        kept = df.filter("".join(pieces))
        kept.schema  # noqa: B018  resolves the names now
        return kept
    except (ParseException, AnalysisException) as e:
        raise ValueError(f"cannot filter by {expression!r}: {e}") from e


def _sample_unnumbered(df: DataFrame, n: int, seed: int, top_rows: int) -> DataFrame:
    """Rows without identity draw a number once; beyond a small sample the n-th smallest is a threshold."""
    if n <= top_rows:
        return df.orderBy(F.rand(seed)).limit(n)
    name = fresh("draw", df.columns)
    drawn = cut(df.withColumn(name, F.floor(F.rand(seed) * F.lit(float(1 << 52)))))
    if n >= drawn.count():
        return df
    last = int(rank_value(drawn, col(name).cast("double"), n - 1))
    below = drawn.filter(col(name) < last)
    tied = drawn.filter(col(name) == last).limit(n - below.count())
    return below.unionByName(tied).drop(name)


def random_sample(
    df: DataFrame,
    n: int | None = None,
    frac: float | None = None,
    seed: int = 42,
    exact: bool = True,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, or ``round(frac * rows)``, without replacement.

    With a ``row_id`` the draw depends on the seed alone. Small samples are a top-k; large ones look up
    the draw number of the last wanted row and filter by it, so no task receives the whole sample.
    ``exact=False`` with ``frac`` is Spark's Bernoulli sample: one pass, size only near the fraction.
    """
    require_batch(df, "random_sample")
    if n is None and frac is None:
        return df
    if n is None:
        if not 0 <= frac <= 1:
            raise ValueError("frac must lie between 0 and 1")
        if not exact:
            return df.sample(False, float(frac), seed)
        n = round(frac * df.count())
    if n < 0:
        raise ValueError("n must not be negative")
    if ROW_ID not in df.columns:
        return _sample_unnumbered(df, n, seed, top_rows)
    draw = F.xxhash64(F.lit(seed), col(ROW_ID))
    # 52 bits, so that the draw survives as a double in the rank search
    short = F.shiftrightunsigned(draw, 12)
    if n <= top_rows:
        return df.orderBy(short, draw, col(ROW_ID)).limit(n)
    rows = df.count()
    if n >= rows:
        return df
    last = int(rank_value(df, short.cast("double"), n - 1))
    below = measure(df, {"n": F.count_if(short < last)})["n"]
    tied = df.filter(short == last).orderBy(draw, col(ROW_ID)).limit(n - below).select(col(ROW_ID)).collect()
    chosen = [r[0] for r in tied]
    return df.filter((short < last) | ((short == last) & col(ROW_ID).isin(chosen)))


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop a row when any listed column is missing."""
    wanted = F.lit(True)
    for c in known(df, columns):
        wanted = wanted & present(df, c)
    return df.filter(wanted)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose data columns are all missing."""
    columns = data_columns(df)
    if not columns:
        return df
    kept = F.lit(False)
    for c in columns:
        kept = kept | present(df, c)
    return df.filter(kept)


def drop_empty_rows_columns(df: DataFrame, rows: bool = True, columns: bool = True) -> DataFrame:
    """Empty rows first, then columns that are empty in what is left."""
    if rows:
        df = drop_empty_rows(df)
    if columns:
        df = drop_empty_columns(df)
    return df
