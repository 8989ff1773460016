"""Distinct values per column, for many columns in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.names import dtype, is_nested, is_numeric, value


def countable(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose values can be compared as text; nested ones are left out."""
    return [c for c in columns if not is_nested(dtype(df, c)) and not isinstance(dtype(df, c), T.BinaryType)]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table ``i, num, txt, n``: rows per non-null value of each column (i = place in ``columns``).

    ``txt`` is the exact text of the value and ``num`` its number, so numbers order as numbers. Rows are
    combined before the shuffle, so a value that fills a third of the table costs one record per task.
    """
    cells = []
    for i, c in enumerate(columns):
        v = value(df, c)
        num = v.cast("double") if is_numeric(dtype(df, c)) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(i).alias("i"), num.alias("num"), v.cast("string").alias("txt")))
    long = df.select(F.inline(F.array(*cells)))
    return long.filter("txt is not null").groupBy("i", "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: float | None = None) -> dict[str, int]:
    """Distinct non-null values per column; ``approximate`` is a relative error for the sketch version."""
    columns = countable(df, columns)
    if not columns:
        return {}
    if approximate is not None:
        row = df.agg(*[F.approx_count_distinct(value(df, c), approximate) for c in columns]).first()
        return dict(zip(columns, row))
    return exact_counts(df, columns)


def hashes(df: DataFrame, name: str) -> list[Column]:
    """Two independent 64-bit hashes of a column of any type; maps count as sets of entries, variants as JSON."""
    v, t = value(df, name), dtype(df, name)
    if isinstance(t, T.VariantType):
        v = F.to_json(v)
    elif "map<" in t.simpleString():
        v = F.array_sort(F.transform(F.map_entries(v), lambda e: F.to_json(e))) if isinstance(t, T.MapType) else F.to_json(F.struct(v))
    return [F.xxhash64(F.lit(seed), v) for seed in (1, 2)]  # the seed first, or one would follow from the other


def exact_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null values of columns of any type: pairs of hashes are shuffled, never the values."""
    if not columns:
        return {}
    cells = []
    for i, c in enumerate(columns):
        h1, h2 = hashes(df, c)
        cells.append(F.struct(F.lit(i).alias("i"), F.when(value(df, c).isNotNull(), h1).alias("h1"), h2.alias("h2")))
    long = df.select(F.inline(F.array(*cells))).filter("h1 is not null").distinct()
    seen = dict(long.groupBy("i").count().collect())
    return {c: seen.get(i, 0) for i, c in enumerate(columns)}


DIRECT_ROWS = 1_000_000
FEW = 1_000
NEAR = 0.25


def decisive_counts(
    df: DataFrame, columns: list[str], rows: int, limits: list[float], direct_rows: int = DIRECT_ROWS
) -> dict[str, int]:
    """Distinct counts good enough to compare with ``limits``.

    On large tables a sketch with 2 % error comes first. Columns it puts above 1,000 values and more
    than 25 % away from every limit keep the estimate; the others, for which the exact number could
    matter, are counted exactly. So wide text is not shuffled to learn that it is wide.
    """
    columns = countable(df, columns)
    if not columns or rows <= direct_rows:
        return distinct_counts(df, columns)
    guess = distinct_counts(df, columns, approximate=0.02)
    near = [c for c in columns if guess[c] <= FEW or any(abs(guess[c] - x) <= NEAR * x for x in limits)]
    return {**guess, **distinct_counts(df, near)}
