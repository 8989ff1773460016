"""First, last and random rows, schema table, key figures, frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import ROW_ID, col, data_columns, dtype, value
from rinsework.operators.rows import random_sample
from rinsework.operators.sizes import column_bytes
from rinsework.plans.counts import countable
from rinsework.plans.heavy import top_counts
from rinsework.plans.onerow import measure
from rinsework.streaming.guard import require_batch


def head(df: DataFrame, n: int = 20, order_by: str = ROW_ID) -> DataFrame:
    return df.orderBy(col(order_by)).limit(n)


def tail(df: DataFrame, n: int = 20, order_by: str = ROW_ID) -> DataFrame:
    """Last rows, in table order."""
    return df.orderBy(col(order_by).desc()).limit(n).orderBy(col(order_by))


def random_rows(df: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    return random_sample(df, n=n, seed=seed)


def schema_table(df: DataFrame) -> DataFrame:
    """One row per column: type, non-null and null counts."""
    require_batch(df, "schema_table")
    columns = data_columns(df)
    got = measure(df, {"rows": F.count(F.lit(1)), **{c: F.count(value(df, c)) for c in columns}})
    rows = [(c, dtype(df, c).simpleString(), got[c], got["rows"] - got[c]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, non_null bigint, nulls bigint"
    )


def key_figures(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and their share, estimated bytes."""
    require_batch(df, "key_figures")
    columns = data_columns(df)
    present = F.lit(0).cast("bigint")
    for c in columns:
        present = present + F.count(value(df, c))
    n = F.count(F.lit(1))
    size = F.lit(0).cast("bigint")
    for c in columns:
        size = size + F.coalesce(F.sum(column_bytes(df, c)), F.lit(0))
    cells = n * len(columns)
    return df.agg(
        n.alias("n_rows"),
        F.lit(len(columns)).cast("bigint").alias("n_columns"),
        (cells - present).alias("missing_cells"),
        F.coalesce(F.try_divide((cells - present) * F.lit(100.0), cells), F.lit(0.0)).alias("missing_pct"),
        size.alias("estimated_bytes"),
    )


def frequent_values(df: DataFrame, columns: list[str] | str, k: int = 5) -> DataFrame:
    """Top values per column with count and share of non-null rows; ties go to the smaller value."""
    require_batch(df, "frequent_values")
    columns = countable(df, [columns] if isinstance(columns, str) else columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, rank bigint, value string, count bigint, pct double")
    top, rows, _ = top_counts(df, columns, k)
    total = F.element_at(F.array(*[F.lit(rows[c]) for c in columns]), F.col("i") + 1)
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return top.select(
        named.alias("column_name"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("txt").alias("value"),
        F.col("n").alias("count"),
        F.bround(F.col("n") * F.lit(100.0) / total, 1).alias("pct"),
    )

