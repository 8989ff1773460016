"""Rename, drop, copy, merge, split and reorder columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.functions.pytext import python_text
from rinsework.functions.text import quote
from rinsework.names import col, data_columns, dtype, is_nested, known, put, value
from rinsework.operators.sizes import fixed_width
from rinsework.plans.onerow import measure
from rinsework.streaming.guard import require_batch


def rename_columns(df: DataFrame, new_names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(new_names)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in columns])


def duplicate_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    if column not in df.columns:
        return df
    return put(df, {new_name: col(column)})


def merge_columns(
    df: DataFrame,
    columns: list[str],
    new_name: str,
    separator: str = " ",
    null_repr: str = "nan",
    skip_nulls: bool = False,
) -> DataFrame:
    """Join the text of several columns; a missing cell is written as ``null_repr``."""
    columns = known(df, columns)
    if not columns:
        return df
    texts = [python_text(col(c), dtype(df, c)) for c in columns]
    if not skip_nulls:
        texts = [F.coalesce(t, F.lit(null_repr)) for t in texts]
    return put(df, {new_name: F.concat_ws(separator, *texts)})


def split_column(
    df: DataFrame, column: str, separator: str, new_names: list[str], regex: bool | None = None
) -> DataFrame:
    """Split text into new columns; surplus parts are dropped, absent ones are null.

    A single-character separator is literal and a longer one is a regular expression, unless ``regex``
    says otherwise.
    """
    if column not in df.columns:
        return df
    as_regex = len(separator) > 1 if regex is None else regex
    pattern = separator if as_regex else quote(separator)
    parts = F.split(python_text(col(column), dtype(df, column)), pattern, -1)
    return put(df, {n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(new_names)})


def reorder_columns(df: DataFrame, ordered: list[str]) -> DataFrame:
    first = known(df, ordered)
    return df.select(*[col(c) for c in first + [c for c in df.columns if c not in first]])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value, without a distinct count.

    A column is constant when its smallest value equals its largest. Text is first judged by the hash of
    the value, a plain number; only columns whose hashes agree are compared as text.
    """
    columns = data_columns(df)
    cells = {c: F.to_json(F.struct(col(c))) if is_nested(dtype(df, c)) else value(df, c) for c in columns}
    cells = {c: F.when(col(c).isNotNull(), e) for c, e in cells.items()}
    fixed = {c for c in columns if fixed_width(dtype(df, c)) is not None}
    judged = {c: e if c in fixed else F.when(e.isNotNull(), F.xxhash64(e)) for c, e in cells.items()}
    got = measure(df, {(c, k): f(e) for c, e in judged.items() for k, f in (("lo", F.min), ("hi", F.max))})
    alike = [c for c in columns if got[(c, "lo")] == got[(c, "hi")]]
    unsure = [c for c in alike if c not in fixed and got[(c, "lo")] is not None]
    exact = measure(df, {(c, k): f(cells[c]) for c in unsure for k, f in (("lo", F.min), ("hi", F.max))})
    return [c for c in alike if c not in unsure or exact[(c, "lo")] == exact[(c, "hi")]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    require_batch(df, "drop_constant_columns")
    return drop_columns(df, constant_columns(df))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    require_batch(df, "drop_empty_columns")
    got = measure(df, {c: F.count(value(df, c)) for c in data_columns(df)})
    return drop_columns(df, [c for c, n in got.items() if n == 0])
