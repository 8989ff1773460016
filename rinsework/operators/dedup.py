"""Duplicate rows: remove and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.names import ROW_ID, col, data_columns, dtype, known, value
from rinsework.plans.cut import cut
from rinsework.plans.lookup import BROADCAST_ROWS
from rinsework.streaming.guard import require_batch


def _comparable(df: DataFrame, name: str) -> Column:
    """Value to group by; maps are compared by their sorted entries."""
    t = dtype(df, name)
    if isinstance(t, T.MapType):
        return F.array_sort(F.map_entries(col(name)))
    if isinstance(t, T.VariantType):
        return F.to_json(col(name))
    return value(df, name)


def remove_duplicates(
    df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order_by: str = ROW_ID
) -> DataFrame:
    """Keep the first or last row per key in table order, or drop every repeated row (``none``).

    Nulls are equal. The rows of a key are combined before the shuffle, so a key with very many copies
    sends one row per task rather than all of them to one window.
    """
    require_batch(df, "remove_duplicates")
    if keep is False:
        keep = "none"
    if keep not in ("first", "last", "none"):
        raise ValueError("keep must be 'first', 'last' or 'none'")
    keys = data_columns(df) if subset is None else known(df, subset, strict=True)
    ordered = order_by in df.columns
    if not ordered and (keep != "none" and subset is not None):
        raise ValueError(f"column {order_by!r} is needed to tell first from last")
    grouped = df.groupBy(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(keys)])
    rest = [c for c in df.columns if c not in keys or isinstance(dtype(df, c), (T.MapType, T.VariantType))]
    aggregates = []
    if keep == "none":
        aggregates.append(F.count(F.lit(1)).alias("__n"))
    if rest == [order_by]:
        # whole-row duplicates: only the order is left to choose, a plain number buffer
        pick = F.max if keep == "last" else F.min
        aggregates.append(pick(col(order_by)).alias("r0"))
    elif rest:
        packed = F.struct(*[col(c).alias(f"v{i}") for i, c in enumerate(rest)])
        by = col(order_by) if ordered else F.lit(0)
        pick = F.max_by if keep == "last" else F.min_by
        aggregates.append(pick(packed, by).alias("__row"))
    if not aggregates:
        return grouped.agg(F.count(F.lit(1)).alias("__n")).select(
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)]
        )
    kept = grouped.agg(*aggregates)
    if keep == "none":
        kept = kept.filter("__n = 1")
    place = {c: F.col(f"k{i}") for i, c in enumerate(keys) if c not in rest}
    if rest == [order_by]:
        place[order_by] = F.col("r0")
    else:
        place.update({c: F.col("__row").getField(f"v{i}") for i, c in enumerate(rest)})
    return kept.select(*[place[c].alias(c) for c in df.columns])


def duplicate_count(
    df: DataFrame, subset: list[str] | None = None, listed: int = BROADCAST_ROWS
) -> DataFrame:
    """One row: how many rows repeat an earlier one.

    Equal rows have equal hashes, so rows whose hash occurs once need no further look: only 64-bit hashes
    are shuffled for them. Rows that share a hash are then compared in full. Where more than ``listed``
    hashes repeat, all rows are compared in full right away.
    """
    require_batch(df, "duplicate_count")
    keys = data_columns(df) if subset is None else known(df, subset, strict=True)
    slim = df.select(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(keys)])
    names = [F.col(f"k{i}") for i in range(len(keys))]
    hashed = slim.withColumn("__hash", F.xxhash64(*names))
    repeated = cut(
        hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__hash").alias("__again"))
    )
    if repeated.count() <= listed:
        slim = hashed.join(F.broadcast(repeated), F.col("__hash") == F.col("__again"), "left_semi")
    counted = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("duplicates"))
