"""Attach per-value results to rows without skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import col

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 20_000
#: Longest text of a key, in bytes, that may be broadcast as a frequent one.
HOT_BYTES = 1_024


def _named(model: DataFrame, keys: dict[str, str], payload: list[str]) -> DataFrame:
    """Key and payload columns under names of their own, so that joins stay unambiguous."""
    cells = [F.col(m).alias(f"__key{i}") for i, m in enumerate(keys.values())]
    return model.select(*cells, *[F.col(p).alias(f"__pay{i}") for i, p in enumerate(payload)])


def _join(df: DataFrame, model: DataFrame, keys: dict[str, str], payload: list[str], how: str) -> DataFrame:
    matches = [col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    joined = df.join(model, reduce(lambda a, b: a & b, matches), how)
    if how == "left_anti":
        return joined
    return joined.select(
        *[col(c) for c in df.columns], *[F.col(f"__pay{i}").alias(p) for i, p in enumerate(payload)]
    )


def attach(
    df: DataFrame,
    model: DataFrame,
    keys: dict[str, str],
    payload: list[str],
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join ``df`` with a table of distinct keys, nulls equal.

    ``model`` must be cut already. ``weight`` names its column with the number of rows
    per key. Up to ``broadcast_rows`` keys of together up to BROADCAST_BYTES are broadcast.
    Beyond that, keys that hold more than 1/hot_keys of all rows (so at most ``hot_keys``
    of them, each up to HOT_BYTES long) are broadcast and their rows never shuffle; the
    remaining keys join by shuffle, where adaptive execution splits those that still weigh.
    """
    length = F.lit(0)
    for k in keys.values():
        length = length + F.coalesce(F.octet_length(col(k).cast("string")), F.lit(0))
    size = model.agg(F.count(F.lit(1)), F.sum(weight), F.sum(length)).first()
    model_rows, total, model_bytes = size[0], size[1] or 0, size[2] or 0
    if model_rows <= broadcast_rows and model_bytes <= BROADCAST_BYTES:
        return _join(df, F.broadcast(_named(model, keys, payload)), keys, payload, "left")
    is_hot = (F.col(weight) * hot_keys >= F.lit(total)) & (length <= HOT_BYTES)
    hot = F.broadcast(_named(model.filter(is_hot), keys, payload))
    cold = _named(model.filter(~is_hot), keys, payload)
    in_hot = _join(df, hot, keys, payload, "inner")
    outside = _join(df, hot, keys, payload, "left_anti")
    return in_hot.unionByName(_join(outside, cold, keys, payload, "left"))
