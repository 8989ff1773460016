"""Guards for operators that need the whole table or its row order."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_batch(df: DataFrame, operator: str) -> None:
    if df.isStreaming:
        raise ValueError(
            f"{operator} needs the whole table; fit it on a batch and apply the model to the stream"
        )
