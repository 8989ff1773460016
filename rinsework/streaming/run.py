"""Run row-local steps and fitted models over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rinsework.plans.cut import working_folder

Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    """Apply steps in order; works on batch and streaming frames alike."""
    for step in steps:
        df = df.transform(step)
    return df


def write_stream(df: DataFrame, path: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append a cleaned stream to Parquet and stop once the waiting input is read."""
    if checkpoint is None:
        checkpoint = f"{working_folder(df.sparkSession)}/streams/{name}"
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
