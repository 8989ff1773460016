"""Lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="rinsework-")
        context.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so later passes see the same rows and survive lost executors."""
    working_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str = "kept") -> tuple[DataFrame, str]:
    """The rows as a Parquet table of their own in the working folder, and its path, for ``drop`` when it is used up.

    Unlike a checkpoint it takes nothing along from the plan it came from. For loops that matters: size estimates of
    joins multiply, and inferred predicates pile up, from round to round.
    """
    spark, path = df.sparkSession, f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables of ``kept``, on whatever storage they lie."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
