"""Readers: CSV, TSV, JSON and Parquet with missing-value tokens and row identity."""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.names import ROW_ID, col, dtype, is_text
from rinsework.plans.cut import cut
from rinsework.plans.lookup import BROADCAST_BYTES
from rinsework.plans.ordered import running_sum

# fixed values: texts read as missing, and file endings with their formats
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "_corrupt_record"
BROADCAST_SPLITS = 100_000
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "parquet": "parquet"}


class UnsupportedFormat(ValueError):
    """The file ending names no known format."""


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    missing: Sequence[str] = MISSING_TOKENS,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    malformed: str = "fail",
    misfits: str = "fail",
) -> DataFrame:
    """Header row, missing tokens to null, then inferred types.

    Without a schema the text is read once more to choose the types, after tokens such as ``N/A`` are
    out of the way; give a schema for very large inputs. Line breaks inside quotes are read, so a file is
    the unit of parallel reading and large data should come as many files; ``multi_line=False`` splits
    files too, for data without such breaks. A record with more or fewer fields than the header fails the
    job, or with ``malformed="keep"`` stands as text in a column CORRUPT. A value that its given type
    cannot hold fails the job, or with ``misfits="null"`` is missing.
    """
    if malformed not in ("fail", "keep") or misfits not in ("fail", "null"):
        raise ValueError("malformed must be 'fail' or 'keep', misfits 'fail' or 'null'")
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line}
    reader = spark.read.options(**options)
    names = reader.csv(path)
    if not names.columns:
        return names
    texts = T.StructType([T.StructField(c, T.StringType()) for c in names.columns])
    if malformed == "fail":
        # every field is parsed, whatever columns are asked for, so that no bad record passes unseen
        raw = reader.options(mode="FAILFAST", columnPruning=False).schema(texts).csv(path)
    else:
        kept = T.StructType([*texts.fields, T.StructField(CORRUPT, T.StringType())])
        raw = reader.option("columnNameOfCorruptRecord", CORRUPT).schema(kept).csv(path)
    raw = normalise_missing(raw, missing)
    if schema is not None:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType for f in wanted}
    else:
        types = infer_types(raw)
    strict = misfits == "fail"
    return raw.select(*[_typed(c, types.get(c, T.StringType()), strict).alias(c) for c in raw.columns])


def _typed(name: str, t: T.DataType, strict: bool):
    if isinstance(t, T.StringType):
        return col(name)
    text = F.trim(col(name))
    if isinstance(t, T.BooleanType):
        text = F.lower(text)
    if not strict:
        return text.try_cast(t)
    problem = F.concat(F.lit(f"column {name!r} cannot hold as {t.simpleString()}: "), text)
    return F.coalesce(text.try_cast(t), F.when(text.isNotNull(), F.raise_error(problem).cast(t)))


def infer_types(raw: DataFrame) -> dict[str, T.DataType]:
    """Narrowest of long, double, boolean, string for each text column, in one aggregate."""
    whole = r"^\s*[+-]?[0-9]{1,18}\s*$"
    real = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    flag = r"^(?i)(true|false)$"
    tests = []
    for i, c in enumerate(raw.columns):
        tests += [F.count(col(c)).alias(f"n{i}")]
        for tag, pattern in (("w", whole), ("r", real), ("b", flag)):
            tests += [F.count_if(~col(c).rlike(pattern)).alias(f"{tag}{i}")]
    row = raw.agg(*tests).first()
    out = {}
    for i, c in enumerate(raw.columns):
        if row[f"n{i}"] == 0:
            out[c] = T.StringType()
        elif row[f"w{i}"] == 0:
            out[c] = T.LongType()
        elif row[f"r{i}"] == 0:
            out[c] = T.DoubleType()
        elif row[f"b{i}"] == 0:
            out[c] = T.BooleanType()
        else:
            out[c] = T.StringType()
    return out


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """An array of records, or one record per line. Lines split over tasks, an array does not."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return normalise_nan(reader.option("multiLine", not lines).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise_nan(spark.read.parquet(path))


def load(spark: SparkSession, path: str, file_format: str | None = None, **options) -> DataFrame:
    """Pick the reader by the file ending."""
    kind = (file_format or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind not in FORMATS:
        raise UnsupportedFormat(f"no reader for format {kind or path!r}")
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "tsv":
        return read_tsv(spark, path, **options)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=kind == "jsonl", **options)
    return read_parquet(spark, path)


def normalise_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing tokens in text columns and NaN in float columns become null."""
    text = normalise_nan(df)
    return text.select(
        *[
            F.when(~col(c).isin(*tokens), col(c)).alias(c) if is_text(dtype(df, c)) else col(c)
            for c in df.columns
        ]
    )


def normalise_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def attach_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Prepend ``row_id``: a natural key, or 0..n-1 in file order.

    Numbering needs no sort of the rows. One aggregate counts rows per file split, and running sums over the
    table of splits (one record each) give every split its first number. The input must be a file scan with
    projections or filters only, so that both passes see the same splits.
    """
    if key is not None:
        return df.select(col(key).cast("bigint").alias(ROW_ID), *[col(c) for c in df.columns if c != ROW_ID])
    seated = df.select(
        *[col(c) for c in df.columns],
        F.input_file_name().alias("__file"),
        F.input_file_block_start().alias("__offset"),
        F.monotonically_increasing_id().alias("__seat"),
    )
    order = ["__file", "__offset", "__part"]
    splits = seated.groupBy("__file", "__offset", F.shiftright("__seat", 33).alias("__part")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__seat").alias("__first")
    )
    splits = cut(splits)
    size = splits.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("__file") + 48).alias("bytes")).first()
    # a table of some splits is added up on the driver and goes to all tasks; a very large one is added up in ranges of its
    # order and meets its rows by shuffle
    small = size["rows"] <= BROADCAST_SPLITS and (size["bytes"] or 0) <= BROADCAST_BYTES
    if small:
        found = splits.orderBy(*order).collect()
        before = accumulate((r["__n"] for r in found), initial=0)
        starts = df.sparkSession.createDataFrame([(*r, n) for r, n in zip(found, before)], f"{_ddl(splits)}, __before long")
    else:
        starts = running_sum(splits, order, "__n", "__before")
    starts = starts.select(
        F.col("__file").alias("__f"), F.col("__offset").alias("__b"), F.col("__part").alias("__p"),
        (F.col("__before") - F.col("__first")).alias("__shift"),
    )
    at = (
        (F.col("__file") == F.col("__f"))
        & (F.col("__offset") == F.col("__b"))
        & (F.shiftright("__seat", 33) == F.col("__p"))
    )
    return seated.join(F.broadcast(starts) if small else starts, at, "inner").select(
        (F.col("__seat") + F.col("__shift")).alias(ROW_ID), *[col(c) for c in df.columns]
    )
