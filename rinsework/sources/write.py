"""Writers: CSV, TSV, JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import col, dtype, is_nested
from rinsework.sources.read import UnsupportedFormat

# fixed values: export formats and their file endings
EXTENSIONS = {"CSV": "csv", "TSV": "tsv", "JSON": "json", "PARQUET": "parquet"}


#: Records per delimited file, as a file is what one task reads back.
FILE_RECORDS = 1_000_000


def write(df: DataFrame, path: str, file_format: str = "PARQUET", mode: str = "errorifexists") -> str:
    """Write part files under ``path`` and return the file ending of the format."""
    kind = file_format.upper()
    if kind not in EXTENSIONS:
        raise UnsupportedFormat(f"no writer for format {file_format!r}")
    writer = _flat(df).write if kind in ("CSV", "TSV") else df.write
    writer = writer.mode(mode)
    if kind in ("CSV", "TSV"):
        sep = "\t" if kind == "TSV" else ","
        writer.options(
            header=True,
            maxRecordsPerFile=FILE_RECORDS,
            sep=sep,
            quote='"',
            escape='"',
            encoding="UTF-8",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    elif kind == "JSON":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return EXTENSIONS[kind]


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which is all a delimited file can hold."""
    nested = [c for c in df.columns if is_nested(dtype(df, c))]
    if not nested:
        return df
    return df.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns])
