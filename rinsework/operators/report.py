"""Profiling report as five tables from shared figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from rinsework.operators.profile import profile_columns, summarise
from rinsework.operators.quality import quality_score, suggest_improvements
from rinsework.operators.validate import validate
from rinsework.plans.tablestats import TableStats


def report_tables(df: DataFrame, as_of: datetime | None = None) -> dict[str, DataFrame]:
    """summary, score, suggestions, validation and columns; figures they share are gathered once for all of them."""
    s = TableStats(df, as_of)
    columns = profile_columns(s)  # first, so that its exact counts serve the others too
    return {
        "summary": summarise(s),
        "score": quality_score(s),
        "suggestions": suggest_improvements(s),
        "validation": validate(s),
        "columns": columns,
    }


def write_report(df: DataFrame, folder: str, as_of: datetime | None = None, mode: str = "errorifexists") -> None:
    """Write the report, one Parquet table per part."""
    for name, table in report_tables(df, as_of).items():
        table.write.mode(mode).parquet(f"{folder}/{name}")
