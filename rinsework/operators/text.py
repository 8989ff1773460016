"""Clean text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.functions import text as fx
from rinsework.functions.pytext import python_text
from rinsework.names import col, dtype, known, put

# fixed values: whole-cell texts that stand for a missing value
MISSING_WORDS = ("nan", "NaN", "None")

SIMPLE = {
    "trim": fx.strip,
    "remove_extra_spaces": fx.squeeze,
    "remove_punct": fx.drop_punctuation,
    "remove_nums": fx.drop_digits,
    "remove_special": fx.drop_special,
    "upper": F.upper,
    "lower": F.lower,
    "title": fx.title,
}


def clean_text(
    df: DataFrame,
    columns: list[str],
    operation: str,
    find: str | None = None,
    replace: str | None = None,
    blank_as_missing: bool = False,
) -> DataFrame:
    """Row-local; cells are read as text and missing ones stay missing, except for ``replace_missing``."""
    new = {}
    for c in known(df, columns):
        s = python_text(col(c), dtype(df, c))
        if operation in SIMPLE:
            new[c] = SIMPLE[operation](s)
        elif operation == "find_replace":
            if find and replace is not None:
                s = F.replace(s, F.lit(find), F.lit(replace))
            new[c] = s
        elif operation == "replace_missing":
            if replace is not None:
                gap = s.isNull() | s.isin(*MISSING_WORDS)
                if blank_as_missing:
                    gap = gap | (fx.strip(s) == "")
                s = F.when(gap, F.lit(replace)).otherwise(s)
            new[c] = s
        else:
            raise ValueError(f"unknown text operation: {operation}")
    return put(df, new)
