"""Validation checks."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.names import ROW_ID, col, dtype, value
from rinsework.plans.counts import hashes
from rinsework.plans.onerow import measure
from rinsework.plans.tablestats import TableStats, gather

ISSUE = "column_name string, issue_type string, affected_rows bigint, severity string, description string"


def duplicate_columns(s: TableStats) -> list[tuple[str, str]]:
    """Pairs of same-typed columns with identical data.

    One fingerprint per column rules out almost all pairs, the rest are compared cell by cell in one
    aggregate.
    """
    df, place = s.df, [col(ROW_ID)] if ROW_ID in s.df.columns else []
    # xor of row hashes cannot overflow, and a position in the hash makes it depend on the order
    prints = measure(df, {c: F.bit_xor(F.xxhash64(hashes(df, c)[0], *place)) for c in s.columns})
    alike = defaultdict(list)
    for c in s.columns:
        alike[(s.types[c].simpleString(), prints[c])].append(c)
    pairs = [p for group in alike.values() for p in combinations(group, 2)]
    same = measure(df, {(a, b): F.bool_and(_equal(df, a, b)) for a, b in pairs})
    order = {c: i for i, c in enumerate(s.columns)}
    return sorted((p for p in pairs if same[p]), key=lambda p: (order[p[0]], order[p[1]]))


def _equal(df: DataFrame, a: str, b: str) -> Column:
    """Equal cells; types without an equality of their own are held together by both of their hashes."""
    t = dtype(df, a).simpleString()
    if "map<" in t or "variant" in t:
        both = F.lit(True)
        for x, y in zip(hashes(df, a), hashes(df, b)):
            both = both & (x == y)
        return both & (col(a).isNull() == col(b).isNull())
    return value(df, a).eqNullSafe(value(df, b))


def validate(
    table: DataFrame | TableStats, as_of: datetime | None = None, mixed: str = "storage"
) -> DataFrame:
    """One row per issue found; ``affected_rows`` is null where a check has no row count."""
    s = table if isinstance(table, TableStats) else gather(table, as_of=as_of, mixed=mixed)
    rows = []
    if s.rows:
        for a, b in duplicate_columns(s):
            rows.append((f"{a} & {b}", "Duplicate Columns", s.rows, "warning", f"{b} repeats {a}"))
        for c in s.columns:
            rows += _column_issues(s, c)
    return s.df.sparkSession.createDataFrame(rows, ISSUE)


def _column_issues(s: TableStats, c: str):
    b = s.basics
    if s.is_constant(c):
        yield c, "Constant Column", s.rows, "info", f"{c} has at most one value"
    if s.is_mixed(c):
        yield c, "Mixed Data Types", None, "warning", f"{c} mixes kinds of values"
    if c in s.numeric and 0 < b[(c, "negative")] < b[(c, "positive")]:
        n = b[(c, "negative")]
        yield c, "Negative Values", n, "warning", f"{n} negative values in a mostly non-negative column"
    if (c, "blank") in b:
        if b[(c, "blank")]:
            yield c, "Blank Strings", b[(c, "blank")], "info", f"{c} has texts of white space only"
        if b[(c, "untrimmed")]:
            yield c, "Untrimmed Spaces", b[(c, "untrimmed")], "warning", f"{c} has white space at the ends"
        if s.is_wide(c):
            yield c, "High Cardinality", None, "info", f"{c} has {s.reported[c]} different texts"
    if b.get((c, "future")):
        n = b[(c, "future")]
        yield c, "Future Dates", n, "danger", f"{n} dates lie in the future"
