"""Figures about a whole table, each gathered at most once and shared by its readers.

Summary, score, suggestions, validation and profile all draw on the same few jobs: one fused aggregate,
the quantiles, the outlier counts against them, the value counts, and the distinct rows.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.functions import parse
from rinsework.functions.text import is_blank, strip
from rinsework.names import (
    col,
    data_columns,
    dtype,
    is_category,
    is_nested,
    is_numeric,
    is_text,
    number,
    value,
)
from rinsework.operators.dedup import duplicate_count
from rinsework.operators.sizes import column_bytes, fixed_width
from rinsework.plans.counts import countable, decisive_counts, exact_counts
from rinsework.plans.heavy import modes
from rinsework.plans.onerow import measure
from rinsework.plans.quantiles import column_quantiles
from rinsework.streaming.guard import require_batch


class TableStats:
    def __init__(self, df: DataFrame, as_of: datetime | None = None, mixed: str = "storage"):
        require_batch(df, "table statistics")
        if mixed not in ("storage", "lexical"):
            raise ValueError("mixed must be 'storage' or 'lexical'")
        self.df, self.mixed_mode = df, mixed
        self.as_of = as_of or datetime.now()
        self.columns = data_columns(df)
        self.types = {c: dtype(df, c) for c in self.columns}
        self.numeric = [c for c in self.columns if is_numeric(self.types[c])]
        self.text = [c for c in self.columns if is_text(self.types[c]) and not is_category(df.schema[c])]
        self.category = [c for c in self.columns if is_category(df.schema[c])]
        self.timed = [
            c for c in self.columns if isinstance(self.types[c], (T.TimestampType, T.TimestampNTZType))
        ]

    @cached_property
    def basics(self) -> dict:
        """Counts, extremes, moments, text checks and sizes in one scan."""
        df, wanted = self.df, {"rows": F.count(F.lit(1))}
        for c in self.columns:
            t, v = self.types[c], value(df, c)
            wanted[(c, "count")] = F.count(v)
            if fixed_width(t) is not None:
                # no text: its buffers would take the whole aggregate off the hash path
                wanted[(c, "min")], wanted[(c, "max")] = F.min(v), F.max(v)
            if fixed_width(t) is None:
                wanted[(c, "bytes")] = F.sum(column_bytes(df, c))
            if c in self.numeric:
                x = number(df, c)
                for name, f in (
                    ("mean", F.avg),
                    ("var", F.var_samp),
                    ("skew", F.skewness),
                    ("kurtosis", F.kurtosis),
                ):
                    wanted[(c, name)] = f(x)
                wanted[(c, "negative")] = F.count_if(x < 0)
                wanted[(c, "positive")] = F.count_if(x >= 0)
            if c in self.text or c in self.category:
                wanted[(c, "blank")] = F.count_if(is_blank(v))
                wanted[(c, "untrimmed")] = F.count_if(v != strip(v))
                if self.mixed_mode == "lexical":
                    wanted[(c, "kinds")] = F.collect_set(_kind(v))
            if isinstance(t, T.VariantType):
                kind = F.schema_of_variant(col(c))
                wanted[(c, "kind_lo")], wanted[(c, "kind_hi")] = F.min(kind), F.max(kind)
            if c in self.timed:
                now = F.lit(self.as_of).cast("timestamp_ntz")
                wanted[(c, "future")] = F.count_if(v.cast("timestamp_ntz") > now)
        return measure(df, wanted)

    @property
    def rows(self) -> int:
        return self.basics["rows"]

    def count(self, c: str) -> int:
        return self.basics[(c, "count")]

    def missing(self, c: str) -> int:
        return self.rows - self.count(c)

    @property
    def missing_cells(self) -> int:
        return sum(self.missing(c) for c in self.columns)

    @cached_property
    def quartiles(self) -> dict[str, list]:
        counts = {c: self.count(c) for c in self.numeric}
        return column_quantiles(self.df, {c: [0.25, 0.5, 0.75] for c in self.numeric}, counts=counts)

    @cached_property
    def outliers(self) -> dict[str, int]:
        """Cells outside 1.5 interquartile ranges per numeric column."""
        wanted = {}
        for c in self.numeric:
            q1, _, q3 = self.quartiles[c]
            if q1 is not None:
                x, reach = number(self.df, c), 1.5 * (q3 - q1)
                wanted[c] = F.count_if((x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach)))
        return measure(self.df, wanted)

    @cached_property
    def tops(self) -> dict:
        """Most frequent value, its count and the exact distinct count per column."""
        return modes(self.df, self.columns)

    def distinct(self, c: str) -> int:
        """Exact distinct values, of nested and binary columns too."""
        return self.tops[c][2] if c in self.tops else self.others.get(c, 0)

    @cached_property
    def others(self) -> dict[str, int]:
        """Exact distinct values of the columns that have no text to compare: nested and binary ones."""
        comparable = set(countable(self.df, self.columns))
        return exact_counts(self.df, [c for c in self.columns if c not in comparable])

    @cached_property
    def reported(self) -> dict[str, int]:
        """Exact distinct values of the text columns with very many of them, for what is said about them."""
        many = [c for c in self.text + self.category if self.is_wide(c)]
        if "tops" in self.__dict__:
            return {c: self.distinct(c) for c in many}
        return exact_counts(self.df, many)

    def is_wide(self, c: str) -> bool:
        """More than 50 texts, but not nearly a text of its own for each row."""
        return 50 < self.sizes[c] < self.rows * 0.9

    def mode(self, c: str) -> str | None:
        return self.tops[c][0] if c in self.tops else None

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Distinct values of the text columns, good enough for the tests on them."""
        if "tops" in self.__dict__:
            return {c: self.distinct(c) for c in self.text + self.category}
        limits = [50, 100, self.rows * 0.3, self.rows * 0.9]
        return decisive_counts(self.df, self.text + self.category, self.rows, limits)

    @cached_property
    def only_values(self) -> dict[str, str]:
        """The single value of each constant column, as text."""
        constant = [c for c in self.columns if self.count(c) and self.is_constant(c)]
        return measure(self.df, {c: F.any_value(value(self.df, c), True).cast("string") for c in constant})

    @cached_property
    def duplicates(self) -> int:
        return duplicate_count(self.df).first()[0]

    @property
    def bytes(self) -> int:
        total = 0
        for c in self.columns:
            width = fixed_width(self.types[c])
            total += (self.basics[(c, "bytes")] or 0) if width is None else width * self.rows
        return total

    def is_constant(self, c: str) -> bool:
        """At most one distinct non-null value."""
        if (c, "min") in self.basics:
            return self.basics[(c, "min")] == self.basics[(c, "max")]
        return self.count(c) == 0 or (self.sizes[c] if c in self.sizes else self.others.get(c)) == 1

    def is_mixed(self, c: str) -> bool:
        """More than one kind of value. Typed storage is never mixed unless it is a variant."""
        if isinstance(self.types[c], T.VariantType):
            return self.basics[(c, "kind_lo")] != self.basics[(c, "kind_hi")]
        return len(self.basics.get((c, "kinds")) or ()) > 1

    def is_reusable_text(self, c: str) -> bool:
        return c in self.text and 0 < self.sizes[c] < 100 and self.sizes[c] < self.rows * 0.3


def _kind(v):
    """Lexical class of a text."""
    s = strip(v)
    return (
        F.when(v.isNull(), None)
        .when(s.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(s.rlike(parse.NUMBER), "float")
        .when(F.lower(s).isin("true", "false"), "bool")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), "date")
        .otherwise("str")
    )


def gather(table: DataFrame | TableStats, **options) -> TableStats:
    return table if isinstance(table, TableStats) else TableStats(table, **options)
