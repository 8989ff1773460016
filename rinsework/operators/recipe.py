"""Recipes: ordered steps over immutable tables, with undo, redo and an audit log.

A recipe holds step names and parameters, not data. Undo is a shorter list over the same input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import col, data_columns, dtype, is_integral, numeric_columns, text_columns, value
from rinsework.operators import columns, dedup, dtypes, encode, features, impute, outliers, rows, scale, text
from rinsework.plans.cut import cut, drop, kept
from rinsework.plans.heavy import modes
from rinsework.plans.onerow import measure
from rinsework.plans.quantiles import column_quantiles

LOADED = "Dataset Loaded"


def smart_clean(df: DataFrame) -> DataFrame:
    """Trim and collapse white space, fill gaps, drop duplicates and constant columns, narrow types.

    Filling with a median or mode stays inside a column's range and adds no text, and whole-row
    duplicates change neither. So one aggregate, the medians and the value counts of the cleaned text
    decide all later steps, and the table itself is shuffled once, to drop the duplicates.
    """
    words = text_columns(df)
    if words:
        df = text.clean_text(df, words, "trim")
        df = text.clean_text(df, words, "remove_extra_spaces")
    every, numbers = data_columns(df), numeric_columns(df)
    wanted = {"rows": F.count(F.lit(1)), **{c: F.count(value(df, c)) for c in every}}
    for c in numbers:
        wanted[(c, "lo")], wanted[(c, "hi")] = F.min(value(df, c)), F.max(value(df, c))
    got = measure(df, wanted)
    ranges = {c: (got[(c, "lo")], got[(c, "hi")]) for c in numbers}
    gaps = [c for c in numbers if got[c] < got["rows"]]
    medians = column_quantiles(df, {c: [0.5] for c in gaps}, counts=got)
    tops = modes(df, words)
    fills = {c: m[0] for c, m in medians.items() if m[0] is not None}
    whole = frozenset(c for c in fills if is_integral(dtype(df, c)))
    fills.update({c: top[0] for c, top in tops.items()})
    filled = impute.FillModel(fills, whole).apply(df)
    distinct = {c: top[2] for c, top in tops.items()}
    static = [c for c in words if distinct.get(c, 0) <= 1] + [c for c in numbers if ranges[c][0] == ranges[c][1]]
    others = [c for c in every if c not in words and c not in numbers]
    static += columns.constant_columns(df.select(*[col(c) for c in others])) if others else []
    kept = columns.drop_columns(filled, static)
    narrow = dtypes.narrow_from(kept, ranges, distinct, _rows_at_least(filled, distinct, got["rows"]))
    return narrow.apply(columns.drop_columns(dedup.remove_duplicates(filled), static))


def _rows_at_least(filled: DataFrame, distinct: dict[str, int], rows: int) -> int:
    """Rows after whole-row duplicates are gone, or any number that decides the 30 % test alike."""
    fewest = max(distinct.values(), default=0)
    if all((d < fewest * 0.3) == (d < rows * 0.3) for d in distinct.values() if d < 100):
        return fewest
    return rows - dedup.duplicate_count(filled).first()[0]


STEPS: dict[str, Callable[..., DataFrame]] = {
    "rename_columns": columns.rename_columns,
    "drop_columns": columns.drop_columns,
    "duplicate_column": columns.duplicate_column,
    "merge_columns": columns.merge_columns,
    "split_column": columns.split_column,
    "reorder_columns": columns.reorder_columns,
    "drop_constant_columns": columns.drop_constant_columns,
    "drop_empty_rows_columns": rows.drop_empty_rows_columns,
    "delete_rows": rows.delete_rows,
    "sort_rows": rows.sort_rows,
    "filter_rows": rows.filter_rows,
    "random_sample": rows.random_sample,
    "drop_missing_rows": rows.drop_missing_rows,
    "remove_duplicates": dedup.remove_duplicates,
    "impute_missing": impute.impute_missing,
    "clean_text": text.clean_text,
    "convert_type": dtypes.convert_type,
    "narrow_types": lambda df, **kw: dtypes.narrow_types(df, **kw)[0],
    "handle_outliers": outliers.handle_outliers,
    "math_column": features.math_column,
    "conditional_column": features.conditional_column,
    "date_parts": features.date_parts,
    "age": features.age,
    "date_difference": features.date_difference,
    "log_transform": features.log_transform,
    "bin_column": features.bin_column,
    "scale_features": scale.scale_features,
    "encode_categorical": encode.encode_categorical,
    "smart_clean": smart_clean,
}


#: Steps after which the number of rows may be another.
ROW_STEPS = frozenset(
    (
        "drop_empty_rows_columns", "delete_rows", "filter_rows", "random_sample", "drop_missing_rows",
        "remove_duplicates", "handle_outliers", "smart_clean",
    )
)


#: Steps that look at the whole table before they return: each would run all steps before it again.
FITTED = frozenset(
    (
        "drop_constant_columns", "drop_empty_rows_columns", "random_sample", "remove_duplicates", "impute_missing", "convert_type",
        "narrow_types", "handle_outliers", "bin_column", "scale_features", "encode_categorical", "smart_clean",
    )
)


@dataclass(frozen=True)
class Step:
    operator: str
    params: dict[str, Any]
    at: datetime

    def run(self, df: DataFrame) -> DataFrame:
        return STEPS[self.operator](df, **self.params)

    def told(self) -> str:
        """What the step does, without when it was pushed."""
        return f"{self.operator}({sorted(self.params.items(), key=lambda x: x[0])!r})"


class Prefixes:
    """Results of the beginnings of recipes over one table, so that a step never runs the steps before it again.

    The rows before each fitted step, and after the last one, are a table in the working folder, found again by what the
    steps do: undo and redo, and other recipes that begin alike, take it from there. ``close``, or the end of a ``with``
    block, removes the tables; results must be used before. Beyond ``most`` tables the one not used for longest goes.
    """

    def __init__(self, df: DataFrame, most: int = 20):
        self.df, self.most, self.tables = df, most, {}

    def __enter__(self) -> Prefixes:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for name in list(self.tables):
            self._forget(name)

    def _forget(self, name: tuple[str, ...]) -> None:
        drop(self.df.sparkSession, self.tables.pop(name)[1])

    def _keep(self, name: tuple[str, ...], df: DataFrame) -> DataFrame:
        table, path = kept(df, "recipe")
        self.tables[name] = (table, path)
        while len(self.tables) > self.most:
            self._forget(next(iter(self.tables)))
        return table

    def table(self, recipe: Recipe) -> DataFrame:
        """The rows after all steps of the recipe."""
        steps, told = recipe.done, tuple(s.told() for s in recipe.done)
        begin = max((n for n in range(1, len(steps) + 1) if told[:n] in self.tables), default=0)
        df, lazy = self.df, 0
        if begin:
            self.tables[told[:begin]] = self.tables.pop(told[:begin])  # used last
            df = self.tables[told[:begin]][0]
        for n in range(begin, len(steps)):
            if lazy and steps[n].operator in FITTED:
                df, lazy = self._keep(told[:n], df), 0
            df, lazy = steps[n].run(df), lazy + 1
        return self._keep(told, df) if lazy else df


@dataclass(frozen=True)
class Recipe:
    """Every change returns a new recipe; ``undone`` holds the steps that redo can bring back."""

    loaded_at: datetime = field(default_factory=datetime.now)
    done: tuple[Step, ...] = ()
    undone: tuple[Step, ...] = ()

    def push(self, operator: str, at: datetime | None = None, **params: Any) -> Recipe:
        if operator not in STEPS:
            raise ValueError(f"unknown step: {operator}")
        return replace(self, done=(*self.done, Step(operator, params, at or datetime.now())), undone=())

    def undo(self) -> Recipe:
        """Take the last step back; the load itself stays."""
        if not self.done:
            return self
        return replace(self, done=self.done[:-1], undone=(self.done[-1], *self.undone))

    def redo(self) -> Recipe:
        if not self.undone:
            return self
        return replace(self, done=(*self.done, self.undone[0]), undone=self.undone[1:])

    def reset(self) -> Recipe:
        return replace(self, done=(), undone=())

    def apply(self, df: DataFrame, prefixes: Prefixes | None = None) -> DataFrame:
        """The rows after all steps. ``prefixes`` of this table keep what steps give, for this recipe and others."""
        if prefixes is not None:
            return prefixes.table(self)
        for step in self.done:
            df = step.run(df)
        return df

    def timeline(self, spark) -> DataFrame:
        """One row per step: index, action, at, status (past, active or undone)."""
        names = [(LOADED, self.loaded_at), *[(s.operator, s.at) for s in (*self.done, *self.undone)]]
        now = len(self.done)
        status = ["active" if i == now else "past" if i < now else "undone" for i in range(len(names))]
        table = [(i, name, at, status[i]) for i, (name, at) in enumerate(names)]
        return spark.createDataFrame(table, "index int, action string, at timestamp_ntz, status string")

    def audit(self, df: DataFrame, sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Run the recipe and log the shape after every step.

        A step that can change the number of rows is cut and counted, so nothing before it runs again; the
        others keep the count they get.
        """
        log = []
        for i, step in enumerate((None, *self.done)):
            if step is not None:
                df = step.run(df)
            if step is None:
                rows = df.count()
            elif step.operator in ROW_STEPS:
                df = cut(df)
                rows = df.count()
            name, params, at = (step.operator, str(step.params), step.at) if step else (LOADED, "", self.loaded_at)
            log.append((i, name, params, at, rows, len(data_columns(df))))
        (sink or (lambda out: out.write.format("noop").mode("overwrite").save()))(df)
        return df.sparkSession.createDataFrame(
            log, "step int, action string, params string, at timestamp_ntz, n_rows bigint, n_cols bigint"
        )
