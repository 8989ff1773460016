"""Exact quantiles without holding a column's distinct values in one task.

Small inputs use the built-in ``percentile``. Larger ones narrow a value bracket around each wanted
rank with the mergeable ``percentile_approx`` sketch, count exactly what lies below and inside it, and
repeat until so few distinct values are left that they fit one small result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.names import col, number
from rinsework.plans.cut import cut
from rinsework.plans.lookup import attach
from rinsework.plans.onerow import measure
from rinsework.plans.ordered import running_sum

DIRECT_ROWS = 1_000_000
DIRECT_COLUMNS = 8
SKETCHES = 60
MANY_GROUPS = 200
FINISH_VALUES = 20_000
SKETCH = 10_000


def column_quantiles(
    df: DataFrame,
    wanted: dict[str, Sequence[float]],
    direct_rows: int = DIRECT_ROWS,
    finish_values: int = FINISH_VALUES,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of several columns in a bounded number of jobs.

    ``counts`` gives the non-missing rows per column where they are known, which saves a scan.
    """
    exprs = {c: number(df, c) for c in wanted}
    return expression_quantiles(df, exprs, wanted, direct_rows, finish_values, counts)


def expression_quantiles(
    df: DataFrame,
    exprs: dict,
    wanted: dict,
    direct_rows: int = DIRECT_ROWS,
    finish_values: int = FINISH_VALUES,
    counts: dict | None = None,
) -> dict:
    if not exprs:
        return {}
    if counts is None:
        counts = measure(df, {k: F.count(e) for k, e in exprs.items()})
    small = [k for k in exprs if 0 < counts[k] <= direct_rows]
    if sum(counts[k] for k in small) > DIRECT_COLUMNS * direct_rows:
        small = []  # together they would not fit one task
    answer: dict = {k: [None] * len(wanted[k]) for k in exprs}
    if small:
        direct = measure(
            df, {k: F.percentile(exprs[k], F.array(*[F.lit(float(q)) for q in wanted[k]])) for k in small}
        )
        answer.update({k: list(v) for k, v in direct.items()})
    large = [k for k in exprs if counts[k] and k not in small]
    if large:
        places = {k: [q * (counts[k] - 1) for q in wanted[k]] for k in large}
        ranks = {(k, r) for k in large for p in places[k] for r in (math.floor(p), math.ceil(p))}
        found = _select(df, exprs, sorted(ranks, key=str), counts, finish_values)
        for k in large:
            answer[k] = [_between(found, k, p) for p in places[k]]
    return answer


def rank_value(df: DataFrame, e: Column, rank: int, finish_values: int = FINISH_VALUES) -> float:
    """Exact value of a double expression at a 0-based rank among its non-null values."""
    rows = measure(df, {0: F.count(e)})
    return _select(df, {0: e}, [(0, rank)], rows, finish_values)[(0, rank)]


def _between(found: dict, key, place: float) -> float:
    lower, upper = found[(key, math.floor(place))], found[(key, math.ceil(place))]
    return lower + (upper - lower) * (place - math.floor(place))


class _Bracket:
    def __init__(self, rows: int):
        self.low, self.high = None, None
        self.below, self.inside = 0, rows

    def holds(self, e: Column) -> Column:
        kept = e.isNotNull()
        if self.low is not None:
            kept = kept & (e >= F.lit(self.low))
        if self.high is not None:
            kept = kept & (e <= F.lit(self.high))
        return kept


def _select(df: DataFrame, exprs: dict, targets: list, counts: dict, finish_values: int) -> dict:
    """Value at each 0-based rank; targets are (expression key, rank) pairs."""
    found: dict = {}
    if len(targets) > SKETCHES:
        # bounds the sketches a task holds at once
        for start in range(0, len(targets), SKETCHES):
            found.update(_select(df, exprs, targets[start : start + SKETCHES], counts, finish_values))
        return found
    brackets = {t: _Bracket(counts[t[0]]) for t in targets}
    open_targets = list(targets)
    ready: list = []
    while open_targets:
        sketches = {}
        for t in open_targets:
            b, e = brackets[t], exprs[t[0]]
            share = (t[1] - b.below) / max(1, b.inside)
            ends = F.array(F.lit(max(0.0, share - 3 / SKETCH)), F.lit(min(1.0, share + 3 / SKETCH)))
            sketches[t] = F.percentile_approx(F.when(b.holds(e), e), ends, SKETCH)
        guess = measure(df, sketches)
        checks = {}
        for t in open_targets:
            e, (low, high) = exprs[t[0]], guess[t]
            inside = e.between(F.lit(low), F.lit(high))
            checks[(t, "below")] = F.count_if(e < F.lit(low))
            checks[(t, "inside")] = F.count_if(inside)
            checks[(t, "values")] = F.approx_count_distinct(F.when(inside, e))
        seen = measure(df, checks)
        waiting = []
        for t in open_targets:
            b, (low, high) = brackets[t], guess[t]
            below, inside = seen[(t, "below")], seen[(t, "inside")]
            if t[1] < below:
                # the sketch guessed too high: keep only what lies strictly below its low end
                b.high, b.inside = math.nextafter(low, -math.inf), below - b.below
                waiting.append(t)
            elif t[1] >= below + inside:
                # too low: keep only what lies strictly above its high end
                b.inside -= below + inside - b.below
                b.low, b.below = math.nextafter(high, math.inf), below + inside
                waiting.append(t)
            else:
                b.low, b.high, b.below, b.inside = low, high, below, inside
                if low == high:
                    found[t] = low
                elif seen[(t, "values")] <= finish_values:
                    ready.append(t)
                else:
                    waiting.append(t)
        open_targets = waiting
    if ready:
        found.update(_finish(df, exprs, brackets, ready))
    return found


def _finish(df: DataFrame, exprs: dict, brackets: dict, ready: list) -> dict:
    """Count the few distinct values left in each bracket and step to the wanted rank."""
    cells = [
        F.struct(F.lit(i).alias("i"), F.when(brackets[t].holds(exprs[t[0]]), exprs[t[0]]).alias("v"))
        for i, t in enumerate(ready)
    ]
    left = df.select(F.inline(F.array(*cells))).filter("v is not null").groupBy("i", "v").count().collect()
    by_target: dict[int, list] = {}
    for i, v, n in left:
        by_target.setdefault(i, []).append((v, n))
    found = {}
    for i, t in enumerate(ready):
        rank = brackets[t].below
        for v, n in sorted(by_target[i]):
            rank += n
            if t[1] < rank:
                found[t] = v
                break
    return found


def group_quantiles(
    df: DataFrame,
    key: str,
    name: str,
    probs: Sequence[float],
    direct_rows: int = DIRECT_ROWS,
    many_groups: int = MANY_GROUPS,
    chunk: int = 40,
) -> DataFrame:
    """Quantiles of ``name`` per ``key``: columns key, n, q (array in the order of ``probs``).

    Groups up to ``direct_rows`` aggregate in one shuffle. A larger group is treated like a column of
    its own, so no single task ever holds it. Where there are more than ``many_groups`` of those, all
    groups are ranked by one distributed sort of the distinct values.
    """
    v = number(df, name)
    levels = F.array(*[F.lit(float(q)) for q in probs])
    counted = df.groupBy(col(key)).agg(F.count(v).alias("n"))
    heavy = counted.filter(F.col("n") > direct_rows).limit(many_groups + 1).collect()
    if len(heavy) > many_groups:
        return _ranked_quantiles(df, key, v, probs)
    light = df
    if heavy:
        rare = F.lit(False)
        if any(r[0] is None for r in heavy):
            rare = col(key).isNull()
        listed = [r[0] for r in heavy if r[0] is not None]
        light = df.filter(~F.coalesce(rare | col(key).isin(listed), F.lit(False)))
    direct = light.groupBy(col(key)).agg(F.count(v).alias("n"), F.percentile(v, levels).alias("q"))
    if not heavy:
        return direct
    rows = []
    for start in range(0, len(heavy), chunk):
        part = heavy[start : start + chunk]
        exprs = {i: F.when(col(key).eqNullSafe(F.lit(r[0])), v) for i, r in enumerate(part)}
        sizes = {i: r[1] for i, r in enumerate(part)}
        got = expression_quantiles(df, exprs, {i: probs for i in exprs}, direct_rows, counts=sizes)
        rows += [(r[0], r[1], got[i]) for i, r in enumerate(part)]
    return direct.unionByName(df.sparkSession.createDataFrame(rows, direct.schema))


def _ranked_quantiles(df: DataFrame, key: str, v: Column, probs: Sequence[float]) -> DataFrame:
    """Sort the distinct (key, value) pairs, number their rows by running counts, pick the wanted ranks."""
    pairs = df.groupBy(col(key).alias("k"), v.alias("v")).agg(F.count(F.lit(1)).alias("rows"))
    pairs = pairs.select("k", "v", F.when(F.col("v").isNotNull(), F.col("rows")).otherwise(0).alias("rows"))
    laid = cut(running_sum(pairs, ["k", "v"], "rows", "before"))
    groups = cut(
        laid.groupBy("k").agg(
            F.min("before").alias("start"), F.sum("rows").alias("total"), F.count(F.lit(1)).alias("pairs")
        )
    )
    placed = attach(laid, groups, {"k": "k"}, ["start", "total"], "pairs")
    first = F.col("before") - F.col("start")
    picks = []
    for i, q in enumerate(probs):
        place = F.lit(float(q)) * (F.col("total") - 1)
        for tag, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            hit = (first <= rank) & (rank < first + F.col("rows"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"{tag}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"f{i}"))
    found = placed.groupBy("k").agg(F.max("total").alias("n"), *picks)
    at = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(probs))]
    levels = F.when(F.col("n") > 0, F.array(*at))
    return found.select(F.col("k").alias(key), "n", levels.alias("q"))
