"""Most frequent values: a frequent-items sketch names candidates with an error bound, exact counts decide among them.

The sketch of all columns is one aggregate over 64-bit hashes, merged from task to task. A second scan counts its
candidates exactly, so the only texts in its shuffle are theirs. Where the bound cannot rule out that another value
belongs to the first k (flat or unique columns), hashes are counted instead, and texts are looked at for the values that
reach the k-th place only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.names import dtype, is_numeric, value
from rinsework.plans.counts import countable, exact_counts, hashes
from rinsework.plans.cut import cut
from rinsework.plans.lookup import BROADCAST_ROWS
from rinsework.plans.onerow import measure

#: Values a sketch follows, and how many of them come back as candidates at least.
TRACKED, CANDIDATES = 4096, 64
#: Characters of a text that take part in the first ordering of values with equal counts.
PREFIX = 16


def sketch_error(rows: int, tracked: int = TRACKED) -> int:
    """The most by which a sketch of so many rows misjudges a value: 3.5 rows in each ``slots``, slots a power of two."""
    slots = 1 << max(3, math.ceil(math.log2(tracked / 0.75)))
    return math.ceil(3.5 * rows / slots)


@dataclass(frozen=True)
class Candidates:
    """What the sketch says of a column: non-null rows, hashes that may be frequent, the most rows another value can have."""

    rows: int
    hashes: list[int]
    others: int


def candidates(df: DataFrame, columns: list[str], k: int, tracked: int = TRACKED) -> dict[str, Candidates]:
    """One aggregate for all columns."""
    most = min(max(CANDIDATES, 4 * k), tracked)
    wanted: dict = {"rows": F.count(F.lit(1))}
    for c in columns:
        key = F.when(value(df, c).isNotNull(), hashes(df, c)[0])
        wanted[c, "n"] = F.count(key)
        wanted[c, "top"] = F.call_function("approx_top_k", key, F.lit(most), F.lit(tracked))
    got, out = measure(df, wanted), {}
    for c in columns:
        top = got[c, "top"] or []  # missing values are an item too
        last = top[-1]["count"] if len(top) >= most else 0
        out[c] = Candidates(got[c, "n"], [r["item"] for r in top if r["item"] is not None], max(last, 2 * sketch_error(got["rows"], tracked)))
    return out


def _cell(df: DataFrame, i: int, c: str, *more: Column) -> Column:
    v = value(df, c)
    num = v.cast("double") if is_numeric(dtype(df, c)) else F.lit(None).cast("double")
    return F.struct(F.lit(i).alias("i"), num.alias("num"), *more, v.cast("string").alias("txt"))


def top_counts(df: DataFrame, columns: list[str], k: int, tracked: int = TRACKED) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """The k most frequent values per column, ties to the smaller value, exact whatever the sketch missed.

    Returns a table (i, rank, num, txt, n) with i the place in ``columns``, the non-null rows of each column, and the
    number of distinct values of those columns whose candidates turned out to be all of them.
    """
    found = candidates(df, columns, k, tracked)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), F.asc("num"), F.asc("txt")))
    cells = []
    for i, c in enumerate(columns):
        mine = hashes(df, c)[0].isin(found[c].hashes) if found[c].hashes else F.lit(False)
        cells.append(F.when(mine & value(df, c).isNotNull(), _cell(df, i, c)))
    long = df.select(F.inline(F.array(*cells))).filter("txt is not null")
    counted = cut(long.groupBy("i", "num", "txt").agg(F.count(F.lit(1)).alias("n")))
    ranked = counted.withColumn("rank", rank)
    sums = ranked.groupBy("i").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("d"), F.max(F.when(F.col("rank") == k, F.col("n"))).alias("last"))
    got = {r["i"]: r for r in sums.collect()}
    whole = {c: got[i]["d"] if i in got else 0 for i, c in enumerate(columns) if (got[i]["rows"] if i in got else 0) == found[c].rows}
    left = [i for i, c in enumerate(columns) if c not in whole and not (i in got and (got[i]["last"] or 0) > found[c].others)]
    top = ranked.filter(~F.col("i").isin(left)) if left else ranked
    if left:
        top = top.unionByName(_by_hash(df, columns, left, k).withColumn("rank", rank))
    top = top.filter(F.col("rank") <= k).select("i", "rank", "num", "txt", "n")
    return top, {c: found[c].rows for c in columns}, whole


def _by_hash(df: DataFrame, columns: list[str], chosen: list[int], k: int) -> DataFrame:
    """Exact counts of all values by a pair of hashes; texts only of values that reach the k-th place in the order of
    count, number and the first characters."""
    pairs = {i: hashes(df, columns[i]) for i in chosen}
    cells = []
    for i in chosen:
        h1, h2 = pairs[i]
        there = F.when(value(df, columns[i]).isNotNull(), h1)
        cells.append(_cell(df, i, columns[i], there.alias("h1"), h2.alias("h2")).withField("txt", F.substring(value(df, columns[i]).cast("string"), 1, PREFIX)))
    long = df.select(F.inline(F.array(*cells))).filter("h1 is not null")
    counted = long.groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("num"), F.min("txt").alias("start"))
    place = F.rank().over(Window.partitionBy("i").orderBy(F.desc("n"), F.asc("num"), F.asc("start")))
    reach = cut(counted.withColumn("place", place).filter(F.col("place") <= k).select("i", "h1", "h2", "n"))
    cells = [_cell(df, i, columns[i], pairs[i][0].alias("h1"), pairs[i][1].alias("h2")) for i in chosen]
    whole = df.select(F.inline(F.array(*cells))).filter("txt is not null")
    few = reach.count() <= BROADCAST_ROWS
    met = whole.join(F.broadcast(reach) if few else reach, ["i", "h1", "h2"])
    return met.groupBy("i", "num", "txt").agg(F.min("n").alias("n"))


def modes(df: DataFrame, columns: list[str], distinct: bool = True) -> dict[str, tuple[str, int, int | None]]:
    """Most frequent value as text, its count and, unless not wanted, the distinct count; ties go to the smallest value.

    Columns without values are left out. Only columns with more values than the candidates have their distinct ones
    counted in a shuffle of hashes.
    """
    columns = countable(df, columns)
    if not columns:
        return {}
    top, _, seen = top_counts(df, columns, 1)
    best = {columns[r["i"]]: (r["txt"], r["n"]) for r in top.collect()}
    if distinct:
        seen |= exact_counts(df, [c for c in best if c not in seen])
    return {c: (*best[c], seen.get(c)) for c in columns if c in best}
