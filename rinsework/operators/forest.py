"""Isolation forest over one numeric column.

One column needs no tree walk per row: a tree is a step function of the value, so the mean path length
of the forest is one too. Trees are grown from bounded random samples in Spark tasks; the steps (at most
trees times sample size) give the flagged value intervals, and rows are tested against those natively.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import ROW_ID

TREES = 100
SAMPLE = 256
EULER = 0.5772156649015329


def mean_path(n: int) -> float:
    """Expected path length of an unsuccessful search among n values (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _steps(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[float, float]]:
    """Leaves of one random tree in value order: (upper end, path length)."""
    leaves: list[tuple[float, float]] = []
    todo = [(np.sort(sample), 0, math.inf)]
    while todo:
        part, depth, end = todo.pop()
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            leaves.append((end, depth + mean_path(len(part))))
            continue
        split = rng.uniform(part[0], part[-1])
        at = int(np.searchsorted(part, split, side="right"))
        # the left part ends at the split, so it is taken from the stack first
        todo.append((part[at:], depth + 1, end))
        todo.append((part[:at], depth + 1, float(split)))
    return leaves


def fit(rows: DataFrame, contamination: float, seed: int):
    """Test of a value against the flagged intervals, and whether any row is flagged.

    ``rows`` has columns value and row_id. The pool of samples is bounded by trees times sample size.
    """
    spark = rows.sparkSession
    draw = F.xxhash64(F.lit(seed), F.col(ROW_ID))
    pool_rows = rows.select("value", draw.alias("d")).orderBy("d", "value").limit(TREES * SAMPLE)
    pool = np.array([r[0] for r in pool_rows.select("value").collect()])
    size = min(SAMPLE, len(pool))
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["tree"]:
                rng = np.random.default_rng([seed, int(tree)])
                sample = rng.choice(pool, size, replace=False)
                leaves = _steps(sample, rng, limit)
                yield pd.DataFrame({"tree": tree, "high": [e for e, _ in leaves], "path": [p for _, p in leaves]})

    ids = spark.range(TREES).withColumnRenamed("id", "tree")
    grown = ids.mapInPandas(grow, "tree long, high double, path double").toPandas()
    ends, depth = _merge(grown)
    scores = 2.0 ** (-depth / mean_path(size)) if size > 1 else np.full(len(depth), 0.5)
    counts = _rows_per_interval(rows, ends)
    if not counts.sum():
        return None, False
    bound = _weighted_quantile(-scores, counts, contamination)
    flagged = (-scores < bound)
    if not (flagged & (counts > 0)).any():
        return None, False
    return _interval_test(ends, flagged), True


def _merge(grown: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean path length of the forest per interval; interval i ends at (and includes) ends[i]."""
    ends = np.unique(grown["high"].to_numpy())
    total = np.zeros(len(ends))
    for _, tree in grown.groupby("tree"):
        highs, paths = tree["high"].to_numpy(), tree["path"].to_numpy()
        order = np.argsort(highs)
        total += paths[order][np.searchsorted(highs[order], ends, side="left")]
    return ends, total / grown["tree"].nunique()


def _rows_per_interval(rows: DataFrame, ends: np.ndarray) -> np.ndarray:
    """Rows in each interval; Bucketizer closes on the left, so inner ends move up by one step."""
    inner = [float(np.nextafter(e, np.inf)) for e in ends[:-1]]
    if not inner:
        return np.array([rows.count()])
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(rows)
    counts = np.zeros(len(ends), dtype=np.int64)
    for bucket, n in bucketed.groupBy("bucket").count().collect():
        low = splits[int(bucket)]
        counts[0 if low == float("-inf") else bisect_left(inner, low) + 1] += n
    return counts


def _weighted_quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    place = q * (upto[-1] - 1)
    lower, upper = math.floor(place), math.ceil(place)
    at = [values[order][np.searchsorted(upto, r, side="right")] for r in (lower, upper)]
    return float(at[0] + (at[1] - at[0]) * (place - lower))


def _interval_test(ends: np.ndarray, flagged: np.ndarray):
    spans, start = [], None
    for i, hit in enumerate(flagged):
        if hit and start is None:
            start = float(ends[i - 1]) if i else -math.inf
        if not hit and start is not None:
            spans.append((start, float(ends[i - 1])))
            start = None
    if start is not None:
        spans.append((start, math.inf))

    return span_test(spans)


def span_test(spans: list[tuple[float, float]]):
    """Test of a column against disjoint rising spans (low, high], a null for null: halving comparisons, as deep as the
    logarithm of their number."""
    # a value lies in a span if an odd number of all ends lies below it
    ends = [e for span in spans for e in span]

    def test(x):
        def within(first: int, last: int):
            if first == last:
                return F.lit(first % 2 == 1)
            middle = (first + last) // 2
            return F.when(x <= F.lit(ends[middle]), within(first, middle)).otherwise(within(middle + 1, last))

        return F.when(x.isNotNull(), within(0, len(ends)))

    return test
