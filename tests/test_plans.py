"""Shared blocks on both of their paths, with limits low enough to reach the large one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinsework.plans.lookup import attach
from rinsework.plans.cut import cut
from rinsework.plans.ordered import carry_fill, positions, running_sum, with_halo
from rinsework.plans.quantiles import column_quantiles, group_quantiles, rank_value
from helpers import numbered, plan, values

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def skewed(n=6000, seed=1):
    """A third of the cells is one value, some are missing."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        u = rng.random()
        out.append(7.5 if u < 0.34 else None if u < 0.4 else round(rng.gauss(0, 50), 3))
    return out


@pytest.mark.parametrize("finish", [5, 300, 20_000])
def test_quantiles_narrow_to_exact(spark, finish):
    cells = skewed()
    df = numbered(spark, cells)
    got = column_quantiles(df, {"x": PROBS}, direct_rows=10, finish_values=finish)["x"]
    want = np.quantile([c for c in cells if c is not None], PROBS)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_quantiles_direct_and_empty(spark):
    df = numbered(spark, [1.0, 2.0, 3.0, 10.0, None])
    assert column_quantiles(df, {"x": [0.25, 0.5, 0.75]})["x"] == [1.75, 2.5, 4.75]
    assert column_quantiles(df.filter("x is null"), {"x": [0.5]})["x"] == [None]


def test_quantiles_ignore_nan(spark):
    df = numbered(spark, [1.0, float("nan"), 3.0])
    assert column_quantiles(df, {"x": [0.5]})["x"] == [2.0]


def test_quantiles_of_several_large_columns(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, 3000).astype(float), rng.normal(size=3000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = column_quantiles(df, {"a": PROBS, "b": PROBS}, direct_rows=10, finish_values=50)
    assert np.allclose(got["a"], np.quantile(a, PROBS)) and np.allclose(got["b"], np.quantile(b, PROBS))


def test_many_columns_narrow_together(spark, monkeypatch):
    from rinsework.plans import quantiles

    monkeypatch.setattr(quantiles, "SKETCHES", 4)
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 500, size=(400, 10)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in cells], ", ".join(f"c{i} double" for i in range(10)))
    wanted = {f"c{i}": [0.1, 0.5] for i in range(10)}
    got = column_quantiles(df, wanted, direct_rows=400, finish_values=50)
    for i in range(10):
        assert np.allclose(got[f"c{i}"], np.quantile(cells[:, i], [0.1, 0.5]))


def test_rank_value(spark):
    cells = [float(x) for x in range(2000)]
    random.Random(5).shuffle(cells)
    df = numbered(spark, cells)
    for rank in (0, 1, 999, 1999):
        assert rank_value(df, F.col("x"), rank, finish_values=20) == rank


@pytest.mark.parametrize("many", [200, 0])
def test_group_quantiles_split_heavy_groups(spark, many):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.gauss(0, 1)) for _ in range(3000)]
    rows += [(None, rng.gauss(5, 1)) for _ in range(700)]
    rows += [("void", None)] * 3 + [("tie", 4.0)] * 30
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in group_quantiles(df, "k", "x", [0.25, 0.5], direct_rows=500, many_groups=many).collect()}
    assert len(got) == 24 and (got["void"]["n"], got["void"]["q"]) == (0, None) and got["tie"]["q"] == [4.0, 4.0]
    rows = [(k, x) for k, x in rows if x is not None]
    got.pop("void")
    for key, r in got.items():
        cells = [x for k, x in rows if k == key]
        assert r["n"] == len(cells) and np.allclose(r["q"], np.quantile(cells, [0.25, 0.5]))


def test_positions_number_all_rows(spark):
    cells = skewed(3000)
    df = numbered(spark, cells)
    placed = positions(df, ["x", "row_id"], "p").collect()
    want = sorted(range(len(cells)), key=lambda i: (cells[i] is not None, cells[i] or 0, i))
    assert [r["row_id"] for r in sorted(placed, key=lambda r: r["p"])] == want
    assert sorted(r["p"] for r in placed) == list(range(len(cells)))


def test_running_sum(spark):
    rows = [(float(i), (i * 7) % 5 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, n bigint").repartition(6)
    got = {r["v"]: r["before"] for r in running_sum(df, ["v"], "n", "before").collect()}
    total = 0
    for v, n in rows:
        assert got[v] == total
        total += n


def test_halo_copies_neighbours(spark):
    df = spark.range(100).withColumnRenamed("id", "p")
    blocks = with_halo(df, "p", 3, block_rows=12).collect()
    home = [r for r in blocks if r["home"]]
    assert sorted(r["p"] for r in home) == list(range(100))
    for r in home:
        seen = {b["p"] for b in blocks if b["block"] == r["block"]}
        assert all(q in seen for q in range(max(0, r["p"] - 3), min(99, r["p"] + 3) + 1))


@pytest.mark.parametrize("ranges", [1, 5, 13])
@pytest.mark.parametrize("backward", [False, True])
def test_carry_fill(spark, ranges, backward):
    cells = [c if i % 11 in (3, 4) and not 200 < i < 320 else None for i, c in enumerate(skewed(700))]
    df = numbered(spark, cells).repartition(5)
    got = values(carry_fill(df, ["x"], "row_id", backward, ranges), "x")
    want, last = [], None
    for c in reversed(cells) if backward else cells:
        last = c if c is not None else last
        want.append(last)
    assert got == (want[::-1] if backward else want)


def test_carry_fill_where_one_order_value_is_hot(spark):
    rows = [(i, 5 if i % 3 else i, float(i) if i % 17 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, t bigint, x double").repartition(5)
    got = {r["row_id"]: r["x"] for r in carry_fill(df, ["x"], "t", ranges=8).collect()}
    last = None
    for i, _, x in sorted(rows, key=lambda r: (r[1], r[0])):
        last = x if x is not None else last
        assert got[i] == last


def test_carry_fill_by_text_order(spark):
    rows = [(i, f"{i:05d}", i if i % 5 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, t string, x bigint").repartition(3)
    got = values(carry_fill(df, ["x"], "t"), "x")
    assert got == [i - i % 5 for i in range(400)]


@pytest.mark.parametrize("limit", [1000, 3])
def test_attach_both_ways(spark, limit):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}") for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id bigint, k string")
    model = cut(
        df.filter("k is null or k <> 'k4'")
        .groupBy(F.col("k").alias("key"))
        .agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    )
    out = attach(df, model, {"k": "key"}, ["first"], "n", broadcast_rows=limit, hot_keys=6)
    got = {r["row_id"]: r["first"] for r in out.collect()}
    firsts = {}
    for i, k in rows:
        firsts.setdefault(k, i)
    assert got == {i: None if k == "k4" else firsts[k] for i, k in rows}


def test_no_single_partition_exchange(spark):
    """Ordered operators must not send the table through one task."""
    from rinsework.operators import charts, density, impute

    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(F.col("event_id").alias("row_id"), "value")
    gaps = df.withColumn("value", F.when(F.col("row_id") % 3 == 0, F.col("value")))
    frames = [
        impute.impute_missing(gaps, ["value"], "ffill"),
        impute.impute_missing(gaps, ["value"], "bfill"),
        charts.normal_order(df, "value"),
        density.local_outlier_factors(df.select("value"), 5),
    ]
    for frame in frames:
        assert "SinglePartition" not in plan(frame)


def test_decisive_counts_agree_with_exact_ones(spark):
    from rinsework.plans.counts import decisive_counts, distinct_counts

    df = spark.range(6000).selectExpr(
        "cast(id % 3 as string) as few", "cast(id % 2000 as string) as near", "cast(id as string) as wide", "'k' as one"
    )
    exact = distinct_counts(df, df.columns)
    got = decisive_counts(df, df.columns, 6000, [100, 1800], direct_rows=10)
    assert {c: got[c] for c in ("few", "near", "one")} == {"few": 3, "near": 2000, "one": 1}
    assert abs(got["wide"] - exact["wide"]) < 0.1 * exact["wide"]
    assert decisive_counts(df, df.columns, 6000, [100, 1800]) == exact


@pytest.mark.parametrize("listed", [100_000, 0])
def test_duplicates_by_hash_and_in_full(spark, listed):
    from rinsework.operators.dedup import duplicate_count

    df = spark.range(3000).selectExpr("id as row_id", "case when id % 3 = 0 then 'hot' else cast(id % 1500 as string) end as s")
    assert duplicate_count(df, listed=listed).first()[0] == 3000 - 1001
    unique = spark.range(100).selectExpr("id as row_id", "id * 2 as v")
    assert duplicate_count(unique, listed=listed).first()[0] == 0
