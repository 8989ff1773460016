"""Frequent values and modes by sketch, against plain counting."""

import random
from collections import Counter

import pytest
from helpers import plan
from pyspark.sql import functions as F

from rinsework.operators import preview
from rinsework.plans import heavy

PREFIX = "the same first characters of a long text "


def cells(n=4000, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        yield {
            "row_id": i,
            "skewed": f"v{min(int(rng.paretovariate(0.7)), 900)}",
            "flat": rng.randrange(700),
            "unique": f"{PREFIX}{rng.random()}",
            "twice": f"{PREFIX}{i // 2:06d}",
            "few": rng.choice([None, "b", "a", ""]),
            "number": rng.choice([-0.0, 0.0, float("nan"), 2.5, -1e300, None]),
            "third": "hot" if i % 3 == 0 else f"{PREFIX}{i}",
            "gone": None,
        }


SCHEMA = "row_id bigint, skewed string, flat int, unique string, twice string, few string, number double, third string, gone string"
COLUMNS = ["skewed", "flat", "unique", "twice", "few", "number", "third", "gone"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [tuple(r.values()) for r in cells()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def plain_counts(name):
    kept = [r[name] for r in cells() if r[name] is not None and r[name] == r[name]]
    return sorted(Counter(kept).items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("k, tracked", [(1, 4096), (5, 4096), (5, 8), (200, 64), (3, 512)])
def test_top_counts(spark, table, k, tracked):
    top, rows, whole = heavy.top_counts(table, COLUMNS, k, tracked)
    got = {}
    for r in top.orderBy("i", "rank").collect():
        got.setdefault(COLUMNS[r["i"]], []).append((r["txt"], r["n"]))
    for c in COLUMNS:
        want = plain_counts(c)
        text = (lambda v: str(v)) if c != "number" else (lambda v: {0.0: "0.0", 2.5: "2.5", -1e300: "-1.0E300"}[v])
        assert got.get(c, []) == [(text(v), n) for v, n in want[:k]], c
        assert rows[c] == sum(n for _, n in want)
        assert c not in whole or whole[c] == len(want)


def test_modes(table):
    got = heavy.modes(table, COLUMNS)
    assert "gone" not in got and set(got) == set(COLUMNS) - {"gone"}
    for c in set(COLUMNS) - {"gone", "number"}:
        want = plain_counts(c)
        assert got[c] == (str(want[0][0]), want[0][1], len(want))
    assert got["number"][0] == "0.0"
    assert heavy.modes(table, ["few"], distinct=False)["few"][:2] == (plain_counts("few")[0])


def test_the_error_of_the_sketch_holds(spark):
    """No value the sketch leaves out has more rows than it says, also where it drops most values."""
    rng = random.Random(3)
    values = [int(rng.paretovariate(0.5)) % 20_000 for _ in range(60_000)]
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(7)
    counts = Counter(values)
    for tracked in (16, 100, 1000):
        found = heavy.candidates(df, ["x"], 5, tracked)["x"]
        keys = {r["h"]: r["x"] for r in df.distinct().select("x", heavy.hashes(df, "x")[0].alias("h")).collect()}
        seen = {keys[h] for h in found.hashes}
        assert max(n for v, n in counts.items() if v not in seen) <= found.others


def test_only_candidates_travel_as_text(spark, table, monkeypatch):
    """The first shuffle that holds texts comes after the test for candidates; the fallback ships hashes and short starts."""
    shown = []
    monkeypatch.setattr(heavy, "cut", lambda df: shown.append(df) or df.cache())
    preview.frequent_values(table, ["unique", "third"], 2).collect()
    first = plan(shown[0])
    assert first.index("xxhash64") < first.index("Exchange hashpartitioning") if "Exchange hashpartitioning" in first else "IN" in first.upper()
    assert {f.name for f in shown[1].schema} == {"i", "h1", "h2", "n"}


def test_hashes_take_the_seed_first(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("k"))
    for h, seed in zip(heavy.hashes(df, "k"), (1, 2)):
        assert df.filter(h != F.xxhash64(F.lit(seed), F.col("k"))).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "a string, x double")
    assert heavy.modes(df, ["a", "x"]) == {}
    assert preview.frequent_values(df, ["a", "x"]).count() == 0
    assert preview.frequent_values(df.select(F.array("a").alias("n")), "n").count() == 0
