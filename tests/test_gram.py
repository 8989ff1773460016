"""Correlations of many columns from one pass, against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from helpers import numbered

from rinsework.operators import charts
from rinsework.plans import gram


def frame(rows=500, columns=12, seed=4):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(rows, columns)) @ rng.normal(size=(columns, columns)), columns=[f"c{k}" for k in range(columns)])
    for k in range(1, columns):
        pdf.loc[rng.random(rows) < 0.1 * (k % 4), f"c{k}"] = np.nan
    pdf["flat"] = 1e9 / 3
    pdf["far"] = 1e8 + pdf["c0"] * 1e-3  # spread far below its values
    pdf["gone"] = np.nan
    pdf["once"] = [1.0] + [np.nan] * (rows - 1)
    pdf["steps"] = np.where(np.arange(rows) % 2 == 0, np.nan, 7.25)
    return pdf


def check(got, pdf):
    want = pdf.corr()
    assert len(got) == len(want) ** 2
    for r in got:
        w = want.loc[r["x"], r["y"]]
        if r["corr"] is None:
            assert math.isnan(w), r
        else:
            assert abs(r["corr"] - w) < 1e-3, r


@pytest.mark.parametrize("parts, at_once", [(1, 4096), (7, 3)])
def test_like_pandas(spark, monkeypatch, parts, at_once):
    monkeypatch.setattr(gram, "PARTS", 2)
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(at_once * 10))
    try:
        check(charts.correlations(df).collect(), pdf)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_two_hundred_columns_are_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(80, 200)), columns=[f"c{k}" for k in range(200)])
    scans = []
    keep = charts.pair_sums
    monkeypatch.setattr(charts, "pair_sums", lambda *a: scans.append(a) or keep(*a))
    monkeypatch.setattr(charts, "measure", lambda *a: pytest.fail("no pair needs a second look"))
    got = charts.correlations(spark.createDataFrame(pdf)).collect()
    assert len(scans) == 1 and len(got) == 40_000
    want = pdf.corr().to_numpy()
    at = {c: k for k, c in enumerate(pdf.columns)}
    assert max(abs(r["corr"] - want[at[r["x"]], at[r["y"]]]) for r in got) < 6e-4


def test_odd_tables(spark):
    none = spark.createDataFrame([], "a double, b int, c string")
    assert [r["corr"] for r in charts.correlations(none).collect()] == [None] * 4
    missing = spark.createDataFrame([(None, None)] * 3, "a double, b double")
    assert [r["corr"] for r in charts.correlations(missing).collect()] == [None] * 4
    assert charts.correlations(numbered(spark, [1.0])).count() == 0
    huge = spark.createDataFrame([(1e200, 1.0), (2e200, 2.0), (3e200, 3.5)], "a double, b double")
    assert all(r["corr"] is None or abs(r["corr"]) <= 1 or math.isnan(r["corr"]) for r in charts.correlations(huge).collect())
