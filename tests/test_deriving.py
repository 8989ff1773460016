import hashlib
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinsework.operators import encode, features, scale
from helpers import numbered, values

CELLS = [3.0, -1.0, None, 0.0, 12.5, 7.0]


def test_arithmetic(spark):
    df = spark.createDataFrame([(0, 6.0, 4), (1, 1.0, 0), (2, None, 2), (3, 5.0, None)], "row_id bigint, a double, b bigint")
    for op, want in {
        "add": [10.0, 1.0, None, None], "subtract": [2.0, 1.0, None, None],
        "multiply": [24.0, 0.0, None, None], "divide": [1.5, None, None, None],
    }.items():
        assert values(features.math_column(df, "a", op, "b", "c"), "c") == want
    assert values(features.math_column(df, "a", "divide", "2", "c"), "c") == [3.0, 0.5, None, 2.5]
    assert values(features.math_column(df, "a", "divide", 0, "c"), "c") == [None] * 4
    with pytest.raises(ValueError):
        features.math_column(df, "a", "add", "many", "c")
    with pytest.raises(ValueError):
        features.math_column(df, "a", "power", 2, "c")
    assert features.math_column(df, "zz", "add", 1, "c") is df


@pytest.mark.parametrize(
    "op,want",
    [("==", "nynnn"), ("!=", "ynyyy"), (">", "ynnny"), ("<", "nnnyn"), (">=", "yynny"), ("<=", "nynyn")],
)
def test_conditions_on_numbers(spark, op, want):
    df = numbered(spark, [5.0, 2.0, None, 1.0, 3.0])
    assert values(features.conditional_column(df, "c", "x", op, "2", "y", "n"), "c") == list(want)


def test_conditions_on_text(spark):
    df = numbered(spark, ["a.c", "abc", None, "None"], "string")

    def flags(*args, **kw):
        return values(features.conditional_column(df, "c", "x", *args, 1, 0, **kw), "c")

    assert flags("contains", "a.c") == [1, 1, 0, 0]
    assert flags("contains", "a.c", literal=True) == [1, 0, 0, 0]
    assert flags("!=", "abc") == [1, 0, 1, 1]
    with pytest.raises(ValueError):
        flags("like", "a")
    with pytest.raises(ValueError):
        features.conditional_column(numbered(spark, [1.0]), "c", "x", ">", "big", 1, 0)


def test_date_parts_like_pandas(spark):
    texts = ["2024-02-29", "1999-12-31", None, "02/03/2020"]
    out = features.date_parts(numbered(spark, texts, "string"), "x", ["Year", "DayOfWeek", "Quarter", "Hour", "Week"])
    assert out.columns == ["row_id", "x", "x_year", "x_dayofweek", "x_quarter", "x_hour"]
    assert values(out, "x_dayofweek") == ["Thursday", "Friday", None, None]
    assert values(out, "x_quarter") == [1, 4, None, None] and values(out, "x_hour") == [0, 0, None, None]
    with pytest.raises(ValueError):
        features.date_parts(numbered(spark, [1], "bigint"), "x", ["Year"])


def test_age_on_leap_days(spark):
    df = numbered(spark, ["2000-02-29", "2000-02-28", None, "2023-03-01"], "string")
    got = values(features.age(df, "x", "age", datetime(2023, 2, 28)), "age")
    assert got == [22, 23, None, -1]


def test_differences_floor(spark):
    df = spark.createDataFrame(
        [(0, datetime(2020, 12, 30, 12), datetime(2020, 12, 30)), (1, datetime(2020, 1, 1), datetime(2021, 1, 1, 6)), (2, None, datetime(2020, 1, 1))],
        "row_id bigint, a timestamp_ntz, b timestamp_ntz",
    )

    def gap(unit):
        return values(features.date_difference(df, "a", "b", "g", unit), "g")

    assert gap("days") == [-1, 366, None]
    assert gap("weeks") == [-1 / 7.0, 366 / 7.0, None]
    assert gap("years") == [-1 / 365.25, 366 / 365.25, None]
    assert gap("hours") == [-12.0, 366 * 24 + 6.0, None]
    with pytest.raises(ValueError):
        gap("moons")


def test_log_shifts_negatives(spark):
    got = values(features.log_transform(numbered(spark, CELLS), "x", "y"), "y")
    assert all(g is None if c is None else math.isclose(g, math.log1p(c + 1), abs_tol=1e-15) for c, g in zip(CELLS, got))
    plain = values(features.log_transform(numbered(spark, [1.0, 3.0]), "x", "y"), "y")
    assert plain == [math.log1p(1.0), math.log1p(3.0)]


@pytest.mark.parametrize("strategy", ["uniform", "quantile"])
@pytest.mark.parametrize(
    "cells",
    [
        CELLS, [1.0, 2.0, 3.0, 10.0, None], [5.0, 5.0, 5.0], [0.0, 0.0], [-7.0], [0.00012, 0.00015, 0.0009, 0.0031],
        [123456.789, 99.5, 3.25e6, 17.125], [float(i % 7) for i in range(60)], [1e9, 1e9 + 1, 1e9 + 2.5],
    ],
)
def test_bins_like_pandas(spark, strategy, cells):
    s = pd.Series(cells, dtype=float)
    cut = pd.cut(s, 4) if strategy == "uniform" else pd.qcut(s, 4, duplicates="drop")
    want = [None if pd.isna(v) else str(v) for v in cut]
    got = values(features.bin_column(numbered(spark, cells), "x", 4, None, "b", strategy), "b")
    assert got == want


def test_bin_labels_and_errors(spark):
    df = numbered(spark, [1.0, 2.0, 3.0, 10.0, None])
    got = values(features.bin_column(df, "x", 4, list("abcd"), "b"), "b")
    assert got == ["a", "a", "a", "d", None]
    with pytest.raises(ValueError):
        features.bin_column(df, "x", 4, ["a"], "b")
    with pytest.raises(ValueError):
        features.bin_column(df, "x", 4, None, "b", "clever")
    with pytest.raises(ValueError):
        features.bin_column(numbered(spark, [1.0, 1.0, 1.0, 2.0]), "x", 4, list("abcd"), "b", "quantile")
    assert features.bin_column(numbered(spark, [None]), "x", 4, None, "b").columns == ["row_id", "x"]


def expected_scale(cells, scaler):
    s = pd.Series(cells, dtype=float)
    s = s.fillna(s.median())
    if scaler == "StandardScaler":
        return (s - s.mean()) / (s.std(ddof=0) or 1)
    if scaler == "MinMaxScaler":
        return (s - s.min()) / ((s.max() - s.min()) or 1)
    if scaler == "RobustScaler":
        return (s - s.median()) / ((s.quantile(0.75) - s.quantile(0.25)) or 1)
    return s / (s.abs().max() or 1)


@pytest.mark.parametrize("scaler", ["StandardScaler", "MinMaxScaler", "RobustScaler", "MaxAbsScaler"])
@pytest.mark.parametrize("cells", [CELLS, [None, None, 1.0, 50.0, 51.0, None], [4.0, 4.0, None], [0.0, 0.0]])
def test_scalers(spark, scaler, cells):
    got = values(scale.scale_features(numbered(spark, cells), ["x", "zz"], scaler), "x")
    assert np.allclose(got, expected_scale(cells, scaler), atol=1e-12)


def test_normalizer(spark):
    df = spark.createDataFrame([(0, 3.0, 4), (1, 0.0, 0), (2, None, 1)], "row_id bigint, a double, b bigint")
    out = scale.scale_features(df, ["a", "b"], "Normalizer")
    a, b = values(out, "a"), values(out, "b")
    assert (a[0], b[0], a[1], b[1]) == (0.6, 0.8, 0.0, 0.0)
    assert math.isclose(a[2] ** 2 + b[2] ** 2, 1.0) and math.isclose(a[2] / b[2], 1.5)


def test_scaler_edges(spark):
    assert values(scale.scale_features(numbered(spark, [None, None]), ["x"], "StandardScaler"), "x") == [None, None]
    text = numbered(spark, ["a"], "string")
    assert values(scale.scale_features(text, ["x"], "MinMaxScaler"), "x") == ["a"]
    with pytest.raises(ValueError):
        scale.scale_features(text, ["x"], "Magic")


# ---- encoding

WORDS = ["b", "a", None, "b", "c", "a", "b"]


def encoded(spark, method, words=WORDS, **kw):
    return encode.encode_categorical(numbered(spark, words, "string"), ["x", "zz"], method, **kw)


def test_label_ordinal_frequency(spark):
    assert values(encoded(spark, "Label Encoding"), "x") == [1, 0, None, 1, 2, 0, 1]
    assert values(encoded(spark, "Ordinal Encoding"), "x") == [1, 2, 3, 1, 4, 2, 1]
    got = values(encoded(spark, "Frequency Encoding"), "x")
    assert got == [3 / 6, 2 / 6, None, 3 / 6, 1 / 6, 2 / 6, 3 / 6]


def test_unseen_values(spark):
    model = encode.fit_ordinal(numbered(spark, ["b", "a"], "string"), "x")
    other = numbered(spark, ["a", "new", None], "string")
    assert values(model.apply(other), "x") == [2, -1, -2]
    seen = encode.fit_ordinal(numbered(spark, ["b", None], "string"), "x")
    assert values(seen.apply(other), "x") == [-1, -1, 2]
    frequency = encode.fit_frequency(numbered(spark, ["b", "a"], "string"), "x")
    assert values(frequency.apply(other), "x") == [0.5, None, None]


@pytest.mark.parametrize("small", [100_000, 2])
def test_codes_are_the_same_for_large_catalogs(spark, small):
    words = [f"w{(i * 37) % 50:02d}" for i in range(200)] + [None]
    df = numbered(spark, words, "string").repartition(4)
    label = encode.fit_label(df, "x", small).table.collect()
    assert {r["key"]: r["code"] for r in label} == {f"w{i:02d}": i for i in range(50)}
    ordinal = encode.fit_ordinal(df, "x", small=small).table.collect()
    firsts = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    assert {r["key"]: r["code"] for r in ordinal} == firsts


def test_one_hot(spark):
    out = encoded(spark, "One Hot Encoding")
    assert out.columns == ["row_id", "x_b", "x_a", "x_nan", "x_c"]
    rows = [tuple(r)[1:] for r in out.orderBy("row_id").collect()]
    assert rows[0] == (1, 0, 0, 0) and rows[2] == (0, 0, 1, 0) and all(sum(r) == 1 for r in rows)
    with pytest.raises(ValueError):
        encoded(spark, "One Hot Encoding", max_categories=2)


def test_binary(spark):
    out = encoded(spark, "Binary Encoding")
    assert out.columns == ["row_id", "x_0", "x_1", "x_2"]
    codes = [r["x_0"] * 4 + r["x_1"] * 2 + r["x_2"] for r in out.orderBy("row_id").collect()]
    assert codes == [1, 2, 3, 1, 4, 2, 1]


@pytest.mark.parametrize("n", [7, 8, 13])
def test_hash_like_md5(spark, n):
    out = encoded(spark, "Hash Encoding", n_components=n)
    assert out.columns == [f"col_{i}" for i in range(n)] + ["row_id"]
    for word, row in zip(WORDS, out.orderBy("row_id").collect()):
        at = int(hashlib.md5(str("nan" if word is None else word).encode()).hexdigest(), 16) % n
        assert [row[f"col_{i}"] for i in range(n)] == [int(i == at) for i in range(n)]


def test_hash_writes_numbers_like_python(spark):
    out = encode.encode_categorical(numbered(spark, [1.0, 2.5]), ["x"], "Hash Encoding")
    for text, row in zip(("1.0", "2.5"), out.orderBy("row_id").collect()):
        assert row[f"col_{int(hashlib.md5(text.encode()).hexdigest(), 16) % 8}"] == 1


def test_target(spark):
    rows = [(i, "ab"[i % 2] if i < 60 else "rare", float(i % 2 * 10 + i % 3)) for i in range(63)]
    df = spark.createDataFrame(rows, "row_id bigint, x string, y double")
    got = values(encode.encode_categorical(df, ["x"], "Target Encoding", "y"), "x")
    pdf = pd.DataFrame(rows, columns=["i", "x", "y"])
    prior, stats = pdf.y.mean(), pdf.groupby("x").y.agg(["count", "mean"])
    weight = 1 / (1 + np.exp(-(stats["count"] - 20) / 10))
    want = pdf.x.map(prior * (1 - weight) + stats["mean"] * weight)
    assert np.allclose(got, want)
    for target in (None, "zz"):
        with pytest.raises(ValueError):
            encode.encode_categorical(df, ["x"], "Target Encoding", target)
    model = encode.fit_target(df, "x", "y")
    assert math.isclose(values(model.apply(numbered(spark, ["new"], "string")), "x")[0], prior)


def test_label_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority")
    model = encode.fit_label(df, "o_orderpriority")
    back = model.apply(df).join(model.table.select("key", F.col("code").alias("o_orderpriority")), "o_orderpriority")
    assert back.join(df.withColumnRenamed("o_orderpriority", "was"), "row_id").filter("was <> key").count() == 0


def test_unknown_encoding(spark):
    with pytest.raises(ValueError):
        encoded(spark, "Morse")
    df = numbered(spark, WORDS, "string")
    assert encode.encode_categorical(df, ["zz"], "Label Encoding") is df
