import math
import re
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinsework.functions.parse import guess_date_format, spark_date_pattern
from rinsework.operators import density, dtypes, impute, outliers
from rinsework.operators.text import clean_text
from helpers import numbered, plan, values


def test_mean_median_mode(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 1, "b"), (1, None, None, "a"), (2, 3.0, 4, None), (3, 8.0, 4, "b"), (4, float("nan"), 7, "a")],
        "row_id bigint, x double, n bigint, s string",
    )
    assert values(impute.impute_missing(df, ["x", "s", "zz"], "mean"), "x") == [1.0, 4.0, 3.0, 8.0, 4.0]
    out = impute.impute_missing(df, ["x", "n"], "median")
    assert values(out, "x") == [1.0, 3.0, 3.0, 8.0, 3.0] and values(out, "n") == [1.0, 4.0, 4.0, 4.0, 7.0]
    assert dict(out.dtypes)["n"] == "double"
    out = impute.impute_missing(df, ["s", "n"], "mode")
    assert values(out, "s") == ["b", "a", "a", "b", "a"] and values(out, "n") == [1, 4, 4, 4, 7]
    assert dict(out.dtypes)["n"] == "bigint"


def test_mode_ties_go_to_the_smallest(spark):
    assert values(impute.impute_missing(numbered(spark, ["b", "a", "b", "a", None], "string"), ["x"], "mode"), "x")[4] == "a"
    assert values(impute.impute_missing(numbered(spark, [10, 9, None], "bigint"), ["x"], "mode"), "x")[2] == 9


def test_integer_column_without_gaps_keeps_its_type(spark):
    df = numbered(spark, [1, 2], "bigint")
    assert dict(impute.impute_missing(df, ["x"], "mean").dtypes)["x"] == "bigint"


def test_constant_is_cast_per_column(spark):
    df = spark.createDataFrame([(None, None, None)], "i bigint, f double, s string")
    out = impute.impute_missing(df, ["i", "f", "s"], "constant", "5").first()
    assert tuple(out) == (5, 5.0, "5")
    with pytest.raises(ValueError):
        impute.impute_missing(df, ["i"], "constant", "five")
    assert impute.impute_missing(df, ["i"], "constant").first()["i"] is None
    with pytest.raises(ValueError):
        impute.impute_missing(df, ["i"], "nearest")


@pytest.mark.parametrize("strategy", ["mean", "median", "mode", "ffill", "bfill"])
def test_all_missing_stays_missing(spark, strategy):
    df = numbered(spark, [None, None])
    assert values(impute.impute_missing(df, ["x"], strategy), "x") == [None, None]


@pytest.mark.parametrize("strategy", ["ffill", "bfill"])
def test_fills_like_pandas(spark, strategy):
    cells = [None, 1.0, None, None, 5.0, None]
    got = values(impute.impute_missing(numbered(spark, cells).repartition(3), ["x"], strategy), "x")
    want = getattr(pd.Series(cells), strategy)()
    assert got == [None if math.isnan(w) else w for w in want]


def test_model_fills_another_batch(spark):
    model = impute.fit_fill(numbered(spark, [1.0, None, 5.0]), ["x"], "median")
    assert values(model.apply(numbered(spark, [None, 9.0])), "x") == [3.0, 9.0]


TEXTS = [
    " \t o'neil mc-donald foo2bar éa\n", "a_b, c! é", "  ", "", "x  y  z\x1f", "ÇA Va ß straße 12٣", "no line", "a.b*c", None, "nan", "None",
    "﷐ odd mark﷐ here", "ΑΣ σας", "１２ ab①",
]


@pytest.mark.parametrize(
    "operation,python",
    [
        ("trim", str.strip),
        ("remove_extra_spaces", lambda s: re.sub(r"\s+", " ", s).strip()),
        ("remove_punct", lambda s: re.sub(r"[^\w\s]", "", s)),
        ("remove_nums", lambda s: re.sub(r"\d+", "", s)),
        ("remove_special", lambda s: re.sub(r"[^A-Za-z0-9\s]", "", s)),
        ("upper", str.upper),
        ("lower", str.lower),
        ("title", str.title),
    ],
)
def test_text_like_python(spark, operation, python):
    texts = [t for t in TEXTS if operation != "title" or t is None or "①" not in t]
    got = values(clean_text(numbered(spark, texts, "string"), ["x", "zz"], operation), "x")
    assert got == [None if t is None else python(t) for t in texts]


@pytest.mark.parametrize("operation,python", [("title", str.title), ("remove_punct", lambda s: re.sub(r"[^\w\s]", "", s))])
def test_text_like_python_on_documents(spark, operation, python):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    assert values(clean_text(df, ["text"], operation), "text") == [python(t) for t in values(df, "text")]


def test_every_white_space_is_stripped(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    df = numbered(spark, [spaces + "a" + spaces + "b" + spaces], "string")
    assert values(clean_text(df, ["x"], "trim"), "x") == ["a" + spaces + "b"]
    assert values(clean_text(df, ["x"], "remove_extra_spaces"), "x") == ["a b"]


def test_find_replace_is_literal(spark):
    df = numbered(spark, ["a.b.c", None], "string")
    assert values(clean_text(df, ["x"], "find_replace", ".", "$1"), "x") == ["a$1b$1c", None]
    assert values(clean_text(df, ["x"], "find_replace", "."), "x") == ["a.b.c", None]


def test_replace_missing(spark):
    df = numbered(spark, [None, "nan", "NaN", "None", " ", "x"], "string")
    assert values(clean_text(df, ["x"], "replace_missing", replace="?"), "x") == ["?", "?", "?", "?", " ", "x"]
    blank = clean_text(df, ["x"], "replace_missing", replace="?", blank_as_missing=True)
    assert values(blank, "x") == ["?", "?", "?", "?", "?", "x"]


def test_text_of_other_types(spark):
    df = spark.createDataFrame([(0, 1.0, True), (1, None, None)], "row_id bigint, f double, b boolean")
    out = clean_text(df, ["f", "b"], "upper")
    assert values(out, "f") == ["1.0", None] and values(out, "b") == ["TRUE", None]
    with pytest.raises(ValueError):
        clean_text(df, ["f"], "shout")


def test_trim_is_idempotent(spark):
    once = clean_text(numbered(spark, TEXTS, "string"), ["x"], "trim")
    assert values(clean_text(once, ["x"], "trim"), "x") == values(once, "x")


def test_numbers_like_pandas(spark):
    texts = [" 5 ", "5d", "1e3", "0x1A", "1_000", "True", "inf", "1,000", "-.5", "5.", "", None, "-Infinity", "nan"]
    got = values(dtypes.convert_type(numbered(spark, texts, "string"), "x", "Float"), "x")
    want = [5.0, None, 1000.0, None, None, None, math.inf, None, -0.5, 5.0, None, None, -math.inf, None]
    assert got == want


def test_integers_round_half_to_even(spark):
    out = dtypes.convert_type(numbered(spark, [0.5, 1.5, 2.5, -0.5, None, float("nan")]), "x", "Integer")
    assert values(out, "x") == [0, 2, 2, 0, None, None] and dict(out.dtypes)["x"] == "bigint"


def test_booleans(spark):
    texts = ["Yes", " y ", "TRUE", "1.0", "t", "No", "f", "0", "0.0", "maybe", None]
    got = values(dtypes.convert_type(numbered(spark, texts, "string"), "x", "Boolean"), "x")
    assert got == [True] * 5 + [False] * 4 + [None] * 2
    assert values(dtypes.convert_type(numbered(spark, [1.0, 0.0, 2.0]), "x", "Boolean"), "x") == [True, False, None]


def test_objects_and_category(spark):
    out = dtypes.convert_type(numbered(spark, [1.0, None, 1e20, float("nan")]), "x", "Object")
    assert values(out, "x") == ["1.0", None, "1e+20", None]
    marked = dtypes.convert_type(numbered(spark, ["a"], "string"), "x", "Category")
    assert marked.schema["x"].metadata == {"logical": "category"}
    with pytest.raises(ValueError):
        dtypes.convert_type(marked, "x", "Complex")
    assert dtypes.convert_type(marked, "zz", "Float") is marked


def test_first_format_rules(spark):
    df = numbered(spark, ["2026-12-01", "12/08/2020", None, "2021-05-15"], "string")
    got = values(dtypes.convert_type(df, "x", "Datetime"), "x")
    assert got == [datetime(2026, 12, 1), None, None, datetime(2021, 5, 15)]
    both = dtypes.convert_type(df, "x", "Datetime", formats=["%Y-%m-%d", "%m/%d/%Y"])
    assert values(both, "x")[1] == datetime(2020, 12, 8)
    assert values(dtypes.convert_type(df, "x", "Datetime", "%m/%d/%Y"), "x")[1] == datetime(2020, 12, 8)
    junk = numbered(spark, ["soon", "2021-05-15", "Jan 5 2024", "20240101", "2024-01-02T03:04:05.5Z"], "string")
    days = [datetime(2021, 5, 15), datetime(2024, 1, 5), datetime(2024, 1, 1), datetime(2024, 1, 2, 3, 4, 5, 500_000)]
    assert values(dtypes.convert_type(junk, "x", "Datetime"), "x") == [None, *days]
    with pytest.raises(ValueError):
        dtypes.convert_type(numbered(spark, [1.0]), "x", "Datetime")
    assert values(dtypes.convert_type(numbered(spark, [None], "string"), "x", "Datetime"), "x") == [None]


@pytest.mark.parametrize(
    "date_format,text",
    [
        ("%Y-%m-%d %H:%M:%S", "2024-02-29 23:59:58"),
        ("%d %B %Y", "3 March 2021"),
        ("%b %d, %Y", "Jan 05, 1999"),
        ("%Y-%m-%dT%H:%M:%S", "2024-01-02T03:04:05"),
        ("%m/%d/%y", "7/4/21"),
        ("%d/%m/%Y %I:%M %p", "04/07/2021 11:30 PM"),
        ("week of %Y-%m-%d", "week of 2020-06-01"),
    ],
)
def test_date_formats_like_strptime(spark, date_format, text):
    df = numbered(spark, [text, "junk"], "string")
    got = values(dtypes.convert_type(df, "x", "Datetime", date_format), "x")
    assert got == [datetime.strptime(text, date_format), None]


def test_unknown_date_part():
    with pytest.raises(ValueError):
        spark_date_pattern("%Y %Q")
    assert guess_date_format("13/02/2020") == "%d/%m/%Y" and guess_date_format("02/03/2020") == "%m/%d/%Y"


def test_detect_types(spark):
    n = 40
    rows = [(i, i % 2, "Yes" if i % 2 else "No", f"2020-01-{i % 28 + 1:02d}", i / 2, i, f"t{i}", "ab"[i % 2], None, True) for i in range(n)]
    df = spark.createDataFrame(
        rows, "row_id bigint, bit int, word string, day string, f double, n bigint, free string, cat string, void string, flag boolean"
    ).withColumn("at", F.current_timestamp())
    got = {r[0]: r[1] for r in dtypes.detect_types(df).collect()}
    assert got == {
        "bit": "Boolean", "word": "Boolean", "day": "Datetime", "f": "Float", "n": "Integer", "free": "Text/Object",
        "cat": "Category", "void": "Category", "flag": "Boolean", "at": "Datetime",
    }


@pytest.mark.parametrize(
    "low,high,kind",
    [(0, 254, "smallint"), (0, 255, "int"), (0, 65_534, "int"), (0, 65_535, "bigint"), (0, 2**33, "bigint"),
     (-127, 126, "tinyint"), (-128, 0, "smallint"), (-1, 127, "smallint"), (-40_000, 0, "int"), (-(2**31), 0, "bigint")],
)
def test_narrow_integers(spark, low, high, kind):
    out, _ = dtypes.narrow_types(numbered(spark, [low, high, None], "bigint"))
    assert dict(out.dtypes)["x"] == kind
    assert values(out, "x") == [low, high, None]


def test_narrow_report_and_marks(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("double").alias("f"))
    out, report = dtypes.narrow_types(df)
    assert out.schema["s"].metadata == {"logical": "category"} and dict(out.dtypes)["f"] == "float"
    assert dict(dtypes.narrow_types(df, narrow_floats=False)[0].dtypes)["f"] == "double"
    assert report.first()["start_mb"] == round((4000 + 32000) / 2**20, 2)
    again = dtypes.narrow_types(out)[0]
    assert again.schema["s"].metadata == {"logical": "category"}


# ---- outliers


def spread(n=400, seed=1):
    import random

    rng = random.Random(seed)
    cells = [round(rng.gauss(50, 5), 2) for _ in range(n)]
    cells[10], cells[20], cells[30] = 500.0, -300.0, None
    return cells


def test_iqr_bounds_and_actions(spark):
    df = numbered(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    marked, meta = outliers.detect_outliers(df, "x", "IQR")
    assert values(marked, "is_outlier") == [False] * 4 + [True, False]
    assert meta == {"lower_bound": -1.0, "upper_bound": 7.0, "q1": 2.0, "q3": 4.0, "iqr": 2.0}
    assert values(outliers.handle_outliers(df, "x", "IQR", "Remove"), "x") == [1.0, 2.0, 3.0, 4.0, None]
    assert values(outliers.handle_outliers(df, "x", "IQR", "Replace"), "x") == [1.0, 2.0, 3.0, 4.0, 2.5, None]
    assert values(outliers.handle_outliers(df, "x", "IQR", "Cap"), "x") == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_nothing_flagged_changes_nothing(spark):
    df = numbered(spark, [1.0, 2.0, 3.0])
    for action in ("Remove", "Replace", "Cap"):
        assert outliers.handle_outliers(df, "x", "IQR", action) is df
    assert outliers.handle_outliers(df, "zz", "IQR", "Cap") is df


def test_no_spread_no_bounds(spark):
    df = numbered(spark, [5.0, 5.0, 5.0, 5.0, 9.0])
    marked, meta = outliers.detect_outliers(df, "x", "Modified Z Score")
    assert meta == {} and not any(values(marked, "is_outlier"))
    assert outliers.detect_outliers(numbered(spark, [1.0]), "x", "Z Score")[1] == {}
    text = numbered(spark, ["a"], "string")
    assert values(outliers.detect_outliers(text, "x", "IQR")[0], "is_outlier") == [False]


def test_z_scores_like_pandas(spark):
    cells = spread()
    s = pd.Series(cells, dtype=float)
    df = numbered(spark, cells)
    got = values(outliers.detect_outliers(df, "x", "Z Score")[0], "is_outlier")
    assert got == (((s - s.mean()) / s.std()).abs() > 3).tolist()
    mad = (s - s.median()).abs().median()
    got = values(outliers.detect_outliers(df, "x", "Modified Z Score")[0], "is_outlier")
    assert got == ((0.6745 * (s - s.median()) / mad).abs() > 3.5).tolist()


def brute_noise(cells, eps, least):
    s = pd.Series(cells, dtype=float)
    x = s.fillna(s.median())
    z = ((x - x.mean()) / (x.std(ddof=0) or 1.0)).tolist()
    core = [sum(abs(a - b) <= eps for b in z) >= least for a in z]
    return [not any(c and abs(a - b) <= eps for b, c in zip(z, core)) for a in z]


@pytest.mark.parametrize("eps,least", [(0.5, 5), (0.05, 4), (0.01, 3), (0.3, 1), (1e-9, 2)])
@pytest.mark.parametrize("block", [None, 8])
def test_noise_like_brute_force(spark, eps, least, block):
    cells = spread(300)
    s = pd.Series(cells, dtype=float)
    filled = numbered(spark, s.fillna(s.median()).tolist()).select(F.col("x").alias("value"))
    noise = {r["value"] for r in density.noise_values(filled, eps, least, block).collect()}
    got = [v in noise for v in s.fillna(s.median())]
    assert got == brute_noise(cells, eps, least)


def test_noise_counts_copies(spark):
    """Copies of a value are neighbours of each other."""
    cells = [1.0, 1.0, 1.0, 50.0, 100.0, 100.0]
    marked, _ = outliers.detect_outliers(numbered(spark, cells), "x", "DBSCAN", eps=0.01, min_samples=2)
    assert values(marked, "is_outlier") == [False, False, False, True, False, False]


def brute_factors(x, k):
    n = len(x)
    near = []
    for i in range(n):
        others = sorted((abs(x[j] - x[i]), x[j], j) for j in range(n) if j != i)[:k]
        near.append(others)
    far = [o[-1][0] for o in near]
    dense = [1 / (sum(max(far[j], d) for d, _, j in o) / k + 1e-10) for o in near]
    return [sum(dense[j] for _, _, j in o) / k / dense[i] for i, o in enumerate(near)]


@pytest.mark.parametrize("k", [1, 4, 20])
@pytest.mark.parametrize("block", [None, 10])
def test_local_outlier_factors_like_brute_force(spark, k, block):
    cells = [c for c in spread(160) if c is not None] + [50.0] * 30 + [51.0] * 3
    filled = spark.createDataFrame([(c,) for c in cells], "value double")
    got = {r["value"]: r["lof"] for r in density.local_outlier_factors(filled, k, block).collect()}
    for c, want in zip(cells, brute_factors(cells, k)):
        assert math.isclose(got[c], want, rel_tol=1e-9), (c, got[c], want)


def test_local_outlier_share(spark):
    cells = spread()
    marked, meta = outliers.detect_outliers(numbered(spark, cells), "x", "Local Outlier Factor")
    flags = values(marked, "is_outlier")
    assert meta == {"contamination": 0.05, "n_neighbors": 20}
    assert 0 < sum(flags) <= 0.05 * len(cells) + 1 and flags[10] and flags[20]


def test_thousands_of_flagged_spans(spark):
    from rinsework.operators.forest import span_test

    spans = [(float("-inf"), -5.0), *[(3.0 * k, 3.0 * k + 1) for k in range(2_000)], (9_000.0, float("inf"))]
    df = spark.range(-40, 20_000).select((F.col("id") / 2).alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    got = df.select("x", span_test(spans)(F.col("x")).alias("hit")).collect()
    for r in got:
        want = None if r.x is None else r.x <= -5 or r.x > 9_000 or (0 < r.x <= 5_998 and 0 < r.x % 3 <= 1)
        assert r.hit == want, r
    assert df.select(span_test([])(F.col("x")).alias("hit")).filter("hit").count() == 0


def test_isolation_forest(spark):
    cells = spread(2000)
    df = numbered(spark, cells)
    flags = values(outliers.detect_outliers(df, "x", "Isolation Forest")[0], "is_outlier")
    assert 0 < sum(flags) <= 0.05 * len(cells) + 1
    assert flags[10] and flags[20] and not flags[30]
    assert flags == values(outliers.detect_outliers(df.repartition(3), "x", "Isolation Forest")[0], "is_outlier")
    middle = [f for c, f in zip(cells, flags) if c is not None and 46 < c < 54]
    assert sum(middle) < 0.02 * len(middle)


def test_isolation_forest_on_flat_or_tiny_columns(spark):
    for cells in ([3.0] * 20, [1.0], [None, None], [None, 2.0]):
        assert not any(values(outliers.detect_outliers(numbered(spark, cells), "x", "Isolation Forest")[0], "is_outlier"))


@pytest.mark.parametrize("method", ["Isolation Forest", "Local Outlier Factor", "DBSCAN"])
def test_cap_by_quantiles(spark, method):
    cells = spread()
    s = pd.Series(cells, dtype=float)
    out = values(outliers.handle_outliers(numbered(spark, cells), "x", method, "Cap"), "x")
    want = s.clip(s.quantile(0.01), s.quantile(0.99))
    assert all((a is None and math.isnan(b)) or math.isclose(a, b) for a, b in zip(out, want))


def test_metrics_and_bad_names(spark):
    df = numbered(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    assert tuple(outliers.outlier_metrics(df, "x", "IQR").first()) == (1, 6, 100 / 6)
    with pytest.raises(ValueError):
        outliers.detect_outliers(df, "x", "Guess")
    with pytest.raises(ValueError):
        outliers.handle_outliers(df, "x", "IQR", "Hide")


def test_interval_test_is_row_local(spark):
    df = numbered(spark, spread())
    model = outliers.fit_outliers(df, "x", "IQR")
    text = plan(model.flag(df))
    assert "Exchange" not in text and "EvalPython" not in text
