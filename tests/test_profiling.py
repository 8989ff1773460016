import math
import os
import statistics
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinsework.operators import charts, profile, quality, recipe, report, validate
from rinsework.plans.tablestats import TableStats
from helpers import numbered, plan, values

CELLS = [1.0, 2.0, 3.0, 10.0, None, 2.0]


def test_profile_like_pandas(spark):
    s = pd.Series(CELLS, dtype=float)
    p = profile.profile_columns(numbered(spark, CELLS)).first()
    assert (p["n_rows"], p["non_null"], p["missing"], p["n_distinct"]) == (6, 5, 1, 4)
    assert p["missing_pct"] == 16.67 and p["mode"] == "2.0" and p["median"] == 2.0
    for name, want in {
        "mean": s.mean(), "var": s.var(), "std": s.std(), "skew": s.skew(), "kurtosis": s.kurt(), "min": 1.0, "max": 10.0,
    }.items():
        assert p[name] == round(want, 4)


def test_tiny_numeric_facts(spark):
    p = profile.profile_columns(numbered(spark, [1.0, 2.0, 3.0, 10.0, None])).first()
    assert (p["median"], p["skew"], p["kurtosis"], p["mode"]) == (2.5, 1.7636, 3.228, "1.0")


def test_profile_edges(spark):
    flat = profile.profile_columns(numbered(spark, [4.0] * 5)).first()
    assert (flat["skew"], flat["kurtosis"], flat["std"]) == (0.0, 0.0, 0.0)
    two = profile.profile_columns(numbered(spark, [1.0, 2.0])).first()
    assert two["skew"] is None and two["kurtosis"] is None
    one = profile.profile_columns(numbered(spark, [1.0])).first()
    assert one["std"] is None and one["mean"] == 1.0
    none = profile.profile_columns(numbered(spark, [None, float("nan")])).first()
    assert none["missing"] == 2 and none["mean"] is None and none["mode"] is None
    empty = profile.profile_columns(spark.createDataFrame([], "row_id bigint, x double, s string")).collect()
    assert [r["n_rows"] for r in empty] == [0, 0] and empty[0]["missing_pct"] == 0.0


def test_summary_counts_kinds(spark):
    df = spark.createDataFrame(
        [(0, 1, True, "a", datetime(2020, 1, 1), [1]), (1, None, None, "a", None, None)],
        "row_id bigint, n int, b boolean, s string, t timestamp, arr array<int>",
    )
    s = profile.summarise(df).first()
    assert (s["n_numeric"], s["n_boolean"], s["n_datetime"], s["n_object"]) == (1, 1, 1, 2)
    assert (s["n_rows"], s["n_cols"], s["missing_cells"], s["duplicates"]) == (2, 5, 4, 0)


def test_score_of_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, x double")
    assert tuple(quality.quality_score(df).first()) == (0.0,) * 6
    assert quality.suggest_improvements(df).count() == 0 and validate.validate(df).count() == 0


def test_score_of_clean_table(spark):
    df = spark.createDataFrame([(i, float(i) + 1e6) for i in range(50)], "row_id bigint, x double")
    assert tuple(quality.quality_score(df).first()) == (100.0,) * 6


def test_variant_kinds_are_mixed(spark):
    df = spark.sql("select id as row_id, parse_json(case when id % 2 = 0 then '1' else '\"a\"' end) as v from range(6)")
    s = TableStats(df)
    assert s.is_mixed("v") and quality.score_parts(s)["consistency"] == 0.0


@pytest.fixture
def flawed(spark):
    rows = [(i, f" n{i % 60}" if i % 4 else "   ", float(-1 if i == 3 else i), i, i, "k", None, datetime(2030 if i < 2 else 2020, 1, 1)) for i in range(300)]
    return spark.createDataFrame(
        rows, "row_id bigint, name string, x double, a bigint, b bigint, k string, void string, at timestamp_ntz"
    )


def test_validation(flawed):
    got = {(r["issue_type"], r["column_name"]): (r["affected_rows"], r["severity"]) for r in validate.validate(flawed, datetime(2025, 1, 1)).collect()}
    assert got == {
        ("Duplicate Columns", "a & b"): (300, "warning"),
        ("Constant Column", "k"): (300, "info"),
        ("Constant Column", "void"): (300, "info"),
        ("Negative Values", "x"): (1, "warning"),
        ("Blank Strings", "name"): (75, "info"),
        ("Untrimmed Spaces", "name"): (300, "warning"),
        ("Future Dates", "at"): (2, "danger"),
    }


def test_duplicate_columns_look_at_order_and_type(spark):
    df = spark.createDataFrame(
        [(0, 1, 2, 1, 1.0, None), (1, 2, 1, 2, 2.0, 5), (2, None, None, None, None, None)],
        "row_id bigint, a int, shuffled int, same int, real double, other int",
    )
    assert validate.duplicate_columns(TableStats(df)) == [("a", "same")]
    assert validate.duplicate_columns(TableStats(df.drop("row_id"))) == [("a", "same")]


def test_lexical_mixture(spark):
    df = numbered(spark, ["1", "x", "2020-01-02", None], "string")
    assert validate.validate(df).filter("issue_type = 'Mixed Data Types'").count() == 0
    assert validate.validate(df, mixed="lexical").filter("issue_type = 'Mixed Data Types'").count() == 1


def test_suggestions(flawed):
    got = {(r["category"], r["column_name"]): r for r in quality.suggest_improvements(flawed).collect()}
    assert got[("Column Check", "void")]["severity"] == "danger"
    assert got[("Column Check", "k")]["detail"] == "k"
    assert got[("Missing Values", "void")]["pct"] == 100.0
    assert got[("Optimization", "name")]["affected"] == 46


def test_stats_are_gathered_once(flawed):
    s = TableStats(flawed)
    quality.quality_score(s)
    before = s.basics, s.tops
    profile.summarise(s)
    quality.suggest_improvements(s)
    assert s.basics is before[0] and s.tops is before[1]


def test_report_tables(flawed, tmp_path, spark):
    report.write_report(flawed, str(tmp_path / "r"), datetime(2025, 1, 1))
    sizes = {n: spark.read.parquet(f"{tmp_path}/r/{n}").count() for n in ("summary", "score", "suggestions", "validation", "columns")}
    assert sizes == {"summary": 1, "score": 1, "suggestions": 5, "validation": 7, "columns": 7}


# ---- chart tables


def test_group_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0), ("b", None)], "k string, x double")

    def got(func):
        return {r["key"]: r["value"] for r in charts.group_aggregate(df, "k", "x", func).collect()}

    assert got("mean") == {"a": 2.0, "b": None} and got("median") == {"a": 2.0, "b": None}
    assert got("count") == {"a": 2, "b": 1} and got("sum") == {"a": 4.0, "b": 0.0}
    with pytest.raises(ValueError):
        got("mad")


def test_value_counts_order(spark):
    df = numbered(spark, ["b", "a", "b", None, "c", "a"], "string")
    assert [tuple(r) for r in charts.count_values(df, "x").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_path_totals(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 4.0)], "a string, b string, v double")
    got = {tuple(r) for r in charts.path_totals(df, ["a", "b", "zz"], "v").collect()}
    assert got == {(1, "x", None, 3.0), (1, "y", None, 4.0), (2, "x", "p", 1.0), (2, "x", "q", 2.0), (2, "y", "p", 4.0)}
    with pytest.raises(ValueError):
        charts.path_totals(df, ["zz"])


def test_correlations_like_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf.loc[::7, "b"] = np.nan
    pdf["flat"] = 1.0
    df = spark.createDataFrame(pdf)
    got = {(r["x"], r["y"]): r["corr"] for r in charts.correlations(df).collect()}
    want = pdf.corr().round(3)
    assert len(got) == 16
    for (x, y), r in got.items():
        assert (r is None and math.isnan(want.loc[x, y])) or math.isclose(r, want.loc[x, y], abs_tol=1e-12)
    assert charts.correlations(df, ["a"]).count() == 0


def test_correlations_in_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(charts, "PAIRS_PER_JOB", 2)
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 7.0), (3.0, 3.0, 1.0)], "a double, b double, c double")
    assert charts.correlations(df).count() == 9


def test_histogram(spark):
    got = [tuple(r) for r in charts.histogram(numbered(spark, [0.0, 1.0, 9.9, 10.0, None]), "x", 10).orderBy("bin").collect()]
    assert got == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (9, 9.0, 10.0, 2)]
    flat = charts.histogram(numbered(spark, [5.0, 5.0]), "x").collect()
    assert [tuple(r) for r in flat] == [(0, 5.0, 5.0, 2)]
    assert charts.histogram(numbered(spark, [None]), "x").count() == 0


def test_box(spark):
    cells = [1.0, 2.0, 3.0, 4.0, 100.0]
    r = charts.box_summary(numbered(spark, cells), "x").first()
    assert (r["q1"], r["q2"], r["q3"], r["low_whisker"], r["high_whisker"], r["n_outliers"]) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert values(charts.box_outliers(numbered(spark, cells), "x"), "value") == [100.0]


def test_scatter_sizes(spark):
    df = numbered(spark, [-3.0, 0.0, None, 5.0])
    assert values(charts.scatter_points(df, "x", "x", size="x"), "size") == [1.0, 4.0, None, 9.0]
    plain = numbered(spark, [2.0, 5.0])
    assert values(charts.scatter_points(plain, "x", "x", size="x"), "size") == [2.0, 5.0]
    assert charts.scatter_points(df, "x", "x", max_points=2).count() == 2
    assert [r["y"] for r in charts.line_points(df, "row_id", "x").collect()] == [-3.0, 0.0, None, 5.0]


def test_probit_like_the_standard_library(spark):
    from rinsework.functions.normal import probit

    p = [1e-300, 1e-20, 1e-12, 1e-5, 0.01, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-12]
    got = values(numbered(spark, p).withColumn("z", probit(F.col("x"))), "z")
    assert np.allclose(got, [statistics.NormalDist().inv_cdf(q) for q in p], rtol=1e-13, atol=1e-15)


def test_normal_plot(spark):
    cells = [3.0, 1.0, 2.0, 2.0, None, 8.0]
    rows = charts.normal_plot(numbered(spark, cells), "x").orderBy("rank").collect()
    assert [r["value"] for r in rows] == [1.0, 2.0, 2.0, 3.0, 8.0]
    n, inverse = 5, statistics.NormalDist().inv_cdf
    top = 0.5 ** (1 / n)
    p = [1 - top, *[(i - 0.3175) / (n + 0.365) for i in (2, 3, 4)], top]
    want = [inverse(q) for q in p]
    assert np.allclose([r["theoretical"] for r in rows], want)
    line = charts.normal_line(numbered(spark, cells), "x").first()
    slope, intercept = np.polyfit(want, [1, 2, 2, 3, 8], 1)
    assert math.isclose(line["slope"], slope) and math.isclose(line["intercept"], intercept)
    assert math.isclose(line["r"], np.corrcoef(want, [1, 2, 2, 3, 8])[0, 1])
    assert charts.normal_plot(numbered(spark, [1.0, 2.0]), "x").count() == 0


# ---- recipes


def test_kept_prefixes_run_no_step_twice(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), f" w{i % 3} ") for i in range(40)], "row_id bigint, x double, s string")
    ran = []

    def rows_of(out):
        return sorted((r["row_id"], round(r["x"], 9), r["s"]) for r in out.collect())

    for name in ("impute_missing", "scale_features", "encode_categorical", "clean_text", "filter_rows"):
        step = recipe.STEPS[name]
        monkeypatch.setitem(recipe.STEPS, name, lambda df, step=step, name=name, **kw: ran.append(name) or step(df, **kw))
    r = (
        recipe.Recipe()
        .push("clean_text", columns=["s"], operation="trim")
        .push("impute_missing", columns=["x"], strategy="median")
        .push("scale_features", columns=["x"], scaler="StandardScaler")
        .push("encode_categorical", columns=["s"], method="Label Encoding")
        .push("filter_rows", expression="row_id < 30")
    )
    want = [rows_of(x.apply(df)) for x in (r, r.undo(), r.undo().undo())]
    ran.clear()
    with recipe.Prefixes(df) as prefixes:
        assert rows_of(r.apply(df, prefixes)) == want[0]
        assert ran == [s.operator for s in r.done]
        ran.clear()
        assert rows_of(r.apply(df, prefixes)) == want[0]
        assert rows_of(r.undo().undo().apply(df, prefixes)) == want[2]
        assert rows_of(r.undo().undo().redo().redo().apply(df, prefixes)) == want[0]
        assert ran == []  # a table lies before each fitted step and after the last
        assert rows_of(r.undo().apply(df, prefixes)) == want[1] and ran == ["encode_categorical"]
        ran.clear()
        later = recipe.Recipe().push("clean_text", columns=["s"], operation="trim").push("filter_rows", expression="row_id < 5")
        assert later.apply(df, prefixes).count() == 5 and ran == ["filter_rows"]
        # what lies on a kept table reads that table, not the input
        assert "Scan parquet" in plan(r.undo().undo().apply(df, prefixes))
        paths = [path for _, path in prefixes.tables.values()]
        assert all(os.path.exists(p.removeprefix("file:")) for p in paths)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    few = recipe.Prefixes(df, most=1)
    r.apply(df, few).count()
    assert len(few.tables) == 1
    few.close()


def test_recipe_prefixes_and_undo(spark):
    df = spark.createDataFrame([(0, " a ", 1.0), (1, "b", None), (2, " a ", 1.0)], "row_id bigint, s string, x double")
    r = recipe.Recipe()
    steps = [
        ("clean_text", {"columns": ["s"], "operation": "trim"}),
        ("impute_missing", {"columns": ["x"], "strategy": "mean"}),
        ("remove_duplicates", {}),
    ]
    direct, states = df, [df]
    for name, params in steps:
        r = r.push(name, **params)
        direct = recipe.STEPS[name](direct, **params)
        states.append(direct)
    for state in reversed(states):
        assert sorted(map(tuple, r.apply(df).collect())) == sorted(map(tuple, state.collect()))
        r = r.undo()
    assert r.done == () and r.undo() is r and len(r.undone) == 3
    r = r.redo().redo()
    assert [s.operator for s in r.done] == ["clean_text", "impute_missing"]
    assert r.push("sort_rows", columns=["x"]).undone == ()
    assert r.reset().done == () and r.reset().undone == ()
    status = [row["status"] for row in r.timeline(spark).orderBy("index").collect()]
    assert status == ["past", "past", "active", "undone"]
    with pytest.raises(ValueError):
        r.push("explode_everything")


def test_audit_writes_once_and_counts_every_step(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("x"))
    r = (
        recipe.Recipe()
        .push("filter_rows", expression="x >= 40")
        .push("encode_categorical", columns=["g"], method="Frequency Encoding")
        .push("remove_duplicates", subset=["g"])
        .push("drop_columns", columns=["x"])
    )
    log = r.audit(df, lambda out: out.write.parquet(str(tmp_path / "out"))).orderBy("step").collect()
    assert [(x["action"], x["n_rows"], x["n_cols"]) for x in log] == [
        ("Dataset Loaded", 100, 2), ("filter_rows", 60, 2), ("encode_categorical", 60, 2), ("remove_duplicates", 1, 2), ("drop_columns", 1, 1),
    ]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_smart_clean(spark):
    rows = [
        (i, f"  U  {i % 50} ", None if i % 4 == 0 else float(i % 50), None if i % 3 == 0 else ["HR", "   ", "Sales"][i % 3], "Active", None)
        for i in range(50)
    ]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:5])]
    df = spark.createDataFrame(rows, "row_id bigint, name string, age double, dept string, constant string, empty string")
    out = recipe.smart_clean(df)
    got = out.collect()
    assert len(got) == 50 and out.columns == ["row_id", "name", "age", "dept"]
    assert dict(out.dtypes)["age"] == "float" and out.schema["dept"].metadata == {"logical": "category"}
    assert all(v is not None for r in got for v in r)
    assert {r["name"] for r in got} == {f"U {i}" for i in range(50)} and {r["dept"] for r in got} == {"", "Sales"}


def test_smart_clean_shuffles_the_table_once(spark):
    from workload.base import messy

    text = plan(recipe.smart_clean(messy(spark, "/root/testdata/sf0.001")))
    assert text.count("Exchange (") <= 4 and "SinglePartition" not in text
