"""Nothing is lost without a word: records, values, columns, late rows, counts."""

from datetime import datetime

import pytest
from helpers import numbered
from pyspark.sql import functions as F

from rinsework.operators import dtypes, encode, outliers, recipe, validate
from rinsework.operators.profile import profile_columns
from rinsework.operators.rows import random_sample
from rinsework.plans import lookup
from rinsework.plans.counts import exact_counts
from rinsework.plans.cut import cut
from rinsework.sources.read import CORRUPT, load, read_csv
from rinsework.sources.write import write


def _file(tmp_path, text):
    path = tmp_path / "data.csv"
    path.write_text(text)
    return str(path)


def test_ragged_records_fail_or_are_kept(spark, tmp_path):
    path = _file(tmp_path, "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, path).collect()
    rows = read_csv(spark, path, malformed="keep").collect()
    assert [r[CORRUPT] for r in rows] == [None, "3,4,5"]
    with pytest.raises(ValueError):
        read_csv(spark, path, malformed="drop")


def test_records_are_checked_whatever_is_selected(spark, tmp_path):
    path = _file(tmp_path, "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, path, schema="a bigint, b bigint").select("a").collect()


def test_values_that_miss_the_schema(spark, tmp_path):
    path = _file(tmp_path, "a,b\n1,x\noops,y\n,z\n")
    with pytest.raises(Exception, match="oops"):
        read_csv(spark, path, schema="a bigint, b string").collect()
    rows = read_csv(spark, path, schema="a bigint, b string", misfits="null").collect()
    assert [r["a"] for r in rows] == [1, None, None]


def test_line_breaks_survive_by_default(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, "plain")], "id bigint, s string")
    write(df, str(tmp_path / "out.csv"), "CSV")
    assert sorted(map(tuple, load(spark, str(tmp_path / "out.csv")).collect())) == sorted(map(tuple, df.collect()))


def test_all_values_decide_about_dates(spark):
    late = [f"2024-01-{i % 28 + 1:02d}" for i in range(300)] + ["free text"]
    got = {r["column_name"]: r["logical_type"] for r in dtypes.detect_types(numbered(spark, late, "string")).collect()}
    assert got["x"] != "Datetime"


def test_encoders_keep_and_tell_apart_columns(spark):
    df = spark.createDataFrame([(0, "nan", 1, 2), (1, None, 3, 4)], "row_id bigint, s string, __code_user int, s_0 int")
    wide = encode.one_hot(df, ["s"])
    assert wide.columns == ["row_id", "s_nan", "s_nan_", "__code_user", "s_0"]
    assert [tuple(r) for r in wide.orderBy("row_id").collect()] == [(0, 1, 0, 1, 2), (1, 0, 1, 3, 4)]
    coded = encode.binary(df, ["s"])
    assert coded.columns == ["row_id", "s_0_", "s_1", "__code_user", "s_0"]
    assert [tuple(r) for r in coded.orderBy("row_id").collect()] == [(0, 0, 1, 1, 2), (1, 1, 0, 3, 4)]
    labelled = encode.fit_label(df.withColumnRenamed("__code_user", "code"), "s").apply(df.withColumnRenamed("__code_user", "code"))
    assert labelled.columns == ["row_id", "s", "code", "s_0"]
    with pytest.raises(ValueError):
        encode.one_hot(df, ["s"], max_categories=1)


def test_outlier_marks_leave_other_columns(spark):
    df = numbered(spark, [1.0, 1.1, 1.2, 50.0] * 5).withColumn("__x", F.lit("mine")).withColumn("hit", F.lit(7))
    out = outliers.fit_outliers(df, "x", "DBSCAN", eps=0.5, min_samples=2).flag(df)
    assert {r["__x"] for r in out.collect()} == {"mine"} and {r["hit"] for r in out.collect()} == {7}


def test_audit_counts_equal_counts_per_step(spark):
    at = datetime(2024, 1, 1)
    df = numbered(spark, [3, 1, 1, None, 2, 2] * 4, "bigint").withColumn("y", F.col("x") * 2)
    steps = recipe.Recipe(at)
    for name, options in (
        ("remove_duplicates", {}), ("impute_missing", {"columns": ["x"], "strategy": "ffill"}),
        ("sort_rows", {"columns": ["x"]}), ("filter_rows", {"expression": "x > 1"}), ("random_sample", {"n": 2}),
        ("sort_rows", {"columns": ["y"], "ascending": False}), ("drop_columns", {"columns": ["y"]}),
    ):
        steps = steps.push(name, at, **options)
    logged = [r["n_rows"] for r in steps.audit(df).orderBy("step").collect()]
    counted = [df.count()]
    for step in steps.done:
        df = step.run(df)
        counted.append(df.count())
    assert logged == counted


def test_nested_and_binary_columns_are_counted(spark):
    df = spark.sql(
        "select id as row_id, array(id % 3) as a, map('k', id % 4) as m, map('k', id % 4) as m2, "
        "cast(cast(id % 5 as string) as binary) as b, named_struct('m', map('k', 1)) as s, "
        "parse_json(cast(id % 2 as string)) as v, parse_json(cast(id % 2 as string)) as v2 from range(40)"
    )
    assert exact_counts(df, ["a", "m", "b", "s", "v"]) == {"a": 3, "m": 4, "b": 5, "s": 1, "v": 2}
    issues = {(r["column_name"], r["issue_type"]) for r in validate.validate(df).collect()}
    assert {("m & m2", "Duplicate Columns"), ("v & v2", "Duplicate Columns"), ("s", "Constant Column")} <= issues
    distinct = {r["column_name"]: r["n_distinct"] for r in profile_columns(df.select("row_id", "a", "m", "b")).collect()}
    assert distinct == {"a": 3, "m": 4, "b": 5}


def test_reported_counts_are_exact_above_the_sketch_limit(spark):
    df = spark.range(1_100_000).select(F.col("id").alias("row_id"), (F.col("id") % 30_011).cast("string").alias("s"))
    said = [r["description"] for r in validate.validate(df).collect() if r["issue_type"] == "High Cardinality"]
    assert said == ["s has 30011 different texts"]


def test_lookup_checks_bytes(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(lookup, "HOT_BYTES", 20)
    rows = [(i, "hot" if i % 2 else f"{'long' * 20}{i % 10}") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, k string")
    model = cut(df.groupBy("k").count().select("k", F.col("count").alias("n"), F.length("k").alias("code")))
    got = lookup.attach(df, model, {"k": "k"}, ["code"], "n")
    assert got.count() == 100 and got.filter("code is null or code <> length(k)").count() == 0


def test_samples_without_row_id(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("x"))
    for n in (5, 300, 2000):
        assert random_sample(df, n=n, top_rows=10).count() == min(n, 1000)
