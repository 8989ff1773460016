import pandas as pd
import pytest

from rinsework.operators import columns, dedup, preview, rows
from helpers import numbered, plan, values


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(0, "a", 1.0, None), (1, "b", None, 2), (2, "a", 1.0, None), (3, None, 3.0, 4), (4, "b", None, 2)],
        "row_id bigint, name string, x double, n bigint",
    )


def test_rename_drop_copy_reorder(people):
    assert columns.rename_columns(people, {"x": "y", "zz": "q"}).columns == ["row_id", "name", "y", "n"]
    assert columns.drop_columns(people, ["x", "zz"]).columns == ["row_id", "name", "n"]
    assert columns.duplicate_column(people, "zz", "c").columns == people.columns
    assert columns.reorder_columns(people, ["n", "zz", "x"]).columns == ["n", "x", "row_id", "name"]


def test_merge_writes_python_text(spark):
    df = spark.createDataFrame(
        [(1.0, 2, True, "a"), (999999.0, 10000000, False, None), (1e16, 1, None, "z"), (1.5e-5, 0, True, "")],
        "f double, i bigint, b boolean, s string",
    )
    got = [r["m"] for r in columns.merge_columns(df, ["f", "i", "b", "s", "zz"], "m", "|").collect()]
    assert got == ["1.0|2|True|a", "999999.0|10000000|False|nan", "1e+16|1|nan|z", "1.5e-05|0|True|"]
    skipped = columns.merge_columns(df, ["i", "s"], "m", "|", skip_nulls=True).collect()
    assert skipped[1]["m"] == "10000000"


def test_float_text_matches_python(spark):
    cells = [0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 1e16, 1e22, 1e100, 1e-4, 1.2e-5, 3.14e-110, 0.1, 1 / 3, -1e-7]
    df = columns.merge_columns(numbered(spark, cells), ["x"], "m")
    assert values(df, "m") == [str(c) for c in cells]


def test_split_separators(spark):
    df = spark.createDataFrame([("a.b.c",), ("a",), (None,), ("",)], "s string")
    got = [tuple(r)[1:] for r in columns.split_column(df, "s", ".", ["p", "q"]).collect()]
    assert got == [("a", "b"), ("a", None), (None, None), ("", None)]
    regex = columns.split_column(df, "s", "[.]b", ["p", "q"]).collect()[0]
    assert (regex["p"], regex["q"]) == ("a", ".c")
    literal = columns.split_column(df, "s", ".b", ["p", "q"], regex=False).collect()[0]
    assert (literal["p"], literal["q"]) == ("a", ".c")


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame(
        [(0, "k", None, 1, "k", [1]), (1, "k", None, 2, None, [1]), (2, "k", None, 1, "k", [2])],
        "row_id bigint, c string, e string, v int, half string, arr array<int>",
    )
    assert columns.constant_columns(df) == ["c", "e", "half"]
    assert columns.drop_constant_columns(df).columns == ["row_id", "v", "arr"]
    assert columns.drop_empty_columns(df).columns == ["row_id", "c", "v", "half", "arr"]


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 4.0)], "row_id bigint, `a b.c` double")
    from rinsework.operators import impute, outliers, profile, scale

    assert values(impute.impute_missing(df, ["a b.c"], "median"), "a b.c") == [1.0, 2.5, 4.0]
    assert values(impute.impute_missing(df, ["a b.c"], "ffill"), "a b.c") == [1.0, 1.0, 4.0]
    assert scale.scale_features(df, ["a b.c"], "MinMaxScaler").count() == 3
    assert profile.profile_columns(df).first()["column_name"] == "a b.c"
    assert outliers.handle_outliers(df, "a b.c", "IQR", "Remove").count() == 3


def test_delete_rows(people, spark):
    assert values(rows.delete_rows(people, [1, "3", "x", 99]), "row_id") == [0, 2, 4]
    assert rows.delete_rows(people, []).count() == 5
    table = spark.createDataFrame([(0,), (4,), (4,)], "label int")
    assert values(rows.delete_rows(people, table), "row_id") == [1, 2, 3]


def test_sort_puts_nulls_last_both_ways(people):
    up = [r["row_id"] for r in rows.sort_rows(people, ["x"]).collect()]
    down = [r["row_id"] for r in rows.sort_rows(people, ["x"], False).collect()]
    assert up == [0, 2, 3, 1, 4] and down == [3, 0, 2, 1, 4]
    mixed = [r["row_id"] for r in rows.sort_rows(people, ["name", "n"], [False, True]).collect()]
    assert mixed == [1, 4, 0, 2, 3]


def test_filter_expressions(people):
    def ids(text):
        return values(rows.filter_rows(people, text), "row_id")

    assert ids("x > 0 & name == 'a'") == [0, 2]
    assert ids("x.isnull() | n == 4") == [1, 3, 4]
    assert ids("~(name == 'a')") == [1, 4]
    assert ids("name in ('b', 'a|b')") == [1, 4]
    assert ids("name == 'a&b'") == []
    for bad in ("x >", "nope > 1"):
        with pytest.raises(ValueError):
            rows.filter_rows(people, bad)


def test_samples(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    for n in (0, 10, 2500):
        for limit in (10_000, 5):
            got = values(rows.random_sample(df, n=n, seed=3, top_rows=limit), "row_id")
            assert len(got) == len(set(got)) == n
    small, large = (values(rows.random_sample(df, n=500, seed=3, top_rows=t), "row_id") for t in (10_000, 5))
    assert small == large, "both ways draw the same rows"
    assert small == values(rows.random_sample(df.repartition(7), n=500, seed=3), "row_id")
    assert small != values(rows.random_sample(df, n=500, seed=4), "row_id")
    assert rows.random_sample(df, n=9999).count() == 3000
    assert rows.random_sample(df, frac=0.25).count() == 750
    assert rows.random_sample(df).count() == 3000
    with pytest.raises(ValueError):
        rows.random_sample(df, frac=1.5)


def test_missing_rows(people):
    assert values(rows.drop_missing_rows(people, ["x", "zz"]), "row_id") == [0, 2, 3]
    assert rows.drop_missing_rows(people, []).count() == 5


def test_empty_rows_then_columns(spark):
    df = spark.createDataFrame([(0, None, None), (1, "a", None)], "row_id bigint, a string, b string")
    out = rows.drop_empty_rows_columns(df)
    assert out.columns == ["row_id", "a"] and values(out, "row_id") == [1]
    nan = numbered(spark, [float("nan"), 1.0])
    assert values(rows.drop_empty_rows(nan), "row_id") == [1]


@pytest.mark.parametrize("keep", ["first", "last", "none", False])
@pytest.mark.parametrize("subset", [None, ["name"], ["x", "n"]])
def test_duplicates_like_pandas(people, keep, subset):
    pdf = people.toPandas().set_index("row_id")
    want = pdf.drop_duplicates(subset=subset, keep=False if keep in ("none", False) else keep)
    got = dedup.remove_duplicates(people, subset, keep)
    assert got.columns == people.columns
    assert values(got, "row_id") == sorted(want.index)
    assert dedup.duplicate_count(people, subset).first()[0] == int(pdf.duplicated(subset=subset).sum())


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (2, None)], "row_id bigint, x int")
    assert values(dedup.remove_duplicates(df), "row_id") == [0, 1]
    assert dedup.duplicate_count(df).first()[0] == 1


def test_dedup_is_idempotent_and_combines_before_the_shuffle(people):
    once = dedup.remove_duplicates(people)
    assert values(dedup.remove_duplicates(once), "row_id") == values(once, "row_id")
    text = plan(dedup.remove_duplicates(people, ["name"], "first"))
    assert "Window" not in text and text.count("Exchange") <= 4


def test_maps_can_be_compared(spark):
    df = spark.sql("select * from values (0, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)) as t(row_id, m)")
    assert dedup.duplicate_count(df).first()[0] == 1
    assert dedup.remove_duplicates(df).count() == 1


def test_previews(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id").repartition(5)
    assert [r[0] for r in preview.head(df, 3).collect()] == [0, 1, 2]
    assert [r[0] for r in preview.tail(df, 3).collect()] == [47, 48, 49]
    assert preview.random_rows(df, 80).count() == 50


def test_schema_and_figures(people):
    got = {r["column_name"]: (r["data_type"], r["non_null"], r["nulls"]) for r in preview.schema_table(people).collect()}
    assert got == {"name": ("string", 4, 1), "x": ("double", 3, 2), "n": ("bigint", 3, 2)}
    f = preview.key_figures(people).first()
    assert (f["n_rows"], f["n_columns"], f["missing_cells"]) == (5, 3, 5)
    assert f["estimated_bytes"] == 4 + 5 * 8 * 2 and abs(f["missing_pct"] - 100 / 3) < 1e-9


def test_frequent_values(people):
    got = [tuple(r) for r in preview.frequent_values(people, "name").orderBy("rank").collect()]
    assert got == [("name", 1, "a", 2, 50.0), ("name", 2, "b", 2, 50.0)]
    numbers = preview.frequent_values(people, ["x"]).orderBy("rank").collect()
    assert [r["value"] for r in numbers] == ["1.0", "3.0"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, a string, x double")
    assert preview.key_figures(df).first()["missing_pct"] == 0.0
    assert columns.constant_columns(df) == ["a", "x"]
    assert dedup.remove_duplicates(df).count() == 0
    assert dedup.duplicate_count(df).first()[0] == 0
    assert isinstance(preview.frequent_values(df, ["a", "x"]).toPandas(), pd.DataFrame)
