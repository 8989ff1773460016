"""Every operator on empty, all-missing, NaN and oddly named columns."""

import pytest

from rinsework.operators import charts, columns, dedup, dtypes, encode, features, impute, outliers, preview
from rinsework.operators import profile, quality, recipe, rows, scale, validate
from rinsework.operators.text import clean_text
from helpers import plan

NAN = float("nan")
X, S = "a b.x", "a b.s"
FRAMES = {
    "empty": [],
    "all missing": [(0, None, None), (1, None, None)],
    "nan": [(0, NAN, "u"), (1, None, None), (2, -0.0, "v"), (3, 0.0, "v"), (4, 3.0, " ")],
}
OPERATORS = {
    "head": lambda df: preview.head(df),
    "tail": lambda df: preview.tail(df),
    "random": lambda df: preview.random_rows(df, 2),
    "schema": preview.schema_table,
    "figures": preview.key_figures,
    "frequent": lambda df: preview.frequent_values(df, [X, S]),
    "rename": lambda df: columns.rename_columns(df, {X: "y"}),
    "drop": lambda df: columns.drop_columns(df, [X]),
    "merge": lambda df: columns.merge_columns(df, [X, S], "m"),
    "split": lambda df: columns.split_column(df, S, "-", ["p", "q"]),
    "reorder": lambda df: columns.reorder_columns(df, [S]),
    "constant": columns.drop_constant_columns,
    "empty": rows.drop_empty_rows_columns,
    "delete": lambda df: rows.delete_rows(df, [0]),
    "sort": lambda df: rows.sort_rows(df, [X, S], [True, False]),
    "filter": lambda df: rows.filter_rows(df, f"`{X}` > 0"),
    "missing": lambda df: rows.drop_missing_rows(df, [X]),
    "dedup": lambda df: dedup.remove_duplicates(df, [X], "last"),
    "duplicates": dedup.duplicate_count,
    **{f"impute {s}": lambda df, s=s: impute.impute_missing(df, [X, S], s) for s in ("mean", "median", "mode", "ffill", "bfill")},
    "impute constant": lambda df: impute.impute_missing(df, [X, S], "constant", "1"),
    **{f"text {o}": lambda df, o=o: clean_text(df, [S, X], o) for o in ("trim", "title", "remove_extra_spaces")},
    "detect": dtypes.detect_types,
    **{f"to {t}": lambda df, t=t: dtypes.convert_type(df, X, t) for t in ("Integer", "Float", "Boolean", "Category", "Object")},
    "narrow": lambda df: dtypes.narrow_types(df)[0],
    **{
        f"{m} {a}": lambda df, m=m, a=a: outliers.handle_outliers(df, X, m, a)
        for m in ("IQR", "Z Score", "Modified Z Score", "Local Outlier Factor", "DBSCAN", "Isolation Forest")
        for a in ("Remove", "Cap")
    },
    "math": lambda df: features.math_column(df, X, "divide", X, "d"),
    "condition": lambda df: features.conditional_column(df, "c", X, ">", 1, "y", "n"),
    "log": lambda df: features.log_transform(df, X, "l"),
    "bins": lambda df: features.bin_column(df, X, 3, None, "b"),
    "quantile bins": lambda df: features.bin_column(df, X, 3, None, "b", "quantile"),
    **{f"scale {s}": lambda df, s=s: scale.scale_features(df, [X], s) for s in scale.SCALERS},
    **{f"encode {m}": lambda df, m=m: encode.encode_categorical(df, [S], m, X) for m in encode.METHODS},
    "profile": profile.profile_columns,
    "summary": profile.summarise,
    "score": quality.quality_score,
    "suggest": quality.suggest_improvements,
    "validate": validate.validate,
    "group": lambda df: charts.group_aggregate(df, S, X, "median"),
    "paths": lambda df: charts.path_totals(df, [S], X),
    "shares": lambda df: charts.shares(df, S, X),
    "correlations": lambda df: charts.correlations(df.withColumn("y", df[f"`{X}`"] * 2)),
    "histogram": lambda df: charts.histogram(df, X),
    "box": lambda df: charts.box_summary(df, X, S),
    "scatter": lambda df: charts.scatter_points(df, X, X, S, X),
    "normal": lambda df: charts.normal_plot(df, X),
    "smart": recipe.smart_clean,
}


@pytest.mark.parametrize("frame", FRAMES)
def test_edge_shapes(spark, frame):
    df = spark.createDataFrame(FRAMES[frame], f"row_id bigint, `{X}` double, `{S}` string")
    failed = {}
    for name, operator in OPERATORS.items():
        try:
            operator(df).collect()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]
    assert not failed


def test_filters_reach_the_scan(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").withColumnRenamed("o_orderkey", "row_id")
    text = plan(rows.filter_rows(orders, "o_totalprice > 1000 & o_orderstatus == 'F'").select("row_id"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text
    text = plan(rows.drop_missing_rows(orders, ["o_totalprice"]).select("row_id"))
    assert "IsNotNull(o_totalprice)" in text
    text = plan(charts.count_values(orders, "o_orderpriority"))
    assert "ReadSchema: struct<o_orderpriority:string>" in text


@pytest.mark.parametrize("operation", ["trim", "remove_extra_spaces", "remove_punct", "title", "find_replace"])
def test_row_local_text_is_one_stage(spark, data, operation):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    text = plan(clean_text(documents, ["text"], operation, "a", "b"))
    assert "Exchange" not in text and "EvalPython" not in text and "codegen id" in text
