"""Row-local steps and fitted models accept streams, whole-table operators refuse them."""

import pytest
from pyspark.sql import functions as F

from rinsework.operators import charts, columns, dedup, dtypes, encode, features, impute, outliers, profile, rows, scale
from rinsework.operators.text import clean_text
from rinsework.streaming.run import chain, write_stream


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.range(60).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("  v"), (F.col("id") % 7).cast("string"), F.lit(" ")).alias("s"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("x"),
        F.lit("2024-01-05").alias("d"),
    )
    df.write.parquet(path)
    batch = spark.read.parquet(path)
    return batch, spark.readStream.schema(batch.schema).parquet(path)


def test_stream_equals_batch(spark, source, tmp_path):
    batch, stream = source
    fill = impute.fit_fill(batch, ["x"], "median")
    scaler = scale.fit_scaler(batch, ["x"], "StandardScaler")
    bins = features.fit_bins(batch, "x", 4, None, "bin")
    codes = encode.fit_ordinal(batch, "s")
    fences = outliers.fit_outliers(batch, "x", "IQR")
    steps = [
        lambda df: clean_text(df, ["d"], "upper"),
        lambda df: columns.split_column(df, "d", "-", ["y", "m"]),
        lambda df: dtypes.convert_type(df, "y", "Integer"),
        lambda df: features.math_column(df, "x", "multiply", 2, "twice"),
        lambda df: features.conditional_column(df, "big", "x", ">", 30, 1, 0),
        lambda df: rows.filter_rows(df, "row_id != 3"),
        fences.flag,
        bins.apply,
        fill.apply,
        scaler.apply,
        codes.apply,
        lambda df: encode.encode_categorical(df, ["d"], "Hash Encoding", n_components=3),
    ]
    out = str(tmp_path / "out")
    query = write_stream(chain(stream, *steps), out, "cleaned", str(tmp_path / "ck"))
    query.awaitTermination(120)
    want = sorted(map(tuple, chain(batch, *steps).collect()))
    got = spark.read.parquet(out).select(*chain(batch, *steps).columns)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 59


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: impute.impute_missing(df, ["x"], "ffill"),
        lambda df: impute.impute_missing(df, ["x"], "mean"),
        lambda df: dedup.remove_duplicates(df),
        lambda df: rows.random_sample(df, n=3),
        lambda df: outliers.detect_outliers(df, "x", "DBSCAN"),
        lambda df: scale.scale_features(df, ["x"], "MinMaxScaler"),
        lambda df: encode.encode_categorical(df, ["s"], "Label Encoding"),
        lambda df: profile.profile_columns(df),
        lambda df: charts.histogram(df, "x"),
        lambda df: dtypes.convert_type(df, "d", "Datetime"),
        lambda df: columns.drop_constant_columns(df),
    ],
)
def test_whole_table_operators_refuse_streams(source, operator):
    with pytest.raises(ValueError, match="needs the whole table"):
        operator(source[1])
