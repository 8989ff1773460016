"""Encoders that learn all columns at once, are kept in a folder, and make sparse vectors."""

import pytest
from helpers import numbered, plan
from pyspark.sql import functions as F

from rinsework.operators import encode
from rinsework.streaming.run import write_stream

LEARNING = [m for m in encode.METHODS if m != "Hash Encoding"]


def wide(spark, n=400, columns=10):
    df = spark.range(n).withColumnRenamed("id", "row_id").repartition(4)
    for k in range(columns):
        df = df.withColumn(f"c{k}", F.when(F.col("row_id") % 11 == k, None).otherwise(F.concat(F.lit("v"), (F.col("row_id") * 7 % (k + 3)).cast("string"))))
    return df.withColumn("y", F.col("row_id") * 1.5)


@pytest.mark.parametrize("method", LEARNING)
def test_ten_columns_are_learned_in_one_shuffle(spark, monkeypatch, method):
    shown = []
    keep = encode.cut
    monkeypatch.setattr(encode, "cut", lambda df: shown.append(plan(df)) or keep(df))
    encode.fit_encoder(wide(spark), [f"c{k}" for k in range(10)], method, "y")
    assert shown[0].count("Exchange hashpartitioning") == shown[0].split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 or (
        shown[0].split("\n\n")[0].count("Exchange") <= 2  # the one of the input and the one of the catalog
    )


@pytest.mark.parametrize("method", LEARNING)
@pytest.mark.parametrize("small", [100_000, 3])
def test_columns_together_are_columns_one_by_one(spark, method, small):
    df = wide(spark, 120, 4)
    names = [f"c{k}" for k in range(4)]
    together = encode.fit_encoder(df, names, method, "y", small=small)
    for i, c in enumerate(names):
        alone = encode.fit_encoder(df, [c], method, "y")
        assert {(r["key"], r["code"]) for r in together.table.filter(F.col("i") == i).collect()} == {
            (r["key"], r["code"]) for r in alone.table.collect()
        }
        assert together.sizes[i] == alone.size


@pytest.mark.parametrize("method", ["Label Encoding", "Ordinal Encoding", "Frequency Encoding", "Target Encoding"])
def test_a_saved_encoder_serves_a_stream(spark, tmp_path, method):
    df = wide(spark, 90, 3)
    names = ["c0", "c1", "c2"]
    model = encode.fit_encoder(df.filter("row_id < 60"), names, method, "y")
    model.write(str(tmp_path / "model"))
    back = encode.Encoder.load(spark, str(tmp_path / "model"))
    assert (back.method, back.columns, back.sizes, back.unseen, back.unseen_null) == (method, names, model.sizes, model.unseen, model.unseen_null)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_stream(back.apply(stream), str(tmp_path / "out"), f"enc{method[:3]}", str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").collect()
    assert got == model.apply(df).orderBy("row_id").collect() and len(got) == 90


def test_sparse_is_dense(spark):
    df = wide(spark, 60, 3).select("row_id", "c0", "c2", "y")
    dense = encode.one_hot(df, ["c2", "c0"])
    model = encode.fit_encoder(df, ["c2", "c0"], "One Hot Encoding")
    sparse = encode.sparse_vectors(df, model)
    assert sparse.columns == ["row_id", "y", "features"]
    names = {r["index"]: f"{r['column_name']}_{'nan' if r['value'] is None else r['value']}" for r in encode.sparse_index(model).collect()}
    assert set(names) == set(range(sum(model.sizes))) and set(names.values()) == set(dense.columns) - {"row_id", "y"}
    ones = {r["row_id"]: {c for c in names.values() if r[c] == 1} for r in dense.collect()}
    for r in sparse.collect():
        assert r.features.size == len(names) and r.features.indices == sorted(r.features.indices)
        assert {names[i] for i in r.features.indices} == ones[r.row_id] and r.features["values"] == [1.0, 1.0]
    other = numbered(spark, ["new", None], "string", "c0").withColumn("c2", F.lit("v1"))
    got = encode.sparse_vectors(other, model).orderBy("row_id").collect()
    assert [len(r.features.indices) for r in got] == [1, 2]


def test_very_many_categories(spark):
    df = spark.range(300_000).select(F.col("id").alias("row_id"), F.concat(F.lit("k"), F.col("id") % 250_000).alias("k"))
    with pytest.raises(ValueError, match="one_hot_sparse"):
        encode.one_hot(df, ["k"])
    vectors = encode.one_hot_sparse(df, ["k"])
    got = vectors.select("row_id", "features.size", F.col("features.indices")[0].alias("at")).agg(
        F.min("size"), F.max("size"), F.count_if(F.col("at") != F.col("row_id") % 250_000), F.count("at")
    )
    assert tuple(got.first()) == (250_000, 250_000, 0, 300_000)


def test_nothing_to_learn(spark):
    df = numbered(spark, ["a"], "string")
    for method in ("Hash Encoding", "Morse"):
        with pytest.raises(ValueError):
            encode.fit_encoder(df, ["x"], method)
    assert encode.fit_encoder(df, ["zz"], "Label Encoding").apply(df).columns == df.columns
    none = numbered(spark, [None, None], "string")
    assert [r["x"] for r in encode.fit_encoder(none, ["x"], "Label Encoding").apply(none).collect()] == [None, None]
    assert encode.one_hot_sparse(none.limit(0), ["x"]).count() == 0
