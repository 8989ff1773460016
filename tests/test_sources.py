import pytest
from helpers import plan

from rinsework.sources import read
from rinsework.sources.read import UnsupportedFormat, attach_row_id, load, normalise_nan, read_csv, read_json
from rinsework.sources.write import write

PEOPLE = """code,name,age,pay,joined,dept,flag,same,none
P1,  Ann  ,58.0,999999.0,2026-12-01,HR,True,on,
P2,Bob,,33905.0,N/A,   ,Yes,on,
P3,Cid,45.0,,12/08/2020,,,on,
P3,Cid,45.0,,12/08/2020,,,on,
P4,Dee,-5.0,50379.0,NULL,HR,No,on,
"""


@pytest.fixture
def people(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(PEOPLE)
    return read_csv(spark, str(path))


def test_dirty_file(people):
    from rinsework.operators.dedup import duplicate_count
    from rinsework.plans.tablestats import TableStats

    s = TableStats(people)
    gaps = {c: s.missing(c) for c in people.columns if s.missing(c)}
    assert gaps == {"age": 1, "pay": 2, "joined": 2, "dept": 2, "flag": 2, "none": 5}
    assert (s.distinct("code"), s.distinct("age"), s.distinct("dept")) == (4, 3, 2)
    assert s.quartiles["age"] == [32.5, 45.0, 48.25]
    assert duplicate_count(people).first()[0] == 1
    kinds = dict(people.dtypes)
    assert (kinds["age"], kinds["pay"], kinds["flag"], kinds["none"]) == ("double", "double", "string", "string")


def test_dirty_file_filters(people):
    from rinsework.operators.rows import filter_rows

    assert filter_rows(people, "age > 30 & pay > 50000").count() == 1
    assert filter_rows(people, "dept == 'HR' and age.notnull()").count() == 2


def test_type_inference_after_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\n1,1.5,true,x\nN/A,,False,NULL\n3,2e3,NA,y\n")
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "x"),
        (None, None, False, None),
        (3, 2000.0, None, "y"),
    ]


def test_unknown_formats(spark, tmp_path):
    with pytest.raises(UnsupportedFormat):
        load(spark, "/nowhere/data.xyz")
    with pytest.raises(UnsupportedFormat):
        write(spark.range(1).toDF("x"), str(tmp_path / "o"), "EXCEL")


def test_json_array(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[\n {"a": 1, "b": "x"},\n {"a": null, "b": "y"}\n]')
    assert {tuple(r) for r in read_json(spark, str(path)).collect()} == {(1, "x"), (None, "y")}


def test_dispatch_ignores_case(spark, tmp_path):
    path = tmp_path / "T.CSV"
    path.write_text("a\n1\n")
    assert load(spark, str(path)).collect()[0]["a"] == 1


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert normalise_nan(df).filter("x is null").count() == 2


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [("  a ",), ('say "hi", now',), ("x\ty",), ("é",)]
    df = spark.createDataFrame(rows, "t string")
    for kind in ("CSV", "TSV"):
        path = str(tmp_path / kind)
        write(df, path, kind)
        back = load(spark, path, file_format=kind.lower())
        assert {r[0] for r in back.collect()} == {r[0] for r in rows}


def test_json_keeps_null_fields(spark, tmp_path):
    path = str(tmp_path / "j")
    write(spark.createDataFrame([(1, None)], "a int, b string"), path, "JSON")
    assert '"b":null' in "".join(r[0] for r in spark.read.text(path).collect())


def test_nested_columns_export_to_csv(spark, tmp_path):
    path = str(tmp_path / "n")
    write(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), path, "CSV")
    assert read_csv(spark, path).collect()[0]["b"] == "[1,2]"


def test_row_ids_follow_file_order(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    df = attach_row_id(spark.read.parquet(path))
    rows = df.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1000))
    assert all(r["row_id"] == r["id"] for r in rows)


@pytest.mark.parametrize("most", [100_000, 2])
def test_row_ids_need_no_window_over_all_splits(spark, tmp_path, monkeypatch, most):
    """Few splits are added up on the driver, many in ranges of their order; either way the ids are the same."""
    monkeypatch.setattr(read, "BROADCAST_SPLITS", most)
    path = str(tmp_path / "many")
    spark.range(500).repartitionByRange(9, "id").sortWithinPartitions("id").write.parquet(path)
    shown = []
    keep = read.cut
    monkeypatch.setattr(read, "cut", lambda df: shown.append(plan(df)) or keep(df))
    df = attach_row_id(spark.read.parquet(path))
    assert all(r["row_id"] == r["id"] for r in df.collect())
    for text in (*shown, plan(df)):
        assert "SinglePartition" not in text and ("Window" not in text or most == 2)
    empty = attach_row_id(spark.read.parquet(path).filter("id < 0"))
    assert empty.columns == ["row_id", "id"] and empty.count() == 0
