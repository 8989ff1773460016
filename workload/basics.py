"""Sources, sinks, previews, columns, rows, duplicates, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinsework.operators import columns, dedup, preview, rows
from rinsework.plans.cut import cut
from rinsework.sources.read import (
    MISSING_TOKENS,
    attach_row_id,
    load,
    normalise_missing,
    read_csv,
    read_json,
    read_parquet,
    read_tsv,
)
from rinsework.sources.write import write
from workload.base import (
    MESSY_COLUMNS,
    MESSY_NUMERIC,
    MESSY_TEXT,
    messy,
    query,
    scratch,
    table,
    tokens_sql,
    union_all,
    with_messy,
)

ALL = ", ".join(MESSY_COLUMNS)
CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _written(spark, df, file_format, **options):
    path = scratch(spark, file_format.lower())
    write(df, path, file_format, **options)
    return path


@query("s1_read_csv", CUSTOMER)
def s1(spark, folder):
    path = _written(spark, table(spark, folder, "customer"), "CSV")
    return read_csv(spark, path)


@query("s2_read_tsv", CUSTOMER)
def s2(spark, folder):
    path = _written(spark, table(spark, folder, "customer"), "TSV")
    return read_tsv(spark, path)


@query("s3_read_json", CUSTOMER)
def s3(spark, folder):
    path = _written(spark, table(spark, folder, "customer"), "JSON")
    return read_json(spark, path, lines=True)


@query("s4_read_parquet", "SELECT * FROM orders")
def s4(spark, folder):
    return read_parquet(spark, f"{folder}/orders.parquet")


@query("s5_format_dispatch", "SELECT * FROM events")
def s5(spark, folder):
    return load(spark, f"{folder}/events.parquet")


@query(
    "s6_missing_tokens",
    with_messy(
        "SELECT row_id, price, qty, qty_copy, "
        + ", ".join(
            f"CASE WHEN {c} IN ({tokens_sql(MISSING_TOKENS)}) THEN NULL ELSE {c} END AS {c}" for c in MESSY_TEXT
        )
        + " FROM messy"
    ),
)
def s6(spark, folder):
    return normalise_missing(messy(spark, folder))


@query("s7_attach_row_id", "SELECT o_orderkey AS row_id, o_orderkey, o_custkey, o_totalprice FROM orders")
def s7(spark, folder):
    return attach_row_id(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("s7_attach_row_id_key", "SELECT event_id AS row_id, event_id, user_id, value FROM events")
def s7_key(spark, folder):
    return attach_row_id(table(spark, folder, "events").select("event_id", "user_id", "value"), key="event_id")


@query(
    "k1_write_csv",
    with_messy(f"SELECT row_id, {ALL} FROM messy"),
)
def k1(spark, folder):
    df = messy(spark, folder)
    texts = ("id", "name", "order_date_txt", "dept", "active_txt", "const_col", "empty_col")
    schema = "row_id bigint, price double, qty bigint, qty_copy bigint, " + ", ".join(f"{c} string" for c in texts)
    return read_csv(spark, _written(spark, df, "CSV"), missing=[""], schema=schema)


@query("s1_read_csv_multiline", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1_lines(spark, folder):
    """Texts with line breaks, quotes and separators, read back with all options as they come."""
    return read_csv(spark, _written(spark, table(spark, folder, "documents"), "CSV"), missing=[])


@query("k1_write_csv_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def k1_text(spark, folder):
    path = _written(spark, table(spark, folder, "documents"), "CSV")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return read_csv(spark, path, missing=[], schema=schema, multi_line=True)


@query("k2_write_json", "SELECT conv_id, turn, role, text FROM conversations")
def k2(spark, folder):
    return read_json(spark, _written(spark, table(spark, folder, "conversations"), "JSON"), lines=True)


@query("k3_write_parquet", with_messy(f"SELECT row_id, {ALL} FROM messy"))
def k3(spark, folder):
    return read_parquet(spark, _written(spark, messy(spark, folder), "PARQUET"))


@query("k4_export_tsv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def k4(spark, folder):
    path = _written(spark, table(spark, folder, "part"), "tsv")
    return load(spark, path, file_format="tsv")


@query("p1_head", with_messy(f"SELECT row_id, {ALL} FROM messy ORDER BY row_id LIMIT 20"))
def p1(spark, folder):
    return preview.head(messy(spark, folder), 20)


@query(
    "p2_tail",
    with_messy(f"SELECT * FROM (SELECT row_id, {ALL} FROM messy ORDER BY row_id DESC LIMIT 20) ORDER BY row_id"),
)
def p2(spark, folder):
    return preview.tail(messy(spark, folder), 20)


@query("p3_random_rows")
def p3(spark, folder):
    return preview.random_rows(messy(spark, folder), 20)


@query("p3_random_rows_facts", with_messy("SELECT least(20, count(*)) AS n, least(20, count(*)) AS n_distinct, count(*) * 0 + 1 AS inside FROM messy"))
def p3_facts(spark, folder):
    df = messy(spark, folder).select("row_id", "price")
    return _sample_facts(df, preview.random_rows(df, 20))


def _type_of(c):
    return {"price": "double", "qty": "bigint", "qty_copy": "bigint"}.get(c, "string")


@query(
    "p4_schema_table",
    with_messy(
        union_all(
            [
                f"SELECT '{c}' AS column_name, '{_type_of(c)}' AS data_type, count({c}) AS non_null, "
                f"count(*) - count({c}) AS nulls FROM messy"
                for c in MESSY_COLUMNS
            ]
        )
    ),
)
def p4(spark, folder):
    return preview.schema_table(messy(spark, folder))


_PRESENT = " + ".join(f"count({c})" for c in MESSY_COLUMNS)
_BYTES = " + ".join(
    [f"8 * count(*)" for _ in MESSY_NUMERIC] + [f"coalesce(sum(strlen({c})), 0)" for c in MESSY_TEXT]
)


@query(
    "p5_key_figures",
    with_messy(
        f"""SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns,
  CAST(10 * count(*) - ({_PRESENT}) AS BIGINT) AS missing_cells,
  round((10 * count(*) - ({_PRESENT})) * 100.0 / (10 * count(*)), 6) AS missing_pct,
  CAST({_BYTES} AS BIGINT) AS estimated_bytes FROM messy"""
    ),
)
def p5(spark, folder):
    return preview.key_figures(messy(spark, folder)).withColumn("missing_pct", F.round("missing_pct", 6))


_TOP = """SELECT '{c}' AS column_name, rank, value, count, pct FROM (
  SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS BIGINT) AS rank, CAST({c} AS VARCHAR) AS value,
         count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
  FROM messy WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""


@query("p6_frequent_values", with_messy(union_all([_TOP.format(c=c) for c in ("name", "qty", "dept", "active_txt")])))
def p6(spark, folder):
    return preview.frequent_values(messy(spark, folder), ["name", "qty", "dept", "active_txt"])


@query(
    "c1_rename_columns",
    with_messy("SELECT row_id, id AS order_code, dept AS department, price, qty FROM messy"),
)
def c1(spark, folder):
    df = messy(spark, folder).select("row_id", "id", "dept", "price", "qty")
    return columns.rename_columns(df, {"id": "order_code", "dept": "department", "unknown": "x"})


@query(
    "c2_drop_columns",
    with_messy("SELECT row_id, id, name, price, qty, order_date_txt, dept, active_txt FROM messy"),
)
def c2(spark, folder):
    return columns.drop_columns(messy(spark, folder), ["const_col", "empty_col", "qty_copy", "unknown"])


@query("c3_duplicate_column", with_messy("SELECT row_id, price, price AS price_before FROM messy"))
def c3(spark, folder):
    df = messy(spark, folder).select("row_id", "price")
    return columns.duplicate_column(df, "price", "price_before")


@query(
    "c4_merge_columns",
    with_messy(
        "SELECT row_id, coalesce(id, 'nan') || ' | ' || coalesce(dept, 'nan') || ' | ' || "
        "coalesce(CAST(price AS VARCHAR), 'nan') || ' | ' || coalesce(CAST(qty AS VARCHAR), 'nan') AS merged FROM messy"
    ),
)
def c4(spark, folder):
    df = columns.merge_columns(messy(spark, folder), ["id", "dept", "price", "qty"], "merged", " | ")
    return df.select("row_id", "merged")


@query(
    "c5_split_column",
    with_messy(
        "SELECT row_id, order_date_txt, string_split(order_date_txt, '-')[1] AS a, "
        "string_split(order_date_txt, '-')[2] AS b, string_split(order_date_txt, '-')[3] AS c, "
        "string_split(order_date_txt, '-')[4] AS d FROM messy"
    ),
)
def c5(spark, folder):
    df = messy(spark, folder).select("row_id", "order_date_txt")
    return columns.split_column(df, "order_date_txt", "-", ["a", "b", "c", "d"])


@query(
    "c6_reorder_columns",
    with_messy(
        "SELECT qty, price, row_id, id, name, order_date_txt, dept, active_txt, const_col, empty_col, qty_copy FROM messy"
    ),
)
def c6(spark, folder):
    return columns.reorder_columns(messy(spark, folder), ["qty", "price"])


@query(
    "c7_drop_constant_columns",
    with_messy("SELECT row_id, id, name, price, qty, order_date_txt, dept, active_txt, qty_copy FROM messy"),
)
def c7(spark, folder):
    return columns.drop_constant_columns(messy(spark, folder))


@query(
    "c8_drop_empty_columns",
    with_messy("SELECT row_id, id, name, price, qty, order_date_txt, dept, active_txt, const_col, qty_copy FROM messy"),
)
def c8(spark, folder):
    return columns.drop_empty_columns(messy(spark, folder))


@query("r1_delete_rows", "SELECT o_orderkey AS row_id, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (0, 3, 17, 4242, 9999)")
def r1(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice")
    return rows.delete_rows(df, [0, 3, "17", "4242", 9999, "not a label", 10**15])


@query(
    "r2_sort_rows",
    with_messy(
        "SELECT row_id, dept, price, CAST(row_number() OVER "
        "(ORDER BY dept ASC NULLS LAST, price DESC NULLS LAST, row_id) - 1 AS BIGINT) AS place FROM messy"
    ),
)
def r2(spark, folder):
    df = messy(spark, folder).select("row_id", "dept", "price")
    laid = cut(rows.sort_rows(df, ["dept", "price"], [True, False]))
    # number the sorted rows in the order they lie in, to show that order
    return attach_row_id(laid.withColumnRenamed("row_id", "old")).withColumnsRenamed({"row_id": "place", "old": "row_id"})


@query(
    "r3_filter_expression",
    with_messy(
        f"SELECT row_id, {ALL} FROM messy WHERE (price > 200000 AND qty < 30) OR (dept = '1-URGENT' AND price IS NULL)"
    ),
)
def r3(spark, folder):
    return rows.filter_rows(messy(spark, folder), "(price > 200000 & qty < 30) | (dept == '1-URGENT' and price.isnull())")


@query("r4_sample_n", with_messy("SELECT least(2000, count(*)) AS n, least(2000, count(*)) AS n_distinct, count(*) * 0 + 1 AS inside FROM messy"))
def r4(spark, folder):
    df = messy(spark, folder).select("row_id", "price")
    return _sample_facts(df, rows.random_sample(df, n=2000, seed=42))


@query(
    "r5_sample_fraction",
    with_messy("SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) AS n, CAST(round_even(count(*) * 0.3, 0) AS BIGINT) AS n_distinct, count(*) * 0 + 1 AS inside FROM messy"),
)
def r5(spark, folder):
    df = messy(spark, folder).select("row_id", "price")
    return _sample_facts(df, rows.random_sample(df, frac=0.3, seed=7))


def _sample_facts(df, sample):
    """Size, distinct rows, and whether all sampled rows come from the table."""
    marked = sample.select("row_id").join(df.select("row_id", F.lit(1).alias("hit")), "row_id", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("row_id").alias("n_distinct"),
        F.min(F.coalesce("hit", F.lit(0))).cast("bigint").alias("inside"),
    )


@query("r4_sample_rows")
def r4_rows(spark, folder):
    return rows.random_sample(messy(spark, folder), n=500, seed=42)


@query("r6_drop_missing_rows", with_messy(f"SELECT row_id, {ALL} FROM messy WHERE price IS NOT NULL AND dept IS NOT NULL"))
def r6(spark, folder):
    return rows.drop_missing_rows(messy(spark, folder), ["price", "dept"])


@query(
    "r7_drop_empty_rows_columns",
    with_messy("SELECT row_id, price, dept FROM messy WHERE price IS NOT NULL OR dept IS NOT NULL"),
)
def r7(spark, folder):
    df = messy(spark, folder).select("row_id", "price", "dept", "empty_col")
    return rows.drop_empty_rows_columns(df)


@query(
    "u1_dedup_first",
    with_messy(f"SELECT min(row_id) AS row_id, {ALL} FROM messy GROUP BY {ALL}"),
)
def u1(spark, folder):
    return dedup.remove_duplicates(messy(spark, folder), keep="first")


_PICK = "SELECT row_id, dept, qty, id, price FROM messy QUALIFY row_number() OVER (PARTITION BY dept, qty ORDER BY row_id {d}) = 1"


@query("u1_dedup_first_subset", with_messy(_PICK.format(d="ASC")))
def u1_subset(spark, folder):
    df = messy(spark, folder).select("row_id", "dept", "qty", "id", "price")
    return dedup.remove_duplicates(df, ["dept", "qty"], "first")


@query("u2_dedup_last", with_messy(_PICK.format(d="DESC")))
def u2(spark, folder):
    df = messy(spark, folder).select("row_id", "dept", "qty", "id", "price")
    return dedup.remove_duplicates(df, ["dept", "qty"], "last")


@query(
    "u3_dedup_none",
    with_messy("SELECT row_id, id, price FROM messy QUALIFY count(*) OVER (PARTITION BY id) = 1"),
)
def u3(spark, folder):
    return dedup.remove_duplicates(messy(spark, folder).select("row_id", "id", "price"), ["id"], "none")


@query(
    "u4_duplicate_count",
    with_messy(f"SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM messy GROUP BY {ALL})"),
)
def u4(spark, folder):
    return dedup.duplicate_count(messy(spark, folder))


@query(
    "u4_duplicate_count_subset",
    with_messy("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM messy GROUP BY name, dept)"),
)
def u4_subset(spark, folder):
    return dedup.duplicate_count(messy(spark, folder), ["name", "dept"])


@query(
    "j3_delete_by_table",
    "SELECT o_orderkey AS row_id, o_custkey, o_totalprice FROM orders "
    "WHERE o_orderkey NOT IN (SELECT doc_id FROM labels)",
)
def j3(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice")
    return rows.delete_rows(df, table(spark, folder, "labels").select("doc_id"))
