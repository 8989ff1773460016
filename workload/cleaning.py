"""Missing values, text, types, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinsework.functions.parse import FALSE_WORDS, TRUE_WORDS
from rinsework.operators import dtypes, impute, outliers
from rinsework.operators.text import clean_text
from rinsework.sources.read import MISSING_TOKENS, normalise_missing
from workload.base import SP, messy, query, sql_strip, table, tokens_sql, with_messy

# ---- missing values


@query(
    "i1_impute_mean",
    with_messy(
        "SELECT row_id, dept, round(coalesce(price, (SELECT avg(price) FROM messy)), 4) AS price, "
        "round(coalesce(qty, (SELECT avg(qty) FROM messy)), 4) AS qty FROM messy"
    ),
)
def i1(spark, folder):
    df = messy(spark, folder).select("row_id", "dept", "price", "qty")
    out = impute.impute_missing(df, ["price", "qty", "dept"], "mean")
    return out.select("row_id", "dept", F.round("price", 4).alias("price"), F.round("qty", 4).alias("qty"))


@query(
    "i2_impute_median",
    with_messy(
        "SELECT row_id, round(coalesce(price, (SELECT median(price) FROM messy)), 6) AS price, "
        "round(coalesce(qty, (SELECT median(qty) FROM messy)), 6) AS qty FROM messy"
    ),
)
def i2(spark, folder):
    df = messy(spark, folder).select("row_id", "price", "qty")
    out = impute.impute_missing(df, ["price", "qty"], "median")
    return out.select("row_id", F.round("price", 6).alias("price"), F.round("qty", 6).alias("qty"))


_MODE = "(SELECT {c} FROM messy WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "i3_impute_mode",
    with_messy(
        "SELECT row_id, "
        + ", ".join(f"coalesce({c}, {_MODE.format(c=c)}) AS {c}" for c in ("dept", "active_txt", "qty", "order_date_txt"))
        + ", empty_col FROM messy"
    ),
)
def i3(spark, folder):
    wanted = ["dept", "active_txt", "qty", "order_date_txt", "empty_col"]
    df = messy(spark, folder).select("row_id", *wanted)
    return impute.impute_missing(df, wanted, "mode")


def _gappy(spark, folder):
    """Events with gaps; most rows have none of the two values."""
    df = table(spark, folder, "events")
    k = F.col("event_id")
    return df.select(
        k.alias("row_id"),
        F.when(k % 7 > 3, F.col("value")).alias("value"),
        F.when(k % 5 == 2, F.col("event_type")).alias("event_type"),
    )


_GAPPY = (
    "gappy AS (SELECT event_id AS row_id, CASE WHEN event_id % 7 > 3 THEN value END AS value, "
    "CASE WHEN event_id % 5 = 2 THEN event_type END AS event_type FROM events)"
)


@query(
    "i4_forward_fill",
    f"WITH {_GAPPY} SELECT row_id, last_value(value IGNORE NULLS) OVER w AS value, "
    "last_value(event_type IGNORE NULLS) OVER w AS event_type FROM gappy "
    "WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def i4(spark, folder):
    return impute.impute_missing(_gappy(spark, folder), ["value", "event_type"], "ffill")


@query(
    "i5_backward_fill",
    f"WITH {_GAPPY} SELECT row_id, last_value(value IGNORE NULLS) OVER w AS value, "
    "last_value(event_type IGNORE NULLS) OVER w AS event_type FROM gappy "
    "WINDOW w AS (ORDER BY row_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def i5(spark, folder):
    return impute.impute_missing(_gappy(spark, folder), ["value", "event_type"], "bfill")


@query(
    "i6_impute_constant",
    with_messy(
        "SELECT row_id, coalesce(price, 0.0) AS price, coalesce(qty, 0) AS qty FROM messy"
    ),
)
def i6(spark, folder):
    df = messy(spark, folder).select("row_id", "price", "qty")
    return impute.impute_missing(df, ["price", "qty"], "constant", "0")


@query(
    "i6_impute_constant_text",
    with_messy("SELECT row_id, coalesce(dept, 'Unknown') AS dept, coalesce(empty_col, 'Unknown') AS empty_col FROM messy"),
)
def i6_text(spark, folder):
    df = messy(spark, folder).select("row_id", "dept", "empty_col")
    return impute.impute_missing(df, ["dept", "empty_col", "unknown"], "constant", "Unknown")


# ---- text, over whole documents


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def _docs(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


@query("t1_trim", with_messy(f"SELECT row_id, {sql_strip('name')} AS name, {sql_strip('dept')} AS dept FROM messy"))
def t1(spark, folder):
    return clean_text(messy(spark, folder).select("row_id", "name", "dept"), ["name", "dept"], "trim")


@query("t1_trim_documents", _docs(sql_strip("text")))
def t1_documents(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "trim")


@query("t2_remove_extra_spaces", _docs(f"trim(regexp_replace(text, '[{SP}]+', ' ', 'g'))"))
def t2(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "remove_extra_spaces")


@query("t3_remove_punctuation", _docs(rf"regexp_replace(text, '[^\p{{L}}\p{{N}}_{SP}]', '', 'g')"))
def t3(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "remove_punct")


@query("t4_remove_numbers", _docs(r"regexp_replace(text, '\p{Nd}+', '', 'g')"))
def t4(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "remove_nums")


@query("t5_remove_special", _docs(f"regexp_replace(text, '[^A-Za-z0-9{SP}]', '', 'g')"))
def t5(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "remove_special")


@query("t6_upper", _docs("upper(replace(text, 'ß', 'ss'))"))
def t6(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "upper")


@query("t7_lower", _docs("lower(text)"))
def t7(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "lower")


_TITLE = (
    r"array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|[^\p{{L}}]+'), "
    "lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || lower(x[2:])), '')"
)


@query("t8_title", "SELECT conv_id, turn, " + _TITLE.format(c="text") + " AS text FROM conversations")
def t8(spark, folder):
    df = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return clean_text(df, ["text"], "title")


@query("t8_title_documents", _docs(_TITLE.format(c="text")))
def t8_documents(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "title")


@query("t9_find_replace", _docs("replace(text, 'th.', '<TH>')"))
def t9(spark, folder):
    return clean_text(_documents(spark, folder), ["text"], "find_replace", "th.", "<TH>")


@query(
    "t10_replace_missing",
    with_messy(
        "SELECT row_id, CASE WHEN dept IS NULL OR dept IN ('nan', 'NaN', 'None') THEN 'missing' ELSE dept END AS dept, "
        "coalesce(empty_col, 'missing') AS empty_col FROM messy"
    ),
)
def t10(spark, folder):
    df = messy(spark, folder).select("row_id", "dept", "empty_col")
    return clean_text(df, ["dept", "empty_col"], "replace_missing", replace="missing")


# ---- types


_DETECTED = {
    "id": "Text/Object", "name": "Category", "price": "Float", "qty": "Integer", "order_date_txt": "Text/Object",
    "dept": "Category", "active_txt": "Category", "const_col": "Category", "empty_col": "Category",
    "qty_copy": "Integer",
}


def _detect_sql(c: str, kind: str) -> str:
    if kind != "text":
        return f"SELECT '{c}' AS column_name, '{kind}' AS logical_type"
    first = f"(SELECT arg_min({c}, row_id) FROM messy WHERE {c} IS NOT NULL)"
    probe = f"(SELECT {c} AS v FROM messy WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 100)"
    formats = "'%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y'"
    dated = " OR ".join(
        f"(try_strptime({first}, {f}) IS NOT NULL AND (SELECT count(*) = count(try_strptime(v, {f})) FROM {probe}))"
        for f in formats.split(", ")
    )
    d = f"(SELECT count(DISTINCT {c}) FROM messy)"
    words = "'0','1','True','False','true','false','T','F','Yes','No','yes','no'"
    return (
        f"SELECT '{c}' AS column_name, CASE WHEN {dated} THEN 'Datetime' "
        f"WHEN {d} = 2 AND (SELECT bool_and({c} IN ({words})) FROM messy WHERE {c} IS NOT NULL) THEN 'Boolean' "
        f"WHEN ({d} > 0 AND {d} < 20) OR {d} < (SELECT count(*) * 0.1 FROM messy) THEN 'Category' "
        f"ELSE 'Text/Object' END AS logical_type"
    )


@query(
    "y1_detect_types",
    with_messy(
        "\nUNION ALL ".join(
            _detect_sql(c, {"price": "Float", "qty": "Integer", "qty_copy": "Integer"}.get(c, "text"))
            for c in _DETECTED
        )
    ),
)
def y1(spark, folder):
    return dtypes.detect_types(messy(spark, folder))


@query(
    "y1_detect_types_dates",
    "SELECT * FROM (VALUES ('flag', 'Boolean'), ('day', 'Datetime'), ('moment', 'Datetime'), "
    "('total', 'Float'), ('priority', 'Category')) AS t(column_name, logical_type)",
)
def y1_dates(spark, folder):
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("No").alias("flag"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.col("o_orderdate").alias("moment"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
    )
    return dtypes.detect_types(df)


@query(
    "y1_detect_types_late_text",
    "SELECT * FROM (VALUES ('day', 'Datetime'), ('late', 'Text/Object')) AS t(column_name, logical_type)",
)
def y1_late(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(day, F.lit("T00:00:00.5")).alias("day"),
        F.when(F.col("o_orderkey") < 500, day).otherwise(F.concat(F.lit("order "), F.col("o_orderkey"))).alias("late"),
    )
    return dtypes.detect_types(df)


@query(
    "y2_boolean_vocabulary",
    "SELECT * FROM (VALUES ('quality', 'Boolean'), ('toxic', 'Boolean'), ('doc_id', 'Integer')) AS t(column_name, logical_type)",
)
def y2(spark, folder):
    return dtypes.detect_types(table(spark, folder, "labels"), order_by="doc_id")


# number texts of several shapes, made from order prices
_NUMBERS = (
    "numbers AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 6 = 0 THEN ' ' || CAST(o_totalprice AS VARCHAR) || '  ' "
    "WHEN o_orderkey % 6 = 1 THEN CAST(o_custkey AS VARCHAR) || '.5' WHEN o_orderkey % 6 = 2 THEN '1e' || CAST(o_custkey % 5 AS VARCHAR) "
    "WHEN o_orderkey % 6 = 3 THEN CAST(o_custkey AS VARCHAR) || 'd' WHEN o_orderkey % 6 = 4 THEN NULL "
    "ELSE '-' || CAST(o_custkey AS VARCHAR) END AS v FROM orders)"
)
_PARSED = (
    r"CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') "
    "THEN CAST(trim(v) AS DOUBLE) END"
)


def _numbers(spark, folder):
    k, p, c = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey").cast("string")
    from rinsework.functions.pytext import python_text
    from pyspark.sql import types as T

    v = (
        F.when(k % 6 == 0, F.concat(F.lit(" "), python_text(p, T.DoubleType()), F.lit("  ")))
        .when(k % 6 == 1, F.concat(c, F.lit(".5")))
        .when(k % 6 == 2, F.concat(F.lit("1e"), (F.col("o_custkey") % 5).cast("string")))
        .when(k % 6 == 3, F.concat(c, F.lit("d")))
        .when(k % 6 == 5, F.concat(F.lit("-"), c))
    )
    return table(spark, folder, "orders").select(k.alias("row_id"), v.alias("v"))


@query("y3_to_integer", f"WITH {_NUMBERS} SELECT row_id, CAST(round_even({_PARSED}, 0) AS BIGINT) AS v FROM numbers")
def y3(spark, folder):
    return dtypes.convert_type(_numbers(spark, folder), "v", "Integer")


@query("y4_to_float", f"WITH {_NUMBERS} SELECT row_id, {_PARSED} AS v FROM numbers")
def y4(spark, folder):
    return dtypes.convert_type(_numbers(spark, folder), "v", "Float")


@query(
    "y5_to_boolean",
    with_messy(
        f"SELECT row_id, CASE WHEN lower(active_txt) IN ({tokens_sql(TRUE_WORDS)}) THEN TRUE "
        f"WHEN lower(active_txt) IN ({tokens_sql(FALSE_WORDS)}) THEN FALSE END AS active_txt, "
        "CASE WHEN qty = 1 THEN TRUE WHEN qty = 0 THEN FALSE END AS qty FROM messy"
    ),
)
def y5(spark, folder):
    df = messy(spark, folder).select("row_id", "active_txt", "qty")
    return dtypes.convert_type(dtypes.convert_type(df, "active_txt", "Boolean"), "qty", "Boolean")


@query("y6_to_category", with_messy("SELECT row_id, dept FROM messy"))
def y6(spark, folder):
    return dtypes.convert_type(messy(spark, folder).select("row_id", "dept"), "dept", "Category")


@query(
    "y7_to_object",
    with_messy("SELECT row_id, CAST(price AS VARCHAR) AS price, CAST(qty AS VARCHAR) AS qty FROM messy"),
)
def y7(spark, folder):
    df = messy(spark, folder).select("row_id", "price", "qty")
    return dtypes.convert_type(dtypes.convert_type(df, "price", "Object"), "qty", "Object")


@query(
    "y8_to_datetime_format",
    with_messy("SELECT row_id, try_strptime(order_date_txt, '%m/%d/%Y') AS order_date_txt FROM messy"),
)
def y8(spark, folder):
    df = messy(spark, folder).select("row_id", "order_date_txt")
    return dtypes.convert_type(df, "order_date_txt", "Datetime", "%m/%d/%Y")


@query(
    "y9_to_datetime_first",
    with_messy(
        "SELECT row_id, CASE WHEN first LIKE '%/%' THEN try_strptime(d, '%m/%d/%Y') ELSE try_strptime(d, '%Y-%m-%d') END AS d "
        "FROM clean, (SELECT arg_min(d, row_id) AS first FROM clean WHERE d IS NOT NULL)",
        f"clean AS (SELECT row_id, CASE WHEN order_date_txt NOT IN ({tokens_sql(MISSING_TOKENS)}) THEN order_date_txt END AS d FROM messy)",
    ),
)
def y9(spark, folder):
    df = normalise_missing(messy(spark, folder).select("row_id", F.col("order_date_txt").alias("d")))
    return dtypes.convert_type(df, "d", "Datetime")


@query(
    "y9_to_datetime_junk_first",
    "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 > 0 THEN date_trunc('day', o_orderdate) + INTERVAL 90 MINUTE END AS d FROM orders",
)
def y9_junk(spark, folder):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, "unknown")
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd 01:30:00.0"))
        .when(kind == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T01:30:00Z")))
        .when(kind == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T03:30:00.000+02:00")))
        .otherwise(F.date_format(day, "yyyy-MM-dd 01:30"))
    )
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), text.alias("d"))
    return dtypes.convert_type(df, "d", "Datetime")


@query(
    "y9_to_datetime_any",
    with_messy(
        "SELECT row_id, coalesce(try_strptime(order_date_txt, '%Y-%m-%d'), try_strptime(order_date_txt, '%m/%d/%Y')) AS order_date_txt FROM messy"
    ),
)
def y9_any(spark, folder):
    df = messy(spark, folder).select("row_id", "order_date_txt")
    return dtypes.convert_type(df, "order_date_txt", "Datetime", formats=["%Y-%m-%d", "%m/%d/%Y"])


@query(
    "y10_narrow_types",
    with_messy(
        "SELECT row_id, CAST(price AS FLOAT) AS price, CAST(qty AS SMALLINT) AS qty, dept, name FROM messy"
    ),
)
def y10(spark, folder):
    df = messy(spark, folder).select("row_id", "price", "qty", "dept", "name")
    return dtypes.narrow_types(df)[0]


@query(
    "y10_narrow_types_chosen",
    """WITH r AS (SELECT min(l_orderkey) AS lo1, max(l_orderkey) AS hi1, min(l_linenumber) AS lo2, max(l_linenumber) AS hi2,
  min(l_suppkey) AS lo3, max(l_suppkey) AS hi3 FROM lineitem),
ranges AS (SELECT 'l_orderkey' AS column_name, lo1 AS lo, hi1 AS hi FROM r UNION ALL SELECT 'l_linenumber', lo2, hi2 FROM r
  UNION ALL SELECT 'l_suppkey', lo3, hi3 FROM r)
SELECT column_name, CASE WHEN lo >= 0 AND hi < 255 THEN 'smallint' WHEN lo >= 0 AND hi < 65535 THEN 'int'
  WHEN lo >= 0 THEN 'bigint' WHEN lo > -128 AND hi < 127 THEN 'tinyint' ELSE 'other' END AS data_type FROM ranges
UNION ALL SELECT 'l_quantity', 'float' UNION ALL SELECT 'l_returnflag', 'string'""",
)
def y10_chosen(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    narrowed = dtypes.narrow_types(df)[0]
    rows = [(f.name, f.dataType.simpleString()) for f in narrowed.schema]
    return spark.createDataFrame(rows, "column_name string, data_type string")


# ---- outliers


def _q(c: str, q: float, t: str = "messy") -> str:
    return f"(SELECT quantile_cont({c}, {q}) FROM {t})"


_IQR = (
    "iqr AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM messy))"
)
_MARK = "coalesce(price < lo OR price > hi, FALSE)"


def _priced(spark, folder):
    return messy(spark, folder).select("row_id", "price")


@query("o1_iqr_mask", with_messy(f"SELECT row_id, price, {_MARK} AS is_outlier FROM messy, iqr", _IQR))
def o1(spark, folder):
    return outliers.detect_outliers(_priced(spark, folder), "price", "IQR")[0]


@query(
    "o1_iqr_bounds",
    with_messy(
        "SELECT round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound, round(q1, 2) AS q1, "
        "round(q3, 2) AS q3, round(q3 - q1, 2) AS iqr FROM iqr",
        _IQR,
    ),
)
def o1_bounds(spark, folder):
    meta = outliers.fit_outliers(_priced(spark, folder), "price", "IQR").meta
    names = ("lower_bound", "upper_bound", "q1", "q3", "iqr")
    bounds = spark.createDataFrame([tuple(meta[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return bounds.select(*[F.round(n, 2).alias(n) for n in names])


@query(
    "o2_z_score_mask",
    with_messy(
        "SELECT row_id, price, coalesce(abs((price - m) / s) > 3, FALSE) AS is_outlier FROM messy, "
        "(SELECT avg(price) AS m, stddev_samp(price) AS s FROM messy)"
    ),
)
def o2(spark, folder):
    return outliers.detect_outliers(_priced(spark, folder), "price", "Z Score")[0]


_MAD = (
    "med AS (SELECT median(price) AS m FROM messy)",
    "mad AS (SELECT median(abs(price - m)) AS d FROM messy, med)",
)


@query(
    "o3_modified_z_mask",
    with_messy(
        "SELECT row_id, price, coalesce(abs(0.6745 * (price - m) / d) > 3.5, FALSE) AS is_outlier FROM messy, med, mad",
        *_MAD,
    ),
)
def o3(spark, folder):
    return outliers.detect_outliers(_priced(spark, folder), "price", "Modified Z Score")[0]


@query("o4_isolation_forest")
def o4(spark, folder):
    return outliers.detect_outliers(_priced(spark, folder), "price", "Isolation Forest")[0]


@query(
    "o4_isolation_forest_facts",
    with_messy(
        "SELECT count(*) AS n_rows, TRUE AS some_flagged, TRUE AS share_kept, TRUE AS extremes_flagged FROM messy"
    ),
)
def o4_facts(spark, folder):
    marked, meta = outliers.detect_outliers(_priced(spark, folder), "price", "Isolation Forest")
    hits = F.count_if(F.col("is_outlier"))
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (hits > 0).alias("some_flagged"),
        (hits <= F.count(F.lit(1)) * meta["contamination"] + 1).alias("share_kept"),
        (F.max_by("is_outlier", "price") & F.min_by("is_outlier", "price")).alias("extremes_flagged"),
    )


# 20 nearest rows by rank in value order, then k-distance, reachability density and factor per row
_LOF = """WITH o AS (SELECT event_id AS id, value AS v, row_number() OVER (ORDER BY value, event_id) AS p FROM events),
pairs AS (SELECT id, v, p + off AS q FROM (SELECT id, v, p, unnest(range(-20, 21)) AS off FROM o) WHERE off <> 0),
near AS (SELECT x.id, b.id AS bid, abs(x.v - b.v) AS d FROM pairs x JOIN o b ON b.p = x.q
  QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY abs(x.v - b.v), b.v, b.p) <= 20),
kd AS (SELECT id, max(d) AS kdist FROM near GROUP BY id),
dense AS (SELECT n.id, 1.0 / (avg(greatest(kd.kdist, n.d)) + 1e-10) AS lrd FROM near n JOIN kd ON kd.id = n.bid GROUP BY n.id),
factor AS (SELECT n.id, round(avg(b.lrd) / any_value(a.lrd), 9) AS lof
  FROM near n JOIN dense b ON b.id = n.bid JOIN dense a ON a.id = n.id GROUP BY n.id)
SELECT o.id AS row_id, o.v AS value, -f.lof < (SELECT quantile_cont(-lof, 0.05) FROM factor) AS is_outlier
FROM o JOIN factor f ON f.id = o.id"""


@query("o5_local_outlier_factor", _LOF)
def o5(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), "value")
    return outliers.detect_outliers(df, "value", "Local Outlier Factor")[0]


# neighbours counted by value range: core values have five rows within half a standard deviation; a row is
# noise when it is not core and no core value lies that near
_NOISE = (
    "filled AS (SELECT row_id, price, coalesce(price, (SELECT median(price) FROM messy)) AS x FROM messy)",
    "scaled AS (SELECT row_id, price, (x - (SELECT avg(x) FROM filled)) / (SELECT stddev_pop(x) FROM filled) AS z FROM filled)",
    "counted AS (SELECT *, count(*) OVER (ORDER BY z RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near FROM scaled)",
    "reached AS (SELECT *, max(CASE WHEN near >= 5 THEN 1 ELSE 0 END) OVER "
    "(ORDER BY z RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS core_near FROM counted)",
)


@query(
    "o6_dbscan_noise",
    with_messy("SELECT row_id, price, core_near = 0 AS is_outlier FROM reached", *_NOISE),
)
def o6(spark, folder):
    return outliers.detect_outliers(_priced(spark, folder), "price", "DBSCAN")[0]


@query(
    "o6_dbscan_noise_fine",
    "WITH scaled AS (SELECT event_id AS row_id, value, (value - (SELECT avg(value) FROM events)) / "
    "(SELECT stddev_pop(value) FROM events) AS z FROM events), "
    "counted AS (SELECT *, count(*) OVER (ORDER BY z RANGE BETWEEN 0.01 PRECEDING AND 0.01 FOLLOWING) AS near FROM scaled), "
    "reached AS (SELECT *, max(CASE WHEN near >= 8 THEN 1 ELSE 0 END) OVER "
    "(ORDER BY z RANGE BETWEEN 0.01 PRECEDING AND 0.01 FOLLOWING) AS core_near FROM counted) "
    "SELECT row_id, value, core_near = 0 AS is_outlier FROM reached",
)
def o6_fine(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), "value")
    return outliers.detect_outliers(df, "value", "DBSCAN", eps=0.01, min_samples=8)[0]


@query("o7_remove", with_messy(f"SELECT row_id, price FROM messy, iqr WHERE NOT {_MARK}", _IQR))
def o7(spark, folder):
    return outliers.handle_outliers(_priced(spark, folder), "price", "IQR", "Remove")


@query(
    "o8_replace",
    with_messy(
        f"SELECT row_id, round(CASE WHEN {_MARK} THEN (SELECT median(price) FROM messy, iqr WHERE NOT {_MARK}) ELSE price END, 6) AS price FROM messy, iqr",
        _IQR,
    ),
)
def o8(spark, folder):
    out = outliers.handle_outliers(_priced(spark, folder), "price", "IQR", "Replace")
    return out.select("row_id", F.round("price", 6).alias("price"))


@query(
    "o9_cap_bounds",
    with_messy(
        "SELECT row_id, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, lo), hi) END, 2) AS price FROM messy, iqr",
        _IQR,
    ),
)
def o9(spark, folder):
    out = outliers.handle_outliers(_priced(spark, folder), "price", "IQR", "Cap")
    return out.select("row_id", F.round("price", 2).alias("price"))


@query(
    "o10_cap_quantiles",
    with_messy(
        f"SELECT row_id, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, {_q('price', 0.01)}), {_q('price', 0.99)}) END, 6) AS price FROM messy"
    ),
)
def o10(spark, folder):
    out = outliers.handle_outliers(_priced(spark, folder), "price", "DBSCAN", "Cap", eps=0.01)
    return out.select("row_id", F.round("price", 6).alias("price"))


@query("o11_nothing_flagged", with_messy("SELECT row_id, qty FROM messy"))
def o11(spark, folder):
    df = messy(spark, folder).select("row_id", "qty")
    return outliers.handle_outliers(df, "qty", "IQR", "Cap")


@query(
    "o12_outlier_metrics",
    with_messy(
        f"SELECT count(*) FILTER (WHERE {_MARK}) AS n_outliers, count(*) AS n_rows, "
        f"round(count(*) FILTER (WHERE {_MARK}) * 100.0 / count(*), 8) AS outlier_pct FROM messy, iqr",
        _IQR,
    ),
)
def o12(spark, folder):
    out = outliers.outlier_metrics(_priced(spark, folder), "price", "IQR")
    return out.withColumn("outlier_pct", F.round("outlier_pct", 8))
