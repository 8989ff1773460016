"""Profiles, quality, validation, recipes and the report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from rinsework.operators import charts, features, profile, quality, recipe, report, validate
from rinsework.plans.tablestats import TableStats
from workload.base import (
    MESSY_COLUMNS,
    MESSY_NUMERIC,
    MESSY_TEXT,
    messy,
    query,
    sql_strip,
    table,
    union_all,
    with_messy,
)

AS_OF = datetime(2000, 1, 1)
ALL = ", ".join(MESSY_COLUMNS)
TYPES = {c: "string" for c in MESSY_TEXT} | {"price": "double", "qty": "bigint", "qty_copy": "bigint"}

_COMMON = (
    "SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count({c}) AS non_null, count(*) - count({c}) AS missing, "
    "round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS n_distinct"
)
_NUMBERS = (
    ", round_even(avg({c}), 4) AS mean, round_even(median({c}), 4) AS median, round_even(CAST(min({c}) AS DOUBLE), 4) AS min, "
    "round_even(CAST(max({c}) AS DOUBLE), 4) AS max, round_even(stddev_samp({c}), 4) AS std, "
    "round_even(skewness({c}), 4) AS skew, round_even(kurtosis({c}), 4) AS kurtosis"
)
_NO_NUMBERS = ", " + ", ".join(
    f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "median", "min", "max", "std", "skew", "kurtosis")
)


def _profile_sql(c: str) -> str:
    tail = _NUMBERS if c in MESSY_NUMERIC else _NO_NUMBERS
    return (_COMMON + tail).format(c=c, t=TYPES[c]) + " FROM messy"


@query(
    "a1_column_profile_common",
    with_messy(union_all([_COMMON.format(c=c, t=TYPES[c]) + " FROM messy" for c in ("price", "dept", "empty_col")])),
)
def a1(spark, folder):
    out = profile.profile_columns(messy(spark, folder), ["price", "dept", "empty_col"])
    return out.select("column_name", "data_type", "n_rows", "non_null", "missing", "missing_pct", "n_distinct")


@query(
    "a2_column_profile_numeric",
    "SELECT round_even(avg(l_extendedprice), 4) AS mean, round_even(median(l_extendedprice), 4) AS median, min(l_extendedprice) AS min, "
    "max(l_extendedprice) AS max, round(var_samp(l_extendedprice), 1) AS var, round_even(stddev_samp(l_extendedprice), 4) AS std FROM lineitem",
)
def a2(spark, folder):
    df = table(spark, folder, "lineitem").select("l_extendedprice")
    return profile.profile_columns(df).select("mean", "median", "min", "max", F.round("var", 1).alias("var"), "std")


_TOP = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "a3_column_mode",
    with_messy(
        union_all([f"SELECT '{c}' AS column_name, CAST({_TOP.format(c=c, t='messy')} AS DOUBLE) AS mode" for c in MESSY_NUMERIC])
    ),
)
def a3(spark, folder):
    out = profile.profile_columns(messy(spark, folder), list(MESSY_NUMERIC))
    return out.select("column_name", F.col("mode").cast("double").alias("mode"))


@query(
    "a4_skew_kurtosis",
    union_all(
        [
            f"SELECT '{c}' AS column_name, round_even(skewness({c}), 4) AS skew, round_even(kurtosis({c}), 4) AS kurtosis FROM lineitem"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ]
    ),
)
def a4(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profile.profile_columns(df).select("column_name", "skew", "kurtosis")


@query(
    "a5_text_profile",
    with_messy(
        union_all(
            [f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, {_TOP.format(c=c, t='messy')} AS mode FROM messy" for c in ("name", "dept", "active_txt")]
        )
    ),
)
def a5(spark, folder):
    out = profile.profile_columns(messy(spark, folder), ["name", "dept", "active_txt"])
    return out.select("column_name", "n_distinct", "mode")


@query(
    "a6_all_missing_numeric",
    with_messy(
        "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS non_null, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, "
        "CAST(NULL AS DOUBLE) AS std, CAST(NULL AS VARCHAR) AS mode FROM messy"
    ),
)
def a6(spark, folder):
    df = messy(spark, folder).select("row_id", F.col("empty_col").cast("double").alias("empty_number"))
    return profile.profile_columns(df).select("n_rows", "non_null", "mean", "median", "std", "mode")


_MISSING = "(" + " + ".join(f"count(*) - count({c})" for c in MESSY_COLUMNS) + ")"
_DUPLICATES = f"(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM messy GROUP BY {ALL}))"
_BYTES = "(" + " + ".join(["24 * count(*)"] + [f"coalesce(sum(strlen({c})), 0)" for c in MESSY_TEXT]) + ")"
_SUMMARY = (
    "SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_cols, CAST(3 AS BIGINT) AS n_numeric, CAST(0 AS BIGINT) AS n_categorical, "
    "CAST(0 AS BIGINT) AS n_boolean, CAST(0 AS BIGINT) AS n_datetime, CAST(7 AS BIGINT) AS n_object, "
    f"CAST({_MISSING} AS BIGINT) AS missing_cells, round_even({_MISSING} * 100.0 / (count(*) * 10), 2) AS missing_pct, "
    f"{_DUPLICATES} AS duplicates, round_even({_BYTES} / 1048576.0, 2) AS memory_mb FROM messy"
)


@query("a7_dataset_summary", with_messy(_SUMMARY))
def a7(spark, folder):
    return profile.summarise(messy(spark, folder))


@query("a8_dataset_profile", with_messy(union_all([_profile_sql(c) for c in MESSY_COLUMNS])))
def a8(spark, folder):
    return profile.profile_columns(messy(spark, folder)).drop("mode", "var")


_AGG_SQL = {
    "sum": "coalesce(sum(price), 0)", "mean": "avg(price)", "median": "median(price)", "min": "min(price)",
    "max": "max(price)", "count": "count(*)",
}


@query(
    "a9_group_aggregates",
    with_messy(
        union_all(
            [
                f"SELECT '{n}' AS func, dept AS key, round(CAST({f} AS DOUBLE), 4) AS value FROM messy WHERE dept IS NOT NULL GROUP BY dept"
                for n, f in _AGG_SQL.items()
            ]
        )
    ),
)
def a9(spark, folder):
    df, out = messy(spark, folder), None
    for name in _AGG_SQL:
        part = charts.group_aggregate(df, "dept", "price", name)
        part = part.select(F.lit(name).alias("func"), "key", F.round(F.col("value").cast("double"), 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a10_value_counts", with_messy("SELECT name AS key, count(*) AS count FROM messy WHERE name IS NOT NULL GROUP BY name"))
def a10(spark, folder):
    return charts.count_values(messy(spark, folder), "name")


def _places(spark, folder):
    """Customers with their nation and region names."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal"
    )


_PLACES = (
    "places AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, c_acctbal FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)


def _paths_sql(amount: str) -> str:
    return (
        f"WITH {_PLACES} SELECT 1 AS level, region, NULL AS nation, NULL AS segment, {amount} AS total FROM places GROUP BY region "
        f"UNION ALL SELECT 2, region, nation, NULL, {amount} FROM places GROUP BY region, nation "
        f"UNION ALL SELECT 3, region, nation, segment, {amount} FROM places GROUP BY region, nation, segment"
    )


@query("a11_path_totals_sum", _paths_sql("round(sum(c_acctbal), 4)"))
def a11(spark, folder):
    out = charts.path_totals(_places(spark, folder), ["region", "nation", "segment"], "c_acctbal")
    return out.withColumn("total", F.round("total", 4))


@query("a11_path_totals_count", _paths_sql("count(*)"))
def a11_count(spark, folder):
    return charts.path_totals(_places(spark, folder), ["region", "nation", "segment"])


@query(
    "a12_shares_count",
    with_messy(
        "SELECT dept AS name, count(*) AS total, round(count(*) * 1.0 / (SELECT count(dept) FROM messy), 9) AS share FROM messy WHERE dept IS NOT NULL GROUP BY dept"
    ),
)
def a12(spark, folder):
    return charts.shares(messy(spark, folder), "dept").withColumn("share", F.round("share", 9))


@query(
    "a12_shares_sum",
    "SELECT event_type AS name, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events), 9) AS share FROM events GROUP BY event_type",
)
def a12_sum(spark, folder):
    out = charts.shares(table(spark, folder, "events"), "event_type", "value")
    return out.select("name", F.round("total", 4).alias("total"), F.round("share", 9).alias("share"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _corr_sql(names, source: str) -> str:
    parts = []
    for x in names:
        for y in names:
            r = "1.0" if x == y else f"round(corr({x}, {y}), 3)"
            parts.append(f"SELECT '{x}' AS x, '{y}' AS y, CAST({r} + 0.0 AS DOUBLE) AS corr FROM {source}" + (" LIMIT 1" if x == y else ""))
    return union_all([f"SELECT * FROM ({p})" for p in parts])


@query("a13_correlations", _corr_sql(_CORR, "lineitem"))
def a13(spark, folder):
    return charts.correlations(table(spark, folder, "lineitem"), list(_CORR))


@query("a13_correlations_with_gaps", with_messy(_corr_sql(MESSY_NUMERIC, "messy")))
def a13_gaps(spark, folder):
    return charts.correlations(messy(spark, folder).select(*MESSY_NUMERIC))


def _wide(c: str, k: str) -> str:
    """Column k of a wide table: related to its neighbours, with gaps of its own."""
    return f"CASE WHEN (l_orderkey * 31 + {k} * 17 + l_linenumber) % ({k} + 5) = 0 THEN NULL ELSE ((l_partkey * {k}) % (50 + {k})) + l_quantity * ({k} % 3) END{c}"


@query(
    "a13_correlations_wide",
    f"SELECT 'c' || i AS x, 'c' || j AS y, CASE WHEN i = j THEN 1.0 ELSE round(corr(v[i], v[j]), 3) + 0.0 END AS corr "
    f"FROM (SELECT [{', '.join(_wide('', str(k)) for k in range(1, 31))}] AS v FROM lineitem) AS t, "
    "unnest(range(1, 31)) AS a(i), unnest(range(1, 31)) AS b(j) GROUP BY i, j",
)
def a13_wide(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(*[_wide(f" AS c{k}", str(k)) for k in range(1, 31)])
    return charts.correlations(df)


# ---- quality


_OUTLIER_COUNTS = tuple(
    f"out_{c} AS (SELECT count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n, count({c}) AS m FROM messy, "
    f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM messy))"
    for c in MESSY_NUMERIC
)
_PENALTY = " + ".join(
    [f"(SELECT CASE WHEN count(DISTINCT {c}) > 0 AND count(DISTINCT {c}) < 100 AND count(DISTINCT {c}) < count(*) * 0.3 THEN 10 ELSE 0 END FROM messy)" for c in MESSY_TEXT]
    + ["(SELECT CASE WHEN max(price) < 32000 THEN 5 ELSE 0 END FROM messy)"]
    + [f"(SELECT CASE WHEN min({c}) > -32000 AND max({c}) < 32000 THEN 5 ELSE 0 END FROM messy)" for c in ("qty", "qty_copy")]
)
_PARTS = (
    *_OUTLIER_COUNTS,
    f"parts AS (SELECT 100 - {_MISSING} * 100.0 / (count(*) * 10) AS completeness, 100 - {_DUPLICATES} * 100.0 / count(*) AS uniqueness, "
    "greatest(0, 100 - ((SELECT n FROM out_price) + (SELECT n FROM out_qty) + (SELECT n FROM out_qty_copy)) * 150.0 / "
    "((SELECT m FROM out_price) + (SELECT m FROM out_qty) + (SELECT m FROM out_qty_copy))) AS regularity, "
    f"100.0 AS consistency, CAST(greatest(50, 100 - ({_PENALTY})) AS DOUBLE) AS efficiency FROM messy)",
)


def _part_sql(name: str) -> str:
    return with_messy(f"SELECT round_even(CAST({name} AS DOUBLE), 4) AS {name} FROM parts", *_PARTS)


def _part(spark, folder, name):
    parts = quality.score_parts(TableStats(messy(spark, folder)))
    return spark.createDataFrame([(round(float(parts[name]), 4),)], f"{name} double")


for _i, _name in enumerate(("completeness", "uniqueness", "regularity", "consistency", "efficiency"), 1):
    query(f"q{_i}_{_name}", _part_sql(_name))(lambda spark, folder, _n=_name: _part(spark, folder, _n))


@query(
    "q6_quality_score",
    with_messy(
        "SELECT round_even(CAST(0.25 * completeness + 0.2 * uniqueness + 0.2 * regularity + 0.15 * consistency + 0.2 * efficiency AS DOUBLE), 1) AS score, "
        + ", ".join(f"round_even(CAST({n} AS DOUBLE), 1) AS {n}" for n in ("completeness", "uniqueness", "regularity", "consistency", "efficiency"))
        + " FROM parts",
        *_PARTS,
    ),
)
def q6(spark, folder):
    return quality.quality_score(messy(spark, folder))


_NONE = "CAST(NULL AS DOUBLE)"
_FIND = "SELECT category, column_name, affected, pct, severity FROM ({parts})"
_GAPS = union_all(
    [
        f"SELECT 'Missing Values' AS category, '{c}' AS column_name, count(*) - count({c}) AS affected, "
        f"round_even((count(*) - count({c})) * 100.0 / count(*), 1) AS pct, "
        f"CASE WHEN (count(*) - count({c})) * 100.0 / count(*) > 40 THEN 'danger' ELSE 'warning' END AS severity FROM messy HAVING count(*) > count({c})"
        for c in MESSY_COLUMNS
    ]
)
_COPIES = (
    f"SELECT 'Duplicates' AS category, CAST(NULL AS VARCHAR) AS column_name, {_DUPLICATES} AS affected, "
    f"round_even({_DUPLICATES} * 100.0 / count(*), 1) AS pct, 'warning' AS severity FROM messy"
)
_STATIC = union_all(
    [
        f"SELECT 'Column Check' AS category, '{c}' AS column_name, count(*) AS affected, CAST(100 AS DOUBLE) AS pct, "
        f"CASE WHEN count({c}) = 0 THEN 'danger' ELSE 'info' END AS severity FROM messy HAVING count(DISTINCT {c}) <= 1"
        for c in MESSY_COLUMNS
    ]
)
_EXTREME = union_all(
    [
        f"SELECT 'Outliers' AS category, '{c}' AS column_name, n AS affected, round_even(n * 100.0 / m, 1) AS pct, 'info' AS severity "
        f"FROM out_{c} WHERE n * 100.0 / m > 1"
        for c in MESSY_NUMERIC
    ]
)
_REUSE = union_all(
    [
        f"SELECT 'Optimization' AS category, '{c}' AS column_name, count(DISTINCT {c}) AS affected, {_NONE} AS pct, 'info' AS severity "
        f"FROM messy HAVING count(DISTINCT {c}) > 0 AND count(DISTINCT {c}) < 100 AND count(DISTINCT {c}) < count(*) * 0.3"
        for c in MESSY_TEXT
    ]
)


def _findings_sql(*parts: str) -> str:
    return with_messy(_FIND.format(parts=union_all([f"SELECT * FROM ({p})" for p in parts])), *_OUTLIER_COUNTS)


def _findings(spark, folder, category=None):
    out = quality.suggest_improvements(messy(spark, folder))
    if category:
        out = out.filter(F.col("category") == category)
    return out.select("category", "column_name", "affected", "pct", "severity")


@query("g1_missing_values", _findings_sql(_GAPS))
def g1(spark, folder):
    return _findings(spark, folder, "Missing Values")


@query("g2_duplicates", _findings_sql(_COPIES))
def g2(spark, folder):
    return _findings(spark, folder, "Duplicates")


@query("g3_empty_or_constant", _findings_sql(_STATIC))
def g3(spark, folder):
    return _findings(spark, folder, "Column Check")


@query("g4_outliers", _findings_sql(_EXTREME))
def g4(spark, folder):
    return _findings(spark, folder, "Outliers")


_KIND = (
    "CASE WHEN regexp_full_match({s}, '[+-]?[0-9]+') THEN 'int' "
    "WHEN regexp_full_match({s}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float' "
    "WHEN lower({s}) IN ('true', 'false') THEN 'bool' "
    "WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN 'date' ELSE 'str' END"
)


def _mixed_sql(head: str) -> str:
    return with_messy(
        union_all(
            [
                f"SELECT {head.format(c=c)} FROM messy WHERE {c} IS NOT NULL HAVING count(DISTINCT {_KIND.format(s=sql_strip(c))}) > 1"
                for c in MESSY_TEXT
            ]
        )
    )


@query("g5_mixed_types", _mixed_sql("'Data Types' AS category, '{c}' AS column_name, 'warning' AS severity"))
def g5(spark, folder):
    found = quality.suggest_improvements(TableStats(messy(spark, folder), mixed="lexical"))
    return found.filter("category = 'Data Types'").select("category", "column_name", "severity")


@query("g6_low_cardinality", _findings_sql(_REUSE))
def g6(spark, folder):
    return _findings(spark, folder, "Optimization")


@query("g_all_suggestions", _findings_sql(_GAPS, _COPIES, _STATIC, _EXTREME, _REUSE))
def g_all(spark, folder):
    return _findings(spark, folder)


# ---- validation


_ISSUE = "SELECT '{c}' AS column_name, '{kind}' AS issue_type, {n} AS affected_rows, '{severity}' AS severity FROM {t} {when}"


def _issue(c: str, kind: str, n: str, severity: str, when: str, t: str = "messy") -> str:
    return _ISSUE.format(c=c, kind=kind, n=n, severity=severity, when=when, t=t)


_V1 = _issue("qty & qty_copy", "Duplicate Columns", "count(*)", "warning", "")
_V2 = union_all([_issue(c, "Constant Column", "count(*)", "info", f"HAVING count(DISTINCT {c}) <= 1") for c in MESSY_COLUMNS])
_V3 = union_all(
    [
        _issue(
            c, "Negative Values", f"count(*) FILTER (WHERE {c} < 0)", "warning",
            f"HAVING count(*) FILTER (WHERE {c} < 0) > 0 AND count(*) FILTER (WHERE {c} >= 0) > count(*) FILTER (WHERE {c} < 0)",
        )
        for c in MESSY_NUMERIC
    ]
)
_V5 = union_all(
    [
        _issue(c, "Blank Strings", f"count(*) FILTER (WHERE {c} <> '' AND {sql_strip(c)} = '')", "info",
               f"HAVING count(*) FILTER (WHERE {c} <> '' AND {sql_strip(c)} = '') > 0")
        for c in MESSY_TEXT
    ]
)
_V6 = union_all(
    [
        _issue(c, "Untrimmed Spaces", f"count(*) FILTER (WHERE {c} <> {sql_strip(c)})", "warning",
               f"HAVING count(*) FILTER (WHERE {c} <> {sql_strip(c)}) > 0")
        for c in MESSY_TEXT
    ]
)
_V7 = union_all(
    [
        _issue(c, "High Cardinality", "CAST(NULL AS BIGINT)", "info",
               f"HAVING count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) < count(*) * 0.9")
        for c in MESSY_TEXT
    ]
)


def _issues(spark, folder, kind=None):
    out = validate.validate(messy(spark, folder), AS_OF)
    if kind:
        out = out.filter(F.col("issue_type") == kind)
    return out.select("column_name", "issue_type", "affected_rows", "severity")


@query("v1_duplicate_columns", with_messy(_V1))
def v1(spark, folder):
    return _issues(spark, folder, "Duplicate Columns")


@query("v2_constant_columns", with_messy(_V2))
def v2(spark, folder):
    return _issues(spark, folder, "Constant Column")


@query("v3_negative_values", with_messy(_V3))
def v3(spark, folder):
    return _issues(spark, folder, "Negative Values")


@query("v4_mixed_types", _mixed_sql("'{c}' AS column_name, 'Mixed Data Types' AS issue_type, CAST(NULL AS BIGINT) AS affected_rows, 'warning' AS severity"))
def v4(spark, folder):
    out = validate.validate(messy(spark, folder), AS_OF, mixed="lexical").filter("issue_type = 'Mixed Data Types'")
    return out.select("column_name", "issue_type", "affected_rows", "severity")


@query("v5_blank_strings", with_messy(_V5))
def v5(spark, folder):
    return _issues(spark, folder, "Blank Strings")


@query("v6_untrimmed", with_messy(_V6))
def v6(spark, folder):
    return _issues(spark, folder, "Untrimmed Spaces")


@query("v7_high_cardinality", with_messy(_V7))
def v7(spark, folder):
    return _issues(spark, folder, "High Cardinality")


@query(
    "v8_future_dates",
    "SELECT 'o_orderdate' AS column_name, 'Future Dates' AS issue_type, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2000-01-01') AS affected_rows, 'danger' AS severity FROM orders",
)
def v8(spark, folder):
    out = validate.validate(table(spark, folder, "orders"), AS_OF).filter("issue_type = 'Future Dates'")
    return out.select("column_name", "issue_type", "affected_rows", "severity")


_ALL_ISSUES = with_messy(union_all([f"SELECT * FROM ({v})" for v in (_V1, _V2, _V3, _V5, _V6, _V7)]))


@query("v_all_issues", _ALL_ISSUES)
def v_all(spark, folder):
    return _issues(spark, folder)


# ---- recipes and report


_CLEANED = (
    "spaced AS (SELECT row_id, price, qty, qty_copy, "
    + ", ".join(f"trim(regexp_replace({sql_strip(c)}, '\\s+', ' ', 'g')) AS {c}" for c in MESSY_TEXT)
    + " FROM messy)",
    "filled AS (SELECT row_id, "
    + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM spaced)) AS {c}" for c in MESSY_NUMERIC)
    + ", "
    + ", ".join(f"coalesce({c}, {_TOP.format(c=c, t='spaced')}) AS {c}" for c in MESSY_TEXT)
    + " FROM spaced)",
)


@query(
    "l1_smart_clean",
    with_messy(
        "SELECT min(row_id) AS row_id, id, name, CAST(price AS FLOAT) AS price, CAST(qty AS FLOAT) AS qty, order_date_txt, dept, active_txt, "
        f"CAST(qty_copy AS FLOAT) AS qty_copy FROM filled GROUP BY {ALL}",
        *_CLEANED,
    ),
)
def l1(spark, folder):
    return recipe.smart_clean(messy(spark, folder))


def _recipe():
    at = datetime(2024, 1, 1)
    return (
        recipe.Recipe(at)
        .push("clean_text", at, columns=["name", "dept"], operation="trim")
        .push("filter_rows", at, expression="price > 1000")
        .push("impute_missing", at, columns=["dept"], strategy="constant", custom_value="none")
        .push("drop_columns", at, columns=["const_col", "empty_col", "qty_copy"])
        .push("random_sample", at, n=5)
    )


_L2 = with_messy(
    f"SELECT row_id, id, {sql_strip('name')} AS name, price, qty, order_date_txt, coalesce({sql_strip('dept')}, 'none') AS dept, active_txt "
    "FROM messy WHERE price > 1000"
)


@query("l2_recipe_undo_redo", _L2)
def l2(spark, folder):
    # the sample is undone twice over, the dropped columns come back by redo
    return _recipe().undo().undo().redo().apply(messy(spark, folder))


@query("l2_recipe_prefixes", _L2)
def l2_prefixes(spark, folder):
    # the whole recipe first; what is left after undo and redo is found among its beginnings
    df, whole = messy(spark, folder), _recipe()
    prefixes = recipe.Prefixes(df)
    whole.apply(df, prefixes)
    return whole.undo().undo().redo().apply(df, prefixes)


_STEPS = ("clean_text", "filter_rows", "impute_missing", "drop_columns", "random_sample")


@query(
    "l3_timeline",
    with_messy(
        union_all(
            [
                f"SELECT {i} AS index, '{name}' AS action, TIMESTAMP '2024-01-01' AS at, "
                f"'{'past' if i < 3 else 'active' if i == 3 else 'undone'}' AS status, count(*) AS n_rows FROM messy"
                for i, name in enumerate(("Dataset Loaded", *_STEPS))
            ]
        )
    ),
)
def l3(spark, folder):
    n = messy(spark, folder).count()
    return _recipe().undo().undo().timeline(spark).withColumn("n_rows", F.lit(n))


@query(
    "l4_audit_log",
    with_messy(
        "SELECT 0 AS step, 'Dataset Loaded' AS action, count(*) AS n_rows, 10 AS n_cols FROM messy "
        "UNION ALL SELECT 1, 'clean_text', count(*), 10 FROM messy "
        "UNION ALL SELECT 2, 'filter_rows', count(*), 10 FROM messy WHERE price > 1000 "
        "UNION ALL SELECT 3, 'impute_missing', count(*), 10 FROM messy WHERE price > 1000 "
        "UNION ALL SELECT 4, 'drop_columns', count(*), 7 FROM messy WHERE price > 1000"
    ),
)
def l4(spark, folder):
    return _recipe().undo().audit(messy(spark, folder)).select("step", "action", "n_rows", "n_cols")


@query(
    "l4_audit_log_row_steps",
    with_messy(
        "SELECT 0 AS step, 'Dataset Loaded' AS action, count(*) AS n_rows, 10 AS n_cols FROM messy "
        "UNION ALL SELECT 1, 'remove_duplicates', count(DISTINCT id), 10 FROM messy "
        "UNION ALL SELECT 2, 'impute_missing', count(DISTINCT id), 10 FROM messy "
        "UNION ALL SELECT 3, 'sort_rows', count(DISTINCT id), 10 FROM messy "
        "UNION ALL SELECT 4, 'random_sample', least(count(DISTINCT id), 100), 10 FROM messy "
        "UNION ALL SELECT 5, 'sort_rows', least(count(DISTINCT id), 100), 10 FROM messy"
    ),
)
def l4_rows(spark, folder):
    at = datetime(2024, 1, 1)
    steps = (
        recipe.Recipe(at)
        .push("remove_duplicates", at)
        .push("impute_missing", at, columns=["qty"], strategy="ffill")
        .push("sort_rows", at, columns=["price"])
        .push("random_sample", at, n=100)
        .push("sort_rows", at, columns=["name"])
    )
    return steps.audit(messy(spark, folder)).select("step", "action", "n_rows", "n_cols")


@query(
    "v_nested_columns",
    """SELECT 'embedding & again' AS column_name, 'Duplicate Columns' AS issue_type FROM embeddings HAVING count(*) > 0
    UNION ALL SELECT c, 'Constant Column' FROM (VALUES ('same'), ('same_map')) AS t(c)
    UNION ALL SELECT 'entry & entry_again', 'Duplicate Columns'
    UNION ALL SELECT c, 'distinct ' || n FROM (
        SELECT 'embedding' AS c, count(DISTINCT embedding) AS n FROM embeddings
        UNION ALL SELECT 'label_bytes', count(DISTINCT label) FROM embeddings
        UNION ALL SELECT 'entry', count(DISTINCT label) FROM embeddings) AS d""",
)
def v_nested(spark, folder):
    label = F.col("label").cast("string")
    df = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", F.col("embedding").alias("again"),
        F.array(F.lit(1), F.lit(2)).alias("same"), F.create_map(F.lit("a"), F.lit(1)).alias("same_map"),
        label.cast("binary").alias("label_bytes"), F.create_map(F.lit("l"), label).alias("entry"),
        F.create_map(F.lit("l"), label).alias("entry_again"),
    )
    issues = validate.validate(df).filter("issue_type in ('Duplicate Columns', 'Constant Column')")
    counts = profile.profile_columns(df).filter(F.col("column_name").isin("embedding", "label_bytes", "entry"))
    distinct = counts.select("column_name", F.concat(F.lit("distinct "), "n_distinct").alias("issue_type"))
    return issues.select("column_name", "issue_type").unionByName(distinct)


def _report_rows(parts: list[str]) -> str:
    return union_all(parts)


@query(
    "l5_report",
    with_messy(
        "SELECT 'summary' AS part, count(*) AS n FROM (SELECT 1) "
        "UNION ALL SELECT 'score', count(*) FROM (SELECT 1) "
        f"UNION ALL SELECT 'suggestions', count(*) FROM ({union_all([f'SELECT * FROM ({p})' for p in (_GAPS, _COPIES, _STATIC, _EXTREME, _REUSE)])}) "
        f"UNION ALL SELECT 'validation', count(*) FROM ({union_all([f'SELECT * FROM ({v})' for v in (_V1, _V2, _V3, _V5, _V6, _V7)])}) "
        "UNION ALL SELECT 'columns', CAST(10 AS BIGINT)",
        *_OUTLIER_COUNTS,
    ),
)
def l5(spark, folder):
    tables = report.report_tables(messy(spark, folder), AS_OF)
    out = None
    for name, part in tables.items():
        counted = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "l2_recipe_features",
    with_messy(
        "SELECT row_id, price, qty, round(price / CASE WHEN qty <> 0 THEN qty END, 8) AS unit_price FROM messy WHERE price IS NOT NULL"
    ),
)
def l2_features(spark, folder):
    steps = (
        recipe.Recipe(AS_OF)
        .push("drop_missing_rows", AS_OF, columns=["price"])
        .push("math_column", AS_OF, column="price", op="divide", operand="qty", new_name="unit_price")
    )
    out = steps.apply(messy(spark, folder).select("row_id", "price", "qty"))
    return out.withColumn("unit_price", F.round("unit_price", 8))
