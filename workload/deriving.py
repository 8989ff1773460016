"""Derived columns, scaling and encoding."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from rinsework.operators import encode, features, scale
from workload.base import messy, query, table, with_messy

AS_OF = datetime(2024, 2, 28, 12, 0)


def _orders(spark, folder, *more):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), *more)


def _lines(spark, folder):
    return table(spark, folder, "lineitem")


@query("e1_add", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_quantity + l_tax AS made FROM lineitem")
def e1(spark, folder):
    df = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return features.math_column(df, "l_quantity", "add", "l_tax", "made")


@query("e2_subtract", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice - 100.5 AS made FROM lineitem")
def e2(spark, folder):
    df = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return features.math_column(df, "l_extendedprice", "subtract", "100.5", "made")


@query("e3_multiply", "SELECT l_orderkey, l_extendedprice, l_discount, l_extendedprice * l_discount AS made FROM lineitem")
def e3(spark, folder):
    df = _lines(spark, folder).select("l_orderkey", "l_extendedprice", "l_discount")
    return features.math_column(df, "l_extendedprice", "multiply", "l_discount", "made")


@query(
    "e4_divide",
    "SELECT l_orderkey, l_extendedprice, l_discount, CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS made FROM lineitem",
)
def e4(spark, folder):
    df = _lines(spark, folder).select("l_orderkey", "l_extendedprice", "l_discount")
    return features.math_column(df, "l_extendedprice", "divide", "l_discount", "made")


@query("e4_divide_by_zero", "SELECT l_orderkey, l_tax, CAST(NULL AS DOUBLE) AS made FROM lineitem")
def e4_zero(spark, folder):
    return features.math_column(_lines(spark, folder).select("l_orderkey", "l_tax"), "l_tax", "divide", 0, "made")


@query(
    "e5_conditional",
    with_messy(
        "SELECT row_id, price, dept, CASE WHEN price > 200000 THEN 'high' ELSE 'low' END AS level, "
        "CASE WHEN dept IS DISTINCT FROM '5-LOW' THEN 1 ELSE 0 END AS other, "
        "CASE WHEN regexp_matches(dept, '^[12]-') THEN 'rush' ELSE 'calm' END AS pace FROM messy"
    ),
)
def e5(spark, folder):
    df = messy(spark, folder).select("row_id", "price", "dept")
    df = features.conditional_column(df, "level", "price", ">", "200000", "high", "low")
    df = features.conditional_column(df, "other", "dept", "!=", "5-LOW", 1, 0)
    return features.conditional_column(df, "pace", "dept", "contains", "^[12]-", "rush", "calm")


@query(
    "e5_conditional_bounds",
    with_messy(
        "SELECT row_id, qty, CASE WHEN qty <= 10 THEN 'y' ELSE 'n' END AS le, CASE WHEN qty >= 80 THEN 'y' ELSE 'n' END AS ge, "
        "CASE WHEN qty = 7 THEN 'y' ELSE 'n' END AS eq, CASE WHEN qty < 7 THEN 'y' ELSE 'n' END AS lt FROM messy"
    ),
)
def e5_bounds(spark, folder):
    df = messy(spark, folder).select("row_id", "qty")
    for name, op, v in (("le", "<=", 10), ("ge", ">=", 80), ("eq", "==", 7), ("lt", "<", 7)):
        df = features.conditional_column(df, name, "qty", op, v, "y", "n")
    return df


@query(
    "e6_date_parts",
    "SELECT event_id AS row_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, "
    "dayname(ts) AS ts_dayofweek, quarter(ts) AS ts_quarter, hour(ts) AS ts_hour FROM events",
)
def e6(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), "ts")
    parts = ["Year", "Month", "Day", "DayOfWeek", "Quarter", "Hour", "Unknown"]
    return features.date_parts(df, "ts", parts).drop("ts")


@query(
    "e7_age",
    "SELECT o_orderkey AS row_id, CAST(2024 - year(o_orderdate) - CASE WHEN (2, 28) < (month(o_orderdate), day(o_orderdate)) "
    "THEN 1 ELSE 0 END AS BIGINT) AS age FROM orders",
)
def e7(spark, folder):
    df = features.age(_orders(spark, folder, "o_orderdate"), "o_orderdate", "age", AS_OF)
    return df.drop("o_orderdate")


_GAP = (
    "gaps AS (SELECT event_id AS row_id, epoch_us(o_orderdate) - epoch_us(ts) AS us FROM events JOIN orders ON o_orderkey = event_id)"
)


def _paired(spark, folder):
    events = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), "ts")
    return events.join(_orders(spark, folder, "o_orderdate"), "row_id")


@query("e8_date_difference_days", f"WITH {_GAP} SELECT row_id, CAST(floor(us / 86400000000.0) AS BIGINT) AS gap FROM gaps")
def e8(spark, folder):
    return features.date_difference(_paired(spark, folder), "ts", "o_orderdate", "gap", "days").select("row_id", "gap")


@query(
    "e9_date_difference_units",
    f"WITH {_GAP} SELECT row_id, round(floor(us / 86400000000.0) / 7.0, 8) AS weeks, "
    "round(floor(us / 86400000000.0) / 365.25, 8) AS years, round(us / 3600000000.0, 6) AS hours FROM gaps",
)
def e9(spark, folder):
    df = _paired(spark, folder)
    for unit in ("weeks", "years", "hours"):
        df = features.date_difference(df, "ts", "o_orderdate", unit, unit)
    return df.select(
        "row_id", F.round("weeks", 8).alias("weeks"), F.round("years", 8).alias("years"), F.round("hours", 6).alias("hours")
    )


@query(
    "e10_log_transform",
    with_messy(
        "SELECT row_id, price, round(ln(1 + price + (SELECT CASE WHEN min(price) < 0 THEN -min(price) ELSE 0 END FROM messy)), 9) AS log_price FROM messy"
    ),
)
def e10(spark, folder):
    df = features.log_transform(messy(spark, folder).select("row_id", "price"), "price", "log_price")
    return df.withColumn("log_price", F.round("log_price", 9))


@query(
    "e11_bin_uniform",
    "WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) "
    "SELECT o_orderkey AS row_id, CASE " + " ".join(
        f"WHEN o_totalprice <= lo + (hi - lo) / 6.0 * {i + 1} THEN 'b{i}'" for i in range(5)
    ) + " ELSE 'b5' END AS bin FROM orders, r",
)
def e11(spark, folder):
    df = _orders(spark, folder, "o_totalprice")
    return features.bin_column(df, "o_totalprice", 6, [f"b{i}" for i in range(6)], "bin").select("row_id", "bin")


@query(
    "e12_bin_quantile",
    "WITH " + ", ".join(f"q{i} AS (SELECT quantile_cont(o_totalprice, {i}.0 / 7) AS e{i} FROM orders)" for i in range(1, 7))
    + " SELECT o_orderkey AS row_id, CASE "
    + " ".join(f"WHEN o_totalprice <= e{i + 1} THEN 'q{i}'" for i in range(6))
    + " ELSE 'q6' END AS bin FROM orders, q1, q2, q3, q4, q5, q6",
)
def e12(spark, folder):
    df = _orders(spark, folder, "o_totalprice")
    labels = [f"q{i}" for i in range(7)]
    return features.bin_column(df, "o_totalprice", 7, labels, "bin", "quantile").select("row_id", "bin")


@query(
    "e13_bin_interval_labels",
    "SELECT l_orderkey, l_quantity, CASE WHEN l_quantity <= 13.25 THEN '(0.951, 13.25]' WHEN l_quantity <= 25.5 THEN '(13.25, 25.5]' "
    "WHEN l_quantity <= 37.75 THEN '(25.5, 37.75]' ELSE '(37.75, 50.0]' END AS bin FROM lineitem",
)
def e13(spark, folder):
    df = _lines(spark, folder).select("l_orderkey", "l_quantity")
    return features.bin_column(df, "l_quantity", 4, None, "bin")


# ---- scaling


_FILLED = (
    "filled AS (SELECT row_id, coalesce(price, (SELECT median(price) FROM messy)) AS p, "
    "coalesce(qty, (SELECT median(qty) FROM messy)) AS q FROM messy)"
)


def _scaled(spark, folder, scaler, digits=7):
    df = scale.scale_features(messy(spark, folder).select("row_id", "dept", "price", "qty"), ["price", "qty", "dept"], scaler)
    return df.select("row_id", F.round("price", digits).alias("price"), F.round("qty", digits).alias("qty"))


def _scale_sql(p: str, q: str, digits: int = 7) -> str:
    return with_messy(f"SELECT row_id, round({p}, {digits}) AS price, round({q}, {digits}) AS qty FROM filled", _FILLED)


def _of(f: str, c: str) -> str:
    return f"(SELECT {f.format(c=c)} FROM filled)"


@query(
    "x1_standard_scaler",
    _scale_sql(*[f"({c} - {_of('avg({c})', c)}) / {_of('stddev_pop({c})', c)}" for c in "pq"]),
)
def x1(spark, folder):
    return _scaled(spark, folder, "StandardScaler")


@query(
    "x2_min_max_scaler",
    _scale_sql(*[f"({c} - {_of('min({c})', c)}) / {_of('(max({c}) - min({c}))', c)}" for c in "pq"]),
)
def x2(spark, folder):
    return _scaled(spark, folder, "MinMaxScaler")


@query(
    "x3_robust_scaler",
    _scale_sql(
        *[f"({c} - {_of('median({c})', c)}) / {_of('(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))', c)}" for c in "pq"]
    ),
)
def x3(spark, folder):
    return _scaled(spark, folder, "RobustScaler")


@query(
    "x4_normalizer",
    _scale_sql("p / CASE WHEN p = 0 AND q = 0 THEN 1 ELSE sqrt(p * p + q * q) END", "q / CASE WHEN p = 0 AND q = 0 THEN 1 ELSE sqrt(p * p + q * q) END"),
)
def x4(spark, folder):
    return _scaled(spark, folder, "Normalizer")


@query("x5_max_abs_scaler", _scale_sql(*[f"{c} / {_of('max(abs({c}))', c)}" for c in "pq"]))
def x5(spark, folder):
    return _scaled(spark, folder, "MaxAbsScaler")


# ---- encoding


def _encoded(spark, folder, *args, **kwargs):
    df = messy(spark, folder).select("row_id", "dept", "active_txt", "price")
    return encode.encode_categorical(df, ["dept", "active_txt", "unknown"], *args, **kwargs)


def _catalog(c: str, order: str, nulls: bool) -> str:
    kept = "" if nulls else f" WHERE {c} IS NOT NULL"
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY {order}) AS code FROM messy{kept} GROUP BY {c})"


@query(
    "n1_label_encoding",
    with_messy(
        "SELECT row_id, a.code - 1 AS dept, b.code - 1 AS active_txt, price FROM messy "
        f"LEFT JOIN {_catalog('dept', 'dept', False)} a ON dept = a.v LEFT JOIN {_catalog('active_txt', 'active_txt', False)} b ON active_txt = b.v"
    ),
)
def n1(spark, folder):
    return _encoded(spark, folder, "Label Encoding")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "n2_one_hot_encoding",
    "SELECT o_orderkey AS row_id, "
    + ", ".join(f"""CAST(o_orderpriority = '{p}' AS BIGINT) AS "o_orderpriority_{p}\"""" for p in _PRIORITIES)
    + ", o_totalprice FROM orders",
)
def n2(spark, folder):
    df = _orders(spark, folder, "o_orderpriority", "o_totalprice")
    return encode.encode_categorical(df, ["o_orderpriority"], "One Hot Encoding")


@query(
    "n2_one_hot_with_missing",
    with_messy(
        "SELECT row_id, CAST(active_txt IS NULL AS BIGINT) AS active_txt_nan, "
        + ", ".join(f"CAST(active_txt IS NOT DISTINCT FROM '{v}' AS BIGINT) AS \"active_txt_{v}\"" for v in ("True", "Yes", "False", "No"))
        + " FROM messy"
    ),
)
def n2_missing(spark, folder):
    return encode.encode_categorical(messy(spark, folder).select("row_id", "active_txt"), ["active_txt"], "One Hot Encoding")


@query(
    "n2_one_hot_wide",
    "SELECT row_id, hits, code FROM (SELECT o_orderkey AS row_id, CAST(1 AS BIGINT) AS hits, "
    "CAST(o_orderkey % 1200 AS BIGINT) AS code FROM orders)",
)
def n2_wide(spark, folder):
    df = _orders(spark, folder).withColumn("k", (F.col("row_id") % 1200).cast("string"))
    wide = encode.encode_categorical(df, ["k"], "One Hot Encoding")
    flags = F.array(*[F.col(f"`{c}`") for c in wide.columns if c != "row_id"])
    names = F.array(*[F.lit(int(c[2:])) for c in wide.columns if c != "row_id"])
    hits = F.aggregate(flags, F.lit(0).cast("bigint"), lambda n, x: n + x)
    return wide.select("row_id", hits.alias("hits"), F.get(names, F.array_position(flags, 1).cast("int") - 1).cast("bigint").alias("code"))


@query(
    "n2_one_hot_sparse",
    "WITH a AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS p FROM orders GROUP BY o_custkey), "
    "b AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS p FROM orders GROUP BY o_orderpriority) "
    "SELECT o_orderkey AS row_id, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS size, a.p AS customer, "
    "(SELECT count(*) FROM a) + b.p AS priority, CAST(2 AS BIGINT) AS ones FROM orders JOIN a USING (o_custkey) JOIN b USING (o_orderpriority)",
)
def n2_sparse(spark, folder):
    df = _orders(spark, folder, "o_custkey", "o_orderpriority")
    vectors = encode.one_hot_sparse(df, ["o_custkey", "o_orderpriority"])
    at = F.col("features.indices")
    ones = F.size("features.values").cast("bigint")
    return vectors.select("row_id", "features.size", at[0].alias("customer"), at[1].alias("priority"), ones.alias("ones"))


@query(
    "n3_ordinal_encoding",
    with_messy(
        "SELECT row_id, a.code AS dept, b.code AS active_txt, price FROM messy "
        f"LEFT JOIN {_catalog('dept', 'min(row_id)', True)} a ON dept IS NOT DISTINCT FROM a.v "
        f"LEFT JOIN {_catalog('active_txt', 'min(row_id)', True)} b ON active_txt IS NOT DISTINCT FROM b.v"
    ),
)
def n3(spark, folder):
    return _encoded(spark, folder, "Ordinal Encoding")


def _share(c: str) -> str:
    return f"round(CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c}) * 1.0 / (SELECT count({c}) FROM messy) END, 10) AS {c}"


@query("n4_frequency_encoding", with_messy(f"SELECT row_id, {_share('dept')}, {_share('active_txt')}, price FROM messy"))
def n4(spark, folder):
    df = _encoded(spark, folder, "Frequency Encoding")
    return df.withColumns({c: F.round(c, 10) for c in ("dept", "active_txt")})


@query(
    "n5_binary_encoding",
    with_messy(
        "SELECT row_id, (code // 4) % 2 AS active_txt_0, (code // 2) % 2 AS active_txt_1, code % 2 AS active_txt_2 FROM messy "
        f"LEFT JOIN {_catalog('active_txt', 'min(row_id)', True)} b ON active_txt IS NOT DISTINCT FROM b.v"
    ),
)
def n5(spark, folder):
    return encode.encode_categorical(messy(spark, folder).select("row_id", "active_txt"), ["active_txt"], "Binary Encoding")


@query(
    "n5_binary_other_columns",
    "SELECT o_orderkey AS row_id, o_totalprice AS __code, o_orderkey AS code, o_orderstatus AS k_0, "
    "(o_orderkey % 3 + 1) // 2 AS k_0_, (o_orderkey % 3 + 1) % 2 AS k_1 FROM orders",
)
def n5_others(spark, folder):
    df = _orders(
        spark, folder, F.col("o_totalprice").alias("__code"), F.col("o_orderkey").alias("code"),
        F.col("o_orderstatus").alias("k_0"), (F.col("o_orderkey") % 3).cast("string").alias("k"),
    )
    return encode.encode_categorical(df, ["k"], "Binary Encoding")


def _bucket(c: str) -> str:
    # the last hexadecimal digit decides the digest modulo 8
    return f"(position(substr(md5(coalesce({c}, 'nan')), 32, 1) IN '0123456789abcdef') - 1) % 8"


@query(
    "n6_hash_encoding",
    with_messy(
        "SELECT row_id, price, "
        + ", ".join(
            f"CAST(({_bucket('dept')} = {i}) AS BIGINT) + CAST(({_bucket('active_txt')} = {i}) AS BIGINT) AS col_{i}" for i in range(8)
        )
        + " FROM messy"
    ),
)
def n6(spark, folder):
    return _encoded(spark, folder, "Hash Encoding")


@query(
    "n7_target_encoding",
    "WITH p AS (SELECT avg(p_retailprice) AS prior FROM part), g AS (SELECT p_brand, avg(p_retailprice) AS m, "
    "1.0 / (1.0 + exp(-(count(*) - 20) / 10.0)) AS s FROM part GROUP BY p_brand) "
    "SELECT p_partkey, round(prior * (1 - s) + m * s, 6) AS p_brand, p_retailprice FROM part JOIN g USING (p_brand), p",
)
def n7(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    out = encode.encode_categorical(df, ["p_brand"], "Target Encoding", "p_retailprice")
    return out.withColumn("p_brand", F.round("p_brand", 6))


@query(
    "j1_frequency_lookup",
    "SELECT l_orderkey, l_linenumber, round(count(*) OVER (PARTITION BY l_partkey) * 1.0 / (SELECT count(*) FROM lineitem), 12) AS l_partkey FROM lineitem",
)
def j1(spark, folder):
    df = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey")
    out = encode.encode_categorical(df, ["l_partkey"], "Frequency Encoding")
    return out.withColumn("l_partkey", F.round("l_partkey", 12))


@query(
    "j2_ordinal_lookup",
    "SELECT event_id AS row_id, code AS user_id FROM events JOIN (SELECT user_id AS u, row_number() OVER (ORDER BY min(event_id)) AS code "
    "FROM events GROUP BY user_id) ON u = user_id",
)
def j2(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), "user_id")
    return encode.encode_categorical(df, ["user_id"], "Ordinal Encoding")
