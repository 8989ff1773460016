"""Tables behind the charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rinsework.functions.normal import CENTRE, SIDE, TAIL
from rinsework.operators import charts, outliers, preview
from workload.base import messy, query, table, union_all, with_messy
from workload.profiling import _corr_sql, _paths_sql, _places


def _priced(spark, folder):
    return messy(spark, folder).select("row_id", "price", "dept", "qty")


_RANGE = "r AS (SELECT min({c}) AS lo, (max({c}) - min({c})) / {n} AS w FROM {t})"
_BIN = "CAST(least(floor(({c} - lo) / w), {m}) AS INTEGER)"


@query(
    "h1_histogram",
    "WITH " + _RANGE.format(c="value", n=30, t="events")
    + f" SELECT bin, round(lo + bin * w, 6) AS low, round(lo + bin * w + w, 6) AS high, n FROM (SELECT {_BIN.format(c='value', m=29)} AS bin, "
    "any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM events, r GROUP BY 1)",
)
def h1(spark, folder):
    out = charts.histogram(table(spark, folder, "events"), "value")
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(
    "h2_histogram_by_outlier",
    with_messy(
        f"SELECT {_BIN.format(c='price', m=19)} AS bin, coalesce(price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1), FALSE) AS is_outlier, "
        "count(*) AS n FROM messy, r, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM messy) WHERE price IS NOT NULL GROUP BY 1, 2",
        _RANGE.format(c="price", n=20, t="messy"),
    ),
)
def h2(spark, folder):
    marked, _ = outliers.detect_outliers(_priced(spark, folder), "price", "IQR")
    return charts.histogram(marked, "price", 20, "is_outlier").select("bin", "is_outlier", "n")


_BOX = (
    "SELECT name, n, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, "
    "min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS low_whisker, "
    "max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS high_whisker, "
    "count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers, min(v) AS min, max(v) AS max "
    "FROM points JOIN (SELECT name AS g, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS q2, quantile_cont(v, 0.75) AS q3 "
    "FROM points GROUP BY name) ON name = g GROUP BY name, n, q1, q2, q3"
)


@query("h3_box_by_category", with_messy(_BOX, "points AS (SELECT dept AS name, price AS v FROM messy WHERE dept IS NOT NULL AND price IS NOT NULL)"))
def h3(spark, folder):
    out = charts.box_summary(_priced(spark, folder), "price", "dept")
    return out.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")})


@query(
    "h3_box_by_two",
    with_messy(
        _BOX,
        "points AS (SELECT dept || '|' || active_txt AS name, price AS v FROM messy WHERE dept IS NOT NULL AND active_txt IS NOT NULL AND price IS NOT NULL)",
    ),
)
def h3_two(spark, folder):
    out = charts.box_summary(messy(spark, folder), "price", "dept", "active_txt")
    out = out.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")})
    return out.withColumn("name", F.concat_ws("|", "name", "color")).drop("color")


@query("h3_box_overall", with_messy(_BOX, "points AS (SELECT 'all' AS name, price AS v FROM messy WHERE price IS NOT NULL)"))
def h3_all(spark, folder):
    out = charts.box_summary(_priced(spark, folder), "price")
    return out.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")})


@query(
    "h3_box_outliers",
    with_messy(
        "SELECT row_id, dept AS name, price AS value FROM messy JOIN (SELECT dept AS g, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 "
        "FROM messy GROUP BY dept) ON dept = g WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)"
    ),
)
def h3_points(spark, folder):
    return charts.box_outliers(_priced(spark, folder), "price", "dept")


@query(
    "h4_scatter_points",
    with_messy(
        "SELECT row_id, qty AS x, price AS y, dept AS color, CASE WHEN lo <= 0 THEN price - lo + 1 ELSE price END AS size FROM messy, (SELECT min(price) AS lo FROM messy)"
    ),
)
def h4(spark, folder):
    return charts.scatter_points(_priced(spark, folder), "qty", "price", "dept", "price")


@query("h5_line_points", "SELECT event_id AS row_id, ts AS x, value AS y, event_type AS color FROM events")
def h5(spark, folder):
    df = table(spark, folder, "events").withColumnRenamed("event_id", "row_id")
    return charts.line_points(df, "ts", "value", "event_type")


@query("h6_bar_counts", "SELECT l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY l_returnflag")
def h6(spark, folder):
    return charts.count_values(table(spark, folder, "lineitem"), "l_returnflag")


@query("h6_bar_aggregate", "SELECT l_returnflag AS key, round(median(l_extendedprice), 6) AS value FROM lineitem GROUP BY l_returnflag")
def h6_aggregate(spark, folder):
    out = charts.group_aggregate(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", "median")
    return out.withColumn("value", F.round("value", 6))


@query(
    "h7_pie_shares",
    "SELECT o_orderpriority AS name, count(*) AS total, round(count(*) * 1.0 / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY o_orderpriority",
)
def h7(spark, folder):
    return charts.shares(table(spark, folder, "orders"), "o_orderpriority").withColumn("share", F.round("share", 9))


@query("h8_treemap", _paths_sql("count(*)"))
def h8(spark, folder):
    return charts.path_totals(_places(spark, folder), ["region", "nation", "segment"])


_ORDERED = (
    "SELECT rank, round(CASE WHEN rank = n THEN power(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - power(0.5, 1.0 / n) "
    "ELSE (rank - 0.3175) / (n + 0.365) END, 10) AS p, value FROM (SELECT row_number() OVER (ORDER BY price, row_id) AS rank, "
    "count(*) OVER () AS n, price AS value FROM messy WHERE price IS NOT NULL)"
)


@query("h9_normal_order", with_messy(_ORDERED))
def h9(spark, folder):
    out = charts.normal_order(_priced(spark, folder), "price")
    return out.select("rank", F.round("p", 10).alias("p"), "value")


def _ratio_sql(region, x: str) -> str:
    above, below = (reduce(lambda s, c: f"({s} * {x} + {c!r})", p[1:], f"{p[0]!r}::DOUBLE") for p in region)
    return f"({above} / {below})"


def _probit_sql() -> str:
    far = "sqrt(-ln(CASE WHEN p <= 0.5 THEN p ELSE 1 - p END))"
    size = f"CASE WHEN {far} <= 5 THEN {_ratio_sql(SIDE, f'({far} - 1.6)')} ELSE {_ratio_sql(TAIL, f'({far} - 5.0)')} END"
    centre = f"(p - 0.5) * {_ratio_sql(CENTRE, '(0.180625 - (p - 0.5) * (p - 0.5))')}"
    return f"CASE WHEN abs(p - 0.5) <= 0.425 THEN {centre} WHEN p < 0.5 THEN -({size}) ELSE {size} END"


_PLACED = (
    "placed AS (SELECT rank, value, CASE WHEN rank = n THEN power(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - power(0.5, 1.0 / n) "
    "ELSE (rank - 0.3175) / (n + 0.365) END AS p FROM (SELECT row_number() OVER (ORDER BY price, row_id) AS rank, "
    "count(*) OVER () AS n, price AS value FROM messy WHERE price IS NOT NULL))"
)


@query("h9_normal_plot", with_messy(f"SELECT rank, round({_probit_sql()}, 8) AS theoretical, value FROM placed", _PLACED))
def h9_plot(spark, folder):
    out = charts.normal_plot(_priced(spark, folder), "price")
    return out.withColumn("theoretical", F.round("theoretical", 8))


@query(
    "h9_normal_line",
    with_messy(
        "SELECT round(regr_slope(value, z), 3) AS slope, round(regr_intercept(value, z), 3) AS intercept, round(corr(value, z), 8) AS r FROM scored",
        _PLACED,
        f"scored AS (SELECT value, {_probit_sql()} AS z FROM placed)",
    ),
)
def h9_line(spark, folder):
    out = charts.normal_line(_priced(spark, folder), "price")
    return out.select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 8).alias("r"))


@query("h10_correlation_map", _corr_sql(("c_acctbal", "c_nationkey"), "customer"))
def h10(spark, folder):
    return charts.correlations(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"])


@query(
    "h11_top_values",
    union_all(
        [
            f"SELECT '{c}' AS column_name, rank, value, count, pct FROM (SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS BIGINT) AS rank, "
            f"CAST({c} AS VARCHAR) AS value, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM part GROUP BY {c}) WHERE rank <= 5"
            for c in ("p_brand", "p_type", "p_size")
        ]
    ),
)
def h11(spark, folder):
    return preview.frequent_values(table(spark, folder, "part"), ["p_brand", "p_type", "p_size"])
