"""Registry of queries and the shared messy view."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinsework.plans.cut import working_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its check, absent where SQL cannot express the result."""

    def keep(f: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the working folder."""
    return f"{working_folder(spark)}/out/{name}-{uuid.uuid4().hex}"


# Every kind of dirt, made from the clean orders table with rules both engines run. The second branch
# appends copies of some rows, so that there are duplicates to find.
_DIRT = """
SELECT {row} AS row_id,
  'ORD_' || CAST(k AS STRING) AS id,
  CASE WHEN k % 10 = 0 THEN '  Customer ' || CAST(c AS STRING) || '  '
       WHEN k % 15 = 0 THEN 'Customer  ' || CAST(c AS STRING)
       WHEN k % 21 = 0 THEN 'Customer ' || CAST(c AS STRING) || chr(9)
       ELSE 'Customer ' || CAST(c AS STRING) END AS name,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 97 = 0 THEN p * 50
       WHEN k % 53 = 0 THEN -p ELSE p END AS price,
  CASE WHEN k % 4 = 1 THEN NULL ELSE (k * 7) % 90 END AS qty,
  CASE WHEN k % 3 = 1 THEN substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4)
       WHEN k % 11 = 0 THEN 'N/A' WHEN k % 17 = 0 THEN NULL ELSE d END AS order_date_txt,
  CASE WHEN k % 19 = 0 THEN '   ' WHEN k % 7 = 0 THEN NULL ELSE s END AS dept,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 4 = 0 THEN 'True' WHEN k % 4 = 1 THEN 'Yes'
       WHEN k % 4 = 2 THEN 'False' ELSE 'No' END AS active_txt,
  'Active' AS const_col,
  CAST(NULL AS STRING) AS empty_col,
  CASE WHEN k % 4 = 1 THEN NULL ELSE (k * 7) % 90 END AS qty_copy
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p,
             substr(CAST(o_orderdate AS STRING), 1, 10) AS d, o_orderpriority AS s
      FROM {orders}) AS o"""


def messy_sql(orders: str = "orders") -> str:
    first = _DIRT.format(row="2 * k", orders=orders)
    copies = _DIRT.format(row="2 * k + 1", orders=orders) + "\nWHERE k % 40 = 0"
    return first + "\nUNION ALL" + copies


def messy(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(messy_sql("{orders}"), orders=table(spark, folder, "orders"))


def with_messy(sql: str, *more: str) -> str:
    """SQL text with the messy view (and further named queries) in front."""
    parts = [f"messy AS ({messy_sql()})", *more]
    return "WITH " + ",\n".join(parts) + "\n" + sql


MESSY_COLUMNS = (
    "id", "name", "price", "qty", "order_date_txt", "dept", "active_txt", "const_col", "empty_col", "qty_copy",
)
MESSY_NUMERIC = ("price", "qty", "qty_copy")
MESSY_TEXT = tuple(c for c in MESSY_COLUMNS if c not in MESSY_NUMERIC)

# character class of white space, as both engines spell it
SP = r"\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def tokens_sql(tokens) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in tokens)
