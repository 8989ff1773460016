"""Line dedup by spread: lines that stand on many sites are boilerplate and go.

How many sites a line is on is estimated by one HyperLogLog sketch per line hash, merged by aggregation, so the
shuffle holds a sketch per line and task however often the line occurs. Lines whose estimate is near the threshold
get an exact distinct count; for all others the estimate decides, as its error cannot reach the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.plans.cut import cut

MIN_SITES = 10
#: Log2 of a sketch's buckets: a relative error of 1.04 / 64, about 1.6 %, and none below some hundred sites.
LOG2_BUCKETS = 12
#: Estimates within this share of the threshold are counted exactly: six times the relative error.
NEAR = 0.1

#: White space that does not tell lines apart at their ends, fixed.
EDGES = " \t\x0b\x0c\r"


def _normal(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES))


def _lines(df: DataFrame, text: Column) -> DataFrame:
    """A row per line that is not blank: its document, place, site and hash."""
    cells = df.select("d", "key", "site", F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return cells.filter(_normal(F.col("line")) != "").select("d", "key", "site", "place", F.xxhash64(_normal(F.col("line"))).alias("line"))


def shared_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, and the smallest document that holds each."""
    spread = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LOG2_BUCKETS)).alias("sketch"), F.min("d").alias("first")
    )
    spread = spread.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = cut(spread.filter(F.col("sites") >= F.lit(min_sites * (1 - NEAR))))
    near = spread.filter(F.col("sites") <= F.lit(min_sites * (1 + NEAR)))
    sure = spread.filter(F.col("sites") > F.lit(min_sites * (1 + NEAR)))
    # only near-threshold lines have their sites made distinct, so a line on one site costs a row per task whatever its count
    pairs = lines.filter(F.col("site").isNotNull()).select("line", "site").join(near.select("line"), "line", "left_semi").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("n"))
    found = near.join(exact.filter(F.col("n") >= min_sites), "line", "left_semi")
    return sure.unionByName(found).select("line", "first")


def drop_shared_lines(
    df: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES
) -> DataFrame:
    """Take lines that stand on ``min_sites`` sites or more out of all documents but the first that holds them.

    A line is what lies between line feeds; white space at its ends does not tell lines apart, and blank lines
    are never taken out. The document with the smallest ``doc_id`` keeps its lines, so that a text copied to many
    sites stays whole once. Returns a row per input row: the row as struct ``row``, n_lines (not blank),
    n_removed, and ``kept``, the remaining lines joined by line feeds.

    A null site counts for no site; a null text has no lines and stays null; an empty text stays empty; rows
    without a ``doc_id`` never count as first and lose all shared lines, also where no row that holds the line has one. Repeated rows are treated alike. Lines are told apart by 64-bit
    hashes. Only hashes and places are shuffled by line; texts are shuffled once, by document.
    """
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{doc_id}`").alias("d"),
        F.xxhash64(F.col(f"`{text}`")).alias("key"),
        F.col(f"`{site}`").alias("site"),
    )
    body = F.col(f"row.`{text}`")  # inside the row only, so that the join ships it once
    lines = _lines(rows, body)
    shared = shared_lines(lines, min_sites)
    hits = lines.join(shared, "line").filter(~F.coalesce(F.col("d") == F.col("first"), F.lit(False)))
    gone = hits.groupBy(F.col("d").alias("d2"), F.col("key").alias("key2")).agg(F.collect_set("place").alias("gone"))
    rows = rows.join(gone, F.col("d").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("key2")), "left")
    rows = rows.withColumn("all", F.split(body, "\n"))
    all_ = F.col("all")
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone")
    kept = F.array_join(F.transform(places, lambda i: F.get(all_, i)), "\n")
    return rows.select(
        "row",
        F.when(body.isNull(), 0).otherwise(F.size(F.filter("all", lambda x: _normal(x) != ""))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), body).otherwise(kept).alias("kept"),
    )


def dedup_lines(
    df: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES
) -> DataFrame:
    """The documents without their shared lines, in their own columns; those that had nothing else are left out."""
    marked = drop_shared_lines(df, text, site, doc_id, min_sites)
    left = marked.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
