"""Connected components by alternating large and small stars, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rinsework.plans.cut import drop, kept
from rinsework.plans.lookup import BROADCAST_ROWS, HOT_KEYS

#: Narrow rows a task takes at least, and the tasks that even little data is spread over.
ROWS_PER_TASK, LEAST_TASKS = 250_000, 12


def tasks(rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks suit so many rows. Rounds over little data would else leave files by the square of all partitions."""
    return max(LEAST_TASKS, -(-rows // per_task))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """The least neighbour of each vertex and how many it has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _met(edges: DataFrame, least: DataFrame, size: Row) -> DataFrame:
    """Edges with the least neighbour ``m`` of their ``u``. Few vertices are broadcast; of many, the hubs are, of which
    there are at most HOT_KEYS, so a hub's edges stay where they are. ``size`` has the vertices and their edges."""
    table = least.select(F.col("u").alias("k"), "m", "n")
    here = F.col("u") == F.col("k")
    if size.rows <= BROADCAST_ROWS:
        return edges.join(F.broadcast(table), here).select("u", "v", "m")
    hub = F.col("n") * HOT_KEYS >= size.edges
    hubs = F.broadcast(table.filter(hub))
    of_hubs = edges.join(hubs, here).select("u", "v", "m")
    others = edges.join(hubs, here, "left_anti").join(table.filter(~hub), here).select("u", "v", "m")
    return of_hubs.unionByName(others)


def _size(least: DataFrame) -> Row:
    """Vertices, their edges, and the vertices that have a smaller neighbour and another one besides."""
    more = F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))
    return least.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("edges"), more.alias("open")).first()


def _small_star(edges: DataFrame, n: int) -> tuple[DataFrame, str]:
    """A vertex and its smaller neighbours are tied to the least of them. Edges run from larger to smaller."""
    least, path = kept(_least_neighbour(edges).coalesce(n))
    rest = _met(edges, least, _size(least)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct(), path


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``edges`` has two integer columns; returns (vertex, root) for each vertex with an edge to another.

    ``root`` is the least vertex of the component, and a root comes with itself. Loops, repeated edges and edges
    with a null end add nothing; no edges give no rows. ``most`` is the number of edges there may be, for a suitable
    number of tasks. Each round is a table on the shared folder, removed when the next one stands; the rounds end when
    no vertex with a smaller neighbour has another one, as then all are stars around their least vertex, which takes a
    few for shallow graphs and a logarithm of them for chains.
    """
    spark, (u, v) = edges.sparkSession, (F.col(f"`{c}`").cast("bigint") for c in edges.columns[:2])
    pairs = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    stars, path = kept(pairs if most is None else pairs.coalesce(tasks(most)), "stars")
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours of a vertex are tied to the least vertex it knows
        found = _least_neighbour(both)
        least, used = kept(found if most is None else found.coalesce(tasks(most)))
        size = _size(least)
        if not size.open:
            drop(spark, used)
            break
        most = size.edges // 2
        larger = _met(both.filter(F.col("v") > F.col("u")), least, size)
        half, half_path = kept(larger.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).coalesce(tasks(most)))
        small, used_too = _small_star(half, tasks(most))
        stars, new_path = kept(small.coalesce(tasks(most)), "stars")
        drop(spark, path, used, half_path, used_too)
        path = new_path
    roots = stars.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
