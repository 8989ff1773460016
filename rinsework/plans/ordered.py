"""Row order across partitions: positions, running sums, halos and fills.

None of these sends the table through an unpartitioned window. Rows are laid out by range,
each range is handled on its own, and only one small record per range crosses ranges.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsework.names import ROW_ID, col, dtype, is_numeric
from rinsework.plans.cut import cut
from rinsework.plans.onerow import measure

ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 10_000
BLOCK_ROWS = 200_000


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Append the 0-based place of every row in the total order.

    Range partitioning on all order columns splits ties of the first one, so ``order`` should
    end with a unique column. The layout is cut, then one count per range gives the offsets.
    """
    by = [col(c) for c in order]
    laid = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("__seat", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id: partition number above bit 33, row number below
    part = F.shiftright("__seat", 33).cast("int")
    sizes = sorted((r[0], r[1]) for r in laid.groupBy(part).count().collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = _small(
        df.sparkSession, [(p, s) for (p, _), s in zip(sizes, starts)], "__part int, __start bigint"
    )
    seated = laid.withColumn("__part", part).join(offsets, "__part", "inner")
    place = F.col("__start") + F.col("__seat").bitwiseAND(F.lit((1 << 33) - 1))
    return seated.select(*[col(c) for c in df.columns], place.alias(name))


def running_sum(df: DataFrame, order: list[str], what: str, name: str) -> DataFrame:
    """Append the sum of ``what`` over all earlier rows of the total order, this row excluded."""
    placed = positions(df, order, "__pos")
    block_rows = max(BLOCK_ROWS, placed.count() // MAX_RANGES)
    block = F.floor(F.col("__pos") / block_rows)
    placed = placed.withColumn("__block", block)
    totals = sorted((r[0], r[1] or 0) for r in placed.groupBy("__block").agg(F.sum(col(what))).collect())
    starts = [0, *accumulate(n for _, n in totals)]
    carried = _small(
        df.sparkSession, [(b, s) for (b, _), s in zip(totals, starts)], "__block bigint, __before bigint"
    )
    w = Window.partitionBy("__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(col(what)).over(w), F.lit(0))
    summed = placed.withColumn("__inside", inside).join(carried, "__block", "inner")
    return summed.select(*[col(c) for c in df.columns], (F.col("__before") + F.col("__inside")).alias(name))


def with_halo(placed: DataFrame, position: str, halo: int, block_rows: int | None = None) -> DataFrame:
    """Cut positioned rows into equal blocks and copy the ``halo`` rows on either side into each.

    Adds ``block`` and ``home``; frames of up to ``halo`` rows inside a block see what they would
    see in the whole table, for rows with ``home`` true. Blocks are spread over as many tasks.
    """
    rows = placed.count()
    parallel = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if block_rows is None:
        block_rows = min(BLOCK_ROWS, rows // parallel + 1)
        block_rows = max(block_rows, 16 * halo)
    block_rows = max(block_rows, 4 * halo)
    p = F.col(position)
    own = F.floor(p / block_rows)
    near = F.array_distinct(
        F.array(F.floor((p - halo) / block_rows), own, F.floor((p + halo) / block_rows))
    )
    spread = placed.withColumn("__own", own).withColumn("block", F.explode(near))
    tasks = max(1, min(MAX_RANGES, rows // block_rows + 1))
    return spread.withColumn("home", F.col("block") == F.col("__own")).drop("__own").repartition(tasks, "block")


def _as_double(df: DataFrame, name: str) -> Column | None:
    t = dtype(df, name)
    if is_numeric(t):
        return col(name).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    return None


def _ranged(df: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """Append ``__range``: a number that grows with the order and holds a bounded share of rows."""
    first = _as_double(df, order[0])
    if first is not None:
        n = measure(df, {"n": F.count(F.lit(1))})["n"]
        if ranges is None:
            parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ranges = max(1, min(MAX_RANGES, max(n // ROWS_PER_RANGE, min(parallel, n // 1000))))
        if ranges == 1:
            return df.withColumn("__range", F.lit(0.0))
        shares = [i / ranges for i in range(1, ranges)]
        cuts = df.agg(F.percentile_approx(first, shares, max(10_000, 20 * ranges))).first()[0] or []
        if len(set(cuts)) == len(cuts):
            splits = [float("-inf"), *cuts, float("inf")]
            # a missing order value sorts first, so it belongs to the first range
            keyed = df.withColumn("__as_double", F.coalesce(first, F.lit(float("-inf"))))
            bucketer = Bucketizer(
                splits=splits, inputCol="__as_double", outputCol="__range", handleInvalid="keep"
            )
            return bucketer.transform(keyed).drop("__as_double")
    # many rows share one order value: let the range partitioner split on the tie-break too
    by = [col(c) for c in order]
    return cut(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id().cast("double")))


def carry_fill(
    df: DataFrame,
    columns: list[str],
    order_by: str = ROW_ID,
    backward: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Fill missing cells with the nearest earlier (or later) value in table order."""
    order = [order_by] if order_by == ROW_ID or ROW_ID not in df.columns else [order_by, ROW_ID]
    ranged = _ranged(df, order, ranges)
    ordering = F.struct(*[col(c) for c in order])
    pick = F.min_by if backward else F.max_by
    edges = (
        ranged.groupBy("__range")
        .agg(
            *[
                pick(_present(df, c), F.when(_present(df, c).isNotNull(), ordering)).alias(f"e{i}")
                for i, c in enumerate(columns)
            ]
        )
        .collect()
    )
    carried, seen = [], [None] * len(columns)
    for edge in sorted(edges, key=lambda r: r["__range"], reverse=backward):
        carried.append((edge["__range"], *seen))
        seen = [edge[f"e{i}"] if edge[f"e{i}"] is not None else s for i, s in enumerate(seen)]
    schema = T.StructType(
        [T.StructField("__range", T.DoubleType())]
        + [T.StructField(f"__c{i}", dtype(df, c)) for i, c in enumerate(columns)]
    )
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, schema))
    by = [col(c).desc() if backward else col(c).asc() for c in order]
    w = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        *[col(c) for c in df.columns],
        "__range",
        *[F.last(_present(df, c), ignorenulls=True).over(w).alias(f"__l{i}") for i, c in enumerate(columns)],
    )
    joined = local.join(carry, "__range", "left")
    new = {c: F.coalesce(F.col(f"__l{i}"), F.col(f"__c{i}")) for i, c in enumerate(columns)}
    return joined.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def _present(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c
