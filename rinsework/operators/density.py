"""Neighbourhood outliers of one numeric column.

Both detectors judge a row by its value alone, so they work on distinct values with row counts: a value
that fills a third of the table is one record. In value order the neighbours of a value are next to it,
so equal blocks of the ordered values with a halo of neighbouring records give exact answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.plans.cut import cut
from rinsework.plans.onerow import measure
from rinsework.plans.ordered import positions, running_sum, with_halo


def _ordered_values(filled: DataFrame) -> DataFrame:
    counted = filled.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return positions(counted, ["value"], "pos")


def noise_values(
    filled: DataFrame, eps: float, min_samples: int, block_rows: int | None = None
) -> DataFrame:
    """Values that are noise: not core, and no core value within ``eps`` (in standard deviations).

    A value is core when at least ``min_samples`` rows, itself included, lie within ``eps``. Each distinct
    value counts at least once, so ``min_samples - 1`` values either side decide. A core within ``eps`` is
    also that near: more non-core values between would all lie within ``eps`` of each other and be core.
    """
    got = measure(filled, {"mean": F.avg("value"), "std": F.stddev_pop("value")})
    std = got["std"] or 1.0
    z = (F.col("value") - F.lit(got["mean"])) / F.lit(std)
    values = _ordered_values(filled).withColumn("z", z)
    reach = max(1, min_samples - 1)
    blocks = with_halo(values, "pos", 2 * reach, block_rows)
    w = Window.partitionBy("block").orderBy("pos")
    around = F.collect_list(F.struct("z", "n")).over(w.rowsBetween(-reach, reach))
    near = F.filter(around, lambda o: F.abs(o["z"] - F.col("z")) <= F.lit(eps))
    rows_near = F.aggregate(near, F.lit(0).cast("bigint"), lambda s, o: s + o["n"])
    cored = blocks.withColumn("core", rows_near >= F.lit(min_samples))
    core_z = F.when(F.col("core"), F.col("z"))
    below = F.last(core_z, ignorenulls=True).over(w.rowsBetween(-reach, -1))
    above = F.first(core_z, ignorenulls=True).over(w.rowsBetween(1, reach))
    judged = cored.withColumn("below", below).withColumn("above", above)
    touched = (F.col("z") - F.col("below") <= F.lit(eps)) | (F.col("above") - F.col("z") <= F.lit(eps))
    noise = judged.filter(F.col("home") & ~F.col("core") & ~F.coalesce(touched, F.lit(False)))
    return cut(noise.select("value", "n", F.lit(True).alias("hit")))


def local_outlier_factors(filled: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """Local outlier factor of every distinct value: columns value, n, lof.

    The k nearest rows of a row are its own copies first, then the values beside it; equal distances go
    to the smaller value. Three passes (k-distance, reachability density, factor) each look k values
    either side, so one halo of 3k serves them all.
    """
    values = _ordered_values(filled)
    blocks = with_halo(values, "pos", 3 * k, block_rows)
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(-k, k)
    me = F.col("value")

    def neighbours(*extra: str) -> Column:
        seen = F.collect_list(F.struct("value", F.col("n").alias("n"), *extra)).over(w)
        # one copy of the value is the row itself
        others = F.transform(
            seen,
            lambda o: F.struct(
                F.abs(o["value"] - me).alias("d"),
                o["value"].alias("v"),
                (o["n"] - F.when(o["value"] == me, 1).otherwise(0)).alias("n"),
                *[o[e].alias(e) for e in extra],
            ),
        )
        return F.array_sort(F.filter(others, lambda o: o["n"] > 0))

    def weighted(near: str, what) -> Column:
        """Mean over the first k rows of ``what`` for each neighbour."""
        start = F.struct(F.lit(k).cast("bigint").alias("left"), F.lit(0.0).alias("sum"))

        def take(state, o):
            used = F.least(state["left"], o["n"])
            return F.struct(
                (state["left"] - used).alias("left"), (state["sum"] + used * what(o)).alias("sum")
            )

        return F.aggregate(F.col(near), start, take, lambda s: s["sum"] / F.lit(float(k)))

    reached = F.aggregate(
        F.col("near"),
        F.struct(F.lit(k).cast("bigint").alias("left"), F.lit(0.0).alias("far")),
        lambda s, o: F.struct(
            (s["left"] - F.least(s["left"], o["n"])).alias("left"),
            F.when(s["left"] > 0, o["d"]).otherwise(s["far"]).alias("far"),
        ),
        lambda s: s["far"],
    )
    first = blocks.withColumn("near", neighbours()).withColumn("kdist", reached).drop("near")
    second = first.withColumn("near", neighbours("kdist"))
    density = F.lit(1.0) / (weighted("near", lambda o: F.greatest(o["kdist"], o["d"])) + F.lit(1e-10))
    second = second.withColumn("lrd", density).drop("near")
    third = second.withColumn("near", neighbours("lrd"))
    factor = weighted("near", lambda o: o["lrd"]) / F.col("lrd")
    return third.filter("home").select("value", "n", factor.alias("lof"))


def local_outlier_values(
    filled: DataFrame, k: int, contamination: float, block_rows: int | None = None
) -> DataFrame:
    """Values whose factor lies above the (1 - contamination) quantile over all rows."""
    # rounding hides the last bits, which depend on the order of summation
    factors = cut(
        local_outlier_factors(filled, k, block_rows).withColumn("lof", F.round(F.col("lof"), 9))
    )
    # quantile of the negated factor, as ranks over rows
    by_factor = factors.groupBy((-F.col("lof")).alias("score")).agg(F.sum("n").alias("n"))
    ranked = cut(running_sum(by_factor, ["score"], "n", "before"))
    total = measure(factors, {"n": F.sum("n")})["n"]
    place = contamination * (total - 1)
    lower, upper = int(place), min(int(place) + 1, total - 1)
    at = {
        r: F.min(F.when((F.col("before") <= r) & (F.col("before") + F.col("n") > r), F.col("score")))
        for r in {lower, upper}
    }
    found = measure(ranked, at)
    bound = found[lower] + (found[upper] - found[lower]) * (place - lower)
    return cut(
        factors.filter(-F.col("lof") < F.lit(bound)).select("value", "n", F.lit(True).alias("hit"))
    )
