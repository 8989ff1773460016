"""Sums, products and pair counts of all columns at once, over the rows where both of a pair are present.

Each task turns its Arrow batches into matrices, zero where a value is missing, and adds up their products with one
another and with the masks: five numbers per pair. Rows of these matrices are summed up in two levels, so a scan of any
number of columns is one pass and no task holds more than some hundreds of rows of one column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.names import number
from rinsework.plans.onerow import measure

#: Rows that shifts are taken from: they keep digits, results do not depend on them otherwise.
PILOT_ROWS = 1000
#: Rows of a batch that are multiplied at a time, and parts of the first level of sums.
BLOCK_ROWS, PARTS = 4096, 256
#: Shifts beyond this would lose what they are taken from.
MOST_SHIFT = 1e150
#: n: rows with both; s, t: sums of the row's and of the other column; q, r: their squares; p: products.
SUMS = ("n", "s", "t", "q", "r", "p")


def _sums(batches, width: int):
    total = [np.zeros((width, width)) for _ in range(4)]
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(at, BLOCK_ROWS)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in block.columns], axis=1)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            there = there.astype(np.float64)
            for k, (a, b) in enumerate(((there, there), (x, there), (x * x, there), (x, x))):
                total[k] += a.T @ b
    n, s, q, p = total
    if n.any():
        rows = [pa.array(range(width), pa.int32())]
        for m in (n, s, s.T, q, q.T, p):
            offsets = pa.array(np.arange(width + 1, dtype=np.int32) * width)
            rows.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).reshape(-1))))
        yield pa.RecordBatch.from_arrays(rows, names=["i", *SUMS])


SCHEMA = "i int, " + ", ".join(f"{c} array<double>" for c in SUMS)


def _added(table: pa.Table) -> pa.Table:
    sums = []
    for c in SUMS:
        rows = table[c].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        sums.append(pa.array([rows.sum(axis=0)], pa.list_(pa.float64())))
    return pa.table([table["i"].slice(0, 1), *sums], names=["i", *SUMS])


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column with its place ``i`` and, for every other column, the six SUMS of values less a shift.

    Shifts are a present value per column, so a column without spread has exact zeros. Values beyond what doubles can
    square give infinite or undefined sums.
    """
    width = len(columns)
    pilot = df.select(*[number(df, c).alias(f"x{k}") for k, c in enumerate(columns)])
    shift = measure(pilot.limit(PILOT_ROWS), {k: F.median(f"x{k}") for k in range(width)})
    shift = {k: v for k, v in shift.items() if v is not None and abs(v) < MOST_SHIFT}
    cells = [(F.col(f"x{k}") - F.lit(float(shift.get(k, 0.0)))).alias(f"x{k}") for k in range(width)]
    sums = pilot.select(*cells).mapInArrow(lambda batches: _sums(batches, width), SCHEMA)
    parts = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    parts = parts.groupBy("i", "part").applyInArrow(_added, SCHEMA)
    return parts.groupBy("i").applyInArrow(_added, SCHEMA)
