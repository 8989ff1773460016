"""Small helpers shared by the tests."""

import contextlib
import io


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def values(df, column, order="row_id"):
    return [r[column] for r in df.orderBy(order).collect()]


def numbered(spark, cells, kind="double", name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(cells)], f"row_id bigint, {name} {kind}")
