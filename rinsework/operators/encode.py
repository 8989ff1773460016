"""Encode categorical columns.

Every encoder that learns from the data starts from one catalog of all its columns: distinct values with their row
count, first row and target mean, combined before the one shuffle. Codes are numbered inside the catalog, by a window
per column while it is small and by ranges beyond. It is joined back by broadcast if small, else by ``attach``, which
keeps frequent values out of the shuffle. No value of the data reaches the driver, but for the column names of the dense
one-hot form. A fitted encoder can be written, loaded, and applied to the next batch or to a stream.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinsework.functions.pytext import python_text
from rinsework.names import ROW_ID, col, dtype, fresh, known, number, put, value
from rinsework.plans.cut import cut
from rinsework.plans.lookup import BROADCAST_BYTES, BROADCAST_ROWS, attach
from rinsework.plans.ordered import positions
from rinsework.streaming.guard import require_batch

# fixed values: method names
METHODS = (
    "Label Encoding",
    "One Hot Encoding",
    "Ordinal Encoding",
    "Frequency Encoding",
    "Binary Encoding",
    "Hash Encoding",
    "Target Encoding",
)


#: Columns the dense one-hot form makes at most, unless the caller allows more.
MOST_DENSE = 10_000


@dataclass(frozen=True)
class Encoder:
    """A number per category of each column, applied by joins. ``table`` has i (place in ``columns``), key (null: the
    missing value), n and code; unseen and missing values that are not in it take the fixed numbers of their column."""

    method: str
    columns: list[str]
    table: DataFrame
    result: str
    unseen: list[float | int | None]
    unseen_null: list[float | int | None]
    sizes: list[int]
    bytes: int

    @property
    def column(self) -> str:
        return self.columns[0]

    @property
    def size(self) -> int:
        return self.sizes[0]

    def code(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """Append the encoded form of each column under the name given for it."""
        small = sum(self.sizes) <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES
        for c, name in names.items():
            i = self.columns.index(c)
            key, hit, code = (fresh(n, df.columns) for n in ("key", "hit", "code"))
            own = self.table.filter(F.col("i") == i)
            keyed = df.withColumn(key, category_text(df, c))
            if small:
                model = own.select(F.col("key").alias("__key"), F.col("code").alias(code), F.lit(True).alias(hit))
                found = keyed.join(F.broadcast(model), col(key).eqNullSafe(F.col("__key")), "left")
            else:
                model = own.select("key", "n", F.col("code").alias(code), F.lit(True).alias(hit))
                found = attach(keyed, model, {key: "key"}, [code, hit], "n")
            missing = F.when(col(key).isNull(), F.lit(self.unseen_null[i])).otherwise(F.lit(self.unseen[i]))
            coded = F.when(col(hit), col(code)).otherwise(missing.cast(self.result)).cast(self.result)
            df = found.select(*[col(x) for x in df.columns], coded.alias(name))
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        """The known columns in encoded form; others stay."""
        new = {}
        for c in known(df, self.columns):
            new[c] = fresh("new", df.columns + list(new.values()))
        coded = self.code(df, new)
        return coded.select(*[col(new[c]).alias(c) if c in new else col(c) for c in df.columns])

    def write(self, path: str) -> None:
        """Keep the encoder in a folder: the catalog and a row of what belongs to it."""
        self.table.write.parquet(f"{path}/catalog")
        rest = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "table"}
        self.table.sparkSession.createDataFrame([(json.dumps(rest),)], "encoder string").coalesce(1).write.parquet(f"{path}/encoder")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        rest = json.loads(spark.read.parquet(f"{path}/encoder").first()[0])
        return Encoder(table=spark.read.parquet(f"{path}/catalog"), **rest)


def category_text(df: DataFrame, name: str) -> Column:
    return python_text(value(df, name), dtype(df, name))


def _catalog(df: DataFrame, columns: list[str], extra: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """Columns i, key (null included), n and the aggregates over ``extra``: one shuffle for all columns."""
    cells = [
        F.struct(F.lit(i).alias("i"), category_text(df, c).alias("key"), *[e.alias(n) for n, e in extra.items()])
        for i, c in enumerate(columns)
    ]
    long = df.select(F.inline(F.array(*cells)))
    return long.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n"), *aggregates)


def _numbered(table: DataFrame, order: str, sizes: list[int], small: int) -> DataFrame:
    """Append the 0-based place of each value among those of its column."""
    if sum(sizes) <= small:
        place = F.row_number().over(Window.partitionBy("i").orderBy(order)) - 1
        return table.withColumn("code", place.cast("long"))
    starts = F.array(*[F.lit(sum(sizes[:i])).cast("long") for i in range(len(sizes))])
    placed = positions(table, ["i", order], "code")
    return placed.withColumn("code", F.col("code") - F.get(starts, F.col("i")))


def fit_encoder(
    df: DataFrame,
    columns: list[str],
    method: str,
    target_column: str | None = None,
    order_by: str = ROW_ID,
    small: int = BROADCAST_ROWS,
    least: float = 20.0,
    smoothing: float = 10.0,
) -> Encoder:
    """Learn the codes of the known columns.

    Label: 0..k-1 in sorted text order; missing stays missing. Ordinal, Binary and One Hot: 1..k in order of first
    appearance, a missing value included; unseen values take -1, an unseen missing one -2. Frequency: share among the
    non-missing rows. Target: category mean of the target, drawn to the overall mean where a category is rare.
    """
    require_batch(df, f"fit_encoder ({method})")
    columns = known(df, columns)
    if method not in METHODS or method == "Hash Encoding":
        raise ValueError(f"nothing to learn for: {method}")
    extra: dict[str, Column] = {}
    aggregates: list[Column] = []
    if method == "Target Encoding":
        if not target_column or target_column not in df.columns:
            raise ValueError("target encoding needs an existing target column")
        extra, aggregates = {"y": number(df, target_column)}, [F.count("y").alias("known"), F.sum("y").alias("total")]
    elif method not in ("Label Encoding", "Frequency Encoding"):
        extra, aggregates = {"seen": col(order_by)}, [F.min("seen").alias("first")]
    if not columns:
        table = df.sparkSession.createDataFrame([], "i int, key string, n long, code double")
        return Encoder(method, [], table, "double", [], [], [], 0)
    table = _catalog(df, columns, extra, aggregates)
    if method in ("Label Encoding", "Frequency Encoding"):
        table = table.filter("key is not null")
    table = cut(table)
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + 24
    sums = [F.count(F.lit(1)).alias("size"), F.sum(size).alias("bytes"), F.sum("n").alias("rows")]
    sums += [F.sum("known").alias("known"), F.sum("total").alias("total")] if method == "Target Encoding" else []
    got = {r["i"]: r for r in table.groupBy("i").agg(*sums).collect()}
    sizes = [got[i]["size"] if i in got else 0 for i in range(len(columns))]
    held = sum(r["bytes"] for r in got.values())
    n = len(columns)
    if method == "Label Encoding":
        return Encoder(method, columns, cut(_numbered(table, "key", sizes, small)), "bigint", [None] * n, [None] * n, sizes, held)
    if method == "Frequency Encoding":
        rows = F.array(*[F.lit(float(got[i]["rows"]) if i in got else 1.0) for i in range(n)])
        return Encoder(method, columns, table.withColumn("code", F.col("n") / F.get(rows, F.col("i"))), "double", [None] * n, [None] * n, sizes, held)
    if method == "Target Encoding":
        prior = got[0]["total"] / got[0]["known"] if 0 in got and got[0]["known"] else None
        weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("known") - F.lit(least)) / F.lit(smoothing)))
        own = F.coalesce(F.try_divide("total", "known"), F.lit(prior))
        return Encoder(method, columns, table.withColumn("code", F.lit(prior) * (1 - weight) + own * weight), "double", [prior] * n, [prior] * n, sizes, held)
    numbered = _numbered(table, "first", sizes, small).withColumn("code", F.col("code") + 1)
    return Encoder(method, columns, cut(numbered), "bigint", [-1] * n, [-2] * n, sizes, held)


def fit_label(df: DataFrame, column: str, small: int = BROADCAST_ROWS) -> Encoder:
    """0..k-1 in sorted text order; missing stays missing."""
    return fit_encoder(df, [column], "Label Encoding", small=small)


def fit_ordinal(df: DataFrame, column: str, order_by: str = ROW_ID, small: int = BROADCAST_ROWS) -> Encoder:
    """1..k in order of first appearance, a missing value included."""
    return fit_encoder(df, [column], "Ordinal Encoding", order_by=order_by, small=small)


def fit_frequency(df: DataFrame, column: str) -> Encoder:
    """Share among the non-missing rows."""
    return fit_encoder(df, [column], "Frequency Encoding")


def fit_target(df: DataFrame, column: str, target: str, least: float = 20.0, smoothing: float = 10.0) -> Encoder:
    """Category mean of the target, drawn to the overall mean where a category is rare."""
    return fit_encoder(df, [column], "Target Encoding", target, least=least, smoothing=smoothing)


def one_hot(df: DataFrame, columns: list[str], order_by: str = ROW_ID, max_categories: int | None = None) -> DataFrame:
    """Columns ``{column}_{value}`` in order of appearance in place of each source column.

    Every value gets a column. Their number is known before any name is fetched: more than ``max_categories`` in a column,
    or MOST_DENSE in all where that is not given, are refused; ``one_hot_sparse`` takes any number. A name that is taken
    already, as by a text ``nan`` beside a missing value, gets underscores behind it.
    """
    model = fit_encoder(df, columns, "One Hot Encoding", order_by=order_by)
    for c, size in zip(model.columns, model.sizes):
        if max_categories is not None and size > max_categories:
            raise ValueError(f"column {c!r} has more than {max_categories} categories")
    if max_categories is None and sum(model.sizes) > MOST_DENSE:
        raise ValueError(f"{sum(model.sizes)} categories are too many for a column each: take one_hot_sparse, or give max_categories")
    taken = [c for c in df.columns if c not in model.columns]
    indicators: dict[str, list[Column]] = {c: [] for c in model.columns}
    for r in model.table.orderBy("i", "code").collect():
        c = model.columns[r["i"]]
        name = fresh(f"{c}_{'nan' if r['key'] is None else r['key']}", taken)
        taken.append(name)
        hit = category_text(df, c).eqNullSafe(F.lit(r["key"]).cast("string"))
        indicators[c].append(hit.cast("bigint").alias(name))
    out: list[Column] = []
    for c in df.columns:
        out += indicators.get(c, [col(c)])
    return df.select(*out)


def sparse_index(model: Encoder) -> DataFrame:
    """What each place of the sparse vectors of a fitted one-hot encoder means: index, column_name, value."""
    starts = F.array(*[F.lit(sum(model.sizes[:i])).cast("long") for i in range(len(model.sizes))])
    names = F.array(*[F.lit(c) for c in model.columns])
    return model.table.select(
        (F.get(starts, F.col("i")) + F.col("code") - 1).alias("index"), F.get(names, F.col("i")).alias("column_name"), F.col("key").alias("value")
    )


def sparse_vectors(df: DataFrame, model: Encoder, name: str = "features") -> DataFrame:
    """Replace the columns of a fitted one-hot encoder by one struct column (size, indices, values).

    A row has a 1.0 at the place of each of its values: places of a column follow those of the columns before it, inside it
    they go by first appearance. A value the encoder has not seen has no place. These are the arguments of a sparse vector.
    """
    present = known(df, model.columns)
    codes: dict[str, str] = {}
    for c in present:
        codes[c] = fresh("code", df.columns + list(codes.values()))
    coded = model.code(df, codes)
    places = []
    for c, code in codes.items():
        start = sum(model.sizes[: model.columns.index(c)])
        places.append((start, F.when(col(code) > 0, col(code) + F.lit(start - 1))))
    indices = F.array_compact(F.array(*[p for _, p in sorted(places, key=lambda x: x[0])]))
    vector = F.struct(
        F.lit(sum(model.sizes)).cast("long").alias("size"),
        indices.cast("array<bigint>").alias("indices"),
        F.transform(indices, lambda _: F.lit(1.0)).alias("values"),
    )
    kept = [c for c in df.columns if c not in codes]
    return coded.select(*[col(c) for c in kept], vector.alias(fresh(name, kept)))


def one_hot_sparse(df: DataFrame, columns: list[str], name: str = "features", order_by: str = ROW_ID) -> DataFrame:
    """One-hot of any number of categories as sparse vectors; see ``sparse_vectors`` and, for their places, ``sparse_index``."""
    return sparse_vectors(df, fit_encoder(df, columns, "One Hot Encoding", order_by=order_by), name)


def binary(df: DataFrame, columns: list[str], order_by: str = ROW_ID) -> DataFrame:
    """Ordinal code in base 2: columns ``{column}_0`` (highest bit) onwards replace the source.

    All other columns stay; a digit column whose name is taken gets underscores behind its name.
    """
    return binary_digits(df, fit_encoder(df, columns, "Binary Encoding", order_by=order_by))


def binary_digits(df: DataFrame, model: Encoder) -> DataFrame:
    """Apply a fitted binary encoder."""
    sources, codes = df.columns, {}
    for c in known(df, model.columns):
        codes[c] = fresh("code", sources + list(codes.values()))
    df = model.code(df, codes)
    taken = [c for c in sources if c not in codes]
    out: list[Column] = []
    for c in sources:
        if c not in codes:
            out.append(col(c))
            continue
        code, digits = col(codes[c]), max(1, math.ceil(math.log2(model.sizes[model.columns.index(c)] + 1)))
        for d in range(digits):
            name = fresh(f"{c}_{d}", taken)
            taken.append(name)
            # unseen codes are negative and have no bits
            bit = F.shiftright(code, digits - 1 - d).bitwiseAND(F.lit(1))
            out.append(F.when(code > 0, bit).otherwise(0).cast("bigint").alias(name))
    return df.select(*out)


def hashed(df: DataFrame, columns: list[str], n_components: int = 8) -> DataFrame:
    """Counts per md5 bucket over the chosen columns: ``col_0`` onwards first, sources dropped.

    Row-local. A missing cell is hashed as the text ``nan``.
    """
    buckets = [_md5_bucket(F.coalesce(category_text(df, c), F.lit("nan")), n_components) for c in columns]
    counts = []
    for i in range(n_components):
        total = F.lit(0).cast("bigint")
        for b in buckets:
            total = total + (b == F.lit(i)).cast("bigint")
        counts.append(total.alias(f"col_{i}"))
    return df.select(*counts, *[col(c) for c in df.columns if c not in columns])


def _md5_bucket(text: Column, n: int) -> Column:
    """128-bit digest modulo n, folded in 32-bit pieces so that BIGINT is enough."""
    digest = F.md5(text.cast("binary"))
    left = F.lit(0).cast("bigint")
    for i in range(4):
        piece = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        left = (left * F.lit(2**32 % n) + piece) % F.lit(n)
    return left


def encode_categorical(
    df: DataFrame,
    columns: list[str],
    method: str,
    target_column: str | None = None,
    n_components: int = 8,
    order_by: str = ROW_ID,
    max_categories: int | None = None,
) -> DataFrame:
    """Encode the known columns with one of the seven methods."""
    if method not in METHODS:
        raise ValueError(f"unknown encoding: {method}")
    columns = known(df, columns)
    if not columns:
        return df
    if method == "Hash Encoding":
        return hashed(df, columns, n_components)
    require_batch(df, f"encode_categorical ({method})")
    if method == "One Hot Encoding":
        return one_hot(df, columns, order_by, max_categories)
    if method == "Binary Encoding":
        return binary(df, columns, order_by)
    return fit_encoder(df, columns, method, target_column, order_by).apply(df)
