"""Token ids in Simple-8b files: 64-bit words whose top four bits say how many ids of how many bits follow."""

from __future__ import annotations

import uuid
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)
from tokenizers import Tokenizer

from rinsework.llm.arrow import of_worker, slices
from rinsework.llm.clip import TextEncoder, byte_names
from rinsework.plans.cut import working_folder

#: Ids and bits per selector, fixed by the format. Selector 1 is an escape: its payload counts into the escape list.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 1
#: The first id too large for each selector but the escape.
LIMITS = np.array([1 << int(b) for s, b in enumerate(BITS) if s != ESCAPE], np.uint64)
#: For ids of up to 16 bits, how many limits they reach.
SIZES = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)
#: Ids per block: each block begins with a fresh word, so blocks decode side by side.
BLOCK = 256
#: Ids a segment holds, if its documents are not larger themselves.
SEGMENT = 1 << 20


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (unsigned 64-bit) to words, the word offset of each block, and the escapes.

    All blocks are packed side by side, one word each per round, taking the selector that holds most ids.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    large = ids >> np.uint64(60) > 0
    escapes = ids[large]
    small = ids.copy()
    small[large] = np.arange(len(escapes), dtype=np.uint64)
    starts = np.arange(0, n, BLOCK)
    limit = np.minimum(starts + BLOCK, n)
    # a row per block, small numbers throughout: how many sizes an id is too large for, and how far a size goes on
    sizes = np.full(len(starts) * BLOCK, len(LIMITS) + 1, np.uint8)
    sizes[:n] = SIZES[ids] if n and ids.max() < len(SIZES) else np.searchsorted(LIMITS, ids, "right")
    sizes[:n][large] = len(LIMITS) + 1
    sizes, ends = sizes.reshape(-1, BLOCK), (limit - starts).astype(np.int16)[:, None]
    place = np.arange(BLOCK, dtype=np.int16)
    best = np.full(sizes.shape, ESCAPE, np.int8)
    taken = sizes > len(LIMITS)
    kinds = len(LIMITS) + 2
    at = np.repeat(np.arange(len(starts)) * kinds, BLOCK) + sizes.reshape(-1)
    numbers = np.bincount(at, minlength=len(starts) * kinds).reshape(-1, kinds).cumsum(axis=1)  # of ids up to each size
    last = sizes[np.arange(len(starts)), ends[:, 0] - 1]
    for order, s in enumerate((0, *range(2, len(COUNTS)))):
        # only blocks with enough such ids, or with one at their end, can hold a run of them
        own = np.flatnonzero((numbers[:, order] >= COUNTS[s]) | (last <= order))
        if not len(own):
            continue
        if taken.all():
            break
        stop = ends[own]
        after = np.minimum.accumulate(np.where(sizes[own] <= order, stop, place)[:, ::-1], axis=1)[:, ::-1]
        after = np.minimum(after, stop)  # how far ids of so few bits go
        fits = ~taken[own] & ((after - place >= COUNTS[s]) | (after == stop) & (after > place))
        best[own] = np.where(fits, np.int8(s), best[own])
        taken[own] |= fits
    best = best.reshape(-1)
    # where words begin: all blocks step from word to word side by side
    at, row, rounds = starts.copy(), np.arange(len(starts)), []
    while len(row):
        rounds.append((row, at))
        at = at + COUNTS[best[at]]
        left = at < limit[row]
        at, row = at[left], row[left]
    owner = np.concatenate([r for r, _ in rounds]) if rounds else np.zeros(0, np.int64)
    begins = np.concatenate([x for _, x in rounds]) if rounds else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    owner, begins = owner[order], begins[order]
    words = best[begins].astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([small, np.zeros(COUNTS.max(), np.uint64)])
    for s in np.unique(best[begins]):
        if BITS[s]:
            own = np.flatnonzero(best[begins] == s)
            steps = np.arange(COUNTS[s])
            places = begins[own][:, None] + steps
            cells = padded[places] * (places < limit[owner[own]][:, None])
            words[own] |= np.bitwise_or.reduce(cells << (steps * BITS[s]).astype(np.uint64), axis=1)
    return words, np.searchsorted(owner, np.arange(len(starts))).astype(np.uint32), escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids again, selector by selector over all blocks at once."""
    out = np.zeros(n, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    sums = np.cumsum(COUNTS[selectors]) - COUNTS[selectors]
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    first = sums - sums[offsets.astype(np.int64)][block] + block * BLOCK if len(words) else sums
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selectors):
        own = np.flatnonzero(selectors == s)
        payload = words[own] & np.uint64((1 << 60) - 1)
        if s == ESCAPE:
            out[first[own]] = escapes[payload.astype(np.int64)]
            continue
        if BITS[s] == 0:
            continue
        steps = np.arange(COUNTS[s])
        values = (payload[:, None] >> (steps * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        places = first[own][:, None] + steps
        good = places < stop[own][:, None]
        out[places[good]] = values[good]
    return out


class LibraryEncoder(TextEncoder):
    """Ids by the tokenizers library, which sees each distinct pre-token once."""

    remembered = 250_000

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        super().__init__(path, {t.content: i for i, t in library.get_added_tokens_decoder().items()})
        self.merge, self.names = library.model.tokenize, byte_names()

    def ids_of(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        merge, names, out = self.merge, self.names, {}
        for piece in pieces:
            text = piece.decode("latin-1")
            if not (text.isascii() and text.isprintable()):  # other bytes have names of their own
                text = text.translate(names)
            out[piece] = array("i", [t.id for t in merge(text)]).tobytes()
        return out

    def of_letters(self, words: list[str]) -> list[bytes]:
        merge, names, id_of = self.merge, self.names, attrgetter("id")
        texts = [w if w.isascii() else w.encode().decode("latin-1").translate(names) for w in words]
        return [array("i", map(id_of, merge(text))).tobytes() for text in texts]


#: One row per segment: whole documents in order, a byte for each that says if its id is given (0 stands for an id
#: that is not), their lengths, and the packed ids.
FILE = StructType(
    [
        StructField("part", IntegerType()),
        StructField("segment", IntegerType()),
        StructField("before", LongType()),
        StructField("n_ids", LongType()),
        StructField("doc_ids", BinaryType()),
        StructField("has_id", BinaryType()),
        StructField("lengths", BinaryType()),
        StructField("words", BinaryType()),
        StructField("offsets", BinaryType()),
        StructField("escapes", BinaryType()),
    ]
)


def write(
    df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", null_ids: bool = False
) -> str:
    """Tokenise, append ``end_id`` to each text, and write the ids in ascending ``doc_id`` order.

    The files are Parquet; a row is a segment of whole documents with its Simple-8b words, the word offset of
    every block of 256 ids, and the ids of 60 bits or more apart. ``part`` and ``segment`` give the order,
    ``before`` the ids before a segment in its part. Rows
    are dealt by ranges of ``doc_id``; equal ids are ordered by text. Null texts hold the end id only. ``doc_id``
    must be an integer of up to 64 bits. With ``null_ids`` rows without one are written too, before all others and
    ordered by text (where texts with the same first 64 characters fill several tasks, by a hash among tasks); else
    they fail the job rather than get lost. Other columns are not written.
    """
    spark = df.sparkSession
    d = F.col(f"`{doc_id}`").cast("bigint")
    if not null_ids:
        d = F.coalesce(d, F.raise_error(F.lit("a doc_id is null")).cast("bigint"))
    rows = df.select(d.alias("d"), F.col(f"`{text}`").alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    begin = F.when(F.col("d").isNull(), F.substring("t", 1, 64))  # many rows may lack an id: their ranges follow the text
    ordered = rows.repartitionByRange(parts, "d", begin, F.xxhash64("t")).sortWithinPartitions("d", "t")
    ordered = ordered.select(F.spark_partition_id().alias("p"), "d", "t")

    def run(batches):
        encoder, end = of_worker(("library", path), lambda: LibraryEncoder(path)), np.array([end_id], np.int32)
        part, segment, before, docs, codes, size = 0, 0, 0, [], [], 0

        def flush():
            ids = np.concatenate(codes).view(np.uint32)
            words, offsets, escapes = pack(ids)
            cells = [
                part, segment, before, len(ids), np.array([d or 0 for d in docs], np.int64).tobytes(),
                np.array([d is not None for d in docs], np.bool_).tobytes(),
                np.array([len(c) for c in codes], np.int64).tobytes(),
                words.tobytes(), offsets.tobytes(), escapes.tobytes(),
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=FILE.names)

        for batch in batches:
            for piece in slices(batch, 2):
                part = piece.column(0)[0].as_py()
                ids, borders = encoder(piece.column(2))
                for d, a, b in zip(piece.column(1).to_pylist(), borders[:-1], borders[1:]):
                    docs.append(d)
                    codes.append(np.concatenate([ids[a:b], end]))
                    size += int(b - a) + 1
                    if size >= SEGMENT:
                        yield flush()
                        segment, before, docs, codes, size = segment + 1, before + size, [], [], 0
        if docs:
            yield flush()

    ordered.mapInArrow(run, FILE).write.mode("errorifexists").parquet(folder)
    return folder


ROWS = StructType(
    [StructField("part", IntegerType()), StructField("segment", IntegerType())]
    + [StructField(c, LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: per document doc_id (null where none was given), start (ids of all documents before it), n_tokens, ids_crc32.

    ``with_ids`` adds the ids themselves. What the driver gathers is one number per written partition; a segment
    carries the number of ids before it in its partition. No files of documents give no rows.
    """
    files = spark.read.schema(FILE).parquet(folder)
    before, bases = 0, {}
    for row in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases[row.part] = before
        before += row.n
    schema = StructType(ROWS.fields + ([StructField("ids", BinaryType())] if with_ids else []))
    shared = spark.sparkContext.broadcast(bases)

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = unpack(
                    np.frombuffer(row["words"], np.uint64), np.frombuffer(row["offsets"], np.uint32),
                    np.frombuffer(row["escapes"], np.uint64), row["n_ids"],
                ).astype("<u4")
                docs, lengths = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
                without = ~np.frombuffer(row["has_id"], np.bool_)
                ends = np.cumsum(lengths)
                bodies = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                base = shared.value[row["part"]] + row["before"]
                cells = [
                    pa.array(np.full(len(docs), row["part"], np.int32)),
                    pa.array(np.full(len(docs), row["segment"], np.int32)),
                    pa.array(docs, mask=without), pa.array(base + ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                ]
                if with_ids:
                    cells.append(pa.array(bodies, pa.binary()))
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return files.mapInArrow(run, schema)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{working_folder(spark)}/out/{name}-{uuid.uuid4().hex}"
