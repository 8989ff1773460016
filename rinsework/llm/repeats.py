"""Substring dedup by fixed-block anchors: repeated runs of words, found without comparing documents in pairs.

Of any run of ``window`` words, some aligned block of (window + 1) // 2 words lies inside it, wherever it starts.
So every document indexes its non-overlapping blocks and probes the index with all its rolling block windows. A
hit (a block's content that occurs elsewhere too) is extended to the runs of ``window`` words that hold it, and
those that occur again are joined to maximal repeated spans.

Index and probes meet by hash range: a chunk of documents sends one packed array per range, not a row per word,
and gets back one bit per sent hash. So a passage that a third of the documents share costs no more than other text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from rinsework.llm.arrow import inside_documents, strings, window_hashes, word_hashes, word_spans

#: Words of the shortest repeat that counts.
WINDOW = 35
#: Text bytes per chunk of documents, and hashes per hash range: each is one task's unit of work. There are at
#: least LEAST of either, so that small tables spread out too.
CHUNK_BYTES = 2 << 20
RANGE_HASHES = 4 << 20
LEAST = 64

#: White space in bytes, fixed: tab to carriage return, and blank.
BLANKS = (9, 10, 11, 12, 13, 32)

MESSAGE = StructType(
    [
        StructField("chunk", IntegerType()),
        StructField("range", IntegerType()),
        StructField("kind", IntegerType()),
        StructField("data", BinaryType()),
    ]
)
HASHES, CANDIDATES, ANSWER = 0, 1, 2


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cells = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cells, kinds)], names=MESSAGE.names)


def _dealt(values: np.ndarray, ranges: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The values of each range, in their order."""
    small = ranges.astype(np.uint16 if n <= 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[order], np.arange(n + 1))
    values = values[order]
    return [(r, values[edges[r] : edges[r + 1]]) for r in np.flatnonzero(np.diff(edges))]


def _marked(ranges: np.ndarray, answers: dict[int, bytes], n: int) -> np.ndarray:
    """The bits that came back, put where their hashes were."""
    out = np.zeros(len(ranges), bool)
    if answers:
        small = ranges.astype(np.uint16 if n <= 1 << 16 else np.uint32)
        order = np.argsort(small, kind="stable")
        edges = np.searchsorted(small[order], np.arange(n + 1))
        for r, bits in answers.items():
            own = order[edges[r] : edges[r + 1]]
            out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return out


class Chunk:
    """The words of some documents and the hashes of their windows."""

    def __init__(self, column: pa.ChunkedArray, window: int, ranges: int):
        self.window, self.block, self.ranges = window, (window + 1) // 2, ranges
        self.data, self.offsets = strings(column)
        blank = np.zeros(256, bool)
        blank[list(BLANKS)] = True
        self.starts, self.stops, self.borders = word_spans(~blank[self.data], self.offsets)
        self.words = word_hashes(self.data, self.starts, self.stops)

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        """The top half of a hash, scaled to the number of ranges."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Where rolling block windows begin, and their hashes."""
        at = np.flatnonzero(inside_documents(self.borders, self.block))
        return at, window_hashes(self.words, self.block)[at]

    def blocks(self) -> list[tuple[int, np.ndarray]]:
        """Per range 32 bits per rolling window: the low half of its hash, whose last bit says if it is indexed too."""
        at, hashes = self.probes()
        inside = at - np.repeat(self.borders[:-1], np.diff(self.borders))[at]
        cells = (hashes & np.uint64(0xFFFFFFFE)).astype(np.uint32)
        cells |= (inside % self.block == 0).astype(np.uint32)
        return _dealt(cells, self.range_of(hashes), self.ranges)

    def candidates(self, answers: dict[int, bytes]) -> np.ndarray:
        """The windows that hold a hit."""
        at, hashes = self.probes()
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[at[_marked(self.range_of(hashes), answers, self.ranges)] + 1] = 1
        sums = np.cumsum(hits)
        first = np.flatnonzero(inside_documents(self.borders, self.window))
        return first[sums[first + self.window - self.block + 1] > sums[first]]

    def window_ranges(self, at: np.ndarray) -> np.ndarray:
        return self.range_of(window_hashes(self.words, self.window, 1)[at])

    def windows(self, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Per range the hashes of these windows. Range and hash come from two independent hashes."""
        return _dealt(window_hashes(self.words, self.window)[at], self.window_ranges(at), self.ranges)


def _answered(table: pa.Table, found) -> pa.Table:
    """For the hashes of one range from all chunks, the bits that ``found`` gives for them."""
    rows = table.to_pylist()
    rows = [r for r in rows if r["kind"] == HASHES]
    kind = np.uint32 if found is _indexed_twice else np.uint64
    arrays = [np.frombuffer(r["data"], kind) for r in rows]
    marks = found(np.concatenate([*arrays, np.zeros(0, kind)]))
    out, at = [], 0
    for r, a in zip(rows, arrays):
        own = marks[at : at + len(a)]
        at += len(a)
        if own.any():
            out.append((r["chunk"], r["range"], ANSWER, np.packbits(own).tobytes()))
    return _messages(out)


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if len(wanted) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def _indexed_twice(cells: np.ndarray) -> np.ndarray:
    """Hashes that occur twice or more, and at least once as an indexed block."""
    ordered = np.sort(cells)
    hashes = ordered >> np.uint32(1)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    last = np.concatenate([first[1:], [len(hashes)]]) - 1 if len(first) else first
    good = (last > first) & (ordered[last] & np.uint32(1) > 0)
    return _member(cells >> np.uint32(1), hashes[first[good]])


def _twice(hashes: np.ndarray) -> np.ndarray:
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    return _member(hashes, np.unique(again))


def repeats(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
    range_hashes: int = RANGE_HASHES,
) -> DataFrame:
    """Find words covered by a run of ``window`` words that starts anywhere else too, in the same text or another.

    Words are separated by ASCII white space and compared byte by byte. Returns a row per input row: doc_id,
    n_words, n_removed, ``spans`` (maximal repeated spans, in words, end excluded) and ``kept`` (the remaining words
    joined by one space). Every occurrence is removed, the first included; runs are judged on the input, so an
    exact copy of 35 words or more goes whole. Null and empty texts have no words and an empty ``kept``; repeated
    rows count as copies of each other; other columns, whatever their names, are not looked at.

    Equality of runs is equality of a 64-bit hash and of the hash range, which comes from a second, independent hash.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks, ranges = max(LEAST, -(-size // chunk_bytes)), max(LEAST, -(-size // (6 * range_hashes)))
    key = F.pmod(F.xxhash64("d", "t"), F.lit(chunks)).cast("int")
    parts = min(chunks, max(LEAST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # one exchange of the texts serves all three passes; the order within a chunk has to be the same each time
    dealt = rows.select(key.alias("chunk"), "d", "t").repartition(parts, "chunk")
    dealt = dealt.sortWithinPartitions("chunk", F.xxhash64("d", "t"), "d", "t")

    def probe(table):
        chunk, number = Chunk(table["t"], window, ranges), table["chunk"][0].as_py()
        return _messages([(number, r, HASHES, v.tobytes()) for r, v in chunk.blocks()])

    def answers(table, kind=ANSWER):
        return {r["range"]: r["data"] for r in table.to_pylist() if r["kind"] == kind}

    def extend(table, replies):
        if table.num_rows == 0 or replies.num_rows == 0:
            return _messages([])
        chunk, number = Chunk(table["t"], window, ranges), table["chunk"][0].as_py()
        at = chunk.candidates(answers(replies))
        marks = np.zeros(len(chunk.words), bool)
        marks[at] = True
        out = [(number, r, HASHES, v.tobytes()) for r, v in chunk.windows(at)]
        # what the next pass has to know rides along through any of the ranges
        return _messages(out + [(number, number % ranges, CANDIDATES, np.packbits(marks).tobytes())] * bool(len(at)))

    def count(table):
        passed = [tuple(r.values()) for r in table.to_pylist() if r["kind"] == CANDIDATES]
        return pa.concat_tables([_answered(table, _twice), _messages(passed)])

    def finish(table, replies):
        chunk = Chunk(table["t"], window, ranges)
        change = np.zeros(len(chunk.words) + 1, np.int64)
        marks = answers(replies, CANDIDATES)
        if marks:
            bits = np.unpackbits(np.frombuffer(*marks.values(), np.uint8), count=len(chunk.words))
            at = np.flatnonzero(bits)
            at = at[_marked(chunk.window_ranges(at), answers(replies), ranges)]
            change[at] += 1
            change[at + window] -= 1
        gone = np.cumsum(change[:-1]) > 0
        return _results(table["d"], chunk, gone)

    id_type = rows.schema["d"].dataType
    result = StructType(
        [
            StructField("doc_id", id_type),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
            StructField("kept", StringType()),
        ]
    )
    first = dealt.groupBy("chunk").applyInArrow(probe, MESSAGE)
    first = first.groupBy("range").applyInArrow(lambda t: _answered(t, _indexed_twice), MESSAGE)
    second = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(extend, MESSAGE)
    second = second.groupBy("range").applyInArrow(count, MESSAGE)
    return dealt.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(finish, result)


def _results(ids: pa.ChunkedArray, chunk: Chunk, gone: np.ndarray) -> pa.Table:
    borders = chunk.borders
    totals = np.concatenate([[0], np.cumsum(gone)])
    removed = totals[borders[1:]] - totals[borders[:-1]]
    # runs of removed words, broken at document borders
    edge = np.zeros(len(gone) + 1, bool)
    edge[borders] = True
    before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
    after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
    begins = np.flatnonzero(gone & (~before | edge[:-1]))
    ends = np.flatnonzero(gone & (~after | edge[1:])) + 1
    owner = np.searchsorted(borders, begins, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((x - borders[owner]).astype(np.int32)) for x in (begins, ends)], names=["start", "end"]
    )
    span_offsets = np.searchsorted(owner, np.arange(len(borders))).astype(np.int32)
    # kept words, each with a blank after it; the last blank of a document is cut off
    keep = np.flatnonzero(~gone)
    lengths = chunk.stops[keep] - chunk.starts[keep] + 1
    first = np.cumsum(lengths) - lengths
    cells = np.repeat(chunk.starts[keep] - first, lengths) + np.arange(int(lengths.sum()))
    body = np.concatenate([chunk.data, np.zeros(1, np.uint8)])[cells]
    body[first + lengths - 1] = 32
    at = np.searchsorted(keep, borders)
    edges = np.concatenate([first, [len(body)]])[at]
    whole = body.tobytes()
    kept = [whole[a : max(a, b - 1)].decode("utf-8") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    n = len(borders) - 1
    return pa.table(
        [
            ids.combine_chunks() if n else pa.array([], ids.type),
            pa.array(np.diff(borders), pa.int64()),
            pa.array(removed, pa.int64()),
            pa.ListArray.from_arrays(pa.array(span_offsets), spans),
            pa.array(kept, pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "spans", "kept"],
    )
