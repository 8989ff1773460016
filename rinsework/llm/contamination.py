"""Benchmark decontamination: a broadcast hash set of test n-grams, probed by every window of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rinsework.llm.arrow import (
    inside_documents,
    strings,
    window_hashes,
    with_columns,
    word_hashes,
    word_spans,
)
from rinsework.plans.cut import cut

#: Words per window; benchmark text that one broadcast may hold, in bytes.
WINDOW = 13
BLOCK_BYTES = 16 << 20

#: The columns that are added.
ADDED = ("n_words", "n_hit", "spans", "items", "cleaned")
#: Bits of the table that most windows of clean text fail at.
SIEVE_BITS = 24


def letters() -> np.ndarray:
    """Each byte's normal form: A-Z lower-cased, digits, a-z and bytes from 128 on kept, others 0."""
    form = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        form[low : high + 1] = np.arange(low, high + 1)
    form[0x41:0x5B] = form[0x61:0x7B]
    return form


def normal_words(column, form):
    data, offsets = strings(column)
    normal = form[data]
    return normal, *word_spans(normal > 0, offsets)


def joined(normal: np.ndarray, start: int, stop: int) -> bytes:
    """The words between two bytes, joined by one space."""
    return b" ".join(filter(None, normal[start:stop].tobytes().split(b"\0")))


def index_of(ids: list[str | None], texts: list[str | None], window: int) -> dict:
    """The windows of a block of items as plain arrays: by window length the sorted hashes and where each begins."""
    normal, starts, stops, borders = normal_words(pa.array(texts, pa.string()), letters())
    words, owner = word_hashes(normal, starts, stops), np.repeat(np.arange(len(ids)), np.diff(borders))
    sizes, tables = np.diff(borders), {}
    for n in sorted({int(min(s, window)) for s in sizes if s}):
        whole = inside_documents(borders, n)[: max(0, len(words) - n + 1)]
        if n < window:  # shorter items are one window each
            only = np.zeros(len(words), bool)
            only[borders[:-1][sizes == n]] = True
            whole &= only[: len(whole)]
        at = np.flatnonzero(whole)
        hashes = window_hashes(words, n)[at]
        order = np.argsort(hashes, kind="stable")
        tables[n] = (hashes[order], at[order])
    return {"ids": ids, "normal": normal, "starts": starts, "stops": stops, "owner": owner, "tables": tables}


class Prober:
    """Finds the windows of a block of items in texts; every hash hit is confirmed on the words themselves."""

    def __init__(self, index: dict):
        self.index, self.form, self.known = index, letters(), {}
        self.sieves = {}
        for n, (hashes, _) in index["tables"].items():
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[hashes >> np.uint64(64 - SIEVE_BITS)] = True
            self.sieves[n] = sieve

    def items(self, n: int, left: int, right: int) -> dict[bytes, frozenset[int]]:
        """The items of equal hashes, by their words."""
        key = (n, left)
        if key not in self.known:
            x, by_words = self.index, {}
            for at in x["tables"][n][1][left:right]:
                words = joined(x["normal"], x["starts"][at], x["stops"][at + n - 1])
                by_words.setdefault(words, set()).add(int(x["owner"][at]))
            self.known[key] = {w: frozenset(s) for w, s in by_words.items()}
        return self.known[key]

    def __call__(self, normal, starts, stops, borders) -> tuple[np.ndarray, list[set[int]]]:
        """Per word whether a window covers it, and per document the numbers of its items."""
        words, found = word_hashes(normal, starts, stops), [set() for _ in range(len(borders) - 1)]
        change = np.zeros(len(words) + 1, np.int64)
        for n, (hashes, _) in self.index["tables"].items():
            probes = window_hashes(words, n)
            maybe = self.sieves[n][probes >> np.uint64(64 - SIEVE_BITS)]
            maybe &= inside_documents(borders, n)[: len(maybe)]
            at = np.flatnonzero(maybe)
            left = np.searchsorted(hashes, probes[at], "left")
            right = np.searchsorted(hashes, probes[at], "right")
            real = right > left
            at, left, right = at[real], left[real], right[real]
            document = np.searchsorted(borders, at, "right") - 1
            for i, a, b, d in zip(at.tolist(), left.tolist(), right.tolist(), document.tolist()):
                items = self.items(n, a, b).get(joined(normal, starts[i], stops[i + n - 1]))
                if items:
                    found[d] |= items
                    change[i] += 1
                    change[i + n] -= 1
        return np.cumsum(change[:-1]) > 0, found


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true cells."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _scan(df: DataFrame, index: dict, text: str, again: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(index)
    at, spans_at, items_at = (df.columns.index(c) if c in df.columns else None for c in (text, "spans", "items"))

    def make():
        probe = Prober(shared.value)
        ids = shared.value["ids"]

        def work(part):
            data, _ = strings(part.column(at))
            normal, starts, stops, borders = normal_words(part.column(at), probe.form)
            hit, found = probe(normal, starts, stops, borders)
            before = [[]] * part.num_rows
            if again:  # what earlier blocks of items have found
                before = part.column(items_at).to_pylist()
                for d, spans in enumerate(part.column(spans_at).to_pylist()):
                    for s in spans:
                        hit[borders[d] + s["start"] : borders[d] + s["end"]] = True
            offsets = strings(part.column(at))[1]
            spans, items, cleaned = [], [], []
            for d in range(part.num_rows):
                own = hit[borders[d] : borders[d + 1]]
                begin, end = runs(own) if own.any() else ((), ())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end)])
                items.append(sorted({ids[i] for i in found[d] if ids[i] is not None}.union(before[d])))
                body, last = [], int(offsets[d])
                for a, b in zip(begin, end):
                    body.append(data[last : starts[borders[d] + a]].tobytes())
                    last = int(stops[borders[d] + b - 1])
                body.append(data[last : offsets[d + 1]].tobytes())
                cleaned.append(b"".join(body).decode("utf-8"))
            return [
                pa.array(np.diff(borders), pa.int64()),
                pa.array([sum(s["end"] - s["start"] for s in row) for row in spans], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(items, pa.list_(pa.string())),
                pa.array(cleaned, pa.string()),
            ]

        return work

    fields = [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("spans", SPANS),
        StructField("items", ArrayType(StringType())),
        StructField("cleaned", StringType()),
    ]
    return with_columns(df, at, fields, make)


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Append what of each text occurs in a benchmark: n_words, n_hit, spans (in words), items and the cleaned text.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A
    word inside any occurrence of a window is hit. ``items`` are the ids, as sorted text, of the items that occur;
    an item without an id still marks words. ``cleaned`` is the text without its hit spans, each from its first
    to its last word.

    Texts are scanned where they lie, without a shuffle. The broadcast is bounded: benchmark texts of up to
    ``block_bytes`` go out at once; a larger benchmark is dealt into blocks by hash and scanned block after
    block, the result so far being cut in between. Null and empty texts have no words, no hits and, cleaned, an
    empty text. An empty benchmark hits nothing. Columns of the five names are replaced, all others are kept, and
    repeated rows stay repeated.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).sort("i", "t").collect()
        index = index_of([r.i for r in rows], [r.t for r in rows], window)
        df = _scan(cut(df) if k else df, index, text, again=k > 0)
    return df


def contaminated(part: int = 20) -> Column:
    """The rule: at least one word in ``part`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * part >= F.col("n_words"))


def decontaminate(df: DataFrame, benchmark: DataFrame, action: str = "documents", text: str = "text", **more) -> DataFrame:
    """Remove contaminated documents, or (``action="spans"``) the hit spans of all documents. Columns stay as they were."""
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    own = [F.col(f"`{c}`") for c in df.columns]
    if {c.lower() for c in df.columns} & set(ADDED):  # columns of the names that are added are kept aside
        own = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
        body = F.col(f"`{text}`").alias("text")
        df, columns, text_now = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), body), df.columns, "text"
    else:
        columns, text_now = df.columns, text
    marked = contamination(df, benchmark, text_now, **more)
    if action == "documents":
        return marked.filter(~contaminated()).select(*own)
    cleaned = F.when(F.col(f"`{text_now}`").isNull(), None).otherwise(F.col("cleaned"))
    return marked.select(*[cleaned.alias(c) if c == text else o for c, o in zip(columns, own)])
