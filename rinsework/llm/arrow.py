"""Helpers around Arrow batches: words as byte spans, and tables that gain columns inside a worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Bytes and documents handled at a time inside a batch, so that a worker's memory follows these and not the batch.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the documents.

    ``is_word`` marks the bytes that belong to words; a word never crosses the end of a document.
    """
    size = len(is_word)
    if size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    borders = offsets[:-1][offsets[:-1] < size]
    begins[borders] = is_word[borders]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = is_word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD = 0xD6E8FEB86659FD93
_SEQUENCES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below n."""
    with np.errstate(over="ignore"):
        up = np.full(max(n, 1), base, np.uint64)
        up[0] = 1
        down = np.full(max(n, 1), pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        lengths = stops - starts
        up, _ = _powers(_WORD, int(lengths.max()))
        first = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        cells = _BYTES[data[inside + np.repeat(starts, lengths)]] * up[inside]
        return mixed(np.add.reduceat(cells, first) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of every run of n words; the runs are not checked against document borders."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(_SEQUENCES[which], len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words ^ np.uint64(which)) * up)])
        return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def inside_documents(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """For each word whether the n words from there on lie in its document."""
    total = int(word_offsets[-1])
    left = np.repeat(word_offsets[1:], np.diff(word_offsets)) - np.arange(total)
    return left >= n


def of_worker(key: tuple, make: Callable):
    """What ``make`` gives, made once in the life of a Python worker: vocabularies and caches outlive a task."""
    shelf = sys.modules.setdefault("rinsework_worker_shelf", types.ModuleType("rinsework_worker_shelf")).__dict__
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def sizes(column: pa.Array) -> np.ndarray:
    """The n + 1 offsets, in bytes, of a column of texts or of lists of numbers."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy().astype(np.int64) * 4
    return np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(), dtype=np.int64)])


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a bounded number of rows and bytes of its column ``at``; one value is never cut."""
    begin, ends = 0, sizes(batch.column(at))
    while begin < batch.num_rows:
        fits = int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, "right")) - 1
        stop = min(begin + SLICE_ROWS, max(begin + 1, fits), batch.num_rows)
        yield batch.slice(begin, stop - begin)
        begin = stop


def with_columns(
    df: DataFrame, at: int, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]
) -> DataFrame:
    """Append columns that a worker computes from slices of Arrow batches; column ``at`` is the one to slice by.

    ``make`` runs once a task and returns the function of a slice. Existing columns of the same names are replaced.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    places = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    schema = StructType(kept + fields)
    out = [f.name for f in schema.fields]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + work(part), names=out)

    return df.mapInArrow(run, schema)
