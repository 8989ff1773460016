"""BPE encoding and decoding over a trie of distinct words.

Greedy merging has a property that makes a trie useful: an encoding is right exactly if each of its tokens
encodes to itself and each pair of neighbours does. So the last token of the encoding of a prefix depends on
that prefix alone, and is the one token that ends there and agrees with the last token of what lies before it.
Walking down the trie depth first, each node finds that token once, whatever number of words share the prefix.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from rinsework.llm.arrow import of_worker, with_columns
from rinsework.llm.clip import TextEncoder, Vocabulary

#: Nodes of a worker's trie, and pairs of tokens whose agreement it remembers: bounds on memory, not on results.
MAX_NODES, MAX_PAIRS = 200_000, 200_000


class WordTrie:
    """Distinct words as byte paths; every node has the last token of its prefix and where that token begins."""

    def __init__(self, vocabulary: Vocabulary):
        self.inner, self.final, self.merges = vocabulary.inner, vocabulary.final, vocabulary.merges
        self.bytes_of = {i: (t, False) for t, i in self.inner.items()} | {i: (t, True) for t, i in self.final.items()}
        self.longest = max(map(len, chain(self.inner, self.final)), default=1)
        self.parts = {made: (rank, a, b) for (a, b), (rank, made) in self.merges.items()}
        built = {made: rank for made, (rank, _, _) in self.parts.items()}
        #: Each token has one merge, after those of its halves; then merges come in the order of their ranks.
        self.ordered = len(self.parts) == len(self.merges) and all(
            max(built.get(a, -1), built.get(b, -1)) < rank for rank, a, b in self.parts.values()
        )
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.child: dict[int, int] = {}
        self.last, self.start = [-1], [0]

    def merged(self, cells: bytes, ends: bool) -> list[int]:
        """Plain greedy merging, lowest rank first, leftmost among equals: the definition of the encoding."""
        ids = [self.inner[cells[i : i + 1]] for i in range(len(cells))]
        if ends:
            ids[-1] = self.final[cells[-1:]]
        while True:
            ranks = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not ranks:
                return ids
            i = min(ranks)[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that lie at one edge while a token is built up, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self.edges:
            steps, rank = [], float("inf")
            while True:
                steps.append((token, rank))
                if token not in self.parts:
                    break
                rank, *halves = self.parts[token]
                token = halves[right]
            self.edges[key] = steps[::-1]
        return self.edges[key]

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to themselves; left -1 is the begin of the word."""
        if left < 0 or not self.ordered:
            first, (second, ends) = self.bytes_of[left][0] if left >= 0 else b"", self.bytes_of[right]
            return self.merged(first + second, ends) == ([left, right] if left >= 0 else [right])
        # no merge across the border may come in its turn
        lefts, rights, i, j = self.edge(left, True), self.edge(right, False), 0, 0
        while True:
            (a, until_a), (b, until_b) = lefts[i], rights[j]
            across = self.merges.get((a, b))
            if across is not None and across[0] < until_a and across[0] <= until_b:
                return False
            if until_a == until_b == float("inf"):
                return self.fits(-1, right)
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.agree(left, right)
        return found

    def ending(self, path: list[int], cells: bytes, tokens: dict[bytes, int]) -> tuple[int, int]:
        """The last token of the encoding of ``cells`` and where it begins; path[i] is the node of the first i bytes.

        Just one token fits, so the order of trying is free: first the last token so far, longer by a byte, then
        the shortest.
        """
        n, last, pairs = len(cells), self.last, self.pairs
        for begin in (self.start[path[-1]], *range(n - 1, max(-1, n - self.longest - 1), -1)):
            token = tokens.get(cells[begin:])
            if token is not None:
                left = last[path[begin]]
                found = pairs.get(left << 20 | token)
                if self.fits(left, token) if found is None else found:
                    return token, begin
        raise ValueError(f"no token ends {cells!r}")

    def encode(self, cells: bytes) -> list[int]:
        """Insert a word and read its ids off the trie."""
        node, path = 0, [0]
        for i in range(len(cells) - 1):
            key = node * 256 + cells[i]
            below = self.child.get(key)
            if below is None:
                token, begin = self.ending(path, cells[: i + 1], self.inner)
                below = self.child[key] = len(self.last)
                self.last.append(token)
                self.start.append(begin)
            node = below
            path.append(node)
        token, begin = self.ending(path, cells, self.final)
        ids = [token]
        while begin:
            node = path[begin]
            ids.append(self.last[node])
            begin = self.start[node]
        return ids[::-1]


class Encoder(TextEncoder):
    """Distinct words go through the trie in sorted order."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        super().__init__(path, vocabulary.special)
        self.trie = WordTrie(vocabulary)

    def ids_of(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for piece in pieces:
            if len(self.trie.last) > MAX_NODES or len(self.trie.pairs) > MAX_PAIRS:
                self.trie.clear()
            out[piece] = array("i", self.trie.encode(piece)).tobytes()
        return out


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the token ids of a text column as array<int>.

    ``path`` names the vocabulary file on every machine. No special tokens are added; those written out in a
    text are taken as such. Null, empty and blank texts give an empty array, never null. All other columns
    are kept; a column already named as the result is replaced. Rows are independent: no shuffle, equal rows
    give equal results, an empty table gives an empty table.
    """
    at = df.columns.index(text)

    def make():
        encoder = of_worker(("trie", path), lambda: Encoder(path))

        def work(part):
            values, offsets = encoder(part.column(at))
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))]

        return work

    return with_columns(df, at, [StructField(ids, ArrayType(IntegerType(), False))], make)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of an id column: the token texts joined by one space, as the vocabulary has no decoder rule.

    Ids outside the vocabulary are passed over; a null or empty array gives an empty text, a null element counts
    as unknown. Special tokens stay. Other columns are kept; a column named as the result is replaced.
    """
    at = df.columns.index(ids)

    def make():
        names = of_worker(("names", path), lambda: Vocabulary(path, merges=False).text)
        known = pa.array([names.get(i) for i in range(max(names, default=0) + 1)], pa.string())

        def work(part):
            column = part.column(at)
            column = pc.if_else(column.is_null(), pa.scalar([], column.type), column)
            values = column.flatten()
            inside = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(known)))
            found = known.take(pc.if_else(inside, values, None))
            offsets = column.offsets.to_numpy()
            if found.null_count:  # unknown ids are passed over
                gone = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])
                offsets = offsets - offsets[0]
                offsets, found = offsets - gone[offsets], found.drop_null()
            lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), found)
            return [pc.binary_join(lists, " ").fill_null("")]

        return work

    return with_columns(df, at, [StructField(text, StringType())], make)
