"""Token counts under a unigram model, by dynamic programming on a trie of distinct pre-tokens.

The best segmentation of a prefix does not depend on what follows, so words with a common prefix share its forward
scores: each node of the trie has the best score of its prefix, the number of tokens that takes, and the pieces
that have begun and may go on. A word's count is stored where it ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from rinsework.llm.arrow import of_worker, with_columns

#: Mark that stands for the blank before a word, fixed by the vocabulary.
BLANK = "▁"
WORDS = r"[\x20\x09-\x0D]+"
#: Offset of the rank-frequency law that gives the pieces their probabilities, and what a byte costs beyond the rarest piece.
RANK_OFFSET, BYTE_PENALTY = 2.7, 10.0
#: Log probabilities are kept as integers of this many parts, so sums and ties are exact.
PARTS = 1_000_000
#: Nodes of a worker's trie and words it remembers: bounds on memory, not on results.
MAX_NODES, REMEMBERED = 150_000, 120_000
#: Bits of a code point, and of a code point with the number of a piece prefix above it.
CHAR, NODE = 21, 45
PREFIX = (1 << NODE) - (1 << CHAR)


def piece_scores(path: str) -> dict[str, int]:
    """The log probability of each ordinary piece: Zipf-Mandelbrot by its place in the vocabulary file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(math.fsum(1 / (r + RANK_OFFSET) for r in range(1, len(ids) + 1)))
    return {
        model.id_to_piece(i): round(PARTS * (-math.log(r + RANK_OFFSET) - total)) for r, i in enumerate(ids, 1)
    }


class CountTrie:
    """Distinct pre-tokens; each node holds score and count of its prefix and the pieces under way.

    A step is an integer, the number of a node or piece prefix above the code point that follows it. A piece under way is
    one too: the node where it began above its prefix. Integers are nothing to the garbage collector, unlike some
    hundred thousand small containers.
    """

    def __init__(self, scores: dict[str, int]):
        ends, numbers = {}, {"": 0}
        for piece, score in scores.items():
            for k in range(1, len(piece) + 1):
                ends[piece[:k]] = score if k == len(piece) else ends.get(piece[:k])
                if k < len(piece):
                    numbers.setdefault(piece[:k], len(numbers))
        #: Per step the score of the piece that ends with it, if one does, and the prefix that may go on, or 0.
        self.go = {
            numbers[p[:-1]] << CHAR | ord(p[-1]): (own, numbers.get(p, 0) << CHAR) for p, own in ends.items()
        }
        self.single = {piece for piece in scores if len(piece) == 1}
        self.byte = min(scores.values(), default=0) - round(PARTS * BYTE_PENALTY)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count, self.under_way = [0], [0], [(0,)]

    def below(self, node: int, code: int) -> int:
        """The node one character further, made if new: what ends here competes, the rest is handed on."""
        scores, counts, go = self.score, self.count, self.go
        best, fewest, going, made = None, 0, [], len(scores)
        for x in self.under_way[node]:
            found = go.get(x & PREFIX | code)
            if found is None:
                continue
            own, further = found
            began = x >> NODE
            if own is not None:
                total, n = scores[began] + own, counts[began] + 1
                if best is None or total > best or total == best and n < fewest:
                    best, fewest = total, n
            if further:
                going.append(began << NODE | further)
        c = chr(code)
        if c not in self.single:  # a character that is no piece goes byte by byte
            size = len(c.encode("utf-8"))
            total, n = scores[node] + size * self.byte, counts[node] + size
            if best is None or total > best or total == best and n < fewest:
                best, fewest = total, n
        going.append(made << NODE)  # pieces may begin here
        self.child[node << CHAR | code] = made
        scores.append(best)
        counts.append(fewest)
        self.under_way.append(tuple(going))
        return made

    def insert(self, word: str) -> int:
        """The tokens of a word that follows a blank."""
        if len(self.score) > MAX_NODES:
            self.clear()
        node, known = 0, self.child.get
        for code in map(ord, BLANK + word):
            node = known(node << CHAR | code) or self.below(node, code)
        return self.count[node]


class Counter:
    """Tokens of the distinct words of a batch; words seen before are looked up."""

    def __init__(self, path: str):
        self.trie = CountTrie(piece_scores(path))
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def words(self, distinct: list[str]) -> np.ndarray:
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        out = list(map(self.recent.get, distinct))
        missing = sorted((distinct[i], i) for i, n in enumerate(out) if n is None)
        for word, i in missing:
            n = self.older.get(word)
            out[i] = self.recent[word] = (self.trie.insert(word) if word else 0) if n is None else n
        return np.array(out, np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        words = pc.split_pattern_regex(column.cast(pa.string()).fill_null(""), WORDS)
        flat, borders = words.flatten(), words.offsets.to_numpy()
        borders = borders - borders[0]
        codes = flat.dictionary_encode()
        tokens = self.words(codes.dictionary.to_pylist())[codes.indices.to_numpy()]
        sums = np.concatenate([[0], np.cumsum(tokens)])
        real = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy() > 0)])
        return real[borders[1:]] - real[borders[:-1]], sums[borders[1:]] - sums[borders[:-1]]


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append n_words and n_tokens: the words between ASCII white space and the tokens of their best segmentation.

    Each word is segmented with the blank before it; the segmentation of the highest summed log probability wins,
    and of equal ones that of fewest tokens. A character that is no piece may go byte by byte. ``path`` names the
    vocabulary file on every machine; its pieces get probabilities by rank, nothing is trained. Null, empty and
    blank texts have no words and no tokens. Rows are independent and stay where they are; columns of the two
    names are replaced, all others kept.
    """
    at = df.columns.index(text)

    def make():
        count = of_worker(("unigram", path), lambda: Counter(path))
        return lambda part: [pa.array(x, pa.int64()) for x in count(part.column(at))]

    return with_columns(df, at, [StructField("n_words", LongType()), StructField("n_tokens", LongType())], make)
