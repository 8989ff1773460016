"""The text side of a word-end BPE vocabulary: normalisation and the split into pre-tokens."""

from __future__ import annotations

import json
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from rinsework.llm.arrow import strings

#: Fixed values of the vocabulary file's normaliser and pre-tokeniser.
SPACE = r"\t-\r \x85\p{Z}"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
WORD_END = "</w>"

#: Characters whose class, case and composition are the same in every Unicode version, and each a lower case of one
#: character; texts with others are left to the library.
UNSETTLED = (
    r"[^\x00-\x1B\x20-\x{12F}\x{131}-\x{24F}\x{400}-\x{45F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}"
    r"\x{3041}-\x{3093}\x{30A1}-\x{30F6}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]"
)
#: ASCII letters in lower case, and ASCII digits and punctuation but the apostrophe: pre-tokens always part between the two.
LETTER = np.array([chr(b) in string.ascii_lowercase for b in range(256)])
MARK = np.array([chr(b) in string.digits + string.punctuation and chr(b) != "'" for b in range(256)])
#: Words a worker remembers, in each of two generations: a bound on memory, not on results.
REMEMBERED = 120_000


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + i)
    return names


def apart(column: pa.Array) -> pa.Array:
    """Lower-cased texts with a blank between letters and marks, so that a word is the same before any mark."""
    data, offsets = strings(column)
    letter, mark = LETTER[data], MARK[data]
    at = np.flatnonzero(letter[:-1] & mark[1:] | mark[:-1] & letter[1:]) + 1
    buffers = [None, pa.py_buffer(offsets + np.searchsorted(at, offsets)), pa.py_buffer(np.insert(data, at, ord(" ")))]
    return pa.Array.from_buffers(pa.large_string(), len(column), buffers)


def listed(words: pa.Array) -> list[str]:
    """Words without blanks as a list, by one long text that Python cuts faster than Arrow hands out strings."""
    if len(words) == 0:
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, pa.scalar(" ", words.type))[0].as_py().split(" ")


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str, merges: bool = True):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.names: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.text = {i: t for t, i in self.names.items()} | {i: t for t, i in self.special.items()}
        if not merges:
            return
        back = {c: b for b, c in byte_names().items()}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, i in self.names.items():
            end = name.endswith(WORD_END)
            if name in self.special:
                continue
            cells = bytes(back[c] for c in (name[: -len(WORD_END)] if end else name))
            (self.final if end else self.inner)[cells] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.names[left], self.names[right]] = (rank, self.names[left + right])


class TextEncoder:
    """Whole texts to ids, word by word: what stands between white space is split and encoded once and remembered.

    Pre-tokens never hold white space, so a text is lower-cased and cut at white space by Arrow, and its distinct
    words are looked up. Texts with rare characters or with special tokens written out take the library's own
    normaliser and splitter. Subclasses say how the bytes of one pre-token become ids.
    """

    remembered = REMEMBERED

    def __init__(self, path: str, special: dict[str, int]):
        self.path, self.special, self.library = path, special, None
        self.pieces = regex.compile(PIECES).findall
        self.borders = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids_of(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """For pre-tokens in UTF-8 their ids, as bytes of 32-bit integers."""
        raise NotImplementedError

    def rare(self, text: str) -> np.ndarray:
        """A text through the library's normaliser and splitter, piece by piece."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.back = {c: b for b, c in byte_names().items()}
        out = []
        for part in self.borders.split(text) if self.borders else [text]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            cells = [bytes(self.back[c] for c in p) for p, _ in found]
            known = self.ids_of(sorted(set(cells)))
            out += [known[c] for c in cells]
        return np.frombuffer(b"".join(out), np.int32)

    def of_letters(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words of letters, which are pre-tokens themselves."""
        cells = [w.encode() for w in words]
        known = self.ids_of(sorted(cells))
        return [known[c] for c in cells]

    def words(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct words. A full cache becomes the older one, so frequent words stay."""
        if len(self.recent) > self.remembered:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        out = list(map(recent.get, distinct))
        missing = [i for i, known in enumerate(out) if known is None]
        new = []
        for i, known in zip(missing, [older.get(distinct[i]) for i in missing]):
            if known is None:
                new.append(i)
            else:
                out[i] = recent[distinct[i]] = known
        letters = [i for i in new if distinct[i].isalpha()]
        own = [distinct[i] for i in letters]
        ids = self.of_letters(own)
        recent.update(zip(own, ids))
        for i, known in zip(letters, ids):
            out[i] = known
        cells = {i: [p.encode() for p in self.pieces(distinct[i])] for i in new if out[i] is None}
        known = self.ids_of(sorted(set(chain.from_iterable(cells.values()))))
        for i, own in cells.items():
            out[i] = recent[distinct[i]] = b"".join([known[c] for c in own])
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts one after another, and the n + 1 offsets of the texts; null is empty."""
        column = column.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(column, UNSETTLED)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(column, token))
        plain = pc.if_else(odd, "", column) if odd.true_count else column
        words = pc.utf8_split_whitespace(apart(pc.utf8_lower(plain)))
        codes = words.flatten().dictionary_encode()
        known = self.words(listed(codes.dictionary))
        flat = np.frombuffer(b"".join(known), np.int32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(sizes) - sizes
        index = codes.indices.to_numpy()
        counts = sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(first[index] - ends[:-1], counts) + np.arange(ends[-1])]
        borders = words.offsets.to_numpy()
        offsets = ends[borders - borders[0]]
        if odd.true_count:
            rows = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                rows[i] = self.rare(column[int(i)].as_py())
            ids = np.concatenate(rows)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, offsets
