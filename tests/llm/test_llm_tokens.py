"""Encoders, files and counts against the library and plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import nothing, odd_documents
from tokenizers import Tokenizer

from rinsework.llm import bpe, simple8b, unigram
from rinsework.llm.queries import PIECE_BPE, WORD_BPE


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_padding()
    t.no_truncation()
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def random_texts(n=400, seed=3):
    rng = random.Random(seed)
    ranges = [(32, 127), (97, 123), (97, 123), (160, 0x250), (0x370, 0x600), (0x900, 0xD700), (0x1F300, 0x1F700), (9, 33)]
    return ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 50))) for _ in range(n)]


def encoded(encoder, texts):
    ids, offsets = encoder(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


@pytest.mark.parametrize("kind", [bpe.Encoder, simple8b.LibraryEncoder])
def test_encoders_agree_with_the_library(kind, library):
    texts = random_texts() + [None, "", "it's we'll !!'s", "<|endoftext|>x<|startoftext|>", "a" * 5000, "İ ΣΑΣ a\x1cb"]
    assert encoded(kind(WORD_BPE), texts) == library(texts)


@pytest.mark.parametrize("kind", [bpe.Encoder, simple8b.LibraryEncoder])
def test_words_part_from_marks(kind, library):
    rng = random.Random(5)
    letters = "absltremdv'''''.,-_(1\xe9\xbd́… \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    assert encoded(kind(WORD_BPE), texts) == library(texts)
    encoder, texts = kind(WORD_BPE), ["under, under. (under) under1 -under", ",x"]
    assert encoded(encoder, texts) == library(texts)
    assert sorted(w for w in encoder.recent if "under" in w) == ["under"]  # remembered once


def test_sizes_of_short_ids_are_those_of_all():
    ids = np.concatenate([simple8b.LIMITS, simple8b.LIMITS - np.uint64(1), np.arange(1000, dtype=np.uint64)])
    for some in (ids, ids[ids < 1 << 16]):
        words, offsets, escapes = simple8b.pack(some)
        assert simple8b.unpack(words, offsets, escapes, len(some)).tolist() == some.tolist()


def test_bounded_caches_change_nothing(library, monkeypatch):
    texts = random_texts(120)
    monkeypatch.setattr(bpe, "MAX_NODES", 50)
    monkeypatch.setattr(bpe.Encoder, "remembered", 20)
    encoder = bpe.Encoder(WORD_BPE)
    got = [row for i in range(0, len(texts), 7) for row in encoded(encoder, texts[i : i + 7])]
    assert got == library(texts)


def test_encode_and_decode_in_spark(spark, library):
    docs = odd_documents(spark)
    back = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE)
    rows = back.collect()
    assert back.columns == [*docs.columns, "ids", "decoded"] and len(rows) == docs.count()
    t = Tokenizer.from_file(WORD_BPE)
    for r, ids in zip(rows, library([r.text for r in rows])):
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_decode_passes_over_unknown_ids(spark):
    df = spark.createDataFrame([([320, -1, 99_999, 321],), ([],), (None,)], "ids array<int>")
    names = bpe.Vocabulary(WORD_BPE).text
    got = [r.decoded for r in bpe.decode(df, WORD_BPE).collect()]
    assert got == [f"{names[320]} {names[321]}", "", ""]


def test_empty_tables(spark, tmp_path):
    empty = nothing(spark)
    assert bpe.decode(bpe.encode(empty, WORD_BPE), WORD_BPE).count() == 0
    assert unigram.count_tokens(empty, PIECE_BPE).count() == 0
    folder = simple8b.write(empty, str(tmp_path / "none"), WORD_BPE, 1)
    assert simple8b.read(spark, folder).count() == 0


@pytest.mark.parametrize(
    "ids",
    [
        [],
        [0] * 1000,
        list(range(5000)),
        [2**63, 5, 2**60, 2**60 - 1, 0, 2**64 - 1] * 100,
        [1] * 255 + [2**30],
        [0] * 239 + [7] + [0] * 300,
    ],
)
def test_packing_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = simple8b.pack(ids)
    assert (simple8b.unpack(words, offsets, escapes, len(ids)) == ids).all()


def test_packing_random_widths():
    rng = np.random.default_rng(1)
    for _ in range(40):
        ids = rng.integers(0, 2 ** rng.integers(1, 63, 700).astype(np.uint64), 700, dtype=np.uint64)
        ids[rng.random(700) < 0.3] = 0
        words, offsets, escapes = simple8b.pack(ids)
        assert (simple8b.unpack(words, offsets, escapes, 700) == ids).all()


def test_token_files(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(simple8b, "SEGMENT", 500)
    docs = odd_documents(spark).filter("doc_id is not null")
    folder = simple8b.write(docs, str(tmp_path / "ids"), WORD_BPE, end_id=1)
    got = {}
    for r in simple8b.read(spark, folder, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1] is not None, r[1]))
    start = 0
    for (d, _), ids in zip(rows, library([t for _, t in rows])):
        body = np.array([*ids, 1], "<u4").tobytes()
        mine = min(got[d], key=lambda r: r.start)
        got[d].remove(mine)
        assert (mine.start, mine.n_tokens, mine.ids_crc32, bytes(mine.ids)) == (start, len(ids) + 1, zlib.crc32(body), body)
        start += len(ids) + 1
    assert not any(got.values())


def test_null_doc_id_fails_the_file(spark, tmp_path):
    with pytest.raises(Exception, match="a doc_id is null"):
        simple8b.write(odd_documents(spark), str(tmp_path / "bad"), WORD_BPE, 1)


def test_null_doc_ids_are_written_and_read(spark, tmp_path, library):
    docs = odd_documents(spark).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, f"{i * 7 % 200} of many") for i in range(200)], docs.schema))
    folder = simple8b.write(docs, str(tmp_path / "ids"), WORD_BPE, 1, null_ids=True)
    got = [(r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in simple8b.read(spark, folder, with_ids=True).collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert sum(d is None for d, _ in rows) == 202
    want, start = [], 0
    for (d, _), ids in zip(rows, library([t for _, t in rows])):
        want.append((start, d, len(ids) + 1, np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1
    assert sorted(got, key=lambda r: r[0]) == want


def plain_count(word, scores, byte):
    s, best = unigram.BLANK + word, [(0, 0)]
    for i in range(1, len(s) + 1):
        ways = [(best[j][0] + scores[s[j:i]], best[j][1] - 1) for j in range(i) if s[j:i] in scores]
        if s[i - 1] not in scores:
            n = len(s[i - 1].encode())
            ways.append((best[i - 1][0] + n * byte, best[i - 1][1] - n))
        best.append(max(ways))
    return -best[-1][1]


def test_counts_against_plain_programming(spark, monkeypatch):
    monkeypatch.setattr(unigram, "MAX_NODES", 300)
    scores = unigram.piece_scores(PIECE_BPE)
    trie = unigram.CountTrie(scores)
    for text in random_texts(150):
        for word in text.split():
            assert trie.insert(word) == plain_count(word, scores, trie.byte)
    import re

    docs = odd_documents(spark).filter("n_chars < 10000 or n_chars is null")
    known = {}
    for r in unigram.count_tokens(docs, PIECE_BPE).collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for w in own:
            if w not in known:
                known[w] = plain_count(w, scores, trie.byte)
        assert (r.n_words, r.n_tokens) == (len(own), sum(known[w] for w in own))
