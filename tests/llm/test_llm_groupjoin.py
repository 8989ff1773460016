"""The token-group join against brute force."""

import random
from collections import Counter

import pytest
from fixtures_llm import nothing, odd_documents
from test_llm_documents import chain, plain_classes

from rinsework.llm import groupjoin


def template(n, common=100, own=30, seed=3):
    """Texts of one template, each with words of its own: alike, but linked with nothing."""
    rng = random.Random(seed)
    return [" ".join([f"t{i}" for i in range(common)] + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def family(n, size=150, edits=3, seed=5):
    """Copies of one text with some words changed: most are linked, some only through others."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"f{i}" for i in range(size)]
        for _ in range(rng.randrange(2 * edits + 1)):
            w[rng.randrange(size)] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def check(docs, got, size=4, percent=85):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_classes([r for r in rows if r[0] is not None], size, percent)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    return Counter(c for _, c in want.values())


def test_classes(spark):
    docs = odd_documents(spark, extra=chain() + template(12) + family(12))
    classes = check(docs, groupjoin.group_join(docs).collect())
    assert max(classes.values()) >= 12


@pytest.mark.parametrize("rough", [True, False])
@pytest.mark.parametrize("percent, size", [(85, 4), (70, 2)])
def test_small_parts(spark, monkeypatch, rough, percent, size):
    """Pieces, tables and parties of two or three documents; without rough clusters the matrix finds every link."""
    monkeypatch.setattr(groupjoin, "PIECE", 3)
    monkeypatch.setattr(groupjoin, "VISITORS", 2)
    monkeypatch.setattr(groupjoin, "LEAST", 5)
    if not rough:
        none = spark.createDataFrame([], "vertex bigint, root bigint")
        monkeypatch.setattr(groupjoin, "_rough_clusters", lambda sets: none)
    docs = odd_documents(spark, seed=11, extra=chain(25) + template(10) + family(30, edits=6) + ["a b c d", "a b c d e", "b c d e"])
    got = groupjoin.group_join(docs, shingle=size, percent=percent, chunk_tokens=2000, range_tokens=700).collect()
    classes = check(docs, got, size, percent)
    assert max(classes.values()) >= 20


def test_rows_that_share_an_id(spark):
    a, b, c = family(1, 60)[0], " ".join(f"q{i}" for i in range(50)), " ".join(f"z{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, a), (4, c), (9, c), (9, None), (5, "")]
    got = groupjoin.group_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(
        [(1, 57, 1), (1, 57, 1), (1, 47, 1), (2, 47, 1), (3, 57, 1), (4, 37, 4), (9, 37, 4), (9, 0, 9), (5, 0, 5)]
    )


def test_of_nothing(spark):
    assert groupjoin.group_join(nothing(spark)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in groupjoin.group_join(empty).collect()) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_a_pair_at_the_limit_shares_a_leading_token(percent):
    """The lengths of the leading parts, over all sizes and the least overlap that links."""
    for large in range(1, 120):
        for small in range(1, large + 1):
            overlap = -(-percent * (large + small) // (100 + percent))
            if overlap <= small:
                assert overlap >= groupjoin.least_overlap(large, percent)
                assert overlap >= -(-2 * percent * small // (100 + percent))
