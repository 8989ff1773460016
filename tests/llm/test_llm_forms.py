"""Fill-in-the-middle and the audit of filters against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from fixtures_llm import nothing, odd_documents
from pyspark.sql import functions as F

from rinsework.llm import interactions, middles

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# fill in the middle


def plain_middle(doc_id, text, units, markers=middles.MARKERS, plain=10):
    """n, form, prefix and middle in code points, output; ``units`` cuts a text into units and a rest."""
    text = text or ""
    cells = units(text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(cells)
    if not text or any(m in text for m in markers) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle = "".join(cells[:a]), "".join(cells[a:b])
    suffix = text[len(prefix) + len(middle) :]
    p, s, m = markers
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


WORDS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
ODD_TEXTS = [
    "a\r\nb\n\n", "\n", " x\u0085y\r", "\U0001f600" * 3000 + "é", "x<P>y", "<S>", "<M><M>", "a<b<c>>", "<" * 40, "<<P", "$1 \\ $2 {3}",
    "ab " * 5000 + "\n", " lead and trail ",
]


@pytest.mark.parametrize(
    "unit, units, markers",
    [
        (middles.CODE_POINT, list, middles.MARKERS),
        (middles.WORD, WORDS.findall, middles.MARKERS),
        (middles.CODE_POINT, list, ("$1", "\\Q[", "<|m|>")),
    ],
)
def test_fill_in_middle(spark, unit, units, markers):
    docs = odd_documents(spark, extra=[t for t in ODD_TEXTS for _ in range(6)])
    made = middles.fill_in_middle(docs, unit=unit, markers=markers)
    back = middles.restored(F.col("output"), F.col("form"), markers).alias("back")
    got = made.select("row.*", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()
    assert len(got) == docs.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text, units, markers), r.text
        assert r.back == (r.text or "")
    assert set(docs.columns) <= set(got[0].__fields__)


def test_fill_in_middle_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), 30).alias("text"))
    made = middles.fill_in_middle(docs, plain_percent=50, spm_percent=100)
    shares = Counter(r.form for r in made.select("form").collect())
    assert abs(shares["plain"] - 2000) < 200 and shares["psm"] == 0
    assert middles.fill_in_middle(nothing(spark)).count() == 0


def test_a_very_long_text_needs_no_deep_stack(spark):
    docs = spark.range(7, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ü x\n"), 1_000_000).alias("text"))
    r = middles.fill_in_middle(docs, plain_percent=0).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(7, "ü x\n" * 1_000_000, list, plain=0)
    assert r.n == 4_000_000
    assert middles.fill_in_middle(docs, unit=middles.WORD, plain_percent=0).first().n == 2_000_000


# audit of filters


def plain_audit(rows, labels):
    firsts = {}
    for d, _, t in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for d, part, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > firsts[t],
        }
        parts[part or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        sums = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in docs if f in x[0] and not before & x[0]]
                sums[f] += len(gone)
                out[part, order, step] = [
                    sum(not x[0] & (before | {f}) for x in docs),
                    len(gone),
                    sum(f in x[0] and bool(before & x[0]) for x in docs),
                    sum(x[0] == {f} for x in docs),
                    sum(x[1] for x in gone),
                    sum(x[2] for x in gone),
                    f,
                ]
        for key, cells in out.items():
            if key[0] == part:
                cells[6] = sums[cells[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    shout = " ".join(f"Word{i} LOUD" for i in range(40))
    docs = odd_documents(spark, extra=[shout, shout, shout + " #1", "a $", None, "", "WORD " * 60, "word " * 60 + "|"])
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (999, 1, 1), (6, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    tags = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    got = interactions.audit(docs, tags).collect()
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want = plain_audit(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[3:]) == want[r.part, r.filter_order, r.step], r


def test_audit_of_nothing(spark):
    tags = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert interactions.audit(nothing(spark), tags).count() == 0
    some = interactions.audit(odd_documents(spark), tags.limit(0)).agg(F.sum("good_lost"), F.count("*")).first()
    assert some[0] == 0 and some[1] % 600 == 0


def test_copies_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "x")] * 500 + [(5, "x")] * 300 + [(6, "x")] * 200, "doc_id bigint, text string")
    docs = docs.withColumn("source", F.lit("s"))
    tags = spark.createDataFrame([(6, 1, 0)], "doc_id bigint, quality int, toxic int")
    first = interactions.audit(docs, tags).filter("filter_order = 'EABCD' and step = 1").first()
    assert (first.kept, first.removed, first.good_lost) == (800, 200, 200)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 100, 12_345])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    want = [int(((words >> np.uint32(i)) & np.uint32(1)).sum()) for i in range(32)]
    assert interactions.positional_popcount(words).tolist() == want


def test_parts_beyond_what_a_task_holds(spark, monkeypatch):
    cells = spark.range(9000).select(
        (F.col("id") % 5000).cast("string").alias("part"), F.lit(-1).alias("word"), F.lit(3).cast("long").alias("n"),
        F.lit(True).alias("good"), F.lit(False).alias("toxic"),
    )
    got = interactions.survivors(cells).agg(F.count("*"), F.sum(F.col("all")[31]), F.sum(F.col("good")[0]), F.sum(F.col("toxic")[0])).first()
    assert tuple(got) == (5000, 27_000, 27_000, 0)
