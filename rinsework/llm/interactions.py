"""How filters work together: what each removes in every order, from one pass over the documents.

A document that fails some of k <= 5 filters survives those subsets of filters that hold none of them: a truth table of
32 bits, kept as one word. Positional popcounts of the words, by part and label, say how many documents survive each
subset; carry-save adders make them, three words to a sum and a carry at a time. Every figure of every order is a
difference of such survivor counts.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsework.plans.cut import cut

#: Filters at most: their subsets are the bits of a 32-bit word.
MOST = 5
SUBSETS = 1 << MOST
LABELS = ("all", "good", "toxic")
#: Parts whose counts a task holds before it passes them on.
PARTS_AT_ONCE = 4096

BLANKS = r"\x20\x09-\x0D"


def document_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a document's own text decides, by letter; ``text`` must not be null.

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * A-Z characters > 5 * code points. D: holds any of
    ``#$%&*|``. Words are runs of other than ASCII white space, compared with their case.
    """
    words = F.array_remove(F.split(text, f"[{BLANKS}]+"), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def survival_word(failed: list[Column]) -> Column:
    """The 32-bit word whose bit s is set if no filter of the subset s (bit i: filter i) fails. Null is no failure."""
    word = F.lit(-1)
    for i, f in enumerate(failed):
        without = sum(1 << s for s in range(SUBSETS) if not s >> i & 1)
        signed = without - (1 << 32) if without >> 31 else without
        word = word.bitwiseAND(F.when(f, F.lit(signed)).otherwise(F.lit(-1)))
    return word.cast("int")


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """For each of the 32 bit places the number of words that have it set.

    Carry-save adders turn three words of one weight into a sum of this weight and a carry of twice the weight.
    """
    counts, weight, level = np.zeros(32, np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third :]])
        counts += weight * (level[:, None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)).astype(np.int64).sum(axis=0)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def _weighted(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Popcounts of words that stand for n documents each, by the bits of n."""
    total, k = np.zeros(32, np.int64), 0
    while len(n) and int(n.max()) >> k:
        total += positional_popcount(words[n >> k & 1 > 0]) << k
        k += 1
    return total


def _count(batches):
    def passed(counts):
        cells = np.array(list(counts.values()), np.int64).reshape(-1, len(LABELS), SUBSETS)
        columns = [pa.array(cells[:, k, s]) for k in range(len(LABELS)) for s in range(SUBSETS)]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *columns], names=["part", *_names()])

    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        part = batch.column(0).dictionary_encode()
        code = part.indices.to_numpy(zero_copy_only=False)
        word = batch.column(1).to_numpy().view(np.uint32)
        n, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(part.dictionary) + 1))
        for i, name in enumerate(part.dictionary.to_pylist()):
            own = order[edges[i] : edges[i + 1]]
            cells = counts.setdefault(name, np.zeros((len(LABELS), SUBSETS), np.int64))
            cells[0] += _weighted(word[own], n[own])
            for k, label in ((1, good), (2, toxic)):
                marked = own[label[own]]
                cells[k] += _weighted(word[marked], n[marked])
        if len(counts) > PARTS_AT_ONCE:
            yield passed(counts)
            counts = {}
    if counts:
        yield passed(counts)


def _names() -> list[str]:
    return [f"{label}{s}" for label in LABELS for s in range(SUBSETS)]


def survivors(cells: DataFrame) -> DataFrame:
    """``cells`` has part, word, n, good, toxic; a row per part with arrays all, good, toxic of survivors by subset."""
    schema = "part string, " + ", ".join(f"{c} bigint" for c in _names())
    counted = cells.select("part", "word", "n", "good", "toxic").mapInArrow(_count, schema)
    summed = counted.groupBy("part").agg(*[F.sum(c).alias(c) for c in _names()])
    arrays = [F.array(*[F.col(f"{label}{s}") for s in range(SUBSETS)]).alias(label) for label in LABELS]
    return summed.select("part", *arrays)


def order_table(counts: DataFrame, filters: str) -> DataFrame:
    """From survivors per part, one row per part, order of the filters and step.

    kept: survivors after the step. removed: by the step's filter, of what came to it. redundant: fail the filter but
    were removed earlier. unique_fails: fail this filter only. good_lost, toxic_lost: removed ones with the label.
    shapley: the filter's ``removed`` summed over all orders.
    """
    whole = (1 << len(filters)) - 1
    places = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            places.append({"filter_order": "".join(filters[i] for i in order), "step": step, "f": f, "s": before, "t": before | 1 << f})
            before |= 1 << f
    schema = "array<struct<filter_order: string, step: int, f: int, s: int, t: int>>"

    def shapley(f: int) -> Column:
        total = F.lit(0).cast("long")
        for s in range(whole + 1):
            if not s >> f & 1:
                m = s.bit_count()
                ways = factorial(m) * factorial(len(filters) - 1 - m)
                total = total + (F.get("all", F.lit(s)) - F.get("all", F.lit(s | 1 << f))) * ways
        return total

    rows = counts.withColumn("sums", F.array(*[shapley(f) for f in range(len(filters))]))
    rows = rows.select("part", *LABELS, "sums", F.inline(F.from_json(F.lit(json.dumps(places)), schema)))
    own = F.col("t") - F.col("s")
    lost = {label: F.get(label, F.col("s")) - F.get(label, F.col("t")) for label in LABELS}
    fails = F.get("all", F.lit(0)) - F.get("all", own)
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("all", F.col("t")).alias("kept"),
        lost["all"].alias("removed"),
        (fails - lost["all"]).alias("redundant"),
        (F.get("all", F.lit(whole) - own) - F.get("all", F.lit(whole))).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.get("sums", F.col("f")).alias("shapley"),
    )


def audit(
    df: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    part: str = "source",
    label_id: str = "doc_id",
    good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """The table of ``order_table`` for the filters of ``document_filters`` and E: equal to the text of a smaller id.

    A null text is empty, a null part the empty string. E looks at the whole table, removed or not; a row without id
    passes E and has no labels. Rows that share an id are documents of their own: equal ones both count, and neither is a
    copy of the other. A document is good or toxic if any row of ``labels`` for its id has a 1 there; labels without a
    document add nothing. No documents give no rows. Texts are compared by their sha256. Other columns are not looked at.

    Texts stay in the first pass; from there on a document is its id, part, digest and the answers of four filters.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.col(f"`{part}`")
    docs = df.select(F.col(f"`{doc_id}`").alias("d"), F.coalesce(own.cast("string"), F.lit("")).alias("part"), body.alias("body"))
    tests = document_filters(F.col("body"))
    # equal rows are combined before they travel: a row that fills a third of the table is one record a task
    docs = docs.select("d", "part", F.unhex(F.sha2("body", 256)).alias("digest"), survival_word(list(tests.values())).alias("word"))
    docs = cut(docs.groupBy("d", "part", "digest", "word").agg(F.count(F.lit(1)).alias("n")))
    named = docs.filter(F.col("d").isNotNull())
    firsts = named.groupBy(F.col("digest").alias("same")).agg(F.min("d").alias("first"))
    # a digest's key is its least document, so the copies of a hot text meet nothing and lie apart
    judged = named.join(firsts, (F.col("digest") == F.col("same")) & (F.col("d") == F.col("first")), "left")
    judged = judged.select("d", "part", "word", "n", F.col("first").isNull().alias("copy"))
    ones = labels.select(F.col(f"`{label_id}`").alias("key"), (F.col(f"`{good}`") == 1).alias("g"), (F.col(f"`{toxic}`") == 1).alias("t"))
    ones = ones.filter(F.col("key").isNotNull() & (F.col("g") | F.col("t")))
    ones = ones.groupBy("key").agg(F.bool_or("g").alias("g"), F.bool_or("t").alias("t"))
    judged = judged.join(ones, F.col("d") == F.col("key"), "left")
    last = survival_word([F.lit(False)] * len(tests) + [F.col("copy")])
    no = F.lit(False)
    cells = judged.select(
        "part", F.col("word").bitwiseAND(last).alias("word"), "n", F.coalesce("g", no).alias("good"), F.coalesce("t", no).alias("toxic")
    )
    cells = cells.unionByName(docs.filter(F.col("d").isNull()).select("part", "word", "n", no.alias("good"), no.alias("toxic")))
    return order_table(survivors(cells), "".join(tests) + "E")
