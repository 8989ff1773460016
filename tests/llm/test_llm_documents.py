"""Document operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from fixtures_llm import nothing, odd_documents

from rinsework.llm import contamination, divergence, graph, lines, neardup, repeats
from rinsework.llm.graph import components
from rinsework.plans.cut import kept

LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall(text or "")


def multiset(rows):
    return Counter(map(repr, rows))


# substring dedup


def plain_repeats(rows, n):
    seen = Counter(tuple(w[i : i + n]) for _, t in rows for w in [split(t)] for i in range(len(w) - n + 1))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 4, 1])
def test_repeats(spark, window):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = odd_documents(spark, extra=[passage + " a b " + passage, "k " + passage, passage[:-3], "ü" * 3 + " " + passage])
    found = repeats.repeats(docs, window=window, chunk_bytes=50_000, range_hashes=500)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert multiset(got) == multiset(plain_repeats(rows, window))
    for r in found.collect():
        spans = [(s.start, s.end) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_repeats_of_nothing(spark):
    assert repeats.repeats(nothing(spark)).count() == 0


# decontamination


def plain_contamination(rows, items, n=13):
    form = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: form.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = norm(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    sizes, out = {len(k) for k in windows}, []
    for d, t in rows:
        w, hit, found = norm(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    hit.update(range(k, k + m))
                    found |= own
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def benchmark(spark):
    long = " ".join(f"q{i}" for i in range(30))
    rows = [(1, long), (2, "Two  words!"), (3, None), (4, ""), (5, "two-WORDS"), (None, "x1 y1 z1"), (6, long), (6, "one")]
    return spark.createDataFrame(rows + rows[:2], "item_id bigint, text string"), long


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, block_bytes):
    items, long = benchmark(spark)
    docs = odd_documents(
        spark,
        extra=[long, "a " * 50 + long[:60], long.upper() + " x1, y1; z1.", "q3 " + long[9:70] + " two... words", "two words " * 30],
    ).filter("n_chars < 60000 or n_chars is null")
    found = contamination.contamination(docs, items, block_bytes=block_bytes)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "items").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_contamination(rows, [(r.item_id, r.text) for r in items.collect()])
    assert multiset(got) == multiset(want)
    assert sum(n for _, _, n, _ in want) > 100


def test_decontaminate(spark):
    items, long = benchmark(spark)
    docs = odd_documents(spark, extra=["start " * 500 + "\n" + long + "! end", long])
    clean = contamination.decontaminate(docs, items)
    assert clean.columns == docs.columns
    plain = plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert clean.count() == sum(not (h and 20 * h >= n) for _, n, h, _ in plain)
    cut = {r.text for r in contamination.decontaminate(docs, items, action="spans").collect()}
    assert "start " * 500 + "\n! end" in cut and None in cut
    clash = docs.withColumnsRenamed({"row": "spans", "d": "Items", "w": "text_"})
    again = contamination.decontaminate(clash, items, action="spans")
    assert again.columns == clash.columns and {r.text for r in again.collect()} == cut
    assert Counter(r.spans for r in again.collect()) == Counter(r.row for r in docs.collect())
    with pytest.raises(ValueError):
        contamination.decontaminate(docs, items, action="other")


def test_decontaminate_empty_sides(spark):
    items, _ = benchmark(spark)
    docs = odd_documents(spark)
    assert contamination.decontaminate(nothing(spark), items).count() == 0
    assert contamination.decontaminate(docs, items.limit(0)).count() == docs.count()


# near duplicates


def plain_classes(rows, size=4, percent=80):
    sets, parent = {}, {}
    for d, t in rows:
        w = split((t or "").translate(LOWER))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        sets[d] = grams or ({tuple(w)} if w else set())
        parent[d] = d

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def chain(n=40):
    """Texts of which each is like the next, and few like more."""
    return [" ".join(f"c{i}" for i in range(k * 4, k * 4 + 90)) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"group": 3, "small_node": 4}, {"group": 2, "small_node": 1}, {"shingle": 5}])
def test_classes(spark, options, monkeypatch):
    monkeypatch.setattr(neardup, "FIRST_LEADERS", 2)
    docs = odd_documents(spark, extra=chain())
    got = neardup.near_duplicates(docs, **options).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_classes([r for r in rows if r[0] is not None], options.get("shingle", 4))
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id][1])
    sizes = Counter(c for _, c in want.values())
    assert max(sizes.values()) >= 20


def test_classes_at_a_lower_percent(spark):
    texts = [[f"p{k}x{i}" for i in range(103)] for k in range(8)]
    rows = [(2 * k, " ".join(w)) for k, w in enumerate(texts)]
    rows += [(2 * k + 1, " ".join(w[: 68 if k < 6 else 50])) for k, w in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=60, enough=20).collect()
    want = plain_classes(rows, percent=60)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) == 10


def test_children_are_made_once(spark, monkeypatch):
    made = []

    def counted(rows, level, children=neardup._children):
        total = spark.sparkContext.accumulator(0)
        made.append(total)

        def count(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        return children(rows, level).mapInArrow(count, "v bigint, node bigint")

    monkeypatch.setattr(neardup, "_children", counted)
    rows = [(k, t) for k, t in enumerate(chain(12))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), small_node=4).count()
    assert made[0].value == neardup.TREES * neardup.CHILDREN * got


def test_rounds_join_only_what_their_links_join(spark, monkeypatch):
    rounds = []

    def watched(edges, *more):
        roots = components(edges, *more)
        rounds.append(({x for e in edges.collect() for x in e}, {r.vertex for r in roots.collect() if r.vertex != r.root}))
        return roots

    monkeypatch.setattr(neardup, "components", watched)
    monkeypatch.setattr(neardup, "FIRST_LEADERS", 2)
    rows = list(enumerate(chain(40)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), group=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_classes(rows)
    gone, rounds = set(), rounds[1:]  # the first is that of rough clusters
    for seen, joined in rounds:
        assert not seen & gone  # whatever was joined to a root comes no more
        gone |= joined
    assert len(rounds) > 1


def test_drop_near_duplicates(spark):
    docs = odd_documents(spark)
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    want = plain_classes([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    keep = Counter(r.doc_id for r in docs.collect() if r.doc_id is None or want[r.doc_id][1] == r.doc_id)
    assert Counter(r.doc_id for r in left.collect()) == keep
    assert neardup.near_duplicates(nothing(spark)).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "kept", lambda df, *name: tables.append(name) or kept(df, *name))
    edges = [(7, 1), (5, 1), (9, 2), (9, 9), (5, 1)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2}
    assert len(tables) <= 2  # the stars and their least neighbours


def test_components(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, 3), (3, 5), (9, 9), (None, 4), (7, None), (1, 3), (40, 41), (42, 41)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 200 for i in range(200, 261)} | {1: 1, 3: 1, 5: 1, 40: 40, 41: 40, 42: 40}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# line spread


def test_lines_that_no_row_with_an_id_holds(spark):
    docs = spark.createDataFrame([(None, f"own {i}\nshared", f"s{i}") for i in range(12)], "doc_id bigint, text string, source string")
    got = lines.drop_shared_lines(docs).select("row.text", "n_lines", "n_removed", "kept").collect()
    assert {tuple(r) for r in got} == {(f"own {i}\nshared", 2, 1, f"own {i}") for i in range(12)}


def plain_lines(rows, sites):
    strip = lambda x: x.strip(" \t\x0b\x0c\r")
    where, first = defaultdict(set), {}
    for d, t, s in rows:
        for x in map(strip, (t or "").split("\n")):
            if x:
                where[x] |= {s} - {None}
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    shared, out = {x for x, s in where.items() if len(s) >= sites}, []
    for d, t, _ in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        cells = t.split("\n")
        gone = [strip(x) in shared and (d is None or d != first.get(strip(x))) for x in cells]
        n = sum(bool(strip(x)) for x in cells)
        out.append((d, n, sum(gone), "\n".join(x for x, g in zip(cells, gone) if not g)))
    return out


@pytest.mark.parametrize("sites", [10, 3, 1])
def test_lines(spark, sites):
    docs = odd_documents(spark)
    marked = lines.drop_shared_lines(docs, min_sites=sites)
    got = [tuple(r) for r in marked.select("row.doc_id", "n_lines", "n_removed", "kept").collect()]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = plain_lines(rows, sites)
    assert multiset(got) == multiset(want) and any(n for _, _, n, _ in want)
    left = lines.dedup_lines(docs, min_sites=sites)
    assert left.columns == docs.columns
    assert left.count() == sum(not (gone and gone == n) for _, n, gone, _ in want)


def test_near_threshold_lines_are_counted(spark):
    rows = [(i * 100 + k, f"line{i}", f"s{k}") for i in range(95, 106) for k in range(i)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    marked = lines.drop_shared_lines(docs, min_sites=100)
    gone = {r.t for r in marked.filter("n_removed > 0").select("row.text").toDF("t").distinct().collect()}
    assert gone == {f"line{i}" for i in range(100, 106)}


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(nothing(spark)).count() == 0


# quality


def plain_measures(text):
    w = split(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    found = [x for x in (text or "").split("\n") if split(x)]
    body = "".join(w)
    return (len(w), len(body), sum(c in "#*$%&|<>" for c in body), len(found) - len(set(found)), len(covered))


def test_quality(spark):
    docs = odd_documents(spark, extra=["a b c " * 40, "#*$ %&| " * 60, "same\nsame\n other\nsame\n"])
    refs = divergence.fit_references(docs)
    got = divergence.judge(docs, refs).select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for r in got.collect():
        measures = plain_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures
        assert r.base_failed == (measures[0] < 50 or 100 * measures[4] > 50 * measures[0])
        assert not (r.kept and r.base_failed)
    kept = divergence.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def test_junk_source_of_a_third_is_rejected(spark):
    rng = random.Random(5)

    def prose(n):
        usual = divergence.COMMON_WORDS["en"]
        return " ".join(rng.choice(usual) if rng.random() < 0.22 else f"{rng.choice('bcdfg')}{rng.choice(LETTERS)}{rng.choice(LETTERS)}y" for _ in range(n))

    junk = [" ".join(f"q{rng.choice(LETTERS)}{rng.choice(LETTERS)}z" for _ in range(900)) for _ in range(20)]
    rows = [(i, prose(300), "en") for i in range(40)] + [(100 + i, t, "en") for i, t in enumerate(junk)]
    rows += [(200, "the same words " * 2_000, "en")]  # fails the base rule, so it adds nothing to the reference
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in divergence.keep_good(docs).collect()) == list(range(40))
    words = divergence.fit_references(docs).words["en"]
    assert sum(words) == 40 * 300 + 20 * 900
    fixed = divergence.Rules(relative=False)
    assert sum(divergence.fit_references(docs, rules=fixed).words["en"]) == sum(words) + 6_000


@pytest.mark.parametrize("n", [60, 600, 6000])
def test_a_filter_on_the_verdict_costs_no_more_than_the_verdict(spark, n):
    docs = spark.createDataFrame([(1, "a b c " * (n // 3), "en"), (2, " ".join(f"w{i}" for i in range(n)), "en")], "doc_id int, text string, lang string")
    judged = divergence.judge(docs, divergence.fit_references(docs))
    start = time.perf_counter()
    assert [r.row.doc_id for r in judged.filter("n_repeat_words = n_words").collect()] == [1]
    assert [r.row.doc_id for r in judged.filter("kept").filter("n_repeat_words = 0").collect()] == [2]
    assert time.perf_counter() - start < 60


def test_quality_of_nothing(spark):
    assert divergence.fit_references(nothing(spark)).pooled == [0] * len(divergence.CLASSES)
    assert divergence.keep_good(nothing(spark)).count() == 0


def test_distance(spark):
    import math

    from pyspark.sql import functions as F

    rows = [([1, 0, 0], [0, 1, 0]), ([2, 2, 0], [50, 50, 0]), ([3, 1, 4], [1, 5, 9]), ([0, 0, 0], [1, 1, 1])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    got = [r[0] for r in df.select(divergence._distance(F.col("a"), F.col("b"))).collect()]
    p, q = [3 / 8, 1 / 8, 4 / 8], [1 / 15, 5 / 15, 9 / 15]
    js = sum(x * math.log2(2 * x / (x + y)) + y * math.log2(2 * y / (x + y)) for x, y in zip(p, q)) / 2
    assert got[0] == 1.0 and got[1] == 0.0 and abs(got[2] - math.sqrt(js)) < 1e-12 and got[3] is None


def test_hash_of_kept_words_is_utf8(spark):
    docs = spark.createDataFrame([(1, "  ü  中\n")], "doc_id bigint, text string")
    from pyspark.sql import functions as F

    got = repeats.repeats(docs).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256("ü 中".encode()).hexdigest()
