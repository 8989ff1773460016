"""Chat perspectives, URL filters and the pipeline against plain versions."""

import re
from collections import Counter, defaultdict

import pytest
from fixtures_llm import nothing, odd_documents
from pyspark.sql import functions as F
from test_llm_documents import plain_classes, plain_contamination, plain_lines

import corpus_pipeline
from rinsework.llm import cascade, divergence, perspectives
from rinsework.llm.queries import URL_RULES, WORD_BPE

# chat perspectives

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "ü\n🙂"), (1, 3, "bob", "same turn"),
    (1, 1, "ann", "hi"), (1, 9, "ann", ""), (2, 0, "system", "nobody else"), (3, None, None, "late"), (3, 5, "", "x"),
    (None, 1, "ann", "no conversation"), (4, 1, "assistant", "a"), (4, 2, "user", "b"), (4, 600, "user", "far"),
]


def plain_rotation(rows, per_part):
    turns = defaultdict(set)
    for c, n, r, t in rows:
        turns[c].add((n, r or "unknown", t or ""))
    out = []
    for c, own in turns.items():
        for me in {r for _, r, _ in own} - {"system"}:
            parts = defaultdict(list)
            for n, r, t in own:
                parts[None if n is None else n // per_part].append((n if n is not None else -1, r, t))
            for part, cells in parts.items():
                text, spans = "", []
                for _, r, t in sorted(cells):
                    text += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == me else f"user name={r}") + "\n"
                    if r == me:
                        spans.append((len(text), len(text) + len(t) + len("<|im_end|>")))
                    text += t + "<|im_end|>\n"
                out.append((c, me, part, text, tuple(spans), len(cells)))
    return out


@pytest.mark.parametrize("per_part", [512, 2])
def test_rotation(spark, per_part):
    df = spark.createDataFrame([(*t, "other") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, conv string")
    rows = perspectives.rotate(df, turns_per_part=per_part).collect()
    got = [(r.conv_id, r.perspective, r.part, r.text, tuple((s.start, s.end) for s in r.targets), r.n_turns) for r in rows]
    assert Counter(got) == Counter(plain_rotation(TURNS, per_part))
    for r in rows:
        assert r.n_targets == len(r.targets) and r.n_target_chars == sum(s.end - s.start for s in r.targets)
        assert all(r.text[s.start : s.end].endswith("<|im_end|>") for s in r.targets)
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_rotation_without_conversations(spark):
    """Many dialogues without an id: no turn is lost, and no part holds more than its bound."""
    rows = [(None, 0, "ann", "hi")] * 7 + [(None, 0, "bob", f"b{i}") for i in range(5)] + [(None, None, "ann", "late")] * 3
    rows += [(None, 1, "bob", "hi")] * 2 + [(1, 0, "ann", "hi")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = perspectives.rotate(df, turns_per_part=4).collect()
    assert [(r.perspective, r.part, r.n_turns) for r in got if r.conv_id == 1] == [("ann", 0, 1)]
    order = sorted(rows[:17], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    for me in ("ann", "bob"):
        own = sorted((r for r in got if r.conv_id is None and r.perspective == me), key=lambda r: r.part)
        assert [(r.part, r.n_turns) for r in own] == [(0, 4), (1, 4), (2, 4), (3, 4), (4, 1)]
        head = lambda role: "assistant" if role == me else f"user name={role}"  # noqa: E731, B023
        assert "".join(r.text for r in own) == "".join(f"<|im_start|>{head(r)}\n{t}<|im_end|>\n" for _, _, r, t in order)
        assert sum(r.n_targets for r in own) == sum(r[2] == me for r in order)


# URL filters

URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://example.net/de", "http://b.example.com/de/2#f", "http://example.com/d",
    "https://x.org/fr/", "https://org/fr/a", "http://xorg/fr/", "http://bad.example", "http://bad.example/de/x", "no scheme/net/",
    "", None, "://net/", "x://y://net/", "http://net", "http://net?x=/", "ftp://u@h.net:80/p?a#b", "http://a.net/line\nbreak",
]


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if host in listed else "allow"


@pytest.mark.parametrize("shard_bytes", [1 << 20, 24])
def test_urls(spark, shard_bytes):
    df = spark.createDataFrame([(i, u, f"r{i}", "old") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, row string, host string")
    listed = spark.createDataFrame([("bad.example",), ("not.there",), (None,), ("h",), ("bad.example",)], "k string")
    got = cascade.judge_urls(df, listed, URL_RULES, shard_bytes=shard_bytes)
    assert got.columns == ["page_id", "url", "row", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS) * 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, {"bad.example", "h"})
    assert cascade.judge_urls(df.limit(0), listed, URL_RULES).count() == 0


@pytest.mark.parametrize("every,shard_bytes", [(7, 1 << 20), (3, 3_000), (10_000, 1 << 20)])
def test_membership_is_exact_over_the_universe(spark, every, shard_bytes):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id").alias("k"), F.col("id"))
    listed = keys.filter(F.col("id") % every == 1).select("k")
    built = cascade.build(keys.select("k").unionByName(keys.select("k")), listed, shard_bytes)
    assert (built.shards > 1) == (shard_bytes == 3_000)
    marked = cascade.mark(keys, built, "k")
    assert marked.filter(F.col("listed") != (F.col("id") % every == 1)).count() == 0 and marked.count() == 3000


def test_null_keys_and_empty_lists(spark):
    keys = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    built = cascade.build(keys, keys.limit(0))
    assert sorted((r.k or "", r.listed) for r in cascade.mark(keys, built, "k").collect()) == [("", None), ("a", False), ("b", False)]


def test_hashes_take_the_seed_first(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("k"))
    for h, seed in [(cascade.hash_key(F.col("k"), s), s) for s in cascade.SEEDS]:
        assert df.filter(h != F.xxhash64(F.lit(seed), F.col("k"))).count() == 0


def test_keys_that_share_both_hashes_fail_the_build(spark, monkeypatch):
    monkeypatch.setattr(cascade, "hash_key", lambda key, seed: F.xxhash64(F.lit(seed), F.substring(key, 1, 1)))
    monkeypatch.setattr(cascade, "CHECKED", 3)
    keys = spark.createDataFrame([("a1",), ("a2",), ("b",)], "k string")
    with pytest.raises(ValueError, match="share both hashes"):
        cascade.build(keys, keys.filter("k = 'a1'"))


# pipeline


def test_stages_against_plain_versions(spark, data, tmp_path):
    """Each stage on what the one before wrote; decisions by brute force, columns unchanged up to the last."""
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.read.parquet(f"{data}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = docs.collect()
        assert out.columns == (columns if k < 4 else [*columns, "ids"])
        ids = Counter(r.doc_id for r in after)
        if k == 0:
            judged = divergence.judge(spark.createDataFrame(before, out.schema), divergence.fit_references(spark.createDataFrame(before, out.schema)))
            assert ids == Counter(r.doc_id for r in judged.filter("kept").select("row.doc_id").collect()) and 0 < len(after) < len(before)
        elif k == 1:
            want = plain_lines([(r.doc_id, r.text, r.source) for r in before], 10)
            assert Counter((r.doc_id, r.text, len(r.text)) for r in after) == Counter(
                (d, t, len(t)) for d, n, gone, t in want if not (gone and gone == n)
            )
            assert all(r.n_chars == len(r.text) for r in after)
        elif k == 2:
            classes = plain_classes([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5)
            assert ids == Counter(r.doc_id for r in before if r.doc_id is None or classes[r.doc_id][1] == r.doc_id)
            assert len(after) < len(before)
        elif k == 3:
            found = plain_contamination([(r.doc_id, r.text) for r in before], items)
            assert ids == Counter(d for d, n, hit, _ in found if not (hit and 20 * hit >= n))
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(WORD_BPE)
            t.no_padding()
            t.no_truncation()
            assert [e.ids for e in t.encode_batch([r.text for r in after], add_special_tokens=False)] == [list(r.ids) for r in after]
            assert len(after) == len(before)


def test_empty_input(spark, data):
    docs = nothing(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
