"""One query per operator over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework.llm import bpe, divergence, simple8b
from rinsework.llm.cascade import host_path, judge_urls
from rinsework.llm.contamination import contaminated, contamination
from rinsework.llm.groupjoin import group_join
from rinsework.llm.interactions import audit
from rinsework.llm.lines import drop_shared_lines
from rinsework.llm.middles import fill_in_middle, restored
from rinsework.llm.neardup import near_duplicates
from rinsework.llm.perspectives import rotate
from rinsework.llm.repeats import repeats
from rinsework.llm.unigram import count_tokens

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


OP1_SQL = """
    WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS words
        FROM docs, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS u(i)),
    again AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM
        (SELECT doc_id, i FROM windows SEMI JOIN again USING (words)) AS t, unnest(range(i, i + 35)) AS u(p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
        sha256(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(coalesce(places, []), p)], ' '))
            AS kept_sha256
    FROM docs LEFT JOIN gone USING (doc_id)"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark, folder):
    found = repeats(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _common(lang: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in divergence.COMMON_WORDS[lang]) + "]"


def _distance_sql(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts, null where either is empty or missing."""
    p, q = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0.0 END"
    cells = f"[{part(p)} + {part(q)} FOR i IN range(1, len({counts}) + 1)]"
    return f"CASE WHEN list_sum({counts}) > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(list_sum({cells}) / 2, 0.0)) END"


OP2_SQL = f"""
    WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS body,
        coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
        CASE lang {" ".join(f"WHEN '{k}' THEN {_common(k)}" for k in divergence.COMMON_WORDS)} END AS list FROM documents),
    solid AS (SELECT *, array_to_string(w, '') AS s,
        [lower(x) FOR x IN w IF strlen(x) <= 5 AND list_contains(list, lower(x))] AS hits FROM words),
    hist AS (SELECT *, length(s) AS word_chars, length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        [length(regexp_replace(s, '[^a-z]+', '', 'g')), length(regexp_replace(s, '[^A-Z]+', '', 'g')),
         length(regexp_replace(s, '[^0-9]+', '', 'g')), length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')),
         length(regexp_replace(s, '[a-zA-Z0-9#*$%&|<>]+|[^\\x00-\\x7F]+', '', 'g')),
         length(regexp_replace(s, '[\\x00-\\x7F]+', '', 'g'))] AS classes,
        CASE WHEN list IS NOT NULL THEN list_append([len([h FOR h IN hits IF h = c]) FOR c IN list], len(w) - len(hits)) END
            AS common,
        [x FOR x IN string_split(body, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM solid),
    cells AS (SELECT lang, i, sum(classes[i]) AS n FROM hist, unnest(range(1, 7)) AS u(i) WHERE len(w) >= 50 GROUP BY lang, i),
    class_refs AS (SELECT lang, list(n ORDER BY i) AS r FROM cells WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang),
    pooled AS (SELECT list(n ORDER BY i) AS r FROM (SELECT i, sum(n) AS n FROM cells GROUP BY i) AS t),
    word_refs AS (SELECT lang, list(n ORDER BY i) AS r FROM
        (SELECT lang, i, sum(common[i]) AS n FROM hist, unnest(range(1, 22)) AS u(i)
         WHERE len(w) >= 100 AND list IS NOT NULL GROUP BY lang, i) AS t GROUP BY lang),
    windows AS (SELECT doc_id, i, w[i : i + 2] AS x FROM words, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS u(i)),
    twice AS (SELECT doc_id, x FROM windows GROUP BY doc_id, x HAVING count(*) > 1),
    repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM
        (SELECT doc_id, i FROM windows SEMI JOIN twice USING (doc_id, x)) AS t, unnest(range(i, i + 3)) AS u(p) GROUP BY doc_id),
    measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
        CASE WHEN len(w) >= 50 THEN {_distance_sql("classes", "coalesce(class_refs.r, pooled.r)")} END AS class_distance,
        CASE WHEN len(w) >= 100 THEN {_distance_sql("common", "word_refs.r")} END AS word_distance
        FROM hist LEFT JOIN repeated USING (doc_id) LEFT JOIN class_refs USING (lang) LEFT JOIN word_refs USING (lang), pooled)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
            AND coalesce(class_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.33 AS kept
    FROM measured"""


@query("op2_distribution_divergence", OP2_SQL)
def op2(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    rules = divergence.Rules(relative=False)  # as the SQL has it: references of all documents, a fixed limit
    judged = divergence.judge(docs, divergence.fit_references(docs, rules=rules), rules=rules)
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP3_SQL = """
    WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS text
        FROM conversations),
    speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
    cells AS (SELECT conv_id, perspective, CAST(floor(turn / 512) AS BIGINT) AS part, turn, role, text, role = perspective AS own,
        '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
            ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
        FROM turns JOIN speakers USING (conv_id)),
    placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part
        ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS after FROM cells)
    SELECT conv_id, perspective, part, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
        coalesce(string_agg(CAST(after - length(body) AS BIGINT) || ':' || CAST(after - 1 AS BIGINT), ',' ORDER BY turn, role, text)
            FILTER (own), '') AS targets,
        count(*) AS n_turns, count(*) FILTER (own) AS n_targets,
        CAST(coalesce(sum(length(body) - 1) FILTER (own), 0) AS BIGINT) AS n_target_chars
    FROM placed GROUP BY conv_id, perspective, part"""


@query("op3_perspective_rotation", OP3_SQL)
def op3(spark, folder):
    rendered = rotate(table(spark, folder, "conversations"))
    spans = F.transform("targets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rendered.withColumn("targets", F.array_join(spans, ","))


OP4_SQL = """
    WITH docs AS (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i,
        unnest(string_split(text, chr(10))) AS raw FROM documents),
    lines AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM docs),
    shared AS (SELECT line, min(doc_id) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
    marked AS (SELECT lines.*, shared.line IS NOT NULL AND coalesce(doc_id <> first, true) AS gone FROM lines LEFT JOIN shared USING (line))
    SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
        sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""


@query("op4_line_site_spread", OP4_SQL)
def op4(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    marked = drop_shared_lines(docs)
    return marked.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


WINDOWS_OF_ITEMS = """
    items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
        array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
        FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0)"""

OP5_SQL = f"""
    WITH {WINDOWS_OF_ITEMS},
    docs AS (SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
    found AS (SELECT doc_id, i, t.n, item_id FROM
        (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
         FROM docs, (SELECT DISTINCT n FROM windows) AS lengths, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS u(i)) AS t
        JOIN windows ON t.n = windows.n AND t.words = windows.words),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
        (SELECT DISTINCT doc_id, i, n FROM found) AS f, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list FROM
        (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) AS f GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


@query("op6_bpe_trie")
def op6(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    back = bpe.decode(bpe.encode(docs, WORD_BPE).select("doc_id", "ids"), WORD_BPE)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_simple8b")
def op7(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    files = simple8b.write(docs, simple8b.new_folder(spark, "simple8b"), WORD_BPE, end_id=1, null_ids=True)
    return simple8b.read(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op8_trie_counts")
def op8(spark, folder):
    counted = count_tokens(table(spark, folder, "documents", "doc_id", "text"), PIECE_BPE)
    return counted.select("doc_id", "n_words", "n_tokens")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A host is listed if one of its labels joins two words of which one is listed here.
LISTED_TERMS = ("spam", "pills", "casino", "adult", "bets", "ads")
LISTED_HOST = r"(^|\.)(([a-z]+-)?(" + "|".join(LISTED_TERMS) + r")-[a-z]+|[a-z]+-(" + "|".join(LISTED_TERMS) + r"))(\.|$)"

OP9_SQL = f"""
    WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    urls AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
        ('allow', 'org', '/fr/')) AS t(action, h, p)),
    fitting AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
        FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(action,
        CASE WHEN regexp_matches(host, '{LISTED_HOST}') THEN 'block' ELSE 'allow' END) AS verdict
    FROM urls LEFT JOIN fitting USING (page_id)"""


@query("op9_bloom_cascade", OP9_SQL)
def op9(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url")
    host, _ = host_path(F.col("url"))
    listed = pages.select(host.alias("host")).filter(F.col("host").rlike(LISTED_HOST)).distinct()
    judged = judge_urls(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_chosen_path")
def op10(spark, folder):
    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


OP11_SQL = """
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
    draws AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
        CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM docs),
    cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90
            THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
    pieces AS (SELECT *, substring(body, 1, a) AS prefix, substring(body, a + 1, b - a) AS middle, substring(body, b + 1) AS suffix
        FROM cuts)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(body) AS restored_sha256
    FROM pieces"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark, folder):
    made = fill_in_middle(table(spark, folder, "documents", "doc_id", "text"))
    return made.select(
        "row.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
    WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
        FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM grams AS a JOIN grams AS b USING (g)
        WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM pairs JOIN sizes AS s ON x = s.doc_id JOIN sizes AS t ON y = t.doc_id
        WHERE 100 * m >= 85 * (s.n + t.n - m)),
    reach AS (SELECT x AS doc_id, y AS other FROM links UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x),
    least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
    FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


@query("op12_token_group_join", OP12_SQL)
def op12(spark, folder):
    return group_join(table(spark, folder, "documents", "doc_id", "text"))


OP13_SQL = """
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
        coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    firsts AS (SELECT body, min(doc_id) AS first FROM docs GROUP BY body),
    marks AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 5 * length(body) AS INT)
        + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask
        FROM docs JOIN firsts USING (body)),
    tags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t
        FROM marks LEFT JOIN tags USING (doc_id) GROUP BY part, mask),
    letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, b)),
    orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
        FROM letters AS p, letters AS q, letters AS r, letters AS s, letters AS t WHERE p.b | q.b | r.b | s.b | t.b = 31),
    steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before
        FROM orders, unnest(range(1, 6)) AS u(step)),
    rows AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
        coalesce(sum(g) FILTER (mask & before = 0 AND mask & own > 0), 0) AS good_lost,
        coalesce(sum(t) FILTER (mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM rows"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    return audit(docs, table(spark, folder, "labels"))
