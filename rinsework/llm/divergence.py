"""Quality rules by distribution divergence: character classes and common words against language references.

A reference is what the corpus itself shows for a language: the summed histograms of its documents that are long
enough and pass the base rule. A document is rejected where its own histogram lies too far from its language's, measured by the
Jensen-Shannon distance (base 2, from 0 to 1). Everything is expressions; the model holds a few dozen numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed lists: frequent function words of each language, lower case.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as are be this by from or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}

WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: a-z, A-Z, digits, symbols, other ASCII, beyond ASCII: counted over the characters of words.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[" + SYMBOLS + "]+", r"[\x00-\x7F]+", None)
#: Bytes of the longest common word: no longer word needs a look.
LONGEST = max(len(w.encode()) for words in COMMON_WORDS.values() for w in words)
#: Share of common words in the references of sf0.1 (0.213 to 0.216), at which max_word_distance holds as it is.
USUAL_SHARE = 0.215


@dataclass(frozen=True)
class Rules:
    """Guards and limits. A test is only made on texts of at least as many words as its guard says.

    ``relative``: references leave out documents that fail the base rule, and for texts with fewer common words
    than their reference ``max_word_distance`` is lowered as far as a text without any lies nearer to it than to a
    reference whose words are common ones by ``USUAL_SHARE``. Else a junk source that thins out the common words of
    its language would put that distance below the limit, and no text could exceed it.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    class_guard: int = 50
    max_class_distance: float = 0.3
    word_guard: int = 100
    max_word_distance: float = 0.33
    relative: bool = True


@dataclass(frozen=True)
class References:
    """Summed counts by language; ``pooled`` serves languages that have no reference of their own."""

    classes: dict[str, list[int]] = field(default_factory=dict)
    words: dict[str, list[int]] = field(default_factory=dict)
    pooled: list[int] = field(default_factory=list)


def _length(c: Column) -> Column:
    return F.char_length(c).cast("long")


def _sum(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def _by_language(lang: Column, make, other: Column) -> Column:
    return reduce(lambda rest, k: F.when(lang == k, make(k)).otherwise(rest), COMMON_WORDS, other)


def _words(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    return df.withColumn("body", body).withColumn("w", F.array_remove(F.split("body", WORDS), ""))


def _class_counts(df: DataFrame) -> DataFrame:
    """Lengths of what is left as class after class is taken out; each step reads a shorter text."""
    df = df.withColumn("left0", F.array_join("w", "")).withColumn("n_left0", _length(F.col("left0")))
    for k, taken in enumerate(CLASSES[:-1]):
        df = df.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", taken, "")).drop(f"left{k}")
        df = df.withColumn(f"n_left{k + 1}", _length(F.col(f"left{k + 1}")))
    last = len(CLASSES) - 1
    counts = [F.col(f"n_left{k}") - F.col(f"n_left{k + 1}") for k in range(last)]
    return df.withColumn("classes", F.array(*counts, F.col(f"n_left{last}"))).drop(f"left{last}")


def _word_counts(df: DataFrame, lang: str) -> DataFrame:
    """How often each common word of the document's language occurs, then all other words; null without a list."""
    language = F.col(f"row.`{lang}`")

    def common(k: str) -> Column:
        return F.filter("w", lambda x: (F.octet_length(x) <= LONGEST) & F.lower(x).isin(COMMON_WORDS[k]))

    df = df.withColumn("hits", F.transform(_by_language(language, common, F.lit(None)), F.lower))
    # each hit stands between blanks of its own, so a word is counted by how much shorter the line is without it
    df = df.withColumn("line", F.concat(F.lit(" "), F.array_join("hits", "  "), F.lit(" ")))
    line, bytes_ = F.col("line"), F.octet_length("line")

    def count(c: Column) -> Column:
        left = F.octet_length(F.replace(line, F.concat(F.lit(" "), c, F.lit(" ")), F.lit("")))
        return ((bytes_ - left) / (F.octet_length(c) + 2)).cast("long")

    words = _by_language(language, lambda k: F.array(*map(F.lit, COMMON_WORDS[k])), F.lit(None).cast("array<string>"))
    counts = F.array_append(F.transform(words, count), (F.size("w") - F.size("hits")).cast("long"))
    return df.withColumn("common", F.when(language.isin(*COMMON_WORDS), counts)).drop("line", "hits")


def _packed(df: DataFrame) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Append n_repeat_words, the number of words in 3-word windows found twice or more in the text."""
    # arrays beside their own shifted slices, not lambdas that look into an outer array: a filter on the result is moved
    # down with all of this inside its condition, and an outer array would then be made anew for every element
    inner = F.greatest(F.size("w") - 2, F.lit(0))
    triples = F.arrays_zip(*[F.slice("w", k, inner) for k in (1, 2, 3)])
    rows = rows.withColumn("hashes", F.transform(triples, lambda t: F.xxhash64(t["0"], t["1"], t["2"])))
    # only texts that hold a window twice sort them, by hash and place, so that equal windows lie side by side
    by_hash = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), by_hash))
    own = F.transform("windows", lambda x: x["h"])
    before = F.concat(F.array(F.lit(None).cast("bigint")), own)
    sides = F.arrays_zip("windows", before, F.slice(own, 2, F.greatest(F.size(own), F.lit(0))))
    twice = F.filter(
        sides,
        lambda x: F.coalesce(x["windows"]["h"] == x["1"], F.lit(False)) | F.coalesce(x["windows"]["h"] == x["2"], F.lit(False)),
    )
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["windows"]["i"]))).drop("windows", "hashes")
    later = F.slice("places", 2, F.greatest(F.size("places"), F.lit(0)))
    covered = F.zip_with("places", later, lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))).cast("long"))
    return rows.withColumn("n_repeat_words", F.coalesce(_sum(covered, "long"), F.lit(0)).cast("long")).drop("places")


def _base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )


def _bare_distance(share: float) -> float:
    """The distance of a text without common words to a reference in which they have this share."""
    rest = 1 - share
    own = rest * math.log2(2 * rest / (1 + rest)) if rest else 0.0
    return math.sqrt(max(0.0, (share + math.log2(2 / (1 + rest)) + own) / 2))


def fit_references(df: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> References:
    """Sum the histograms of documents that reach the guards, by language: one job, a handful of rows back.

    With ``rules.relative`` only those that pass the base rule count.
    """
    rows = _word_counts(_class_counts(_words(_packed(df), text)), lang)
    language = F.when(F.col(f"row.`{lang}`").isin(*COMMON_WORDS), F.col(f"row.`{lang}`"))
    n = F.size("w")
    if rules.relative:
        rows = _repeat_words(rows.withColumn("n_words", n.cast("long")))
        rows = rows.withColumn("counted", F.when(_base_failed(rules), 0).otherwise(F.col("n_words")))
        n = F.col("counted")
    size = 1 + max(map(len, COMMON_WORDS.values()))
    # guards inside the sums: as a filter they would be moved down and every text cut into words twice
    sums = rows.groupBy(language.alias("k")).agg(
        *[F.sum(F.when(n >= rules.class_guard, F.get("classes", F.lit(i)))).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.when(n >= rules.word_guard, F.get("common", F.lit(i)))).alias(f"w{i}") for i in range(size)],
    )
    found = {r.k: r for r in sums.collect() if r.c0 is not None}
    classes = {k: [r[f"c{i}"] for i in range(len(CLASSES))] for k, r in found.items()}
    words = {
        k: [r[f"w{i}"] for i in range(1 + len(COMMON_WORDS[k]))] for k, r in found.items() if k and r.w0 is not None
    }
    pooled = [sum(c[i] for c in classes.values()) for i in range(len(CLASSES))]
    return References({k: c for k, c in classes.items() if k}, words, pooled)


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as counts; null where either is empty."""
    n, m = _sum(counts, "long"), _sum(reference, "long")

    def part(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0)

    def cell(a: Column, b: Column) -> Column:
        p, q = a / n, b / m
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    total = _sum(F.zip_with(counts, reference, cell), "double")
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def judge(df: DataFrame, references: References, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per document: the input row as struct ``row``, the measures, both distances, base_failed and kept.

    Words are runs of other than ASCII white space. Measures: n_words, word_chars, n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words (words in 3-word windows found twice or more in the
    text). ``base_failed``: fewer than min_words words, or more than max_repeat_percent of them repeated. ``kept``:
    not base_failed, and no distance above its limit; a distance whose guard the text misses, whose language has
    no reference, or whose histogram is empty is null and rejects nothing.

    A null or empty text has no words and fails the base rule. Unknown and null languages are held against the
    pooled characters of all languages and no word list. Rows are judged one by one: repeated rows give repeated
    results, and no row moves between tasks.
    """
    rows = _word_counts(_class_counts(_words(_packed(df), text)), lang)
    language = F.col(f"row.`{lang}`")
    array = lambda values: F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")
    pooled = array(references.pooled) if references.pooled else F.lit(None).cast("array<bigint>")
    of_classes = _by_language(language, lambda k: array(references.classes[k]) if k in references.classes else pooled, pooled)
    none = F.lit(None).cast("array<bigint>")
    of_words = _by_language(language, lambda k: array(references.words[k]) if k in references.words else none, none)
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    rows = rows.withColumn("class_reference", of_classes).withColumn("word_reference", of_words)
    limit = F.lit(rules.max_word_distance)
    if rules.relative:
        rest, of_rest = F.element_at("common", -1), F.element_at("word_reference", -1)
        fewer = rest * _sum(F.col("word_reference"), "long") > of_rest * _sum(F.col("common"), "long")

        def lowered(k: str) -> Column:
            counts = references.words.get(k, [])
            share = 1 - counts[-1] / sum(counts) if sum(counts) else USUAL_SHARE
            return F.lit(rules.max_word_distance * min(1.0, _bare_distance(share) / _bare_distance(USUAL_SHARE)))

        limit = F.when(fewer, _by_language(language, lowered, limit)).otherwise(limit)

    rows = _repeat_words(rows)
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    rows = rows.select(
        "row",
        "n_words",
        F.col("n_left0").alias("word_chars"),
        (F.col("n_left3") - F.col("n_left4")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.when(F.col("n_words") >= rules.class_guard, _distance(F.col("classes"), F.col("class_reference"))).alias("class_distance"),
        F.when(F.col("n_words") >= rules.word_guard, _distance(F.col("common"), F.col("word_reference"))).alias("word_distance"),
        limit.alias("word_limit"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > F.col("word_limit")
    )
    rows = rows.withColumn("base_failed", _base_failed(rules)).withColumn("kept", ~F.col("base_failed") & ~far).drop("word_limit")
    # columns of a generator: a filter on them stays above it and is not moved down with all measures inside its condition
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, in their own columns. References come from ``df`` itself."""
    judged = judge(df, fit_references(df, text, lang, rules), text, lang, rules)
    good = judged.filter("kept").select("row")
    return good.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
