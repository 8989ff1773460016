"""URL filters by a Bloom filter cascade: exact membership over a known universe of keys, without a join.

The first level encodes the listed keys. Keys of the universe that pass it by mistake are encoded in the second
level, listed keys that pass that one by mistake in the third, and so on, until nothing passes by mistake. A key of
the universe is then listed exactly if the first level that it fails has an even number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from rinsework.llm.arrow import with_columns
from rinsework.names import fresh
from rinsework.plans.cut import cut

#: Bytes of one shard's levels that may be broadcast. More keys make more shards, not larger ones.
SHARD_BYTES = 32 << 20
#: A key's hash has 128 bits in two halves; equal halves would be the only way to tell two keys apart wrongly.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Levels after which the hashes are searched for keys that no level can tell apart.
CHECKED = 40


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int


def level_for(n: int, rate: float) -> Level:
    """The size of a filter of n keys with the given rate of false positives."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return Level(-(-bits // 64) * 64, max(1, round(-math.log2(rate))))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (to ``?``, ``#`` or the end)."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, host, path) that fits a host, or one above it, and the start of the path: name, action."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        action = F.when(fits, verdict).otherwise(action)
    return name, action


def _places(h1: Column, h2: Column, level: Level, number: int) -> Column:
    """The bits of a key in a level: steps of one hash from the other, both turned for each level."""
    first = F.xxhash64(h1, F.lit(number))
    step = F.xxhash64(h2, F.lit(number))
    return F.transform(
        F.sequence(F.lit(0), F.lit(level.probes - 1)),
        lambda i: F.pmod(F.shiftrightunsigned(first, 2) + i * F.shiftrightunsigned(step, 24), F.lit(level.bits)),
    )


def _bit() -> Column:
    return F.pmod("bit", F.lit(64)).cast("int")


def _words(keys: DataFrame, level: Level, number: int) -> DataFrame:
    """The set bits of a level by shard, as 64-bit words: or-ed task by task before the shuffle."""
    bits = keys.select("shard", F.explode(_places(F.col("h1"), F.col("h2"), level, number)).alias("bit"))
    word = F.shiftrightunsigned("bit", 6).alias("word")
    return bits.groupBy("shard", word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit())).alias("x"))


class Cascade:
    """The levels of all shards as tables on the shared folder, and how many keys went into each."""

    def __init__(self, shards: int, levels: list[tuple[Level, DataFrame]]):
        self.shards, self.levels = shards, levels

    def shard(self, number: int) -> list[tuple[int, int, np.ndarray]]:
        """One shard's levels in memory: bits, probes, words. Bounded by the size a shard was planned for."""
        out = []
        for level, words in self.levels:
            cells = np.zeros(level.bits // 64, np.int64)
            rows = words.filter(F.col("shard") == number).select("word", "x").toPandas()
            cells[rows["word"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64)
            out.append((level.bits, level.probes, cells.view(np.uint64)))
        return out




def hash_key(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)  # the seed first: after the key it would only turn the key's one hash


def _passing(keys: DataFrame, words: DataFrame, level: Level, number: int) -> DataFrame:
    """Keys whose bits are all set in a level. Bits meet words by shard and place, as neither is bounded."""
    word = F.shiftrightunsigned("bit", 6)
    probes = keys.select("*", F.explode(F.array_distinct(_places(F.col("h1"), F.col("h2"), level, number))).alias("bit"))
    probes = probes.select("*", word.alias("word"))
    found = probes.join(words, ["shard", "word"], "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("x"), _bit()).bitwiseAND(1), F.lit(0))
    return found.groupBy(*keys.columns).agg(F.min(hit).alias("all")).filter("all = 1").drop("all")


def build(universe: DataFrame, listed: DataFrame, shard_bytes: int = SHARD_BYTES) -> Cascade:
    """A cascade over all keys of ``universe`` (one text column), of which those in ``listed`` are listed.

    Keys are made distinct first, so a key that a third of the rows bear costs one row per task. Listed keys that
    the universe lacks are encoded too; null keys are left out. Every level is built and probed in Spark and cut on
    the shared folder; keys never come to the driver. The number of levels follows the logarithm of the keys. A listed
    key that shares all 128 bits of its hash with another fails the build.
    """
    column = F.col(f"`{universe.columns[0]}`")
    wanted = listed.select(F.col(f"`{listed.columns[0]}`").alias("k"), F.lit(True).alias("listed"))
    all_keys = universe.select(column.alias("k"), F.lit(False).alias("listed")).unionByName(wanted)
    keys = all_keys.filter("k is not null").groupBy("k").agg(F.max("listed").alias("listed"))
    hashes = [hash_key(F.col("k"), s).alias(n) for s, n in zip(SEEDS, ("h1", "h2"))]
    keys = cut(keys.select(*hashes, "listed"))
    both = keys.filter("listed").join(keys.filter("not listed").select("h1", "h2"), ["h1", "h2"], "left_semi")
    n_listed, n_rest = (keys.filter(c).count() for c in ("listed", "not listed"))
    # all levels together take a few times the first: its bits for the listed keys, then a bit and a half a key and level
    rate = min(0.5, max(1e-6, 0.7 * n_listed / max(1, n_rest)))
    expected = level_for(max(1, n_listed), rate).bits // 8 + n_listed
    shards = max(1, -(-4 * expected // shard_bytes))
    keys = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "listed")
    encoded, others = keys.filter("listed").drop("listed"), keys.filter("not listed").drop("listed")
    levels, number, n = [], 0, max(1, n_listed)
    while True:
        # a shard holds its share of the keys, give or take some standard deviations
        share = n if shards == 1 else n / shards + 6 * math.sqrt(n / shards) + 1
        level = level_for(math.ceil(share), rate if number == 0 else 0.5)
        words = cut(_words(encoded, level, number))
        levels.append((level, words))
        others, encoded = encoded, cut(_passing(others, words, level, number))
        n, number = encoded.count(), number + 1
        if n == 0:
            return Cascade(shards, levels)
        if number == CHECKED and not both.isEmpty():
            raise ValueError("a listed key and another share both hashes, so no number of levels tells them apart")


class Member:
    """Membership of hashed keys in one shard's levels."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels

    def __call__(self, firsts: list[np.ndarray], steps: list[np.ndarray]) -> np.ndarray:
        n = len(firsts[0]) if firsts else 0
        inside, left = np.zeros(n, bool), np.arange(n)
        for number, (bits, probes, words) in enumerate(self.levels):
            if not len(left):
                break
            passed = np.ones(len(left), bool)
            first, step = firsts[number][left] >> np.uint64(2), steps[number][left] >> np.uint64(24)
            for i in range(probes):
                place = (first + np.uint64(i) * step) % np.uint64(bits)
                passed &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
            inside[left[~passed]] = number % 2 == 1
            left = left[passed]
        inside[left] = len(self.levels) % 2 == 1  # passed all: only keys encoded in the last level do
        return inside


def mark(df: DataFrame, cascade: Cascade, key: str, out: str = "listed") -> DataFrame:
    """Append whether a key is listed: exact for keys of the universe the cascade was built on; null for null keys.

    Rows are probed where they lie. With more than one shard the rows are taken in as many passes, each with one
    shard's levels broadcast, so what an executor holds stays within the size of a shard.
    """
    column = F.col(f"`{key}`")
    h1, h2 = (hash_key(column, s) for s in SEEDS)
    n = len(cascade.levels)
    firsts, steps = fresh("firsts", [*df.columns, out]), fresh("steps", [*df.columns, out])
    hashed = df.withColumn(firsts, F.array(*[F.xxhash64(h1, F.lit(i)) for i in range(n)]))
    hashed = hashed.withColumn(steps, F.array(*[F.xxhash64(h2, F.lit(i)) for i in range(n)]))
    at = df.columns.index(key)
    done = None
    for k in range(cascade.shards):
        own = hashed.filter(F.pmod(h1, F.lit(cascade.shards)) == k) if cascade.shards > 1 else hashed
        shared = df.sparkSession.sparkContext.broadcast(cascade.shard(k))

        def make(shared=shared, width=len(hashed.columns)):
            member = Member(shared.value)

            def work(part):
                grids = [
                    part.column(c).flatten().to_numpy().reshape(-1, n).view(np.uint64) for c in (width - 2, width - 1)
                ]
                found = member(*[[g[:, i] for i in range(n)] for g in grids])
                return [pa.array(found, pa.bool_(), mask=part.column(at).is_null().to_numpy(zero_copy_only=False))]

            return work

        marked = with_columns(own, at, [StructField(out, BooleanType())], make).drop(firsts, steps)
        done = marked if done is None else done.unionByName(marked)
    return done


def judge_urls(
    df: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Append host, path, rule and verdict (block or allow) to rows with urls.

    A rule (action, host, path) fits its host and all hosts below it if the url's path starts with the rule's path;
    the one with most characters wins, and its action is the verdict. Without a rule, hosts of ``listed`` (one text
    column) are blocked and others allowed, by a cascade over all hosts of ``df``. A null url and one without
    ``://`` have an empty host and path. Columns of the four names are replaced, others kept; rows are not moved.
    """
    host, path = host_path(F.col(f"`{url}`"))
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    marked = mark(rows, build(rows.select("host"), listed, shard_bytes), "host")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return marked.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path", rule.alias("rule"), verdict.alias("verdict"))
