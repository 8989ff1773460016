"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of word shingles. In each of several independent trees, a document goes down two children per
node, each named by one of its minwise tokens, so similar documents keep meeting while others part. Two documents
of similarity 0.8 share a child with probability 0.96. All nodes of a tree's level take the same two tokens, so a pair
comes through L levels with probability 0.96^L: where nodes stay large to the fifth, it is lost in 18.5 % of trees and
in all six with probability 4.0e-5.

Small nodes are compared exhaustively, by the share of equal minwise tokens; pairs that may be similar make rough
clusters. Inside these, links are confirmed on the full sets. A large node has a centre, in each place the commonest
token of its members: those much like it join its rough cluster and go no deeper, so a crowd of near copies, which lie
nearer to what they were made from than to one another, does not multiply on its way down; a node that stays large to
the last level joins a rough cluster whole. Clusters of any size are confirmed in bounded groups, so no pair is given
up for skew.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from rinsework.llm.arrow import inside_documents, mixed, slices, strings, window_hashes, word_hashes, word_spans
from rinsework.llm.graph import components, tasks
from rinsework.names import fresh
from rinsework.plans.cut import cut, drop, kept
from rinsework.plans.lookup import attach

SHINGLE, PERCENT = 4, 80
#: Independent trees, their levels, and children per node: one minwise token for each.
TREES, LEVELS, CHILDREN = 6, 5, 2
TOKENS = TREES * LEVELS * CHILDREN
#: Equal tokens a pair needs to be looked at on its sets: five standard deviations below what similarity 0.8 gives.
ENOUGH = 32
#: Equal tokens with the centre of a large node from which a member joins the centre's cluster, and from which it
#: goes no deeper. Unequal tokens are a metric: who shares 36 tokens with a member that shares 48 with the centre
#: shares at least 24 with the centre, so both are in its cluster. A pair of similarity 0.8 shares fewer than 36 with
#: probability 1.0e-4, in all trees alike, as all read the same 60 tokens.
JOIN, RETIRE = 24, 48
#: Members that a centre is taken from, about; any centre will do, a good one lets more members retire.
VOTERS = 64
#: Members of a node that is compared exhaustively; documents of a cluster confirmed in one group.
SMALL_NODE = 512
GROUP = 128
#: Leaders of a cluster that visit its groups in the first round, how many times more do so in each that follows, and
#: those that a group is sent at once; rounds go on until all have visited.
FIRST_LEADERS, MORE_LEADERS, MOST_LEADERS = 32, 16, 512
#: Rows that a task takes at once, over many small nodes or clusters; there are at least LEAST such bundles.
AT_ONCE = 4096
LEAST = 64

BLANKS = (9, 10, 11, 12, 13, 32)


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the n + 1 offsets of the texts."""
    data, offsets = strings(column)
    form = np.arange(256, dtype=np.uint8)
    form[0x41:0x5B] += 32
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    data = form[data]
    starts, stops, borders = word_spans(~blank[data], offsets)
    words = word_hashes(data, starts, stops)
    at = np.flatnonzero(inside_documents(borders, size))
    hashes, owner = window_hashes(words, size)[at], np.searchsorted(borders, at, "right") - 1
    counts = np.diff(borders)
    for n in range(1, size):  # shorter texts are one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes = np.concatenate([hashes, window_hashes(words, n)[borders[short]]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[first], owner[first]
    return hashes, np.searchsorted(owner, np.arange(len(borders)))


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that name each set."""
    out = []
    with np.errstate(over="ignore"):
        for seed in _seeds(2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ seed))])
            out.append(mixed(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def minwise(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of each set that is not empty, 32 bits each."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, TOKENS), np.uint32)
    if len(full):
        with np.errstate(over="ignore"):
            for k, seed in enumerate(_seeds(TOKENS + 2)[2:]):
                # multiply, then take the top half: an order of its own for each seed
                values = ((hashes ^ (seed >> np.uint64(7))) * seed >> np.uint64(32)).astype(np.uint32)
                out[full, k] = np.minimum.reduceat(values, offsets[:-1][full])
    return out


SETS = StructType(
    [
        StructField("n", LongType()),
        StructField("a", LongType()),
        StructField("b", LongType()),
        StructField("tokens", ArrayType(IntegerType())),
    ]
)


def _features(docs: DataFrame, size: int) -> DataFrame:
    schema = StructType([docs.schema["d"]] + SETS.fields)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                hashes, offsets = shingles(part.column(1), size)
                a, b = digests(hashes, offsets)
                tokens = minwise(hashes, offsets).view(np.int32)
                places = np.arange(part.num_rows + 1, dtype=np.int32) * TOKENS
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(tokens.reshape(-1)))
                cells = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(a), pa.array(b), lists]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return docs.mapInArrow(run, schema)


def _children(rows: DataFrame, level: int) -> DataFrame:
    """Two children of each row's node; a node's last three bits name its tree."""
    tree = F.col("node").bitwiseAND(7)
    first = (tree * LEVELS + level) * CHILDREN
    child = F.explode(F.sequence(F.lit(0), F.lit(CHILDREN - 1))).alias("c")
    token = F.get("tokens", first.cast("int") + F.col("c"))
    name = F.xxhash64("node", "c", token).bitwiseAND(~7).bitwiseOR(tree)
    return rows.select("v", "node", "tokens", child).select("v", name.alias("node"))


def _small_nodes(members: DataFrame, sets: DataFrame, enough: int, percent: int) -> DataFrame:
    """Links that may be similar, from exhaustive comparison inside small nodes of all trees and levels: a star for each
    bundle of them."""
    # a byte of each token is enough here: bytes of equal tokens are equal, others rarely are
    low = F.transform("tokens", lambda t: (F.pmod(t, F.lit(256)) - 128).cast("tinyint"))
    size = members.count()
    rows = members.select("node", "v").join(sets.select("v", "n", low.alias("tokens")), "v").coalesce(tasks(size))
    parts = F.pmod(F.xxhash64("node"), F.lit(max(LEAST, -(-size // AT_ONCE))))

    def compare(table):
        node = table["node"].to_numpy()
        order = np.lexsort((table["v"].to_numpy(), node))  # the least member is the root, in most nodes the same
        node, v, n = node[order], table["v"].to_numpy()[order], table["n"].to_numpy()[order]
        tokens = table["tokens"].combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)[order]
        edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            left = np.arange(a, b)
            while len(left) > 1:  # take a member, gather all that hang together with it
                queue, left = [left[0]], left[1:]
                root = v[queue[0]]
                while queue and len(left):
                    i = queue.pop()
                    near = (tokens[left] == tokens[i]).sum(axis=1) >= enough
                    near &= np.minimum(n[left], n[i]) * 100 >= np.maximum(n[left], n[i]) * percent
                    queue += left[near].tolist()
                    out += [(v[j], root) for j in left[near]]
                    left = left[~near]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    bundled = rows.withColumn("part", parts).groupBy("part")
    return bundled.applyInArrow(compare, "u bigint, v bigint").filter("u <> v")


def _with_centres(large: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Members of large nodes with ``equal``, the number of minwise tokens they share with their node's centre."""
    drawn = F.pmod(F.xxhash64("node", "v"), F.ceil(F.col("size") / VOTERS)) == 0
    voters = large.filter(drawn).join(sets.select("v", "tokens"), "v")
    commonest = [F.mode(F.get("tokens", F.lit(k)), deterministic=True) for k in range(TOKENS)]
    # few centres are broadcast; of many those with very many members are, so these stay where they are
    centres = cut(voters.groupBy("node").agg(F.array(*commonest).alias("theirs"), F.first("size").alias("size")).coalesce(n))
    rows = attach(large.join(sets.select("v", "tokens"), "v"), centres, {"node": "node"}, ["theirs"], "size")
    equal = F.size(F.filter(F.zip_with("tokens", "theirs", lambda a, b: a == b), lambda same: same))
    return rows.select("v", "node", equal.alias("equal"))


def _rough_links(sets: DataFrame, n_sets: int, enough: int, percent: int, small_node: int, used: list[str]) -> DataFrame:
    """Links between sets that may be similar, from all trees. The tables they are read from are added to ``used``."""
    n = tasks(TREES * CHILDREN * n_sets)
    rows = sets.select("v", "tokens", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)).cast("array<bigint>")).alias("node"))
    small, found = [], []
    for level in range(LEVELS):
        # both their count and the join read the children, which are made once
        rows, path = kept(_children(rows, level).coalesce(n))
        used.append(path)
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("v").alias("least")).filter("size > 1")
        least = F.when(F.col("size") > small_node, F.col("least")).alias("least")  # of large nodes only
        members, path = kept(rows.join(sizes, "node").select("v", "node", "size", least).coalesce(n))
        used.append(path)
        small.append(members.filter("least is null"))
        large = members.filter("least is not null")
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            found.append(large.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v"))
            break
        large, path = kept(_with_centres(large, sets, n).coalesce(n))
        used.append(path)
        # a centre is a vertex of its own, named by its node; it has no text and leaves before links are confirmed
        found.append(large.filter(F.col("equal") >= JOIN).select(F.col("v").alias("u"), F.col("node").alias("v")))
        rows = large.filter(F.col("equal") < RETIRE).join(sets.select("v", "tokens"), "v")
    links = _small_nodes(reduce(DataFrame.unionByName, small), sets, enough, percent)
    return reduce(DataFrame.unionByName, found, links)


CONFIRMED = "v bigint, root bigint, degree bigint"


def _compressed(docs: DataFrame) -> DataFrame:
    """Texts as bytes: their length and their Zstandard form, a third of what is shuffled otherwise."""
    schema = StructType([docs.schema["d"], StructField("body", BinaryType())])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t.encode("utf-8") for t in part.column(1).fill_null("").to_pylist()]
                bodies = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _texts(bodies: list[bytes]) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True).decode("utf-8") for b in bodies], pa.string())


def _sets_of(bodies: list[bytes], size: int) -> list[np.ndarray]:
    hashes, offsets = shingles(_texts(bodies), size)
    return [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _similar(inter: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return inter * 100 >= percent * (n + sizes - inter)


class _Sets:
    """Full sets side by side, their tokens numbered, so that one set is held against all in one pass."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)

    def shared_with(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.all, tokens), len(self.all) - 1)
        marks = np.zeros(len(self.all), np.int64)
        marks[at[self.all[at] == tokens]] = 1
        return np.add.reduceat(marks[self.numbers], self.starts)


def _confirm_groups(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Inside each group of a cluster, all pairs on the full sets: each member's root in its group and its links."""
    key = F.pmod(F.xxhash64("cluster", "group"), F.lit(max(LEAST, -(-rows.count() // (4 * GROUP)))))

    def confirm(table):
        rows = sorted(zip(table["cluster"].to_pylist(), table["group"].to_pylist(), table["v"].to_pylist(), table["body"].to_pylist()), key=lambda r: r[:3])
        out, at = [], 0
        while at < len(rows):
            stop = at
            while stop < len(rows) and rows[stop][:2] == rows[at][:2]:
                stop += 1
            vs, sets = [r[2] for r in rows[at:stop]], _sets_of([r[3] for r in rows[at:stop]], size)
            at = stop
            if len(vs) == 1:
                out.append((vs[0], vs[0], 0))
                continue
            whole, root = _Sets(sets), np.arange(len(vs))
            degree = np.zeros(len(vs), np.int64)
            for i, tokens in enumerate(sets):
                linked = np.flatnonzero(_similar(whole.shared_with(tokens), len(tokens), whole.sizes, percent))
                degree[i] = len(linked) - 1
                roots = np.unique(root[linked])
                root[np.isin(root, roots)] = roots[0]
            out += [(vs[i], vs[root[i]], int(degree[i])) for i in range(len(vs))]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["v", "root", "degree"])

    return rows.withColumn("part", key).groupBy("part").applyInArrow(confirm, CONFIRMED)


def _confirm_leaders(rows: DataFrame, leaders: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between some leaders of a cluster and all its members: leaders visit every group of their cluster, in
    batches, which ``leaders`` numbers from 0 below its ``batches``."""

    def confirm(members, visitors):
        empty = pa.table([pa.array([], pa.int64())] * 2, names=["u", "v"])
        if members.num_rows == 0 or visitors.num_rows == 0:
            return empty
        whole = _Sets(_sets_of(members["body"].to_pylist(), size))
        roots, out = members["own"].to_numpy(), []  # members of one root are linked already: one link to it is enough
        for v, tokens in zip(visitors["visitor"].to_pylist(), _sets_of(visitors["theirs"].to_pylist(), size)):
            linked = _similar(whole.shared_with(tokens), len(tokens), whole.sizes, percent)
            out += [(int(u), v) for u in np.unique(roots[linked]) if u != v]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["u", "v"])

    groups = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g")
    visits = leaders.select(F.col("cluster").alias("c"), groups, "b", F.col("v").alias("visitor"), F.col("body").alias("theirs"))
    batch = F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch")
    members = rows.select("cluster", "group", batch, "own", "body")
    pairs = members.groupBy("cluster", "group", "batch").cogroup(visits.groupBy("c", "g", "b"))
    return pairs.applyInArrow(confirm, "u bigint, v bigint").distinct()


def _confirmed_roots(docs: DataFrame, sets: DataFrame, clusters: DataFrame, size: int, percent: int, group: int) -> DataFrame:
    """The least vertex that each member of a rough cluster is joined with by links on full sets, as (vertex, root).

    A cluster of up to ``group`` documents is one group and all its pairs are looked at. In a larger one, all
    pairs inside each group are; then leaders visit all groups in rounds, first the best linked members, then
    members outside the largest component so far, until each of them has visited: no pair is left out but
    pairs inside one component. Each round has more leaders than the one before; a group is sent a bounded number of
    them at once. After a round only the roots that its links join are joined anew.
    """
    counts = clusters.groupBy("root").agg(F.count("*").alias("n_docs"))
    groups = F.ceil(F.col("n_docs") / group).cast("int")
    members = clusters.join(counts, "root").select(
        F.col("vertex").alias("v"), F.col("root").alias("cluster"), groups.alias("groups")
    )
    members = members.withColumn("group", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int"))
    members = members.join(sets.select("v", "a", "b"), "v")
    texts = members.join(_compressed(docs), F.col("d") == F.col("v")).select("v", "cluster", "groups", "group", "body", "a", "b")
    schema = StructType(texts.schema.fields[:5])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4):  # of rows that share a doc_id, only those of the very text
                a, b = digests(*shingles(_texts(part.column(4).to_pylist()), size))
                same = (a == part.column(5).to_numpy()) & (b == part.column(6).to_numpy())
                table = pa.RecordBatch.from_arrays([part.column(k) for k in range(5)], names=schema.names)
                yield table.filter(pa.array(same))

    spark = docs.sparkSession
    rows, rows_path = kept(texts.coalesce(tasks(clusters.count(), 4 * GROUP)).mapInArrow(run, schema))
    inside = _confirm_groups(rows, size, percent)
    inside = cut(inside.coalesce(tasks(rows.count())))
    roots = inside.select(F.col("v").alias("vertex"), "root").distinct()
    several = rows.filter("groups > 1")
    n_several = several.count()
    if not n_several:
        drop(spark, rows_path)
        return roots
    own = several.join(inside.select("v", F.col("root").alias("own")).distinct(), "v")
    several, several_path = kept(own.coalesce(tasks(n_several, 4 * GROUP)))
    n = tasks(n_several)
    drop(spark, rows_path)
    state, state_path = kept(several.select("cluster", "v", F.col("own").alias("root")).distinct().coalesce(n))
    degrees = inside.groupBy("v").agg(F.max("degree").alias("degree"))
    visited, at_once = None, FIRST_LEADERS
    while True:
        sizes = state.groupBy("cluster", "root").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("cluster").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("parts"))
        waiting = state.join(largest.filter("parts > 1"), "cluster")
        if visited is None:
            # the best linked go first; ranks up to a bound are found task by task before any shuffle
            rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), F.xxhash64("v"), "v"))
            chosen = waiting.join(degrees, "v").select("cluster", "v", rank.alias("rank")).filter(F.col("rank") <= at_once)
            chosen = chosen.select("cluster", "v")
        else:
            waiting = waiting.filter(F.col("root") != F.col("main")).join(visited, "v", "left_anti")
            counts = waiting.groupBy("cluster").agg(F.count("*").alias("waiting"))
            drawn = F.pmod(F.xxhash64(F.lit(at_once), "v"), F.ceil(F.col("waiting") / at_once)) == 0
            chosen = waiting.join(counts, "cluster").filter(drawn).select("cluster", "v")
        chosen = cut(chosen.coalesce(n))
        if chosen.isEmpty():
            break
        batches = chosen.groupBy("cluster").agg(F.ceil(F.count("*") / MOST_LEADERS).cast("int").alias("batches"))
        active = several.join(batches, "cluster")
        leaders = active.join(chosen.select("v"), "v", "left_semi")
        leaders = leaders.withColumn("b", F.pmod(F.xxhash64(F.lit("batch"), "v"), F.col("batches")).cast("int"))
        links, links_path = kept(_confirm_leaders(active, leaders, size, percent).coalesce(n))
        # the roots that the links join
        for end in ("u", "v"):
            named = state.select(F.col("v").alias("k"), F.col("root").alias("r"))
            links = links.join(named, F.col(end) == F.col("k")).withColumn(end, F.col("r")).select("u", "v")
        moved = components(links, n_several).withColumnRenamed("root", "to")
        moved = cut(moved.join(sizes.select(F.col("root").alias("vertex"), "size"), "vertex").coalesce(n))
        state, old = attach(state, moved, {"root": "vertex"}, ["to"], "size"), state_path
        state, state_path = kept(state.select("cluster", "v", F.coalesce("to", "root").alias("root")).coalesce(n))
        drop(spark, old, links_path)
        visited = chosen.select("v") if visited is None else cut(visited.unionByName(chosen.select("v")))
        at_once *= MORE_LEADERS
    drop(spark, several_path)
    alone = roots.join(state, roots.vertex == state.v, "left_anti")
    return alone.unionByName(state.select(F.col("v").alias("vertex"), "root"))


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    small_node: int = SMALL_NODE,
    group: int = GROUP,
    enough: int = ENOUGH,
) -> DataFrame:
    """Classes of near-duplicate documents: a row per input row with doc_id, n_shingles, component_id and kept.

    A document's set holds its distinct runs of ``shingle`` words (lower-cased A-Z, split at ASCII white space); a
    shorter text is one run. Documents are linked if the intersection of their sets is at least ``percent`` of the
    union, judged on the full sets. ``component_id`` is the smallest doc_id that can be reached by links; ``kept``
    marks the document that bears it. Equal sets are joined before, so copies cost a row each and no comparison.

    Texts without words have an empty set and are linked with nothing. A row without doc_id gets a null component
    and is kept. Rows that share doc_id and text are one document, and each of them is returned. ``doc_id`` must be
    an integer; other columns are not looked at. The trees aim at similarity 0.8; ``enough`` is the number of equal
    minwise tokens, of 60, from which a pair is looked at on its sets, and is to be lowered with ``percent``.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t"))
    features = cut(_features(docs, shingle))
    full = features.filter((F.col("n") > 0) & F.col("d").isNotNull())
    named = full.groupBy("a", "b").agg(F.min("d").alias("v"))
    sets = named.join(full.select(F.col("d").alias("v"), "a", "b", "n", "tokens"), ["a", "b", "v"])
    sets = cut(sets.dropDuplicates(["a", "b", "v"]).select("v", "a", "b", "n", "tokens"))
    n_sets = sets.count()
    sets = sets.coalesce(tasks(n_sets, AT_ONCE))
    used: list[str] = []
    clusters = components(_rough_links(sets, n_sets, enough, percent, small_node, used), TREES * n_sets)
    drop(docs.sparkSession, *used)
    roots = _confirmed_roots(docs, sets, clusters, shingle, percent, group)
    classes = named.join(roots, named.v == roots.vertex, "left").select("a", "b", F.coalesce("root", "v").alias("component"))
    rows = features.select("d", "n", "a", "b").join(classes, ["a", "b"], "left")
    component = F.when((F.col("n") > 0) & F.col("d").isNotNull(), F.col("component")).otherwise(F.col("d"))
    return rows.select(
        F.col("d").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("d") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **more) -> DataFrame:
    """The documents without those whose class has a smaller doc_id; columns stay as they are.

    Rows that share a doc_id stay or go together.
    """
    name = fresh("gone", df.columns)
    gone = near_duplicates(df, text, doc_id, **more).filter(~F.col("kept")).select(F.col("doc_id").alias(name))
    return df.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
