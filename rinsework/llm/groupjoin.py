"""Jaccard self-join of word n-gram sets over a token-group matrix.

Similar documents are put into groups, the matrix says which tokens a group's union holds, and a document opens only
those foreign groups whose union can overlap it far enough.

1. Groups. Documents that agree in a band of minwise tokens hang together roughly. Inside such clusters, cut into pieces
   of bounded size, pairs are confirmed on their full sets; of each piece's components the best linked member goes on
   and meets those of the other pieces, and so on. A group is a component of the links found: all its members belong
   together already, so its inner pairs need no further look.
2. Matrix. For each token the number of groups whose union holds it. A set of n tokens can only be linked into a foreign
   group if ceil(t n) of its tokens stand in two groups or more; most documents end here.
3. Bound. Tokens are ordered by that number, rare ones first. If two sets are linked, the first n - ceil(t n) + 1 tokens
   of the larger and the first m - ceil(2 t m / (1 + t)) + 1 of the smaller share one. These cells of the matrix name the
   groups a document may have to open.
4. Open. A group's members form tables of bounded size, each of members of nearly one size. A visitor is held against the union of a table first, and against
   the members only if ceil(t n) of its tokens are in there.

All links between groups are found in 3 and 4, whatever the first step missed, so the components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from rinsework.llm.arrow import SLICE_BYTES, mixed, slices
from rinsework.llm.graph import components
from rinsework.llm.neardup import digests, shingles
from rinsework.plans.cut import cut
from rinsework.plans.lookup import attach

SHINGLE, PERCENT = 4, 85
#: Bands of minwise tokens, and tokens per band, by which documents hang together roughly.
BANDS, BAND = 4, 3
#: Documents whose pairs are looked at together, and visitors of an opened table.
PIECE, VISITORS = 128, 256
#: Times that clusters of several pieces are dealt anew.
DEALS = 4
#: Sets of one table differ in size by less than this factor.
SIZE_STEP = 1.05
#: Tokens per chunk of documents and per range of the matrix; there are at least LEAST of each, and chunks lie in at most
#: MOST partitions.
CHUNK_TOKENS, RANGE_TOKENS, LEAST, MOST = 1 << 20, 1 << 21, 64, 50_000
#: Messages from chunks to ranges, and back.
SENT = "chunk int, range int, giant bigint, tokens binary, counts binary"
ANSWERED = "chunk int, range int, giant bigint, counts binary"


def least_overlap(n, percent: int):
    """Tokens that a set of n shares at least with any set it is linked to."""
    return -(-n * percent // 100)


def _signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS numbers per set, each of BAND minwise tokens; sets without tokens get none worth comparing."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * BAND if len(full) else 0):
            seed = mixed(np.array([0xA24BAED4963EE407 + k], np.uint64))[0] | np.uint64(1)
            values = ((hashes ^ (seed >> np.uint64(9))) * seed) >> np.uint64(24)
            least = np.minimum.reduceat(values, offsets[:-1][full])
            out[full, k // BAND] = mixed(out[full, k // BAND] ^ (least + np.uint64(k + 1)))
    return out.view(np.int64)


def _features(docs: DataFrame, size: int) -> DataFrame:
    fields = [StructField(c, LongType()) for c in ("h", "n", "a", "b")] + [StructField("bands", ArrayType(LongType()))]
    schema = StructType([docs.schema["d"], *fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                hashes, offsets = shingles(part.column(1), size)
                a, b = digests(hashes, offsets)
                places = np.arange(part.num_rows + 1, dtype=np.int32) * BANDS
                bands = pa.ListArray.from_arrays(pa.array(places), pa.array(_signatures(hashes, offsets).reshape(-1)))
                cells = [part.column(0), part.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(a), pa.array(b), bands]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return docs.mapInArrow(run, schema)


def _hashed(docs: DataFrame) -> DataFrame:
    """The text's own hash beside it: of rows that share an id, it finds the one that a set was read from."""
    return docs.withColumn("h", F.xxhash64(F.lit(3), F.coalesce("t", F.lit(""))))


def _bodies(docs: DataFrame) -> DataFrame:
    """(d, h, body): each text of an id once, as its length and its Zstandard form, a third of what is shuffled else."""
    schema = StructType([docs.schema["d"], StructField("h", LongType()), StructField("body", BinaryType())])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t.encode("utf-8") for t in part.column(1).fill_null("").to_pylist()]
                bodies = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bodies, pa.binary())], names=schema.names)

    packed = docs.filter(F.col("d").isNotNull()).mapInArrow(run, schema)
    return packed.groupBy("d", "h").agg(F.first("body").alias("body"))


def _sets_of(bodies: list[bytes], size: int) -> list[np.ndarray]:
    """The token sets of packed texts, made from some megabytes of text at a time."""
    codec, out, texts, held = pa.Codec("zstd"), [], [], 0
    for k, body in enumerate(bodies):
        length = int.from_bytes(body[:8], "little")
        texts.append(codec.decompress(body[8:], length, asbytes=True).decode("utf-8") if length else "")
        held += length
        if held >= SLICE_BYTES or k == len(bodies) - 1:
            hashes, offsets = shingles(pa.array(texts, pa.string()), size)
            out += [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            texts, held = [], 0
    return out


class Union:
    """The union of some sets, its tokens numbered, so that one set is held against all in one pass."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)

    def found(self, tokens: np.ndarray) -> np.ndarray:
        """The numbers of those tokens that the union holds."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at[self.tokens[at] == tokens]

    def linked(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The sets linked to this one: none are looked at if the union holds too few of its tokens."""
        inside = self.found(tokens)
        if len(inside) < least_overlap(len(tokens), percent):
            return np.zeros(0, np.int64)
        marks = np.zeros(len(self.tokens), np.int64)
        marks[inside] = 1
        shared = np.add.reduceat(marks[self.numbers], self.starts)
        return np.flatnonzero(shared * 100 >= percent * (len(tokens) + self.sizes - shared))


def _rough_clusters(sets: DataFrame) -> DataFrame:
    """Components of documents that agree in a band. Equal bands lie side by side in ranges of (band, document), so a
    band of any weight is spread over tasks; its documents hang on the first one of each task."""
    keys = sets.select(F.posexplode("bands").alias("k", "band"), "v").select(F.xxhash64("k", "band").alias("key"), "v")
    keys = keys.repartitionByRange("key", "v").sortWithinPartitions("key", "v")

    def star(batches):
        last, root = None, None
        for batch in batches:
            key, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            roots = v[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
            if last is not None and key[0] == last:  # the band goes on from the batch before
                roots[: int(np.argmax(key != last)) if (key != last).any() else len(key)] = root
            last, root = key[-1], roots[-1]
            other = roots != v
            yield pa.RecordBatch.from_arrays([pa.array(v[other]), pa.array(roots[other])], names=["u", "v"])

    return components(keys.mapInArrow(star, "u bigint, v bigint"))


def _in_parts(rows: DataFrame, keys: list[str], count: str, part: str, most: int, deal: int = 0) -> DataFrame:
    """Append into how many parts of about ``most`` rows the keys are cut, and the row's part, drawn by its id and set;
    another ``deal`` draws other parts."""
    counts = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    counts = counts.select(*keys, "rows", F.ceil(F.col("rows") / most).cast("int").alias(count))
    cells = attach(rows, counts, {k: k for k in keys}, [count], "rows")
    return cells.withColumn(part, F.pmod(F.xxhash64(F.lit(deal), "v", "h", count), F.col(count)).cast("int"))


CONFIRMED = "v bigint, h bigint, root bigint, cluster bigint, body binary"


def _confirmed(rows: DataFrame, n: int, size: int, percent: int) -> DataFrame:
    """All pairs of each piece on the full sets: each member's root; the best linked member of each component of a piece
    that is not alone in its cluster brings its body along."""

    def confirm(table):
        cells = sorted(zip(*(table[c].to_pylist() for c in ("cluster", "piece", "v", "h", "pieces", "body"))), key=lambda r: r[:4])
        out, at = [], 0
        while at < len(cells):
            stop = at + 1
            while stop < len(cells) and cells[stop][:2] == cells[at][:2]:
                stop += 1
            vs, sets = [r[2] for r in cells[at:stop]], _sets_of([r[5] for r in cells[at:stop]], size)
            whole, root, degree = Union(sets), np.arange(len(vs)), np.zeros(len(vs), np.int64)
            for i, tokens in enumerate(sets):
                linked = whole.linked(tokens, percent)
                degree[i] = len(linked)
                roots = np.unique(root[linked])
                root[np.isin(root, roots)] = roots[0]
            best = {}
            for i in np.argsort(-degree, kind="stable").tolist():
                best.setdefault(int(root[i]), i)
            for i, v in enumerate(vs):
                goes_on = cells[at][4] > 1 and best[int(root[i])] == i
                out.append((v, cells[at + i][3], vs[root[i]], cells[at][0], cells[at + i][5] if goes_on else None))
            at = stop
        return _table(out, [pa.int64()] * 4 + [pa.binary()], ["v", "h", "root", "cluster", "body"])

    bundle = F.pmod(F.xxhash64("cluster", "piece"), F.lit(max(LEAST, -(-n // (2 * PIECE)))))
    return rows.withColumn("bundle", bundle).groupBy("bundle").applyInArrow(confirm, CONFIRMED)


def _links_in_clusters(clustered: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside rough clusters, enough of them to hold together what is alike. Rows: v, h, cluster, body.

    Clusters of several pieces are dealt DEALS times, so a member linked to one in fifty of the others is hardly ever left
    alone; the best linked members of the first deal then meet those of the other pieces.
    """
    n, links, rows = clustered.count(), None, clustered
    for deal in range(1, DEALS):
        dealt = _in_parts(clustered, ["cluster"], "pieces", "piece", PIECE, deal).filter("pieces > 1")
        done = cut(_confirmed(dealt, n, size, percent).filter("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v")))
        links = done if links is None else links.unionByName(done)
    while True:
        done = cut(_confirmed(_in_parts(rows, ["cluster"], "pieces", "piece", PIECE), n, size, percent))
        found = done.filter("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v"))
        links = found if links is None else links.unionByName(found)
        rows = done.filter("body is not null").select("v", "h", "cluster", "body")
        met = rows.count()
        # the members that go on are few where a cluster hangs together; where it does not, the matrix is the way
        if met == 0 or 2 * met > n:
            return links
        n = met


class Tokens:
    """The tokens of a chunk's documents: distinct ones by range of the matrix, those of each giant group for itself."""

    def __init__(self, table: pa.Table, ranges: int, size: int):
        self.v, self.h, self.group = (table[c].to_pylist() for c in ("v", "h", "g"))
        self.sets = _sets_of(table["body"].to_pylist(), size)
        self.hashes = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        group = np.unique(self.group, return_inverse=True)[1][owner]
        giants = sorted({g for g, giant in zip(self.group, table["giant"].to_pylist()) if giant})
        self.lanes = [None, *giants]
        number = {g: k for k, g in enumerate(self.lanes)}
        lane = np.array([number.get(g, 0) for g in self.group], np.int64)[owner]
        # the top half of a hash names the range, the low half the token inside it
        low = np.uint64(0xFFFFFFFF)
        range_ = ((self.hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        short = (self.hashes & low).astype(np.int64)
        self.order = np.lexsort((group, short, range_, lane))
        lane, range_, short, group = (x[self.order] for x in (lane, range_, short, group))
        fresh = np.ones(len(short), bool)
        fresh[1:] = (short[1:] != short[:-1]) | (range_[1:] != range_[:-1]) | (lane[1:] != lane[:-1])
        first, self.cell = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        own = fresh.copy()
        own[1:] |= group[1:] != group[:-1]
        self.groups = np.minimum(np.add.reduceat(own.astype(np.int64), first), 255).astype(np.uint8)
        self.short, lane, range_ = short[first].astype(np.uint32), lane[first], range_[first]
        edges = np.flatnonzero(np.concatenate([[True], (range_[1:] != range_[:-1]) | (lane[1:] != lane[:-1]), [True]]))
        #: Runs of cells that go to one place: range, giant group or none, first and last cell.
        self.runs = [(int(range_[a]), self.lanes[lane[a]], a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def messages(self, chunk: int) -> list[tuple]:
        """Per run the distinct tokens, and in how many groups of the chunk each is."""
        return [(chunk, r, g, self.short[a:b].tobytes(), self.groups[a:b].tobytes()) for r, g, a, b in self.runs]

    def frequencies(self, answers: dict[tuple, bytes]) -> np.ndarray:
        """For each token of each document the answer of the matrix: a byte that rises with the number of groups."""
        cells = np.zeros(len(self.short), np.uint8)
        for r, g, a, b in self.runs:
            cells[a:b] = np.frombuffer(answers[r, g], np.uint8)
        out = np.zeros(len(self.hashes), np.uint8)
        out[self.order] = cells[self.cell]
        return out


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _answer(table: pa.Table) -> pa.Table:
    """In how many groups each token of a range is, over all chunks; a group in many chunks counts once."""
    rows = table.to_pylist()
    tokens = [np.frombuffer(r["tokens"], np.uint32) for r in rows]
    counts = [np.frombuffer(r["counts"], np.uint8).astype(np.int64) for r in rows]
    seen: dict[int, np.ndarray] = {}
    for k, r in enumerate(rows):
        if r["giant"] is not None:
            had = seen.get(r["giant"], np.zeros(0, np.uint32))
            counts[k] = (~np.isin(tokens[k], had)).astype(np.int64)
            seen[r["giant"]] = np.union1d(had, tokens[k])
    every, place = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    # beyond 200 groups only the magnitude counts
    total = np.where(total <= 200, total, 200 + np.log2(np.maximum(total, 1) / 200).astype(np.int64)).astype(np.uint8)
    answers, at = [], 0
    for r, t in zip(rows, tokens):
        answers.append((r["chunk"], r["range"], r["giant"], total[place[at : at + len(t)]].tobytes()))
        at += len(t)
    return _table(answers, [pa.int32(), pa.int32(), pa.int64(), pa.binary()], ["chunk", "range", "giant", "counts"])


def _candidates(dealt: DataFrame, ranges: int, size: int, percent: int) -> DataFrame:
    """Documents that can be linked into a foreign group: their whole set, and those of their leading tokens that stand
    in other groups too, with their places. ``dealt`` has (chunk, v, h, g, giant, body)."""

    def send(table):
        rows = Tokens(table, ranges, size).messages(table["chunk"][0].as_py())
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return _table(rows, types, ["chunk", "range", "giant", "tokens", "counts"])

    def judge(table, replies):
        out, at = [], 0
        if table.num_rows:
            chunk = Tokens(table, ranges, size)
            groups = chunk.frequencies({(r["range"], r["giant"]): r["counts"] for r in replies.to_pylist()})
            for v, h, g, tokens in zip(chunk.v, chunk.h, chunk.group, chunk.sets):
                own, n = groups[at : at + len(tokens)], len(tokens)
                at += n
                enough = least_overlap(n, percent)
                alive = int((own > 1).sum())
                if alive >= enough:
                    order = np.lexsort((tokens, own))[: n - enough + 1]
                    places = np.flatnonzero(own[order] > 1)
                    probe = tokens[order[places]].view(np.int64)
                    out.append((v, h, g, n, alive, tokens.tobytes(), probe.tolist(), places.tolist()))
        types = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return _table(out, types, ["v", "h", "g", "n", "alive", "tokens", "probe", "places"])

    sent = dealt.groupBy("chunk").applyInArrow(send, SENT)
    answers = sent.groupBy("range").applyInArrow(_answer, ANSWERED)
    schema = "v bigint, h bigint, g bigint, n bigint, alive bigint, tokens binary, probe array<bigint>, places array<bigint>"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, schema)


def _visits(rows: DataFrame, percent: int) -> DataFrame:
    """Which tables of foreign groups a document has to open: (v, h, g, class, table).

    By the leading tokens of both sides, and by size: a document of n tokens and one of m share percent * (n + m) /
    (100 + percent) of them or more, all of which stand in two groups. Tables hold members of nearly one size, so the
    smallest of them bounds what the visitor, and what the best of them, must have of such tokens.
    """
    own = ["v", "h", "g", "n", "alive"]
    cells = rows.select(*own, "class", "table", F.explode(F.arrays_zip("probe", "places")).alias("x"))
    cells = cells.select(*own, "class", "table", F.col("x.probe").alias("token"), F.col("x.places").alias("place"))
    # places count from 0, so this takes one token more than needed, against rounding of the quotient
    leading = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1
    most = [F.min("n").alias("low"), F.max("n").alias("high"), F.max("alive").alias("best")]
    matrix = cells.filter(F.col("place") <= leading).groupBy("token", "g", "class", "table").agg(*most)
    renamed = {"token": "t", "g": "group", "class": "of_class", "table": "of"}
    matrix = matrix.select(*[F.col(c).alias(x) for c, x in renamed.items()], "low", "high", "best")
    needed = F.lit(percent) * (F.col("n") + F.col("low"))
    fits = (F.col("g") != F.col("group")) & (F.col("low") <= F.col("n")) & (F.col("high") * 100 >= F.col("n") * percent)
    fits &= (F.col("alive") * (100 + percent) >= needed) & (F.col("best") * (100 + percent) >= needed)
    found = cells.select(*own, "token").join(matrix, (F.col("token") == F.col("t")) & fits)
    return found.select("v", "h", F.col("group").alias("g"), F.col("of_class").alias("class"), F.col("of").alias("table")).distinct()


def _opened(rows: DataFrame, visits: DataFrame, percent: int) -> DataFrame:
    """Links of visitors to the groups whose tables they open: one to a table, whatever the number of members. Visitors of a table come in parties of up to VISITORS, and
    each party meets the table in a place of its own."""
    n, place = visits.count(), ["g", "class", "table"]
    counts = visits.groupBy(*place).agg(F.count(F.lit(1)).alias("rows"))
    counts = cut(counts.select(*place, "rows", F.ceil(F.col("rows") / VISITORS).cast("int").alias("parties")))
    party = F.pmod(F.xxhash64("v", "h", "parties"), F.col("parties")).cast("int").alias("party")
    guests = attach(visits, counts, {c: c for c in place}, ["parties"], "rows").select(*place, party, "v", "h")
    guests = guests.join(rows.select("v", "h", "tokens"), ["v", "h"])
    guests = guests.select(*place, "party", "v", "tokens", F.lit(True).alias("guest"))
    parties = F.explode(F.sequence(F.lit(0), F.col("parties") - 1)).alias("party")
    members = rows.join(counts, place).select(*place, parties, "v", "tokens", F.lit(False).alias("guest"))
    bundle = F.pmod(F.xxhash64(*place, "party"), F.lit(max(LEAST, -(-n // VISITORS))))

    def meet(met):
        cells = sorted(zip(*(met[c].to_pylist() for c in ("g", "class", "table", "party", "guest", "v", "tokens"))), key=lambda r: r[:6])
        out, at = [], 0
        while at < len(cells):
            stop = at + 1
            while stop < len(cells) and cells[stop][:4] == cells[at][:4]:
                stop += 1
            here = [(r[4], r[5], np.frombuffer(r[6], np.uint64)) for r in cells[at:stop]]
            whole = Union([s for guest, _, s in here if not guest])
            # a group's members belong together already, so a link to any of them is a link to the group
            out += [(cells[at][0], v) for guest, v, s in here if guest and len(whole.linked(s, percent))]
            at = stop
        return _table(out, [pa.int64()] * 2, ["u", "v"])

    return members.unionByName(guests).withColumn("bundle", bundle).groupBy("bundle").applyInArrow(meet, "u bigint, v bigint")


def group_join(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    chunk_tokens: int = CHUNK_TOKENS,
    range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """Classes of documents whose n-gram sets are linked: a row per input row with doc_id, n_shingles, component_id.

    A document's set holds its distinct runs of ``shingle`` words (lower-cased A-Z, split at ASCII white space); a
    shorter text is one run. Two documents are linked if the intersection of their sets is at least ``percent`` of the
    union. ``component_id`` is the smallest doc_id that can be reached by links, the own one included. Equal sets are
    joined before all else, so copies cost a row each and no comparison.

    Texts without words have an empty set and are linked with nothing; null is empty. A row without doc_id has a null
    component and links with nothing. Rows that share a doc_id and a set are one document, each of them is returned; rows
    that share a doc_id but no set link as one document, since links name it by its id. ``doc_id`` must be an integer;
    other columns are not looked at. Tokens are 64-bit hashes of runs, sets are told apart by 128 bits.
    """
    docs = _hashed(df.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")))
    features = cut(_features(docs, shingle))
    full = features.filter((F.col("n") > 0) & F.col("d").isNotNull())
    first = F.min(F.struct("d", "h")).alias("first")
    sets = full.groupBy("a", "b").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = cut(sets.select("a", "b", F.col("first.d").alias("v"), F.col("first.h").alias("h"), "n", "bands"))
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    chunks, ranges = max(LEAST, -(-tokens // chunk_tokens)), max(LEAST, -(-tokens // range_tokens))
    bodies = _bodies(docs).select(F.col("d").alias("v"), "h", "body")

    # groups
    clusters = _rough_clusters(sets).select(F.col("vertex").alias("v"), F.col("root").alias("cluster"))
    clustered = cut(sets.select("v", "h").join(clusters, "v").join(bodies, ["v", "h"]).select("v", "h", "cluster", "body"))
    links = _links_in_clusters(clustered, shingle, percent)
    groups = components(links).select(F.col("vertex").alias("v"), F.col("root").alias("g"))
    held = cut(sets.select("v", "h").join(groups, "v", "left").select("v", "h", F.coalesce("g", "v").alias("g")))
    # a group lies in one chunk, unless it is too large for it
    held = _in_parts(held, ["g"], "parts", "part", PIECE).withColumn("giant", F.col("parts") > 1)
    key = F.when(F.col("giant"), F.xxhash64("v", "h")).otherwise(F.xxhash64("g"))
    held = cut(held.select("v", "h", "g", "giant", F.pmod(key, F.lit(chunks)).cast("int").alias("chunk")))

    # matrix, bound, and groups opened: both passes over the chunks read one exchange of the texts
    dealt = held.join(bodies, ["v", "h"]).select("chunk", "v", "h", "g", "giant", "body")
    dealt = dealt.repartition(min(chunks, MOST), "chunk").sortWithinPartitions("chunk", "v", "h")
    rows = cut(_candidates(dealt, ranges, shingle, percent))
    rows = cut(_in_parts(rows.withColumn("class", F.floor(F.log(SIZE_STEP, "n"))), ["g", "class"], "tables", "table", PIECE))
    links = links.unionByName(_opened(rows, cut(_visits(rows, percent)), percent))

    roots = components(links)
    classes = sets.join(roots, F.col("v") == F.col("vertex"), "left").select("a", "b", F.coalesce("root", "v").alias("component"))
    out = features.select("d", "n", "a", "b").join(classes, ["a", "b"], "left")
    component = F.when((F.col("n") > 0) & F.col("d").isNotNull(), F.col("component")).otherwise(F.col("d"))
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
