"""Exact n-gram Jaccard join by partitioning the universe of shingles.

Sizes fall into bands.  A scheme for each band bounds the Hamming distance of a
linked pair whose smaller set lies in the band, and cuts the universe of hashed
shingles into more segments than that distance: at least one segment (in fact one
more than the scheme's slack) must be equal.  Each set posts the hashes of its
segments under its own band's scheme and, if its partners may be smaller than its
band, under the one below.

What a set looks up is allocated by cost.  The cost of a segment is the number of
sets that post it, which is counted over the whole corpus.  A set leaves out (value
-1) its empty segments and then its dearest ones, as many as the slack pays for;
the others are looked up as they are (value 0).  The slack is half the distance: a larger one would find less
by chance, but cost more postings.  Small sets whose empty segments
use up more than the slack post coarser segments with all their one-deletion
neighbourhoods (value 1), which find sets that differ by one shingle there.
As all sets order their postings in the same way, linked sets have one in common that
both look up; those that only one set looks up are dropped.

Postings are packed and grouped by bucket.  Postings of the same sets are one
candidate group.  Candidates are verified exactly, and a set is shipped to where it
is compared, not to every partner:

1. Neighbouring sets get a common home by a few rounds of taking the smallest home
   of a group.  Homes are cut into blocks of bounded size, and a few sets of a home
   stand in all its blocks; each block is compared in itself.
2. Links are contracted.  Groups whose sets are of one component by now need no
   further comparison.  In the others components meet with lists of the groups that
   they are in: sets that link have more postings in common than either could have
   left out.  Only components with such a partner are compared, each pair in the first
   of its common groups, and no component with itself.

Only spanning links leave a task, so no list of pairs is ever made.

Equal sets are one node from the start.  Nodes are 80-bit hashes of sets; the
comparison itself counts common 64-bit shingle hashes of two sets.

Defined results: a null text or one without words has an empty set and is linked
with nothing; a text with fewer words than a shingle is one shingle; repeated rows
are copies of each other; a null ``doc_id`` never names a component unless all
members have none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.frames import NO_ID, cut, deal, map_arrow, partitions
from basketlens.llm.words import Words, mix, release, slices

#: Sets, and shingles, that a block has on average at most.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Sets of a home that stand in all its blocks.
SEEDS = 8
#: Postings that a task gathers before it hands them on.
GATHERED = 500_000
#: A posting that more sets of a task share goes from task to task without being held in memory.
LARGE = 512
#: Rounds in which sets take the home of their neighbours.
ROUNDS = 2
#: Ids that are broadcast to choose texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Postings are 40-bit hashes in a bucket: two that are equal by chance only make a candidate more.
_SIG = np.uint64((1 << 40) - 1)
#: Scheme of a posting: that of the set's own band, the one below, or a neighbourhood.
OWN, BELOW, NEAR = 0, 1, 2
#: A set, and how many segments it may leave out under its two schemes.
_NODE = np.dtype([("high", "<u8"), ("low", "<u2"), ("skips", "<u2", (2,))])


class Schemes:
    """Bands and the segment counts of their schemes, for a threshold in percent."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 10_000 // percent**2)))
        self.percent = percent
        self.edges = np.array(edges, np.int64)
        self.distance = (100 - percent) * (self.edges[1:] - 1) // percent
        self.slack = self.distance // 2
        self.segments = self.distance + 1 + self.slack

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, side="right") - 1

    def reaches_below(self, size: np.ndarray) -> np.ndarray:
        """Whether the smallest partner of a set lies in the band below."""
        return size * self.percent <= 100 * (self.edges[self.band(size)] - 1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and how many each row has."""
    w = Words(column, fold=True)
    hashes = w.hashes()
    at, own = w.windows(size, hashes)
    row = np.searchsorted(w.first, at, side="right") - 1
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = counts[short] > j
            whole[more] = mix(whole[more] * _A + hashes[w.first[short[more]] + j] + np.uint64(j + 1))
        row, own = np.concatenate([row, short]), np.concatenate([own, whole])
        order = np.argsort(row, kind="stable")
        row, own = row[order], own[order]
    bounds = np.searchsorted(row, np.arange(w.rows + 1)).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1:
            own[a:b].sort()
    if not len(own):
        return own, np.zeros(w.rows, np.int64)
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    return own[fresh], np.bincount(row[fresh], minlength=w.rows)


def node_names(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """80-bit hashes of the sets; rows without a set have zeros."""
    out = np.zeros(len(counts), _NODE)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for part, salt in (("high", _A), ("low", _B)):
            out[part][full] = mix(np.add.reduceat(mix(own ^ salt), starts) + counts[full].astype(np.uint64)).astype(_NODE[part])
    return out


def _names(nodes: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(nodes[["high", "low"]].astype([("high", ">u8"), ("low", ">u2")]))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(10), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def postings(own: np.ndarray, counts: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posted hashes, the rows and schemes that post them, and how many segments each row may leave out."""
    sigs, rows, kinds = [], [], []
    skips = np.zeros((len(counts), 2), np.uint16)
    row = np.repeat(np.arange(len(counts)), counts)
    size = np.maximum(counts, 1)
    band = schemes.band(size)
    starts = np.cumsum(counts) - counts
    for below in (OWN, BELOW):
        scheme = np.maximum(band - below, 0)
        use = (counts > 0) & ((band > 0) & schemes.reaches_below(size) if below else True)
        pick = use[row]
        h, r = own[pick], row[pick]
        if not len(h):
            continue
        m = schemes.segments[scheme].astype(np.uint64)
        segment = ((h >> np.uint64(32)) * m[r]) >> np.uint64(32)  # ascends with h
        at = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (r[1:] != r[:-1])]))
        of = r[at]
        sigs.append(mix(np.add.reduceat(mix(h), at) + segment[at] * _A + scheme[of].astype(np.uint64) * _B))
        rows.append(of)
        kinds.append(np.full(len(of), below, np.uint8))
        empty = schemes.segments[scheme] - np.bincount(of, minlength=len(counts))
        skips[:, below] = np.where(use, np.clip(schemes.slack[scheme] - empty, 0, 65535), 0)
        for i in np.flatnonzero(use & (empty > schemes.slack[scheme])):  # few and small
            found = _neighbourhoods(own[starts[i] : starts[i] + counts[i]], int(scheme[i]), int(schemes.distance[scheme[i]]))
            sigs.append(found)
            rows.append(np.full(len(found), i))
            kinds.append(np.full(len(found), NEAR, np.uint8))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), skips
    return np.concatenate(sigs), np.concatenate(rows), np.concatenate(kinds), skips


def _neighbourhoods(h: np.ndarray, scheme: int, distance: int) -> np.ndarray:
    """Coarse segments, full and with each shingle deleted; sets with a segment of one shingle or none share one posting."""
    parts = distance // 2 + 1
    of = (mix(h ^ _C) % np.uint64(parts)).astype(np.int64)
    values, out, thin = mix(h + _C), [], False
    lane = mix(np.array([2 * scheme + 1]))[0]
    for p in range(parts):
        own = values[of == p]
        thin |= len(own) < 2
        if len(own):
            total = own.sum(dtype=np.uint64)
            out.append(mix(np.concatenate([[total], total - own if len(own) > 1 else own[:0]]).astype(np.uint64) + mix(np.array([p + 1])) ^ lane))
    if thin:
        out.append(mix(np.array([lane], np.uint64) ^ _C))
    return np.unique(np.concatenate(out))


def _ordered(sigs: np.ndarray, nodes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct postings by hash and set, and for each how many sets have its hash."""
    order = np.lexsort((nodes["high"], sigs))
    s, n, k = sigs[order], nodes[order], kinds[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (n["high"][1:] != n["high"][:-1]) | (n["low"][1:] != n["low"][:-1])
    s, n, k = s[fresh], n[fresh], k[fresh]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(s)))
    return s, n, k, np.repeat(times, times)


class _Gathered:
    """Postings of a task's texts, packed by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.n, self.parts = buckets, 0, []

    def add(self, sigs: np.ndarray, nodes: np.ndarray, kinds: np.ndarray) -> bool:
        self.parts.append((sigs, nodes, kinds))
        self.n += len(sigs)
        return self.n >= GATHERED

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """Bucket and blob: a byte that marks large postings, then hashes, schemes and sets."""
        if not self.n:
            return
        sigs, nodes, kinds, times = _ordered(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.n, self.parts = 0, []
        bucket = (sigs % np.uint64(self.buckets)).astype(np.int64)
        for large in (False, True):
            at = np.flatnonzero((times > LARGE) == large)
            at = at[np.argsort(bucket[at], kind="stable")]
            for own in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1):
                if len(own):
                    yield int(bucket[own[0]]), _packed(large, sigs[own], nodes[own], kinds[own])


def _packed(large: bool, sigs: np.ndarray, nodes: np.ndarray, kinds: np.ndarray) -> bytes:
    _, at, index = np.unique(nodes["high"], return_index=True, return_inverse=True)
    table = nodes[at]
    index = index.astype(np.uint32) << np.uint32(2) | kinds
    wide = len(table) >= 1 << 14
    short = (sigs >> np.uint64(24) & _SIG).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return bytes([large | 2 * wide]) + np.array([len(sigs), len(table)], np.uint32).tobytes() + short.tobytes() + index.astype(np.uint32 if wide else np.uint16).tobytes() + table.tobytes()


def _unpacked(blob: bytes) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
    n, m = map(int, np.frombuffer(blob, np.uint32, 2, 1))
    sigs = np.zeros((n, 8), np.uint8)
    sigs[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 9).reshape(-1, 5)
    kind = np.dtype(np.uint32 if blob[0] & 2 else np.uint16)
    index = np.frombuffer(blob, kind, n, 9 + 5 * n)
    table = np.frombuffer(blob, _NODE, m, 9 + (5 + kind.itemsize) * n)
    return bool(blob[0] & 1), sigs.view("<u8").ravel(), table[index >> 2], (index & 3).astype(np.uint8)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_shingles`` and ``node`` (null for an empty set)."""
    names = [c for c in docs.columns if c not in ("text", "n_shingles", "node")]
    fields = [f"`{c}` {kind}" for c, kind in docs.dtypes if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "text")):
            own, counts = shingle_sets(batch.column("text"), size)
            nodes = _names(node_names(own, counts))
            nodes = pa.array([x if n else None for x, n in zip(nodes.to_pylist(), counts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts, pa.int64()), nodes], names=[*names, "n_shingles", "node"])

    return map_arrow(docs.select(*names, "text"), run, ", ".join([*fields, "n_shingles long, node binary"]))


_GROUPS = ["gid", "node", "kind", "skips", "n"]


def posted_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``gid, node, kind, skips, n``: the sets of postings that two sets or more have; postings of the same sets have one ``gid``."""
    buckets = partitions(docs.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        schemes, gathered = Schemes(percent), _Gathered(buckets)

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(gathered.flush())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

        for batch in (part for batch in batches for part in slices(batch, "text")):
            own, counts = shingle_sets(batch.column("text"), size)
            sigs, rows, kinds, skips = postings(own, counts, schemes)
            nodes = node_names(own, counts)
            nodes["skips"] = skips
            if gathered.add(sigs, nodes[rows], kinds):
                yield from out()
        yield from out()

    def rows_of(gid: np.ndarray, nodes: np.ndarray, kinds: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        skips = np.select([kinds == OWN, kinds == BELOW], [nodes["skips"][:, 0], nodes["skips"][:, 1]], 0)
        for a in range(0, len(gid), 50_000):
            own = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(gid[own].view(np.int64)), _names(nodes[own]), pa.array(kinds[own].astype(np.int8)), pa.array(skips[own].astype(np.int32)), pa.array(times[own].astype(np.int64))], names=_GROUPS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, large = [], set()
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                wide, s, n, k = _unpacked(blob)
                if wide:
                    large.update(np.unique(s).tolist())
                    yield from rows_of(mix(s), n, k, np.full(len(s), 1 << 40))
                else:
                    parts.append((s, n, k))
        if not parts:
            return
        s, n, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        ascending = np.sort(s)
        twice = np.isin(s, ascending[1:][ascending[1:] == ascending[:-1]])  # the others need no ordering by set
        del ascending
        if large:
            away = np.isin(s, np.array(sorted(large), np.uint64))
            yield from rows_of(mix(s[away]), n[away], k[away], np.full(int(away.sum()), 1 << 40))
            twice &= ~away
        s, n, k, times = _ordered(s[twice], n[twice], k[twice])
        if not len(s):
            return
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        gid = mix(np.add.reduceat(mix(n["high"] ^ mix(n["low"])), first) + times[first].astype(np.uint64) * _C)
        gid = np.repeat(gid, times[first])
        some = times > 1
        yield from rows_of(gid[some], n[some], k[some], times[some])

    posted = map_arrow(docs.select("text"), post, "bucket int, blob binary")
    return map_arrow(deal(posted, "bucket"), meet, "gid long, node binary, kind tinyint, skips int, n long")


def asked_postings(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``gid, node, kind, times, skips, asks``: the postings of all sets by group; the dearest that a set may leave out are not asked.

    ``times`` is how many postings of a kind a set has in the group.
    """
    own = posted_groups(docs, size, percent).groupBy("gid", "node", "kind").agg(F.count("*").cast("int").alias("times"), F.max("n").alias("n"), F.max("skips").alias("skips"))
    dearest = Window.partitionBy("node", "kind").orderBy(F.desc("n"), "gid").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("asks", F.sum("times").over(dearest) > F.col("skips")).drop("n")


def candidate_groups(asked: DataFrame) -> DataFrame:
    """``gid, node``: the groups that two sets or more ask for, with these sets."""
    members = asked.filter("asks").select("gid", "node").distinct()
    several = members.groupBy("gid").agg(F.count("*").alias("n")).filter("n > 1").select("gid")
    return members.join(several, "gid", "left_semi")


def homes(groups: DataFrame) -> DataFrame:
    """``node, home``: the smallest hash of a node that a few rounds over common groups lead to."""
    found = groups.select("node").distinct().withColumn("home", F.xxhash64("node"))
    for _ in range(ROUNDS):
        least = groups.join(found, "node").groupBy("gid").agg(F.min("home").alias("home"))
        found = groups.join(least, "gid").groupBy("node").agg(F.min("home").alias("home"))
    return found


def _blocks(sizes: Column) -> Column:
    """How many blocks some sets are cut into."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(sizes) / BLOCK_SHINGLES)).cast("int")


def home_cells(home: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cell, node``: the blocks of each home (``node, home``), with its seeds in all of them."""
    placed = home.join(sizes, "node")
    seeds = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"].alias(f"seed{k}") for k in range(SEEDS)]
    blocks = cut(placed.groupBy("home").agg(_blocks(F.col("n_shingles")).alias("blocks"), *seeds))
    own = placed.join(blocks.select("home", "blocks"), "home").select(F.xxhash64("home", F.pmod(F.hash("node"), "blocks")).alias("cell"), "node")
    common = blocks.filter("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    common = common.select(F.xxhash64("home", "block").alias("cell"), F.explode(F.array(*(f"seed{k}" for k in range(SEEDS)))).alias("node"))
    return own.unionByName(common).distinct()


def component_groups(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """``gid, node, kind, times, skips, asks`` of components (``node`` is their root); groups of the same components become one.

    A component has at least the postings, and leaves out at most what, each of its sets does.
    """
    own = asked.join(labels, "node").groupBy("gid", "root", "kind").agg(F.max("times").alias("times"), F.min("skips").alias("skips"), F.max("asks").alias("asks"))
    own = cut(own)
    same = own.select("gid", "root").distinct().groupBy("gid").agg(F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("all"), F.count("*").alias("n"))
    same = same.filter("n > 1").select("gid", F.xxhash64("all", "n").alias("joined"))
    found = own.join(same, "gid").groupBy("joined", "root", "kind").agg(F.sum("times").cast("int").alias("times"), F.min("skips").alias("skips"), F.max("asks").alias("asks"))
    return found.select(F.col("joined").alias("gid"), F.col("root").alias("node"), "kind", "times", "skips", "asks")


def _paired(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``cell, gid, node``: all pairs of blocks of each group (``gid, node``); ``blocks`` (``gid, blocks``) says how many it has."""
    own = members.join(blocks, "gid").withColumn("block", F.pmod(F.hash("node"), "blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select(F.xxhash64("gid", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "gid", "node")


def group_cells(groups: DataFrame) -> DataFrame:
    """``cell, gid, node``: blocks in which all members of each group meet."""
    return _paired(groups, cut(groups.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))))


def component_cells(possible: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cell, node``: blocks in which the sets of possible partners meet (``cell, root``: components of one cell).

    Small components meet in their cell.  A component of several blocks meets all its
    partners, of whatever cell, once: its blocks meet theirs, and not each other.
    """
    each = labels.join(possible.select("root").distinct(), "root", "left_semi").join(sizes, "node")
    each = cut(each.groupBy("root").agg(_blocks(F.col("n_shingles")).alias("blocks"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")))
    known = cut(possible.join(each, "root"))
    small = known.filter("blocks = 1").select("cell", "root").join(labels, "root").join(sizes, "node").select(F.col("cell").alias("gid"), "node", "n_shingles")
    blocks = small.groupBy("gid").agg(_blocks(F.col("n_shingles")).alias("blocks"))
    inside = _paired(small.select("gid", "node"), blocks).select("cell", "node")

    large = known.filter("blocks > 1").select("cell", F.col("root").alias("of"), F.col("blocks").alias("own_blocks"))
    met = large.join(known, "cell").filter("of <> root and (blocks = 1 or of < root)").select("of", "own_blocks", "root", "n", "size").distinct()
    facing = cut(met.groupBy("of", "own_blocks").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    own = facing.join(labels, F.col("of") == F.col("root")).select("of", "node", F.pmod(F.hash("node"), "own_blocks").alias("block"), every("blocks"))
    own = own.select(F.xxhash64("of", "block", "other").alias("cell"), "node")
    others = met.select("of", "root").join(facing, "of").join(labels, "root").select("of", "node", F.pmod(F.hash("node"), "blocks").alias("block"), every("own_blocks"))
    others = others.select(F.xxhash64("of", "other", "block").alias("cell"), "node")
    return inside.unionByName(own).unionByName(others).distinct()


_MEMBERS = ["cell", "gid", "node", "skips", "list"]
_ENTRY = np.dtype([("gid", "<i8"), ("times", "<u4"), ("kind", "u1"), ("asks", "?")])


def group_lists(asked: DataFrame) -> DataFrame:
    """``node, skips, list``: for each component the groups that it is in, packed, and what it may leave out by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list")
            flat = lists.flatten()
            entries = np.zeros(len(flat), _ENTRY)
            for k, name in enumerate(("gid", "times", "kind", "asks")):
                entries[name] = flat.field(k).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            blobs = [entries[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("skips"), pa.array(blobs, pa.binary())], names=["node", "skips", "list"])

    skips = F.array(*(F.coalesce(F.min(F.when(F.col("kind") == k, F.col("skips"))), F.lit(0)) for k in (OWN, BELOW, NEAR)))
    own = asked.groupBy("node").agg(skips.alias("skips"), F.collect_list(F.struct("gid", "times", "kind", "asks")).alias("list"))
    return map_arrow(own.select("node", "skips", "list"), run, "node binary, skips array<int>, list binary")


def _products(row: np.ndarray, column: np.ndarray, weight: np.ndarray, n: int, width: int = 2048) -> np.ndarray:
    """Sums, over the columns that two rows have in common, of the first row's weights."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        if lo == hi:
            continue
        has, often = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
        has[row[lo:hi], column[lo:hi] - a] = 1
        often[row[lo:hi], column[lo:hi] - a] = weight[lo:hi]
        out += often @ has.T
    return out


def _partners(gid: int, skips: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """Which of some components may link with which others and ask for no common group that comes before ``gid``."""
    n = len(lists)
    entries = np.frombuffer(b"".join(lists), _ENTRY)
    row = np.repeat(np.arange(n), [len(x) // _ENTRY.itemsize for x in lists])
    _, column, count = np.unique(entries["gid"], return_inverse=True, return_counts=True)
    pick = count[column] > 1
    entries, row, column = entries[pick], row[pick], (np.cumsum(count > 1) - 1)[column[pick]]
    before = entries["asks"] & (entries["gid"] < gid)
    link = ~np.eye(n, dtype=bool)
    if before.any():
        link &= _products(row[before], column[before], np.ones(int(before.sum())), n) == 0
    if not link.any():
        return link
    lane = row * 3 + entries["kind"]  # a row for each kind of postings
    used, lane = np.unique(lane, return_inverse=True)
    common = _products(lane, column, entries["times"], len(used))
    left_out = skips[used // 3, used % 3]
    a, b = np.nonzero(np.minimum(common, common.T) > np.maximum(left_out[:, None], left_out[None]))
    possible = np.zeros((n, n), bool)
    possible[used[a] // 3, used[b] // 3] = True
    return link & possible


def possible_cells(placed: DataFrame, lists: DataFrame) -> DataFrame:
    """``cell, node``: the components of each cell that have a possible partner there, connected ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cell: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            gids, nodes, skips, lists = zip(*rows, strict=True)
            a, b = np.nonzero(_partners(gids[0], np.array(skips), lists)) if len(nodes) > 1 else ((), ())
            if not len(a):
                return
            own = np.arange(len(nodes))
            while True:
                new = own.copy()
                np.minimum.at(new, a, own[b])
                new = new[new]
                if (new == own).all():
                    break
                own = new
            used = np.unique(a)
            cells = mix(np.uint64(cell & (1 << 64) - 1) + mix(own[used].astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array([nodes[i] for i in used], pa.binary())], names=["cell", "node"])

        cell, rows = None, []
        for batch in batches:
            for c, *row in zip(*(batch.column(k).to_pylist() for k in _MEMBERS), strict=True):
                if c != cell and rows:
                    yield from flush(cell, rows)
                    rows = []
                cell = c
                rows.append(row)
        if rows:
            yield from flush(cell, rows)

    dealt = deal(placed.join(lists, "node").select(*_MEMBERS), "cell").sortWithinPartitions("cell", "node")
    return map_arrow(dealt, run, "cell long, node binary")


def linked(own: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sorted sets the first set of its component under exact links."""
    n = len(own)
    label = np.arange(n)
    size = np.array([len(x) for x in own])
    if n <= 12:
        for i in range(n):
            for j in range(i + 1, n):
                if label[i] != label[j] and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        a, b = sorted((label[i], label[j]))
                        label[label == b] = a
        return label
    values, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    pick = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[pick], number[column[pick]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 8192
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((n, width), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    link = 100 * both >= percent * (size[:, None] + size[None] - both)
    while True:
        new = np.where(link, label[None], n).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(texts: DataFrame, placed: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: nodes of equal component; enough to span the components of exact links in each cell.

    ``texts`` has the ``text`` of all nodes in ``placed`` (``cell, node``); other texts do no harm.
    """

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "text")):
            own, counts = shingle_sets(batch.column("text"), size)
            ends = np.cumsum(counts)
            blobs = [own[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([_names(node_names(own, counts)), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(nodes: list[bytes], own: list[bytes]) -> pa.RecordBatch:
            label = linked([np.frombuffer(x, np.uint64) for x in own], percent)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array([nodes[label[i]] for i in moved], pa.binary()), pa.array([nodes[i] for i in moved], pa.binary())], names=["a", "b"])

        cell, held = None, {}
        for batch in batches:
            for c, node, own in zip(*(batch.column(k).to_pylist() for k in ("cell", "node", "shingles")), strict=True):
                if c != cell and held:
                    if len(held) > 1:
                        yield flush(list(held), list(held.values()))
                    held = {}
                cell = c
                held[node] = own
        if len(held) > 1:
            yield flush(list(held), list(held.values()))

    found = map_arrow(texts.select("text"), with_set, "node binary, shingles binary")
    dealt = deal(placed.join(found, "node").select("cell", "node", "shingles"), "cell").sortWithinPartitions("cell", "node")
    return map_arrow(dealt, compare, "a binary, b binary")


def texts_of(docs: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the id of one of the nodes; ``ids`` has ``node, __id``."""
    chosen = cut(ids.join(nodes.select("node").distinct(), "node", "left_semi").select("__id").distinct())
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    return docs.join(chosen, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("__id"), "left_semi")


def components(pairs: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of every node of ``pairs`` (``a, b``).

    Each round sends every node to its smallest neighbour and contracts the pairs,
    until none is left; states are checkpointed in the cluster's shared folder.
    """
    ends = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    found = ends.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while not ends.isEmpty():
        to = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("of"), F.least("a", "b").alias("to"))
        found = cut(found.join(to, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")))
        other = to.select(F.col("of").alias("of_b"), F.col("to").alias("to_b"))
        ends = cut(ends.join(to, F.col("a") == F.col("of")).join(other, F.col("b") == F.col("of_b")).select(F.col("to").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct())
    return found


def node_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, node, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``); rows of no shingle have no node.

    Two texts link when the Jaccard similarity of their sets of ``size``-word
    shingles (A-Z lower-cased) is at least ``percent`` hundredths; the component's
    id is the smallest ``doc_id`` that links lead to.
    """
    docs = docs.select("doc_id", "text")
    rows = cut(sets(docs, size))
    ids = cut(rows.filter("node is not null").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("__id"), F.max("n_shingles").alias("n_shingles")))
    sizes = ids.select("node", "n_shingles")
    asked = cut(asked_postings(docs, size, percent))
    members = cut(candidate_groups(asked))
    home = cut(homes(members))
    near = cut(links(texts_of(docs, ids, home), home_cells(home, sizes), size, percent))
    root = components(near)
    labels = cut(home.select("node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = cut(component_groups(asked, labels))
    open_ = cut(candidate_groups(groups))
    if not open_.isEmpty():
        lists = group_lists(groups.join(open_.select("node").distinct(), "node", "left_semi"))
        possible = possible_cells(group_cells(open_), lists).withColumnRenamed("node", "root")
        cells = cut(component_cells(cut(possible), labels, sizes))
        far = cut(links(texts_of(docs, ids, cells), cells, size, percent))
        root = components(near.unionByName(far))
    named = ids.select("node", "__id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(named.groupBy("root").agg(F.min("__id").alias("least")))
    named = cut(named.join(least, "root").select(F.col("node").alias("__node"), F.when(F.col("least") != NO_ID, F.col("least")).alias("least")))
    return rows.join(named, F.col("node") == F.col("__node"), "left").select("doc_id", "node", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, as :func:`node_components` finds them."""
    return node_components(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those of a component whose smallest ``doc_id`` is another one.

    Of repeated rows of one id and text one stays; different texts of one id are
    judged each by its own component.  Rows without an id cannot be told apart and
    all stay, as do those with an empty set.
    """
    found = cut(node_components(docs, size, percent).filter("doc_id is not null"))
    gone = found.filter("doc_id <> component_id").select("doc_id", "node").distinct()
    left = docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    twice = docs.join(repeated, "doc_id", "left_semi").withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"])
    own = sets(twice.select(F.col("__hash").alias("doc_id"), "text"), size).select(F.col("doc_id").alias("__hash"), F.col("node").alias("__node")).distinct()
    away = gone.select(F.col("doc_id").alias("__id"), F.col("node").alias("__gone"))
    twice = twice.join(own, "__hash", "left").join(away, (F.col("doc_id") == F.col("__id")) & (F.col("__node") == F.col("__gone")), "left_anti")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(twice.select(*docs.columns))


def query(spark, folder):
    """``op4``: components of all documents under 4-word shingles and a similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"), 4, 85)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
