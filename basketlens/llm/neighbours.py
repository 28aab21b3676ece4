"""Approximate nearest neighbours with a permutation index.

A vector is represented by the pivots that are nearest to it, in their order, and is
posted in these pivots' inverted files with the pivot's place.  A query reads the
files of its own nearest pivots alone and adds up, pivot by pivot, how far the
places are from its own (the footrule distance, where a pivot that is not among the
nearest stands behind them all), reranks the nearest share of every block by inner
product in double precision, and merges the blocks' best.

Blocks have a bounded number of vectors, and queries are packed in blocks too, so
that tasks compare one block with another.  Pivots are a bounded sample
(``PIVOTS`` distinct vectors of smallest hash); every vector is indexed.  Equal
vectors are indexed once with their smallest ids, which are gathered task by task
before they are shuffled: a vector that a third of all rows share is no hot group.

Defined results: vectors that are null, empty, all zero, hold a null or non-finite
component, or have another number of components than most, take no part, nor do
rows without an id; repeated rows count as vectors of one id, of which one is
found once; fewer candidates than asked for give all; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.frames import cut, map_arrow

#: Pivots, and how many of them a vector is posted under.
PIVOTS, NEAREST = 512, 128
BLOCK, QUERY_BLOCK = 8192, 512
#: Share of a block that is reranked, and how many times the asked number of vectors at least.
RERANKED, LEAST = 0.2, 4
#: Distinct vectors that a task gathers before it hands them on.
GATHERED = 50_000


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding array<double>`` of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", e.alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    rows = rows.filter(finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == sizes[0]["d"]) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1) + 0.0)  # no negative zeros


def _key(vector: np.ndarray) -> bytes:
    return hashlib.blake2b(vector.tobytes(), digest_size=16).digest()


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """``key, ids, vector``: every distinct vector with its ``k + 1`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array([sorted(x[0])[: k + 1] for x in seen.values()], pa.list_(pa.int64())), pa.array([x[1] for x in seen.values()], pa.binary())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["key", "ids", "vector"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("embedding")) if batch.num_rows else (), strict=True):
                held = seen.setdefault(_key(v), (set(), v.tobytes()))
                held[0].add(i)
                if len(held[0]) > 4 * k + 4:
                    keep = sorted(held[0])[: k + 1]
                    held[0].clear()
                    held[0].update(keep)
            if len(seen) > GATHERED:
                yield out()
        yield out()

    found = map_arrow(rows, run, "key binary, ids array<long>, vector binary")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return found.groupBy("key").agg(ids.alias("ids"), F.first("vector").alias("vector"))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the nearest pivots of every vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :NEAREST]


def inverted_files(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each pivot's file begins, and the vectors and places of all files one after the other."""
    near = nearest_pivots(vectors, pivots)
    order = np.argsort(near, axis=None, kind="stable")
    begins = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))
    return begins.astype(np.int32), (order // near.shape[1]).astype(np.int32), (order % near.shape[1]).astype(np.int16)


INDEX = "block long, ids array<array<long>>, vectors binary, begins binary, posted binary, places binary"


def index(vectors: DataFrame, pivots: np.ndarray, blocks: int) -> DataFrame:
    """One row for each block: ids, vectors, and the inverted files of all pivots one after the other."""

    def pack(block: pa.Table) -> pa.Table:
        raw = b"".join(block.column("vector").to_pylist())
        own = np.frombuffer(raw, np.float64).reshape(block.num_rows, -1)
        ids = pa.array([block.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))
        files = [pa.array([x.tobytes()], pa.binary()) for x in inverted_files(own, pivots)]
        return pa.table([block.column("block")[:1], ids, pa.array([raw], pa.binary()), *files], names=["block", "ids", "vectors", "begins", "posted", "places"])

    return vectors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(pack, INDEX)


def unrolled(files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, last: int) -> np.ndarray:
    """A row for each pivot's file with the places of all ``n`` vectors; those that are not posted stand at ``last``.

    Made once for a block of queries, so that a query adds up rows instead of looking postings up.
    Sums of ``last`` distances up to ``last`` must fit the type.
    """
    begins, posted, places = files
    rows = np.full((len(begins) - 1, n), last, np.int16 if last * last < 2**15 else np.int32)
    rows[np.repeat(np.arange(len(begins) - 1), np.diff(begins)), posted] = places
    return rows


def footrule_nearest(rows: np.ndarray, near: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` vectors whose nearest pivots are most alike to ``near``; ``rows`` are unrolled files."""
    if depth >= rows.shape[1]:
        return np.arange(rows.shape[1])
    off = rows[near]
    off -= np.arange(len(near), dtype=rows.dtype)[:, None]
    return np.argpartition(np.abs(off, out=off).sum(axis=0, dtype=rows.dtype), depth - 1)[:depth]


def best_scores(vectors: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which ``vectors`` have the ``k`` largest inner products (and all that tie), and these products."""
    rows, scores = np.arange(len(vectors)), (vectors * vector).sum(axis=1)
    if len(rows) > k:
        rows = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores = scores[rows]
    return rows, scores


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the ids in ``queries`` (``vec_id``) their ``k`` nearest other rows.

    ``score`` is the inner product of the original vectors; ties go to the smaller id.
    """
    rows = valid(vectors)
    known = cut(distinct(rows, k))
    pivots = [np.frombuffer(r["vector"], np.float64) for r in known.orderBy("key").select("vector").limit(PIVOTS).collect()]
    result = "query_id long, rank int, vec_id long, score double"
    if not pivots:
        return vectors.sparkSession.createDataFrame([], result)
    pivots = np.array([p / np.linalg.norm(p) for p in pivots])
    blocks = -(-known.count() // BLOCK)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(v) for v in _matrix(batch.column("embedding"))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], names=["query_id", "key"])

    asked = cut(map_arrow(rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi"), keyed, "query_id long, key binary").distinct())
    keys = known.join(asked.select("key").distinct(), "key")
    query_blocks = -(-asked.count() // QUERY_BLOCK) or 1

    def pack(block: pa.Table) -> pa.Table:
        return pa.table([block.column("query_block")[:1], pa.array([block.column("key").to_pylist()], pa.list_(pa.binary())), pa.array([b"".join(block.column("vector").to_pylist())], pa.binary())], names=["query_block", "keys", "queries"])

    packed = keys.withColumn("query_block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(query_blocks))).groupBy("query_block").applyInArrow(pack, "query_block long, keys array<binary>, queries binary")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def compare(cell: pa.Table) -> pa.Table:
        """The best of one block for one block of queries."""
        row = {c: cell.column(c)[0].as_py() for c in ("ids", "vectors", "begins", "posted", "places", "keys", "queries")}
        own = np.frombuffer(row["vectors"], np.float64).reshape(len(row["ids"]), -1)
        files = tuple(np.frombuffer(row[c], kind) for c, kind in (("begins", np.int32), ("posted", np.int32), ("places", np.int16)))
        asked_vectors = np.frombuffer(row["queries"], np.float64).reshape(len(row["keys"]), -1)
        asked_near = nearest_pivots(asked_vectors, pivots)
        files = unrolled(files, len(own), asked_near.shape[1])
        depth = max(LEAST * (k + 1), int(RERANKED * len(own)))
        out: tuple[list, list, list] = ([], [], [])
        for key, vector, order in zip(row["keys"], asked_vectors, asked_near, strict=True):
            near = footrule_nearest(files, order, depth)
            at, score = best_scores(own[near], vector, k + 1)
            best = sorted((-s, i) for v, s in zip(near[at].tolist(), score.tolist(), strict=True) for i in row["ids"][v])[: k + 1]
            out[0].extend([key] * len(best))
            out[1].extend(i for _, i in best)
            out[2].extend(-s for s, _ in best)
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["key", "vec_id", "score"])

    cells = packed.join(index(known, pivots, blocks), "block")
    found = cells.groupBy("block", "query_block").applyInArrow(compare, "key binary, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", best).filter(F.col("place") <= k + 1)
    mine = asked.join(found, "key").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, folder):
    """``op7``: the 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
