"""Centroid clustering over a vector-approximation file.

Vectors of whole numbers are stored once with their approximation: a cell of a few
bits for each component.  Cells are even over the bulk of a component's values in all vectors; the
first and the last one reach to its least and its largest value.
In a round, lookup tables of a centroid's least and largest squared difference to each cell give
an interval of its distance to a vector from the cells alone.  A vector whose best interval
overlaps no other is assigned by its cells; only of the others is the full vector handed
over, and measured against the centroids that are still possible.

Sums of a round are kept from the round before: only vectors that change their cluster are
added and taken off, so that after the first rounds most full vectors stay unread.

Distances and means are exact whole numbers.  The driver holds the cuts (64 times 2 to the
number of bits), the centroids and their sums, whatever the number of vectors.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite ones take no part; rows of one id are vectors of their own, and where ids tie
for a start the smaller vector comes first; null ids start last; fewer vectors than centroids
make fewer centroids; components beyond 2 to the 27th (after scaling) are taken as that bound, so that distances fit
a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import cut, map_arrow

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Bits of a cell, and the share of values left to each of the two outer cells.
BITS = 7
TAIL = 0.005
#: Largest component after scaling: 64 squared differences of it fit a long.
BOUND = 1 << 27
#: Vectors of a slice: bounds of all centroids are held for as many.
SLICE = 2048


def whole_vectors(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``vector``: the finite vectors of that many components, scaled and floored."""
    real = df.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    fit = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    number = lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(x * scale).cast("long"))).cast("int")
    return real.filter(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform("embedding", number).alias("vector"))


def marks(vectors: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray | None:
    """Borders of the cells of each component, the least and the largest value included.  None without vectors."""
    at = [F.element_at("vector", d + 1) for d in range(dimensions)]
    row = vectors.agg(*(F.array(F.min(c), F.max(c)) for c in at), *(F.percentile_approx(c, [TAIL, 1 - TAIL], 1000) for c in at)).first()
    if row[0][0] is None:
        return None
    inner = np.linspace(*np.array([row[dimensions + d] for d in range(dimensions)], np.float64).T, (1 << bits) - 1, axis=1)
    outer = np.array([row[d] for d in range(dimensions)], np.int64)
    return np.concatenate([outer[:, :1], np.floor(inner).astype(np.int64), outer[:, 1:]], axis=1)


def approximate(vectors: DataFrame, borders: np.ndarray) -> DataFrame:
    """Adds ``cells``: for each component the number of its cell, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = _matrix(batch.column("vector"), len(borders))
            cells = np.empty(full.shape, np.uint8)
            for d, border in enumerate(borders):
                cells[:, d] = np.searchsorted(border[1:-1], full[:, d], side="right")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), _binary(cells)], names=["vec_id", "vector", "cells"])

    return map_arrow(vectors, run, "vec_id long, vector array<int>, cells binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _binary(cells: np.ndarray) -> pa.Array:
    n, width = cells.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(cells).tobytes())])


class Bounds:
    """Lookup tables of least and largest squared differences: component, cell, centroid."""

    def __init__(self, borders: np.ndarray, centroids: np.ndarray) -> None:
        low, high = borders[:, :-1, None], borders[:, 1:, None]  # a cell's values lie between its borders, both included
        at = centroids.T[:, None, :]
        self.least = np.square(np.maximum(0, np.maximum(low - at, at - high)))
        self.most = np.square(np.maximum(np.abs(at - low), np.abs(high - at)))

    def possible(self, cells: np.ndarray) -> np.ndarray:
        """For each row the centroids whose interval meets the best one."""
        least = np.zeros((len(cells), self.least.shape[2]), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            least += self.least[d][cells[:, d]]
            most += self.most[d][cells[:, d]]
        return least <= most.min(axis=1, keepdims=True)


def settled(cells: pa.Array, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each row, -1 where intervals overlap, and the possible centroids of each row as bits."""
    width = len(bounds.least)
    flat = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[cells.offset * width : (cells.offset + len(cells)) * width].reshape(-1, width)
    near = np.empty(len(flat), np.int32)
    masks = np.empty((len(flat), bounds.least.shape[2]), bool)
    for at in range(0, len(flat), SLICE):
        possible = bounds.possible(flat[at : at + SLICE])
        near[at : at + SLICE] = np.where(possible.sum(axis=1) == 1, possible.argmax(axis=1), -1)
        masks[at : at + SLICE] = possible
    return near, masks


def measured(full: np.ndarray, possible: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest possible centroid of each full vector; ties go to the smaller number."""
    best = np.full(len(full), np.iinfo(np.int64).max)
    near = np.zeros(len(full), np.int32)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero(possible[:, j])
        distance = np.square(full[rows] - centroid).sum(axis=1)
        nearer = distance < best[rows]
        best[rows[nearer]], near[rows[nearer]] = distance[nearer], j
    return near


def _bounded(borders: np.ndarray, *sets: np.ndarray):
    """Expression over ``cells``: for each set of centroids the settled cluster and, where there is none, the possible ones."""
    tables: dict[int, Bounds] = {}  # built by the task that needs them

    @F.arrow_udf("struct<" + ", ".join(f"near{k}: int, possible{k}: binary" for k in range(len(sets))) + ">")
    def run(cells: pa.Array) -> pa.Array:
        columns, names = [], []
        for k in range(len(sets)):
            if k not in tables:
                tables[k] = Bounds(borders, sets[k])
            near, possible = settled(cells, tables[k])
            bits = [row.tobytes() if n < 0 else None for n, row in zip(near, np.packbits(possible, axis=1), strict=True)]
            columns += [pa.array(near), pa.array(bits, pa.binary())]
            names += [f"near{k}", f"possible{k}"]
        return pa.StructArray.from_arrays(columns, names)

    return run


def _fetched(centroids: np.ndarray):
    """Expression over a full vector and possible centroids, both null where cells have settled it."""

    @F.arrow_udf("int")
    def run(vector: pa.Array, possible: pa.Array) -> pa.Array:
        out = np.full(len(vector), -1, np.int32)
        rows = np.flatnonzero(possible.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            full = _matrix(vector.take(pa.array(rows)), centroids.shape[1])
            bits = np.frombuffer(b"".join(possible.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
            out[rows] = measured(full, np.unpackbits(bits, axis=1)[:, : len(centroids)].astype(bool), centroids)
        return pa.array(out)

    return run


def assigned(stored: DataFrame, borders: np.ndarray, *sets: np.ndarray) -> DataFrame:
    """``stored`` with ``cluster0``, ``cluster1``, ...: the nearest centroid of each set, from cells where these settle it."""
    rows = stored.withColumn("b", _bounded(borders, *sets)("cells"))
    for k, centroids in enumerate(sets):
        open_ = F.col(f"b.near{k}") < 0
        found = _fetched(centroids)(F.when(open_, F.col("vector")), F.col(f"b.possible{k}"))
        rows = rows.withColumn(f"cluster{k}", F.when(open_, found).otherwise(F.col(f"b.near{k}")))
    return rows.drop("b")


def moves(rows: DataFrame, dimensions: int) -> DataFrame:
    """What each cluster gains: sums of components and, as component -1, the number of vectors.

    ``vector`` goes to ``cluster1`` and leaves ``cluster0`` (-1: none); rows that do not move are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            full = _matrix(batch.column("vector"), dimensions)
            full = np.concatenate([full, np.ones((len(full), 1), np.int64)], axis=1)
            for name, sign in (("cluster0", -1), ("cluster1", 1)):
                own = batch.column(name).to_numpy()
                for j in np.unique(own[own >= 0]):
                    total[int(j)] = total.get(int(j), 0) + sign * full[own == j].sum(axis=0)
        for j, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(sums), pa.int32()), pa.array([*range(dimensions), -1], pa.int32()), pa.array(sums)], names=["cluster", "component", "total"])

    parts = map_arrow(rows.filter("cluster0 <> cluster1").select("vector", "cluster0", "cluster1"), run, "cluster int, component int, total long")
    return parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"))


def start(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these."""
    salted = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(salted.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(count).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def cluster(df: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every vector that takes part."""
    spark = df.sparkSession
    vectors = whole_vectors(df, dimensions)
    borders = marks(vectors, dimensions, bits)
    if borders is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = cut(approximate(vectors, borders))
    centroids = start(vectors, count)
    sums = np.zeros((len(centroids), dimensions + 1), np.int64)
    before = None
    for _ in range(rounds):
        if before is None:
            rows = assigned(stored, borders, centroids).withColumnsRenamed({"cluster0": "cluster1"}).withColumn("cluster0", F.lit(-1))
        else:
            rows = assigned(stored, borders, before, centroids)
        for r in moves(rows, dimensions).collect():  # at most a number for each cluster and component
            sums[r["cluster"], r["component"]] += r["total"]
        filled = sums[:, -1] > 0
        before, centroids = centroids, centroids.copy()
        centroids[filled] = sums[filled, :-1] // sums[filled, -1:]
    final = assigned(stored, borders, centroids)
    at = [F.lit(c.tolist()).cast("array<long>") for c in centroids]
    gap = F.zip_with("vector", F.get(F.array(*at), F.col("cluster0")), lambda a, b: (a - b) * (a - b))
    rows = final.select("vec_id", F.col("cluster0").alias("cluster"), F.aggregate(gap, F.lit(0).cast("long"), lambda a, b: a + b).alias("distance"))
    inertia = rows.groupBy(F.col("cluster").alias("of")).agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r[1] for r in inertia)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(r[0], r[1], total, digest[r[0]]) for r in inertia], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), F.col("cluster") == F.col("of")).drop("of")  # a row for each cluster


def query(spark, folder):
    """``op12``: clusters of ``embeddings``."""
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle() -> str:
    """Plain rounds in SQL: every vector against every centroid."""
    near = (
        "n{k} AS MATERIALIZED (SELECT r, first(j ORDER BY g, j) AS j, min(g) AS g FROM (SELECT v.r, c.j, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS g "
        "FROM v, c{k} c) GROUP BY r)"
    )
    move = (
        "c{n} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT j, list(x ORDER BY d) AS c FROM (SELECT j, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x "
        "FROM (SELECT n.j, unnest(v.v) AS x, unnest(range(64)) AS d FROM n{k} n JOIN v USING (r)) GROUP BY j, d) GROUP BY j) m USING (j))"
    )
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(-134217728, least(134217728, floor(256 * x::DOUBLE)))::BIGINT) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM v QUALIFY j < 40)",
    ]
    for k in range(ROUNDS):
        parts += [near.format(k=k), move.format(k=k, n=k + 1)]
    parts.append(near.format(k=ROUNDS))
    return (
        f"WITH {', '.join(parts)} SELECT v.vec_id, n.j::INT AS cluster, n.g AS distance, (sum(n.g) OVER (PARTITION BY n.j))::BIGINT AS cluster_inertia, (sum(n.g) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM n{ROUNDS} n JOIN v USING (r) JOIN c{ROUNDS} c USING (j)"
    )


ORACLE = _oracle()
