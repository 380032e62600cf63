"""Clustering around centroids by annulus search, in exact integers.

Centroids are sorted by norm.  A vector's distance u to the centroid next to it in norm
bounds the distance to its nearest one from above, and any centroid at a distance of u or
less has a norm within u of the vector's.  Binary search finds that stretch of the sorted
norms; only its centroids are compared exactly, the ends included, so ties are seen.

A round is one scan: every task assigns its vectors and sums them by cluster, and the sums
of tasks are added up.  No vector is shuffled, and the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magnitudes below this are handled as 64-bit integers, larger ones as Python integers.
SMALL = 1 << 26
#: The largest distance or inertia that a column can hold; larger ones are given as this.
MOST = (1 << 63) - 1
#: Vectors worked on at a time.
BLOCK = 8192


def quantised(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors without nulls, as integers [n, dim]."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    if len(x) == 0 or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    whole = [[int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array(whole, dtype=object).reshape(len(x), dim)


class Centroids:
    """Integer centroids [k, dim], sorted by norm; ``names`` are their numbers."""

    def __init__(self, rows: list[list[int]]):
        self.rows = [[int(v) for v in row] for row in rows]
        squares = [sum(v * v for v in row) for row in self.rows]
        self.names = sorted(range(len(rows)), key=lambda c: (squares[c], c))
        self.norms = np.sqrt(np.array([float(squares[c]) for c in self.names]))
        self.small = all(abs(v) < SMALL for row in self.rows for v in row)

    def distances(self, x: np.ndarray, place: int) -> np.ndarray:
        """Exact squared distances of the rows of x to the centroid at a place of the order."""
        exact = np.int64 if x.dtype != object and self.small else object
        d = x.astype(exact) - np.array(self.rows[self.names[place]], dtype=exact)
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and how many distances were worked out."""
        f = x.astype(np.float64)
        norm = np.sqrt((f * f).sum(axis=1))
        k = len(self.names)
        at = np.searchsorted(self.norms, norm)
        left = np.clip(at - 1, 0, k - 1)
        right = np.clip(at, 0, k - 1)
        first = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        best = np.zeros(len(x), dtype=object if x.dtype == object or not self.small else np.int64)
        name = np.zeros(len(x), np.int64)
        work = len(x)
        for place in np.unique(first):
            own = first == place
            best[own] = self.distances(x[own], place)
            name[own] = self.names[place]
        # norms and the bound are rounded: the annulus is widened by more than that
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + norm * 1e-9 + 1e-6
        lo, hi = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for place in range(k):
            own = np.flatnonzero((lo <= place) & (place < hi) & (first != place))
            if len(own) == 0:
                continue
            work += len(own)
            d = self.distances(x[own], place)
            better = (d < best[own]) | ((d == best[own]) & (self.names[place] < name[own]))
            best[own[better]] = d[better]
            name[own[better]] = self.names[place]
        return name, best, work

    def sha256(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[c])).encode()).hexdigest()


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles."""
    given = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.filter((F.size("v") == dim) & finite)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part.column("vec_id"), quantised(part.column("v"), dim, scale)


def _starts(base: DataFrame, k: int, dim: int, scale: int) -> list[list[int]]:
    """The k vectors of least hash; among rows of one id the least vector comes first."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = base.filter("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return quantised(pa.array([r.v for r in rows], pa.list_(pa.float64())), dim, scale).tolist()


def _sums(base: DataFrame, centroids: Centroids, dim: int, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """cluster -> (vectors, sums of components, sum of squared distances).

    A task gives one row a cluster, with numbers of any length as text, and those are added up by cluster.
    """
    schema = "cluster int, n long, sums array<string>, total string"

    def rows(held: dict[int, list]) -> list[pa.Array]:
        return [
            pa.array(list(held), pa.int32()),
            pa.array([g[0] for g in held.values()], pa.int64()),
            pa.array([[str(v) for v in g[1]] for g in held.values()], pa.list_(pa.string())),
            pa.array([str(g[2]) for g in held.values()], pa.string()),
        ]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, x in _blocks(batches, dim, scale):
            name, best, _ = centroids.nearest(x)
            for c in np.unique(name).tolist():
                own = name == c
                got = held.setdefault(c, [0, [0] * dim, 0])
                got[0] += int(own.sum())
                got[1] = [a + b for a, b in zip(got[1], x[own].sum(axis=0).tolist())]
                got[2] += sum(best[own].tolist())
        yield pa.RecordBatch.from_arrays(rows(held), ["cluster", "n", "sums", "total"])

    def add(table: pa.Table) -> pa.Table:
        sums = [sum(map(int, v)) for v in zip(*table["sums"].to_pylist())]
        total = sum(map(int, table["total"].to_pylist()))
        held = {table["cluster"][0].as_py(): [sum(table["n"].to_pylist()), sums, total]}
        return pa.Table.from_arrays(rows(held), ["cluster", "n", "sums", "total"])

    found = base.mapInArrow(task, schema).groupBy("cluster").applyInArrow(add, schema)
    return {r.cluster: (r.n, [int(v) for v in r.sums], int(r.total)) for r in found.collect()}


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row a vector.

    Vectors of exactly ``dim`` components, none null or not finite, take part, each component
    as floor(scale * x).  The k vectors whose ``1:<vec_id>`` has the least sha256 start; each
    round assigns all vectors (ties to the smaller number) and moves every centroid that has
    vectors to the floor of their mean; then vectors are assigned once more.

    Rows with a null id take part but don't start.  Repeated rows count as often as they are
    there, and among rows of one id the least vector starts first.  Fewer vectors than k are
    as many centroids; an empty table gives no rows, and so does one without an id.  Extra
    columns are ignored.  Arithmetic is exact at any magnitude; a squared distance or inertia
    beyond 63 bits is given as 2^63 - 1.
    """
    base = _vectors(vectors, id_col, vector_col, dim)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    start = _starts(base, k, dim, scale)
    if not start:
        return base.sparkSession.createDataFrame([], schema)
    centroids = Centroids(start)
    for _ in range(rounds):
        found = _sums(base, centroids, dim, scale)
        rows = [[s // found[c][0] for s in found[c][1]] if c in found else row for c, row in enumerate(centroids.rows)]
        centroids = Centroids(rows)
    totals = {c: total for c, (_, _, total) in _sums(base, centroids, dim, scale).items()}
    whole = min(sum(totals.values()), MOST)
    hashes = [centroids.sha256(c) for c in range(len(start))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim, scale):
            name, best, _ = centroids.nearest(x)
            columns = [
                ids,
                pa.array(name.astype(np.int32)),
                pa.array([min(int(d), MOST) for d in best.tolist()], pa.int64()),
                pa.array([min(totals[c], MOST) for c in name.tolist()], pa.int64()),
                pa.array([whole] * len(name), pa.int64()),
                pa.array([hashes[c] for c in name.tolist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return base.mapInArrow(run, schema)
