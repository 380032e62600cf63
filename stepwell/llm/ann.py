"""Nearest neighbours by inner product: score-aware anisotropic quantisation, pruned by bounds alone.

Directions of vectors are coded in subspaces of two dimensions with 16 centres each: four
bits a subspace, two codes a byte; the length stays beside the code.  The loss weighs the
residual parallel to the vector more than the rest, since that is what moves large inner
products.  Tables of query times centre are summed over the codes of a block.  A vector's
residual is kept as a length, and with it a sum bounds the inner product from above: every
vector whose bound reaches the k-th score known so far is ranked again in double precision.

Vectors are dealt to coarse partitions by direction.  Each query starts from its k-th exact
score among the sampled vectors and goes to the partitions whose widest angle and greatest
length leave room for more.  So centres are fitted on a sample, but no near vector is lost
to it, however unlike the sample the rest is: even directions cost a look at all codes.  A
vector is shuffled once for each block of queries (64 MB of them), beside its code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import discard, materialise

#: Vectors that the index is fitted on, the least by hash of the id, and bytes of them that give first scores.
SAMPLE, FIRST = 8192, 16 << 20
DIMS = 2
CENTRES = 16
#: Rows whose codes are ranked together, and the share of them from which all are ranked again at once.
UNIT, DENSE = 8192, 0.05
#: Bytes of queries or of vectors that meet in one task.
MEET = 64 << 20
#: Room for rounding in bounds, as a share of both lengths: of sums in single and in double precision.
ROUGH, FINE = 1e-5, 1e-12


def weight(dim: int, threshold: float = 0.2) -> float:
    """How much the parallel residual counts, for scores above threshold x norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _blocks(x: np.ndarray) -> np.ndarray:
    """[n, dim] -> [subspaces, n, DIMS], the last subspace filled up with zeros."""
    n, dim = x.shape
    m = -(-dim // DIMS)
    wide = np.zeros((n, m * DIMS))
    wide[:, :dim] = x
    return wide.reshape(n, m, DIMS).transpose(1, 0, 2)


def assign(x: np.ndarray, centres: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes [n, subspaces] by coordinate descent on the anisotropic loss."""
    parts = _blocks(x)
    m, n, _ = parts.shape
    norm = np.maximum((x * x).sum(axis=1), 1e-30)
    plain = [((parts[j][:, None, :] - centres[j][None]) ** 2).sum(axis=2) for j in range(m)]
    along = [((parts[j][:, None, :] - centres[j][None]) * parts[j][:, None, :]).sum(axis=2) for j in range(m)]
    codes = np.stack([p.argmin(axis=1) for p in plain], axis=1)
    rows = np.arange(n)
    total = sum(along[j][rows, codes[:, j]] for j in range(m))
    for _ in range(passes):
        for j in range(m):
            rest = total - along[j][rows, codes[:, j]]
            loss = plain[j] + (eta - 1) * (rest[:, None] + along[j]) ** 2 / norm[:, None]
            codes[:, j] = loss.argmin(axis=1)
            total = rest + along[j][rows, codes[:, j]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres [subspaces, 16, DIMS]: codes and weighted least squares by turns."""
    rng = np.random.default_rng(seed)
    parts = _blocks(x)
    m, n, d = parts.shape
    eta, norm = weight(x.shape[1]), np.maximum((x * x).sum(axis=1), 1e-30)
    centres = np.stack([p[rng.integers(0, n, CENTRES)] for p in parts])
    rows = np.arange(n)
    for _ in range(rounds):
        codes = assign(x, centres, eta, 1)
        along = np.stack([((parts[j] - centres[j][codes[:, j]]) * parts[j]).sum(axis=1) for j in range(m)])
        total = along.sum(axis=0)
        for j in range(m):
            rest = total - along[j] + (parts[j] ** 2).sum(axis=1)
            for c in range(CENTRES):
                own = rows[codes[:, j] == c]
                if len(own) == 0:
                    centres[j, c] = parts[j][rng.integers(0, n)]
                    continue
                p, w = parts[j][own], (eta - 1) / norm[own]
                left = len(own) * np.eye(d) + (p * w[:, None]).T @ p
                centres[j, c] = np.linalg.solve(left, p.sum(axis=0) + (p * (w * rest[own])[:, None]).sum(axis=0))
            total = total - along[j]
            along[j] = ((parts[j] - centres[j][codes[:, j]]) * parts[j]).sum(axis=1)
            total = total + along[j]
    return centres


def partition_centres(u: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Directions of ``n`` partitions (spherical k-means)."""
    centres = u[np.random.default_rng(seed).choice(len(u), n, replace=False)]
    for _ in range(rounds):
        own = (u @ centres.T).argmax(axis=1)
        for c in range(n):
            total = u[own == c].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 0:
                centres[c] = total / size
    return centres


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-300)[:, None], norm


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits a byte."""
    if codes.shape[1] % 2:
        codes = np.column_stack([codes, np.zeros(len(codes), np.uint8)])
    return codes[:, 0::2] * np.uint8(CENTRES) + codes[:, 1::2]


def scan(queries: np.ndarray, packed: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate scores [queries, rows]: sums of table entries, one look-up a byte."""
    tables = np.einsum("jqd,jcd->jqc", _blocks(queries), centres)
    if len(tables) % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:1])])
    out = np.zeros((len(queries), len(packed)), np.float32)
    for j in range(packed.shape[1]):
        both = (tables[2 * j][:, :, None] + tables[2 * j + 1][:, None, :]).reshape(len(queries), -1).astype(np.float32)
        out += both[:, packed[:, j]]
    return out * norm.astype(np.float32)


def decoded(packed: np.ndarray, centres: np.ndarray, dim: int) -> np.ndarray:
    """The directions that codes stand for."""
    codes = np.stack([packed // CENTRES, packed % CENTRES], axis=2).reshape(len(packed), -1)[:, : len(centres)]
    return centres[np.arange(len(centres)), codes].reshape(len(packed), -1)[:, :dim]


@dataclass
class Index:
    """What is fitted on the sample: code centres and partitions."""

    centres: np.ndarray
    partitions: np.ndarray

    def codes(self, u: np.ndarray) -> np.ndarray:
        return pack(assign(u, self.centres, weight(u.shape[1])))

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest partition, cosine of the angle to its direction)."""
        cos = u @ self.partitions.T
        return cos.argmax(axis=1), cos.max(axis=1)


def fit_index(x: np.ndarray, n_partitions: int) -> Index:
    u, _ = directions(x)
    return Index(fit(u), partition_centres(u, min(n_partitions, len(u))))


def first_scores(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among some of its candidates: no lower one can be among its k nearest."""
    if len(x) <= k:
        return np.full(len(q), -np.inf)
    scores = q @ x.T
    scores[q_rows[:, None] == rows[None, :]] = -np.inf
    return np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]


def may_hold(q: np.ndarray, least: np.ndarray, index: Index, longest: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """[queries, partitions]: whether a partition's greatest length and widest angle (its cosine) leave room for ``least``."""
    u, norm = directions(q)
    apart = np.arccos(np.clip(u @ index.partitions.T, -1, 1)) - np.arccos(np.clip(cos, -1, 1)) - 1e-6
    with np.errstate(invalid="ignore", over="ignore"):
        most = norm[:, None] * longest * np.maximum(np.cos(np.maximum(apart, 0)), 0)
        most += ROUGH * norm[:, None] * longest
    return ~(most < least[:, None])


def unit_search(q_rows, q, least, rows, ids, x, packed, norm, err, index: Index, k: int) -> list[tuple]:
    """(query row, positions, exact scores): the best k of one unit, sorted by id, that reach ``least``, which they raise."""
    found = []
    top = min(len(ids), k)
    for a in range(0, len(q_rows), 128):
        asked, low = q[a : a + 128], least[a : a + 128]
        own = q_rows[a : a + 128, None] == rows[None, :]
        length = np.linalg.norm(asked, axis=1)[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            scores = scan(asked, packed, norm, index.centres)
            most = scores + length * (err + ROUGH * norm)
            scores = np.where(own, -np.inf, np.nan_to_num(scores, nan=-np.inf))
            if len(ids) > k:
                near = np.argpartition(scores, len(ids) - top, axis=1)[:, len(ids) - top :]
                kth = np.einsum("qkd,qd->qk", x[near], asked).min(axis=1)
                slack = FINE * length[:, 0] * norm.max()
                low = np.fmax(low, kth - slack)
            maybe = ~(most < low[:, None]) & ~own
            if maybe.mean() > DENSE:
                scores = np.where(own, -np.inf, asked @ x.T)
                kth = np.partition(scores, len(ids) - top, axis=1)[:, len(ids) - top]
                slack = FINE * length[:, 0] * norm.max()
                maybe &= ~(scores < (np.fmax(low, kth) - slack)[:, None])
            for i in np.flatnonzero(maybe.any(axis=1)).tolist():
                near = np.flatnonzero(maybe[i])
                exact = (x[near] * asked[i]).sum(axis=1)
                order = np.lexsort((ids[near], -exact))[:k]
                found.append((a + i, near[order], exact[order]))
                if len(order) == k:
                    least[a + i] = max(least[a + i], exact[order[-1]])
    return found


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, vec): the rows that take part, each with a number of its own."""
    vec = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    rows = rows.join(F.broadcast(dims.select("dim")), F.size("vec") == F.col("dim"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binaries."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x.tobytes())])


def _read(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``.

    The score is the inner product in double precision; equal scores go by the smaller
    vec_id.  Every row but the query's own is a candidate: rows of one id are candidates and
    queries of their own.  Null ids, and vectors that are null, zero or hold a null or
    non-finite component, take no part; nor do vectors of another length than the most
    common.  Fewer than k candidates are all returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    table = materialise(clean_vectors(vectors, id_col, vec_col), "vectors")
    n = table.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = table.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("row", "vec").toArrow().combine_chunks()
    x = _matrix(sample.column("vec").combine_chunks())
    index = fit_index(x, max(1, min(n // (UNIT // 2), SAMPLE // 32)))
    few = max(4 * k, FIRST // (8 * x.shape[1]))
    firsts = spark.sparkContext.broadcast((x[:few], sample.column("row").to_numpy()[:few]))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if len(x):
                u, norm = directions(x)
                part, cos = index.place(u)
                codes = index.codes(u)
                with np.errstate(invalid="ignore", over="ignore"):
                    err = norm * np.linalg.norm(u - decoded(codes, index.centres, u.shape[1]), axis=1)
                columns = [batch.column("row"), batch.column("vec_id"), pa.array(part.astype(np.int32)), pa.array(cos)]
                columns += [pa.array(norm), pa.array(err), _packed(codes), _packed(x)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "part", "cos", "norm", "err", "codes", "vec"])

    held = table.mapInArrow(indexed, "row long, vec_id long, part int, cos double, norm double, err double, codes binary, vec binary")
    held = materialise(held, "index")
    known = held.groupBy("part").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.min("cos").alias("cos")).collect()  # a row a partition
    longest, cos = np.full(len(index.partitions), -np.inf), np.ones(len(index.partitions))
    for r in known:
        longest[r["part"]], cos[r["part"]] = r["longest"], r["cos"]
    filled = np.isfinite(longest) | (longest > 0)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if len(x):
                least = first_scores(x, batch.column("row").to_numpy(), *firsts.value, k)
                query, part = np.nonzero(may_hold(x, least, index, longest, cos) & filled)
                offsets = np.searchsorted(query, np.arange(len(x) + 1)).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.astype(np.int32)))
                columns = [batch.column("row"), batch.column("vec_id"), _packed(x), pa.array(least), parts]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "vec", "least", "parts"])

    routes = table.filter(F.col("vec_id") % every == 0).mapInArrow(routed, "row long, vec_id long, vec binary, least double, parts array<int>")
    asked = materialise(routes, "queries")
    discard(table)
    width = 8 * x.shape[1]
    slots = 2 * spark.sparkContext.defaultParallelism
    most = min(max(UNIT // 4, -(-n // slots)), max(UNIT, MEET // width))
    blocks = {r["part"]: -(-r["n"] // most) for r in known}
    query_blocks = max(1, -(-asked.count() * width // MEET))
    split = F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair])
    queries = asked.select("row", "vec_id", "vec", "least", F.explode("parts").alias("part"), F.pmod(F.xxhash64("row"), F.lit(query_blocks)).alias("a"))
    queries = queries.withColumn("b", F.explode(F.sequence(F.lit(0), F.coalesce(split[F.col("part")], F.lit(0)) - 1, F.lit(1))))
    cell = ["part", "a", "b"]
    rows = held.withColumn("b", F.pmod(F.xxhash64("row"), split[F.col("part")].cast("long")).cast("int"))
    rows = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))
    out = "query long, query_id long, row long, vec_id long, score double"

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({name.split()[0]: [] for name in out.split(", ")})
        c = c.sort_values(["vec_id", "row"])
        q_rows, q_ids, asked = q["row"].to_numpy(), q["vec_id"].to_numpy(), _read(q["vec"], np.float64)
        least = q["least"].to_numpy().copy()
        parts = []
        for lo in range(0, len(c), UNIT):
            unit = c.iloc[lo : lo + UNIT]
            rows, ids, x = unit["row"].to_numpy(), unit["vec_id"].to_numpy(), _read(unit["vec"], np.float64)
            codes, norm, err = _read(unit["codes"], np.uint8), unit["norm"].to_numpy(), unit["err"].to_numpy()
            for i, near, exact in unit_search(q_rows, asked, least, rows, ids, x, codes, norm, err, index, k):
                parts.append((np.full(len(near), q_rows[i]), np.full(len(near), q_ids[i]), rows[near], ids[near], exact))
        names = [name.split()[0] for name in out.split(", ")]
        return pd.DataFrame({name: np.concatenate([p[j] for p in parts]) if parts else [] for j, name in enumerate(names)})

    near = queries.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(meet, out)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
