"""Operator 6: exact top-k inner products by a vector-approximation file.

Vectors are packed into rows and dealt evenly into pieces that a task holds, whatever their content; every piece is
cut into blocks. Beside its exact integers a block holds the approximation: one byte per component, the number of its
cell. A pack of queries scans the approximations, which bound each score from both sides; then exact vectors are read
in the order of their upper bound until the k-th score found, in this block or an earlier one, is at least the next
bound. Query packs go to every piece; they and the piece's vectors are stacked and sorted, not joined, so that a task
holds one piece and one pack. Each piece gives k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
#: Factor of the integer grid.
GRID = 256
#: Vectors in a candidate block, in a query pack, and in a candidate pack.
BLOCK, QUERIES, PACK = 4096, 512, 256
#: Components of a piece, about: what a task holds. Queries are sent once for each piece.
PIECE = 1 << 22
#: Cells of a component.
CELLS = 256
#: Exact vectors read at once for a query.
STEP = 32


def usable(vector: str = "embedding") -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


class Approximation:
    """Cells of the components of a block, all of one width, and the bounds they give."""

    def __init__(self, exact: np.ndarray) -> None:
        self.exact = exact
        self.low = exact.min(axis=0).astype(np.float64)
        self.width = max(1.0, math.ceil((float(exact.max(initial=0)) - float(exact.min(initial=0)) + 1) / CELLS))
        self.cells = ((exact - self.low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each query and vector.

        A component lies between its cell's lower edge and that plus width - 1; rounding of the double sums is
        covered by a margin.
        """
        q = queries.astype(np.float64)
        edge = q @ (self.cells.astype(np.float64) * self.width).T + (q @ self.low)[:, None]
        room = self.width - 1
        margin = 1e-9 * (np.abs(q).sum(axis=1) * (np.abs(self.low).max(initial=0) + CELLS * self.width))[:, None] + 1e-6
        return (edge + (np.minimum(q, 0).sum(axis=1) * room)[:, None] - margin,
                edge + (np.maximum(q, 0).sum(axis=1) * room)[:, None] + margin)


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[-1]
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    if any(abs(x) >= 2**63 for x in np.ravel(exact)):
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def top_of_blocks(queries: np.ndarray, query_ids: np.ndarray, blocks: Iterable[tuple[np.ndarray, Approximation]],
                  k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of the blocks: ids and scores, best first, ties to the smaller id."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in query_ids]
    for ids, block in blocks:
        least, greatest = block.bounds(queries)
        own = ids[None, :] == query_ids[:, None]
        least[own] = greatest[own] = -np.inf
        # No vector under the k-th best score, or before there is one the k-th best lower bound, can be wanted.
        sure = np.array([float(best[-1]) if len(best) == k else -np.inf for _, best in found])
        few = np.isneginf(sure)
        if len(ids) > k and few.any():
            sure[few] = np.partition(least[few], len(ids) - k, axis=1)[:, len(ids) - k]
        stay = (greatest >= sure[:, None]) & ~own
        for i in np.flatnonzero(stay.any(axis=1)).tolist():
            names, best = found[i]
            allowed = np.flatnonzero(stay[i])
            allowed = allowed[np.argsort(-greatest[i, allowed], kind="stable")]
            for at in range(0, len(allowed), STEP):
                if len(best) == k and best[-1] > greatest[i, allowed[at]]:
                    break
                read = allowed[at:at + STEP]
                best = np.concatenate([best, inner(queries[i:i + 1], block.exact[read])[0]])
                names = np.concatenate([names, ids[read]])
                first = np.lexsort((names, -best))[:k]
                best, names = best[first], names[first]
            found[i] = names, best
    for query, (names, best) in zip(query_ids.tolist(), found, strict=True):
        if len(best):
            yield query, names, best


def packs(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, dim, q) packed into rows of up to ``size`` vectors: dim, ids, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([part[0] for part in held[dim]])
            exact = np.concatenate([part[1] for part in held[dim]])
            end = len(ids) if whole else len(ids) // size * size
            for at in range(0, end, size):
                upto = min(at + size, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([ids[at:upto].astype("<i8").tobytes()], pa.binary()),
                     pa.array([exact[at:upto].astype("<i8").tobytes()], pa.binary())], ["dim", "ids", "exact"])
            held[dim] = [(ids[end:], exact[end:])]

        for batch in batches:
            ids, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dim"))
            for dim in np.unique(dims).tolist():
                own = dims == dim
                exact = batch.column("q").filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.setdefault(dim, []).append((ids[own], exact))
                yield from packed(dim, whole=False)
            if sum(part[1].size for parts in held.values() for part in parts) > PIECE:  # vectors of very many lengths
                for dim in list(held):
                    yield from packed(dim, whole=True)
                held.clear()
        for dim in list(held):
            yield from packed(dim, whole=True)

    return vectors.select("vec_id", "dim", "q").mapInArrow(run, "dim int, ids binary, exact binary")


def search(embeddings: DataFrame, every: int = 50, k: int = TOP, size: int = BLOCK, queries: int = QUERIES,
           piece: int = PIECE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id. A
    vector is compared with those of its own length. Rows that share the query's id are not its candidates; other
    repeated rows are candidates each. A query id on several rows is one query for each different vector, and its
    best scores over them count.
    """
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long"), F.size("embedding").alias("dim"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * GRID)).alias("q"))
    there = rows.agg(F.count(F.lit(1)).alias("vectors"), F.coalesce(F.sum("dim"), F.lit(0)).alias("components")).first()
    # As few pieces as a task can hold, each being a copy of the queries, but work for every core.
    cores = embeddings.sparkSession.sparkContext.defaultParallelism
    many = max(1, -(-there.components // piece), min(2 * cores, -(-there.vectors // size)))
    candidates = packs(rows, min(size, PACK)).withColumns({
        "piece": F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(many)).cast("int"),
        "asks": F.lit(False)})
    # The stated query set meets every vector: its rows are sent to each piece.
    asked = packs(rows.where(F.col("vec_id") % every == 0).dropDuplicates(), queries).withColumns({
        "piece": F.explode(F.sequence(F.lit(0), F.lit(many - 1))), "asks": F.lit(True)})
    pieces = candidates.unionByName(asked).repartitionById(many, "piece").sortWithinPartitions("piece", "dim", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, blocks = None, [], []
        for batch in batches:
            for at, dim, asks, ids, exact in zip(*(batch.column(c) for c in ("piece", "dim", "asks", "ids", "exact")), strict=True):
                if (at, dim) != last:
                    last, parts, blocks = (at, dim), [], []
                names = np.frombuffer(ids.as_buffer(), "<i8")
                vectors = np.frombuffer(exact.as_buffer(), "<i8").reshape(-1, dim.as_py())
                if not asks.as_py():
                    parts.append((names.copy(), vectors.copy()))
                    continue
                if parts:  # a length's vectors stand before its queries
                    held, those = (np.concatenate(x) for x in zip(*parts, strict=True))
                    blocks = [(held[i:i + size], Approximation(those[i:i + size])) for i in range(0, len(held), size)]
                    parts = []
                found = list(top_of_blocks(vectors, names, blocks, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                     pa.array(np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)),
                     pa.array(np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64))],
                    ["query_id", "vec_id", "score"])

    near = pieces.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
