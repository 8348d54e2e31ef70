"""Operator 4: packing by cutting-stock column generation.

A document's ids are cut into full sequences and a tail. Tails are counted by length class (a histogram with a
bounded number of classes). On the histogram a linear program chooses how often each pattern of classes fills a
sequence; new patterns come from a knapsack dynamic program over the dual prices. The rounded pattern counts,
and first-fit patterns for what rounding leaves, are then dealt to the documents ranked within their class.
Only the histogram and the patterns pass through the driver; documents meet their place by a join on class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanward.llm.bpe import VOCABULARY, encoder
from loanward.llm.common import Scratch, slices

LENGTH = 2048
#: Lengths are rounded up to a multiple of this for the histogram: finer wastes less and plans longer.
STEP = 8
#: Id that closes a document.
END = 1
#: Rows per rank block: a class is ranked in blocks of about this many rows.
BLOCK = 20_000


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes 1..len(prices) within ``capacity``, by dynamic programming."""
    sizes = len(prices)
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, 0, dtype=np.int64)
    for room in range(1, capacity + 1):
        most = min(sizes, room)
        options = best[room - most:room][::-1] + prices[:most]
        pick = int(options.argmax())
        if options[pick] > best[room - 1] + 1e-12:
            best[room], last[room] = options[pick], pick + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(sizes, dtype=np.int64), capacity
    while room > 0:
        if last[room]:
            counts[last[room] - 1] += 1
            room -= int(last[room])
        else:
            room -= 1
    return float(best[capacity]), counts


def relaxed(demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, for the linear cutting-stock problem: revised simplex, priced columns.

    ``demand[i]`` pieces of size i+1. Stops when the priced bound shows that less than ``gap`` can be won.
    """
    rows = np.flatnonzero(demand)
    need = demand[rows].astype(float)
    basis = np.diag([float(capacity // (i + 1)) for i in rows])  # a pattern of one size for each size
    inverse = np.diag(1 / np.diag(basis))
    use = inverse @ need
    for _ in range(rounds):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        full = np.zeros(int(rows[-1]) + 1)
        full[rows] = np.maximum(prices, 0)
        value, counts = knapsack(full, capacity)
        # prices / value is dual feasible, so this much of the present cost is a lower bound.
        if value <= 1 + 1e-9 or use.sum() * (1 - 1 / value) < max(gap * use.sum(), 0.5):
            break
        column = counts[rows].astype(float)
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        pivot = inverse[leave] / direction[leave]
        moved = use[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        use = np.maximum(use - moved * direction, 0)
        use[leave] = moved
        basis[:, leave] = column
    patterns = []
    for k in range(len(rows)):
        counts = np.zeros(len(demand), dtype=np.int64)
        counts[rows] = np.rint(basis[:, k]).astype(np.int64)
        patterns.append((counts, float(use[k])))
    return patterns


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that together hold every piece once."""
    left = demand.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []
    if left.sum():
        for counts, use in sorted(relaxed(demand, capacity), key=lambda p: -p[1]):
            fits = int(min((left[counts > 0] // counts[counts > 0]).min(initial=2**62), np.floor(use + 1e-9)))
            if fits > 0 and counts.any():
                chosen.append((counts, fits))
                left -= counts * fits
    while left.any():  # first fit decreasing, one pattern at a time
        counts, room = np.zeros_like(left), capacity
        while True:
            size = int(np.flatnonzero(left[:room] > counts[:room]).max(initial=-1)) + 1
            if size <= 0:
                break
            more = int(min(left[size - 1] - counts[size - 1], room // size))
            counts[size - 1] += more
            room -= more * size
        times = int((left[counts > 0] // counts[counts > 0]).min())
        chosen.append((counts, times))
        left -= counts * times
    return chosen


def token_pieces(documents: DataFrame, path: str, length: int) -> DataFrame:
    """doc_id, doc_tokens, and pieces (start, length, ids_crc32) of every row; the end id is counted."""
    schema = "doc_id long, doc_tokens long, pieces array<struct<start: long, length: long, ids_crc32: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([END], dtype="<u4").tobytes()
        for batch in slices(batches, "text"):
            totals, rows = [], []
            for raw in own.encode(t or "" for t in batch.column("text").to_pylist()):
                raw += end
                totals.append(len(raw) // 4)
                rows.append([{"start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                             for at in range(0, len(raw), 4 * length) for part in (raw[at:at + 4 * length],)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()),
                 pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                                    ("ids_crc32", pa.int64())])))],
                ["doc_id", "doc_tokens", "pieces"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece with the end id alone. A repeated row is packed as often as it occurs.
    Pieces of a sequence stand gapless from offset 0; full pieces have a sequence of their own. Other columns
    are ignored. ``length`` must be a multiple of ``step``.
    """
    if length % step:
        raise ValueError("length must be a multiple of step")
    spark, path = documents.sparkSession, path or public_tokenizers.path(VOCABULARY)
    scratch = Scratch(spark, "packing")
    pieces = scratch.put("pieces", token_pieces(documents, path, length).select(
        "doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "p.*"))
    sizes = F.when(F.col("length") == length, 0).otherwise(F.ceil(F.col("length") / step)).cast("int")
    # A row's block follows from its content, so that a task run again puts it in the same place.
    total = pieces.count()
    blocks = max(1, -(-total // BLOCK))
    ranked = pieces.withColumns({"size": sizes, "block": F.pmod(
        F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int")})
    counted = ranked.groupBy("size", "block").count()
    offsets = counted.select("size", "block", (F.sum("count").over(
        Window.partitionBy("size").orderBy("block")) - F.col("count")).alias("before"))
    classes = length // step
    demand = np.zeros(classes, dtype=np.int64)
    full = 0
    for row in counted.groupBy("size").agg(F.sum("count").alias("n")).collect():  # at most length/step + 1 rows
        if row["size"]:
            demand[row["size"] - 1] = row["n"]
        else:
            full = row["n"]
    dealt, sequence = [], 0
    given = np.zeros(classes, dtype=np.int64)
    for counts, times in plan(demand, classes):
        slot = 0
        for i in np.flatnonzero(counts)[::-1].tolist():
            each = int(counts[i])
            dealt.append((i + 1, int(given[i]), int(given[i]) + each * times, sequence, each, slot))
            given[i] += each * times
            slot += each
        sequence += times
    if full:
        dealt.append((0, 0, full, sequence, 1, 0))
    places = spark.createDataFrame(
        dealt, "size int, from_rank long, to_rank long, base long, each long, slot long")
    order = Window.partitionBy("size", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = (ranked.join(offsets, ["size", "block"])
              .withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("before", "block"))
    # Broadcast size: patterns times classes in them, both bounded by length / step.
    placed = ranked.join(F.broadcast(places.withColumnRenamed("size", "of")), (F.col("size") == F.col("of")) & (
        F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    nth = F.col("rank") - F.col("from_rank")
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.expr("(rank - from_rank) div each")).alias("sequence_id"),
        (F.col("slot") + nth % F.col("each")).alias("slot"))
    within = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.sum("length").over(within) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         offset.alias("offset"))
