"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import Scratch


def _pointed(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, without loops and repeats."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def stars(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(u, v): v is the least node of u's component; the least nodes themselves have no row.

    ``edges`` has long columns u and v. Neighbours are never gathered: a node's least neighbour is an aggregate,
    joined back to its edges.
    """
    now, turn = scratch.put(f"{label}-0", _pointed(edges)), 0
    while True:
        # A forest of stars is done: no centre is a leaf of another.
        if now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = _pointed(both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")))
        large = scratch.put(f"{label}-{turn}-large", large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _pointed(small.unionByName(least.select("u", F.col("m").alias("v"))))
        now = scratch.put(f"{label}-{turn + 1}", small)
        scratch.drop(f"{label}-{turn}")
        scratch.drop(f"{label}-{turn}-large")
        turn += 1
