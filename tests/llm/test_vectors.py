"""Exact search against all scores."""

import math
import random

import numpy as np
import pytest

from loanward.llm.vectors import Approximation, search
from tests.llm.conftest import table


def _plain(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def _got(frame, **options):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in search(frame, **options).collect()}


@pytest.mark.parametrize("scale", [0.01, 1.0, 3e5])
def test_random_vectors_in_small_blocks(spark, scale):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) * scale for _ in range(8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert _got(frame, every=20, size=16, queries=3) == _plain(rows, 20, 5)


def test_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0]) for i in range(120)] + [
        (1000, None), (1001, []), (1050, [1.0, None]), (1100, [nan, 1.0]), (1150, [inf, 0.0]), (1200, [1.0]),
        (1250, [2.0]), (1300, [-0.001, -5.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    assert _got(frame, size=7) == _plain(rows, 50, 5)


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert _got(spark.createDataFrame([], kind)) == set()
    assert _got(spark.createDataFrame([(0, [1.0])], kind)) == set()
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.25]), (2, [0.25, 1.0])]
    assert _got(spark.createDataFrame(rows, kind)) == _plain(rows, 50, 5)


def test_bounds_hold():
    r = np.random.default_rng(8)
    block = Approximation(r.integers(-5000, 5000, (300, 12)))
    queries = r.integers(-5000, 5000, (20, 12))
    least, greatest = block.bounds(queries)
    exact = queries @ block.exact.T
    assert (least <= exact).all() and (exact <= greatest).all()


def test_whole_table(spark, small):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, small, "embeddings").collect()]
    assert _got(table(spark, small, "embeddings")) == _plain(rows, 50, 5)


def test_queries_are_never_broadcast(spark):
    """Repeated for every piece they are many times what their shuffle shows; no join may gather them."""
    rows = [(i, [float(i % 7), float(i % 11), 1.0][:2 + i % 2]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    near = search(frame, every=10, size=16, queries=3, piece=32)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in near.collect()} == _plain(rows, 10, 5)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_copies_are_dealt_over_pieces(spark):
    """Equal rows, ids included, are candidates each and do not make one piece."""
    rows = [(50 + i % 2, [1.0, 2.0]) for i in range(600)] + [(100, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    # A repeated query row is one query, so each query has five different places.
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search(frame, size=8, queries=2, piece=40).collect()) == sorted(_plain(rows, 50, 5))
