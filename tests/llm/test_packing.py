"""Packing: the plan, and every id in exactly one place."""

import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loanward.llm.bpe import VOCABULARY
from loanward.llm.packing import knapsack, pack, plan, relaxed
from tests.llm.conftest import table


def test_knapsack_against_all_multisets():
    r = random.Random(1)
    for _ in range(20):
        prices = np.array([r.random() for _ in range(5)])
        best = max(sum(p * n for p, n in zip(prices, counts)) for counts in product(range(10), repeat=5)
                   if sum((i + 1) * n for i, n in enumerate(counts)) <= 9)
        value, counts = knapsack(prices, 9)
        assert abs(value - best) < 1e-9 and abs((prices * counts).sum() - best) < 1e-9
        assert (np.arange(1, 6) * counts).sum() <= 9


def test_plan_holds_every_piece_and_wastes_little():
    r = np.random.default_rng(2)
    for demand in (r.integers(0, 400, 64), np.zeros(64, int), np.eye(1, 64, 40, dtype=int)[0] * 7):
        chosen = plan(demand, 64)
        placed = sum((counts * times for counts, times in chosen), np.zeros(64, int))
        assert (placed == demand).all()
        assert all((np.arange(1, 65) * counts).sum() <= 64 for counts, _ in chosen)
        total, relaxation = sum(t for _, t in chosen), sum(use for _, use in relaxed(demand, 64)) if demand.any() else 0
        assert relaxation - 1e-6 <= total <= 1.001 * relaxation + 3


def _check(rows, texts, length=2048):
    """Whole documents come back from their pieces; sequences are gapless. Returns the padding's share."""
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,) for t in texts)
    assert sum(r.length for r in rows) == sum(map(len, want))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / (length * len(sequences))


def test_documents_come_back(spark, docs):
    texts = ["", None, "one", "one", "word " * 5000, "a b c " * 700, *["x y z " * n for n in range(60)]]
    frame = docs(list(enumerate(texts))).withColumnRenamed("source", "length")
    rows = pack(frame).collect()
    _check(rows, texts)
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_repeated_rows_and_ids_are_packed_each(docs):
    texts = ["same text"] * 5 + ["other"] * 3
    rows = pack(docs([(None if i > 5 else 1, t) for i, t in enumerate(texts)])).collect()
    assert len(rows) == 8
    _check(rows, texts)
    assert pack(docs([])).collect() == []


def test_padding_of_a_table_is_small(spark, small):
    frame = table(spark, small, "documents")
    share = _check(pack(frame).collect(), [r.text for r in frame.collect()])
    assert share < 0.02
