"""Ranked search against the score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loanward.llm import lexical
from loanward.llm.lexical import combined, index, search, terms_of
from tests.llm.conftest import table

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _terms(text):
    return _TERM.findall((text or "").translate(_LOW))


def _plain(items, docs, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = Counter()
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out.update((item, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k], 1))
    return out


def _got(spark, items, docs, parts=4):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS score", "2 AS item_id", "3 AS n")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 AS term", "5 AS rank")
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search(asked, frame).collect())


def test_terms():
    text = "Élan VITAL x1_y2\x00z\x7fß—w v don't ÀB"
    assert [t.decode() for t in terms_of(text)] == _terms(text)
    assert terms_of(None) == [] and terms_of(" .,\n") == []


def test_combined_bounds_take_the_best_cover():
    assert combined([5, 4, 6], [9, 10]) == [0, 5, 9, 15]
    assert combined([5, 4, 6], [5, 6]) == [0, 5, 5, 11]
    assert combined([5, 5, 5, 5], [10, 5, 10]) == [0, 5, 10, 10, 15]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 7), (3, 40)])
def test_random_documents(spark, monkeypatch, seed, block):
    r = random.Random(seed)
    words = [f"w{n}" for n in range(60)]
    odds = [1 / (n + 1) for n in range(60)]
    docs = [(i, " ".join(r.choices(words, odds, k=r.randint(0, 60)))) for i in range(500)]
    docs += [(i, docs[3][1]) for i in range(500, 540)] + [(3, docs[3][1]), (None, docs[3][1]), (601, None), (602, "... !")]
    items = [(n, " ".join(r.choices(words, k=r.randint(1, 14)))) for n in range(25)] + [
        (50, docs[3][1]), (51, "W3 w3"), (52, None), (53, "unknown"), (None, "w5 w9"), (0, "w59")]
    blocks = index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert blocks.selectExpr("sum(n)").first()[0] == sum(bool(_terms(t)) for _, t in docs)
    # Workers read the module anew: block sizes there come from the partitions.
    assert _got(spark, items, docs, parts=max(1, 500 // block)) == _plain(items, docs)


def test_bounds_skip_postings():
    """Light terms stay closed where their combined bound cannot reach what is needed."""
    rng = np.random.default_rng(5)
    size = 400
    terms = {t: np.sort(rng.choice(size, n, replace=False)).astype(np.uint16) for t, n in enumerate((300, 290, 250, 40))}
    impacts = {t: rng.integers(1, 40, len(p)) if t < 3 else rng.integers(500, 900, len(p)) for t, p in terms.items()}
    shared = [np.intersect1d(terms[t], terms[t + 1]) for t in range(3)]
    full = {t: np.zeros(size, np.int64) for t in terms}
    for t, p in terms.items():
        full[t][p] = impacts[t]
    joint = [int((full[t] + full[t + 1])[shared[t]].max()) for t in range(3)]
    row = {"terms": np.array(list(terms), "<i4"), "term_sizes": np.array([len(p) for p in terms.values()], "<i4"),
           "places": np.concatenate(list(terms.values())).astype("<u2"), "impacts": np.concatenate(list(impacts.values())).astype("<i8"),
           "term_most": np.array([v.max() for v in impacts.values()], "<i8"), "pairs": np.arange(3, dtype="<i4"),
           "pair_sizes": np.array([len(s) for s in shared], "<i4"), "shared": np.concatenate(shared).astype("<u2"),
           "pair_most": np.array(joint, "<i8")}
    lists = lexical.Lists({c: v.tobytes() for c, v in row.items()}, np.arange(size))
    total = sum(full.values())
    want = np.lexsort((np.arange(size), -total))[:10]
    at, score = lexical.best_of_block(lists, [0, 1, 2, 3], [0, 1, 2], 0)
    assert at.tolist() == want.tolist() and score.tolist() == total[want].tolist()
    none, _ = lexical.best_of_block(lists, [0, 1, 2, 3], [0, 1, 2], int(total.max()) + 1)
    assert not len(none)
    before = lists.opened
    lexical.best_of_block(lists, [0, 1, 2], [0, 1], sum(int(v.max()) for t, v in impacts.items() if t < 3) + 1)
    assert lists.opened == before  # the whole query is ruled out by its bounds


def test_long_text_and_empty_tables(spark):
    docs = [(1, "word " * 200_000 + "x" * 1_000_000), (2, "word other"), (3, "é" * 500_000)]
    assert _got(spark, [(1, "WORD x"), (2, "é" * 500_000)], docs) == _plain([(1, "WORD x"), (2, "é" * 500_000)], docs)
    assert not _got(spark, [], docs) and not _got(spark, [(1, "word")], [])


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    got = search(table(spark, small, "benchmark"), table(spark, small, "documents"))
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == _plain(items, docs)
