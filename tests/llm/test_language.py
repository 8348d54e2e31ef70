"""Language identification: the sum over segmentations, held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from loanward.llm import language
from loanward.llm.language import UNKNOWN, Pieces, Scorer, identify, vocabulary
from tests.llm.conftest import table

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]


def _all_ways(text, chance):
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        p = chance.get(text[:n], UNKNOWN if n == 1 else 0.0)
        if p:
            total += p * _all_ways(text[n:], chance)
    return total


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(3)
    table = Pieces(PIECES)
    chance = np.zeros((len(PIECES) + 2, 2))
    chance[:-2], chance[-1] = r.random((len(PIECES), 2)), UNKNOWN
    words = ["a", "b", "ab", "abab", "c", "abcab", "bbbb", "ababababababababababab", "", "a" * 40]
    scores = table.score(words, chance)
    for word, row in zip(words, scores):
        for j in range(2):
            if len(word) < 25:
                want = _all_ways("▁" + word, dict(zip(PIECES, chance[:, j])))
                assert abs(row[j] - np.log(want)) < 1e-6
    assert np.isfinite(scores).all()


def test_expected_counts_against_all_segmentations():
    table = Pieces(PIECES)
    chance = np.concatenate([np.linspace(0.1, 0.8, len(PIECES)), [0.0, UNKNOWN]])
    p = dict(zip(PIECES, chance))

    def ways(text):
        if not text:
            yield 1.0, []
        for n in range(1, len(text) + 1):
            if text[:n] in p:
                for q, rest in ways(text[n:]):
                    yield q * p[text[:n]], [text[:n], *rest]

    want, total = np.zeros(len(PIECES)), 0.0
    for q, cut in ways("▁abab"):
        total += q
        for piece in cut:
            want[PIECES.index(piece)] += q
    got = table.expected(["abab"], np.array([3.0]), chance)
    assert np.allclose(got, 3 * want / total)


def test_held_out_accuracy(spark, small):
    documents = table(spark, small, "documents")
    rows = identify(documents).collect()
    assert len(rows) == documents.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_is_no_input_of_the_prediction(spark, small):
    """Other labels, sources and ids of held-out rows leave their predictions as they are."""
    documents = table(spark, small, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn(
        "source", F.lit(None).cast("string"))
    want = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(documents).collect()}
    assert want == {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(changed).collect()}


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "123 456 !!"), (4, "the cat sat"), (4, "the cat sat"), (None, "word"),
            (7, "ab" * 30000), (8, " \n")]
    out = identify(docs(rows).withColumnRenamed("source", "score").withColumn("lang", F.lit("en")))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "held_out", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert {(i, p) for i, p, _ in found} == {
        (1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (7, "en"), (8, "und")}
    assert all(s == 0 for _, p, s in found if p == "und") and len(found) == 8
    unlabelled = identify(docs(rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert identify(docs([])).collect() == []


def test_pieces_of_all_lengths_are_used():
    pieces = vocabulary()
    assert {"▁function", "▁something", "▁different"} <= set(pieces)
    table, longest = Pieces(pieces), max(pieces, key=len)
    chance = np.full((len(pieces) + 2, 1), 1e-9)
    chance[pieces.index("▁something")] = 0.5
    assert abs(table.score(["something"], chance)[0, 0] - np.log(0.5)) < 1e-4
    ids = table.found([longest.removeprefix("▁")], len(longest.removeprefix("▁")) + 1)
    assert pieces.index(longest) in ids


def test_what_is_kept_is_bounded_and_changes_nothing(monkeypatch):
    """Many different long chunks: the tables are emptied on the way, and predictions stay."""
    r = np.random.default_rng(6)
    chance = np.concatenate([r.random((len(PIECES), 2)) / 10, np.zeros((1, 2)), np.full((1, 2), UNKNOWN)])
    texts = [" ".join("".join(r.choice(list("abc.é"), size=int(n))) for n in r.integers(1, 400, 30)) for _ in range(60)] + ["", None, "..."]
    texts += texts[:5]
    fresh = [p for t in texts for p in Scorer(PIECES, ["x", "y"], chance, np.array([0.3, 0.7])).predict([t])]
    scorer = Scorer(PIECES, ["x", "y"], chance, np.array([0.3, 0.7]))
    monkeypatch.setattr(language, "KEPT", 60_000)
    got = []
    for at in range(0, len(texts), 3):
        got += list(scorer.predict(texts[at:at + 3]))
        assert scorer.chunks.bytes <= 60_000 and scorer.words.bytes <= 60_000
    assert [p for p, _ in got] == [p for p, _ in fresh] and np.allclose([s for _, s in got], [s for _, s in fresh])


def test_long_texts_of_different_long_chunks(spark, docs):
    rows = [(i, " ".join(f"{'abcdefghij'[i]}{n}" + "xyz" * (200 * (n % 40)) for n in range(400))) for i in range(4)]
    assert {r.lang_pred for r in identify(docs(rows), carry=["doc_id"]).collect()} == {"en"}
