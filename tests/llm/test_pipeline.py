"""The corpus pipeline: each stage on its own, odd rows, and the whole run."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from loanward.llm.registry import oracles, queries
from tests.compare import connect, difference

STAGE = dict(cp.STAGES)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(queries()) | {"pipeline"} <= set(names) and set(oracles()) <= set(queries())
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_duplicates", "repeats", "packing"]


@pytest.mark.parametrize("name", sorted(oracles()))
def test_oracles(spark, small, name):
    assert difference(queries()[name](spark, small), connect(small), oracles()[name]) is None


def test_stages_decide(spark, docs, small):
    text = " ".join(f"word{i}" for i in range(120))
    near = text.replace("word60", "other")
    rows = docs([(5, text), (2, near), (9, "12 34"), (7, "too short"), (None, " ".join(f"x{i}" for i in range(70)))])
    extra = rows.withColumn("kept", F.lit("x")).withColumn("row", F.lit(1)).withColumn("score", F.lit(2))
    out = STAGE["language"](spark, extra, small)
    assert out.columns == extra.columns and {r.doc_id for r in out.collect()} == {5, 2, 7, None}
    out = STAGE["quality"](spark, extra, small)
    assert out.columns == extra.columns and {r.doc_id for r in out.collect()} == {5, 2, None}
    out = STAGE["near_duplicates"](spark, extra, small)
    assert out.columns == extra.columns and {r.doc_id for r in out.collect()} == {2, 9, 7, None}
    out = STAGE["repeats"](spark, extra, small)
    kept = {r.doc_id: r for r in out.collect()}
    assert out.columns == extra.columns and len(kept[5].text) < len(text) and kept[5].n_chars == len(kept[5].text)
    assert kept[7].text == "too short"


def test_rows_that_share_an_id_are_one_document(spark, docs, small):
    rows = docs([(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text"), (2, "a b c d e f"), (3, None), (3, None)])
    out = STAGE["near_duplicates"](spark, rows, small).collect()
    assert sorted(r.doc_id for r in out) == [1, 3]


def test_empty_documents(spark, docs, small):
    out = docs([])
    for _, stage in cp.STAGES:
        out = stage(spark, out, small)
    assert out.collect() == []


def test_whole_run(spark, small):
    rows = cp.run(spark, small).collect()
    ids = {r.doc_id for r in rows}
    assert 0 < len(ids) < spark.read.parquet(f"{small}/documents.parquet").count()
    assert cp.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()


def test_passages_of_over_50_words_go_at_any_size(spark, docs, small):
    texts = lambda k: [(i, " ".join([f"{i}a{n}" for n in range(90)] + [f"w{n}" for n in range(k)]
                                    + [f"{i}b{n}" for n in range(90)])) for i in (1, 2)]
    for many, gone in ((50, False), (51, True)):
        rows = docs(texts(many))
        assert len(" ".join(f"w{n}" for n in range(many))) < 400
        for r in STAGE["repeats"](spark, rows, small).collect():
            assert ("w7" not in r.text.split()) == gone and len(r.text.split()) == 180 + (0 if gone else many)
            assert r.n_chars == len(r.text)


def test_near_duplicates_are_decided_by_row(spark, docs, small):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "quite another text here"), (None, "A b c d e f"),
            (None, "only without an id"), (None, "only without an id"), (None, "Only without an id"), (None, None),
            (None, " "), (9, ""), (9, "nine has words too")]
    seen = set()
    for order in (rows, rows[::-1]):
        out = STAGE["near_duplicates"](spark, docs(order), small).collect()
        seen.add(tuple(sorted((str(r.doc_id), str(r.text)) for r in out)))
    (kept,) = seen
    lone = [k for k in kept if k[0] == "None" and k[1].strip() not in ("", "None")]
    assert len(lone) == 1 and lone[0][1].lower() == "only without an id"
    assert set(kept) - set(lone) == {("1", "a b c d e f"), ("7", "quite another text here"), ("None", "None"),
                                     ("None", " "), ("9", "nine has words too")}
