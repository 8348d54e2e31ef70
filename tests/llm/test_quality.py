"""Quality rules against plain Python, and the host verdict."""

import re
from collections import Counter

from pyspark.sql import functions as F

from loanward.llm.quality import METRICS, judge
from tests.llm.conftest import table


def _plain(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts, covered, seen, repeated = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered))


ODD = [None, "", " \t\n\r\x0b\x0c", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z q x y z\nx\nx\n \n \n", "#*$%&|<>",
       "é b ü", "l\r\nl\r\nl", "one two three " * 4000, "w " * 60, " lead and trail ", "\n\n\n", "a b c d " * 20]


def test_figures_match_plain_python(spark, docs):
    frame = docs(list(enumerate(ODD))).withColumnRenamed("lang", "words").withColumnRenamed("n_chars", "n_words")
    rows = {r.doc_id: r for r in judge(frame).collect()}
    for i, text in enumerate(ODD):
        want = _plain(text)
        assert tuple(rows[i][m] for m in METRICS) == want, text
        assert rows[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (rows[i].base_failed and rows[i].kept)
    assert "words" in judge(frame).columns


def test_figures_on_a_table(spark, small):
    frame = table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in judge(frame, carry=["doc_id"]).collect():
        assert tuple(r[m] for m in METRICS) == _plain(texts[r.doc_id])


def test_a_host_that_mostly_fails_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [("bad", "short")] * 90 + [("bad", good)] * 10 + [("fine", good)] * 200 + [("fine", "short")] * 5 + [
        (None, good)] * 30 + [("one", "short")] + [("tiny", good)]
    frame = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    out = judge(frame)
    by = {r.source: r for r in out.groupBy("source").agg(
        F.sum(F.col("kept").cast("int")).alias("kept"), F.max("host_rate").alias("rate"), F.count("*").alias("n")).collect()}
    assert by["bad"].kept == 0 and by["fine"].kept == 200 and by[None].kept == 30 and by["tiny"].kept == 1
    assert 0.5 < by["bad"].rate < 0.9 and by["one"].rate < 1  # shrunk towards the pooled rate
    assert out.count() == len(rows)


def test_empty_and_narrow_tables(spark, docs):
    assert judge(docs([])).collect() == []
    assert judge(spark.createDataFrame([("x",)], "text string")).first().base_failed


def test_only_jvm_operators(spark, docs):
    plan = judge(docs([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
