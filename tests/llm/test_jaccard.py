"""The join against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loanward.llm import common
from loanward.llm import jaccard as j
from loanward.llm.components import stars
from loanward.llm.common import Scratch
from tests.llm.conftest import table

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((str(doc), len(sets[i]), str(least.get(root(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))


def got(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in j.components(frame).collect())


def near_copies(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(r.choice([5, 12, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            words = words[:r.randrange(len(words) + 1)]
        if r.random() < 0.3:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((i * 7 % 101, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_match_all_pairs(docs, seed):
    rows = near_copies(seed)
    assert got(docs(rows).repartition(4)) == plain(rows)


def test_the_token_order_changes_nothing(docs, monkeypatch):
    rows = near_copies(4)
    monkeypatch.setattr(j, "ORDER_SAMPLE", 1)
    monkeypatch.setattr(j, "FREQUENT", 2)
    assert got(docs(rows)) == plain(rows)


def test_without_leaders_and_broadcasts(docs, monkeypatch):
    """Groups of one: every link is found by the matrix; texts are fetched by shuffled joins."""
    rows = near_copies(5)
    monkeypatch.setattr(j, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(j, "HASHES", 0)
    assert got(docs(rows)) == plain(rows)


def test_odd_rows(docs):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (11, "É é"), (12, "é é"),
            (4, "a b c d e f g h"), (4, "a b c d e f g h"), (3, "A B C D E F G H"), (None, "a b c d e f g h"),
            (None, "all alone here"), (20, "x " * 30000), (21, "x " * 5), (22, "y" * 3_000_000 + " z"),
            (23, "Y" * 3_000_000 + " z")]
    frame = docs(rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "component_id")
    assert got(frame) == plain(rows)
    assert got(docs([])) == []


def test_whole_table(spark, small):
    frame = table(spark, small, "documents")
    assert got(frame) == plain([(r.doc_id, r.text) for r in frame.collect()])


def test_no_linked_pair_is_ruled_out():
    """Random sets under a random order: prefixes meet, and the bound holds, for every linked pair."""
    r = random.Random(10)
    for _ in range(400):
        n = r.randrange(1, 60)
        a = set(r.sample(range(1000), n))
        b = (a - set(r.sample(sorted(a), r.randrange(n // 4 + 1)))) | set(r.sample(range(1000, 2000), r.randrange(n // 4 + 1)))
        both = len(a & b)
        if 100 * both < 75 * len(a | b):
            continue
        order = list(range(2000))
        r.shuffle(order)
        heads = [set(sorted(x, key=order.__getitem__)[:j.prefix_size(len(x))]) for x in (a, b)]
        shared = len(heads[0] & heads[1])
        assert shared
        rest = max(len(x) - j.prefix_size(len(x)) for x in (a, b))
        assert shared + rest >= -(-75 * (len(a) + len(b)) // 175)


def test_meetings_across_batches():
    r = random.Random(9)
    rows = sorted((r.randrange(30), r.randrange(3) if r.random() < 0.5 else 7, r.randrange(12)) for _ in range(200))
    rows = sorted({(t, n): (t, c, n, 10 + n % 4) for t, c, n in rows}.values())
    want = {}
    for t, c, n, k in rows:
        for t2, c2, n2, k2 in rows:
            if t == t2 and n < n2 and c != c2 and 100 * min(k, k2) >= 75 * max(k, k2):
                want[n2, n, k2, k] = want.get((n2, n, k2, k), 0) + 1
    for size in (1, 2, 7, 50, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at:at + size]], pa.int64()) for i in range(4)],
                                              ["token", "comp", "node", "n"]) for at in range(0, len(rows), size)]
        found = {}
        for b in j._meetings(iter(batches)):
            for x in b.to_pylist():
                key = (x["u"], x["v"], x["nu"], x["nv"])
                found[key] = found.get(key, 0) + x["shared"]
        assert found == want, size


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 300), (7, 7)]
    frame = stars(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "stars-test"), "x")
    found = {r.u: r.v for r in frame.collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 300: 100}


def test_cells_of_a_frequent_token_are_dealt_into_bounded_pieces(spark):
    cells = spark.range(600).selectExpr("1L token", "id comp", "id node", "10L n").unionByName(
        spark.range(5).selectExpr("2L token", "id comp", "id node", "10L n"))
    frequent = spark.createDataFrame([(1, 6)], "often long, pieces long")
    dealt = j._dealt(cells, frequent)
    assert max(r["count"] for r in dealt.groupBy("token").count().collect()) <= 300
    met = dealt.repartition("token").sortWithinPartitions("token").mapInArrow(
        j._meetings, "u long, v long, nu long, nv long, shared long").groupBy("u", "v").sum("shared").collect()
    assert {(r.u, r.v): r[2] for r in met} == {(b, a): 2 if b < 5 else 1 for b in range(600) for a in range(b)}


def test_pieces_change_nothing(docs, monkeypatch):
    rows = near_copies(6)
    monkeypatch.setattr(j, "HELD", 4)
    assert got(docs(rows)) == plain(rows)


def test_pairs_of_one_token_are_written_out_in_bounded_parts():
    n = 300
    table = pa.table([pa.array(x, pa.int64()) for x in ([1] * n, range(n), range(n), [10] * n)],
                     ["token", "comp", "node", "n"])
    parts = [b.num_rows for b in j._met(table, most=1000)]
    assert sum(parts) == n * (n - 1) // 2 and max(parts) <= 1000 + n


def test_linked_pairs_share_enough_tokens_in_early_places():
    r = random.Random(11)
    seen = 0
    for _ in range(600):
        n = r.randrange(1, 90)
        a = set(r.sample(range(1000), n))
        b = (a - set(r.sample(sorted(a), r.randrange(n // 4 + 1)))) | set(r.sample(range(1000, 2000), r.randrange(n // 4 + 1)))
        both = len(a & b)
        if 100 * both < 75 * len(a | b):
            continue
        rank = list(range(2000))
        r.shuffle(rank)
        sizes = np.array([len(a)]), np.array([len(b)])
        least, most = int(j.early(*sizes)[0]), int(j.overlap(*sizes)[0])
        assert 1 <= least <= j.EARLY and both >= most
        places = [len(x) - most + least for x in (a, b)]
        assert all(k <= j.prefix_size(len(x)) for k, x in zip(places, (a, b), strict=True))
        heads = [set(sorted(x, key=rank.__getitem__)[:k]) for k, x in zip(places, (a, b), strict=True)]
        assert len(heads[0] & heads[1]) >= least
        seen += least > 1
    assert seen > 50


def test_a_large_group_of_near_copies_makes_few_pairs(spark, docs, monkeypatch):
    """Copies of one text that are mostly too far from each other: what meets does not grow with their square."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(1, 301):
        words = list(base)
        for k, at in enumerate(r.sample(range(150), r.choice([2, 3, 10, 12]))):
            words[at] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    rows.insert(200, (0, " ".join(base)))
    monkeypatch.setattr(j, "ORDER_SAMPLE", 1)
    made, meetings = spark.sparkContext.accumulator(0), j._meetings

    def counted(batches):
        for batch in meetings(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(j, "_meetings", counted)
    assert got(docs(rows)) == plain(rows)
    assert made.value < 10 * len(rows)


def test_prefixes_do_not_stay_on_disk(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows = near_copies(7)
    frame = j.components(docs(rows))
    left = {p.name for p in tmp_path.glob("jaccard-*/*")}
    assert "sized" in left and not left & {"signed", "candidates"}
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in frame.collect()) == plain(rows)
