"""Operator 11: ranked lexical search by MaxScore with bounds of term pairs.

The index is cut by documents: a block holds some thousand documents and the postings of all their terms. Statistics
come from the blocks. For a set of queries each block then gets its impact lists: for a term the documents and exact
impacts with their maximum; for a pair of terms that stand side by side in some query, ordered by weight, the
documents that hold both and the greatest joint impact. A query walks its terms from light to heavy. The least bound
of the first i terms combines single maxima and joint maxima of neighbours, whichever cover gives less. Terms whose
combined bound stays under the score that is needed bring no candidates of their own; candidates of the others take
on the light terms from the heaviest down and leave as soon as what is left, bounded pair by pair, cannot lift them.
What is needed is known from a first part of the blocks and rises in the others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanward.llm.common import Scratch, slices

TOP = 10
#: Documents of a block, and bytes of text after which a block is closed anyway.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Term rows of queries that one round serves; a round's queries are broadcast. An item never is in two rounds.
ROUND_TERMS = 400_000
#: One block in this many is searched first, to know the scores that the others need.
FIRST = 8
#: Term counts up to this many are broadcast to the blocks' terms; beyond, the join shuffles.
BROADCAST_TERMS = 500_000
_BREAKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_BREAKS + bytes(range(65, 91)), b" " * len(_BREAKS) + bytes(range(97, 123)))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def index(documents: DataFrame) -> DataFrame:
    """Blocks of the index: every row of ``documents``, with the postings of all terms.

    A block has doc_ids and lengths of its documents with terms, its terms with the number of documents of each, and
    their postings one after the other: places of documents and occurrences. A text of any length is one document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.add(doc, text)
                if len(block.ids) >= BLOCK or block.bytes >= BLOCK_BYTES:
                    yield block.packed()
                    block = _Block()
        if block.ids:
            yield block.packed()

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "n long, total long, doc_ids array<long>, lengths binary, terms array<string>, dfs array<int>, "
                                "places binary, occurrences binary")


class _Block:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.held: list[np.ndarray] = []
        self.many: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc: int | None, text: str) -> None:
        words = terms_of(text)
        if not words:
            return
        self.bytes += len(text)
        counts = Counter(words)
        known = self.terms
        self.held.append(np.fromiter((known.setdefault(w, len(known)) for w in counts), np.int32, len(counts)))
        self.many.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ids.append(doc)
        self.sizes.append(len(words))

    def packed(self) -> pa.RecordBatch:
        term = np.concatenate(self.held)
        place = np.repeat(np.arange(len(self.held), dtype=np.uint16), [len(h) for h in self.held])
        many = np.concatenate(self.many)
        order = term.argsort(kind="stable")
        dfs = np.bincount(term, minlength=len(self.terms)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(self.ids)], pa.int64()), pa.array([sum(self.sizes)], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())),
             pa.array([np.array(self.sizes, "<i8").tobytes()], pa.binary()),
             pa.array([[t.decode("utf-8", "surrogatepass") for t in self.terms]], pa.list_(pa.string())),
             pa.array([dfs], pa.list_(pa.int32())), pa.array([place[order].astype("<u2").tobytes()], pa.binary()),
             pa.array([many[order].astype("<i4").tobytes()], pa.binary())],
            ["n", "total", "doc_ids", "lengths", "terms", "dfs", "places", "occurrences"])


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows that share an id are one item, a null id being one too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(at, pa.int64())),
                 pa.array([t.decode("utf-8", "surrogatepass") for t in chain.from_iterable(found)], pa.string())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, many: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document's score: its weight, occurrences and the document's length, in whole numbers."""
    m = 100 - 90 + (90 * lengths * documents) // total
    return weights * ((1_000_000_000 * many) // (1000 * many + 8 * m))


class Queries:
    """The items of a round: their terms by id, from light to heavy."""

    def __init__(self, rows: list[tuple[int | None, str]], holding: dict[str, int], documents: int, total: int) -> None:
        self.documents, self.total = documents, total
        self.names = sorted({t for _, t in rows if t in holding})
        self.ids = {t: i for i, t in enumerate(self.names)}
        self.weights = np.array([weight(documents, holding[t]) for t in self.names], dtype=np.int64)
        by_item: dict[int | None, list[int]] = {}
        for item, term in rows:
            if term in self.ids and self.weights[self.ids[term]] > 0:
                by_item.setdefault(item, []).append(self.ids[term])
        self.items = {item: sorted(own, key=lambda t: (self.weights[t], t)) for item, own in by_item.items()}
        self.pairs = sorted({p for own in self.items.values() for p in zip(own, own[1:])})
        self.pair_ids = {p: i for i, p in enumerate(self.pairs)}


def _cut(data: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    return [data[end - size:end] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]


def impact_lists(blocks: DataFrame, queries) -> DataFrame:
    """For each block the lists that the round's queries read, of terms and of pairs; ``queries`` is broadcast.

    ``terms`` and ``pairs`` are numbers in Queries, ``*_sizes`` the lengths of their lists, ``*_most`` the greatest
    impact, of a pair jointly.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        for batch in batches:
            for row in range(batch.num_rows):
                found = {c: batch.column(c)[row].as_py() for c in ("lengths", "dfs", "places", "occurrences")}
                names = batch.column("terms")[row].as_py()
                sizes = np.array(found["dfs"], dtype=np.int64)
                own = [(asked.ids[t], i) for i, t in enumerate(names) if t in asked.ids]
                if not own:
                    continue
                ends = np.cumsum(sizes)
                lengths = np.frombuffer(found["lengths"], "<i8")
                places, many = np.frombuffer(found["places"], "<u2"), np.frombuffer(found["occurrences"], "<i4").astype(np.int64)
                lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for t, i in sorted(own):
                    at = slice(int(ends[i] - sizes[i]), int(ends[i]))
                    lists[t] = places[at], impacts(asked.weights[t], many[at], lengths[places[at]], asked.documents, asked.total)
                pairs, shared, joint = [], [], []
                dense = np.zeros(len(lengths), dtype=np.int64)
                last = None
                for n, (a, b) in enumerate(asked.pairs):  # sorted by their first term
                    if a not in lists or b not in lists:
                        continue
                    if a != last:
                        dense[:] = 0
                        dense[lists[a][0]] = lists[a][1]
                        last = a
                    other = dense[lists[b][0]]
                    both = np.flatnonzero(other)
                    pairs.append(n)
                    shared.append(lists[b][0][both])
                    joint.append(int((other[both] + lists[b][1][both]).max(initial=0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids").slice(row, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (
                        np.array(list(lists), "<i4"), np.array([len(x[0]) for x in lists.values()], "<i4"),
                        np.concatenate([x[0] for x in lists.values()]).astype("<u2"),
                        np.concatenate([x[1] for x in lists.values()]).astype("<i8"),
                        np.array([x[1].max() for x in lists.values()], "<i8"),
                        np.array(pairs, "<i4"), np.array([len(x) for x in shared], "<i4"),
                        np.concatenate([np.zeros(0, np.uint16), *shared]).astype("<u2"), np.array(joint, "<i8")))], _LISTS)

    return blocks.mapInArrow(run, "doc_ids array<long>, " + ", ".join(f"{c} binary" for c in _LISTS[1:]))


_LISTS = ["doc_ids", "terms", "term_sizes", "places", "impacts", "term_most", "pairs", "pair_sizes", "shared", "pair_most"]


class Lists:
    """The impact lists of a block, opened one by one."""

    def __init__(self, row: dict[str, bytes], ids: np.ndarray) -> None:
        self.ids = ids
        def read(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)
        sizes = read("term_sizes", "<i4")
        self.at = {t: i for i, t in enumerate(read("terms", "<i4").tolist())}
        self.places, self.impacts = _cut(read("places", "<u2"), sizes), _cut(read("impacts", "<i8"), sizes)
        self.most = read("term_most", "<i8").tolist()
        self.pair_at = {p: i for i, p in enumerate(read("pairs", "<i4").tolist())}
        self.shared, self.joint = _cut(read("shared", "<u2"), read("pair_sizes", "<i4")), read("pair_most", "<i8").tolist()
        self.opened = 0

    def open(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        self.opened += 1
        i = self.at[term]
        return self.places[i], self.impacts[i]


def combined(single: list[int], pair: list[int]) -> list[int]:
    """The least bound of the first i terms, i = 0 to all: each stands alone or with its neighbour.

    pair[i] bounds terms i and i + 1 together: the joint maximum, or the greater single one where only one is held.
    """
    bound = [0]
    for i, alone in enumerate(single):
        least = bound[i] + alone
        if i:
            least = min(least, bound[i - 1] + pair[i - 1])
        bound.append(least)
    return bound


def best_of_block(lists: Lists, terms: list[int], pair_ids: list[int], needed: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a block, ties to the first place, of those with ``needed`` at least."""
    here = [(t, i) for i, t in enumerate(terms) if t in lists.at]
    none = np.zeros(0, np.int64)
    if not here:
        return none, none
    single = [lists.most[lists.at[t]] for t, _ in here]
    pair, members = [], []
    for n in range(len(here) - 1):
        (_, i), (_, j) = here[n], here[n + 1]
        at = lists.pair_at.get(pair_ids[i]) if j == i + 1 else None
        one = max(single[n], single[n + 1])
        pair.append(single[n] + single[n + 1] if at is None else max(one, lists.joint[at]))
        members.append(at)
    bound = combined(single, pair)
    if bound[-1] < needed:
        return none, none
    needed = max(needed, 1)
    score = np.zeros(len(lists.ids), dtype=np.int64)
    at, seen = len(here), 0
    while at and bound[at] >= needed:  # heavy terms bring candidates, and raise what is needed
        places, adds = lists.open(here[at - 1][0])
        score[places] += adds
        at, seen = at - 1, seen + len(places)
        if seen >= 4 * k and np.count_nonzero(score) >= k:
            needed = max(needed, int(np.partition(score, len(score) - k)[len(score) - k]))
            seen = 0
    stay = np.flatnonzero(score)
    while at:
        stay = stay[score[stay] + bound[at] >= needed]
        if not len(stay):
            return none, none
        held = members[at - 2] if at > 1 else None
        if held is not None:  # what the last two terms can add to a document that holds only one of them
            room = np.full(len(stay), max(single[at - 1], single[at - 2]), dtype=np.int64)
            both = np.isin(stay, lists.shared[held], assume_unique=True)
            room[both] = pair[at - 2]
            stay = stay[score[stay] + bound[at - 2] + room >= needed]
        places, adds = lists.open(here[at - 1][0])
        dense = np.zeros(len(lists.ids), dtype=np.int64)
        dense[places] = adds
        score[stay] += dense[stay]
        at -= 1
        if len(stay) > k:
            needed = max(needed, int(np.partition(score[stay], len(stay) - k)[len(stay) - k]))
    stay = stay[score[stay] >= needed]
    if len(stay) > k:
        least = np.partition(score[stay], len(stay) - k)[len(stay) - k]
        stay = stay[score[stay] >= least]
    order = np.lexsort((lists.ids[stay], -score[stay]))[:k]
    return stay[order], score[stay[order]]


_LAST = (1 << 63) - 1


def _searched(lists: DataFrame, queries, needed, k: int) -> DataFrame:
    """item_id, doc_id, score: for each block and item its best; ``needed`` are known scores of items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = queries.value, needed.value
        pairs = {item: [asked.pair_ids[p] for p in zip(own, own[1:])] for item, own in asked.items.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                names = batch.column("doc_ids")[row].as_py()
                ids = np.array([_LAST if i is None else i for i in names], dtype=np.int64)  # no id comes last
                opened = Lists({c: batch.column(c)[row].as_py() for c in _LISTS[1:]}, ids)
                items, docs, scores = [], [], []
                for item, own in asked.items.items():
                    at, score = best_of_block(opened, own, pairs[item], known.get(item, 0), k)
                    items += [item] * len(at)
                    docs += [names[i] for i in at.tolist()]
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())],
                                                 ["item_id", "doc_id", "score"])

    return lists.mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, documents: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents with the highest scores above 0.

    Null and wordless texts have no terms and are neither counted nor found; an item without terms that stand in a
    document has no rows. Equal scores go by ascending doc_id, one without id last; repeated rows are documents each.
    Rows that share an item_id are one item. Texts may have any length. Empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    blocks = scratch.put("blocks", index(documents))
    facts = blocks.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    asked = scratch.put("asked", query_terms(items))
    rows = asked.count()
    rounds = max(1, -(-rows // ROUND_TERMS))
    wanted = asked.select("term").distinct()
    if rows <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    holding = scratch.put("holding", blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(
        F.col("x.terms").alias("term"), F.col("x.dfs").alias("df")).join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")))
    bucket = F.pmod(F.xxhash64("item_id", F.lit("round")), F.lit(rounds))
    found = None
    for turn in range(rounds):
        part = asked.where(bucket == turn).join(holding, "term").toArrow()  # about ROUND_TERMS rows of the stated query set
        terms, dfs = part.column("term").to_pylist(), part.column("df").to_pylist()
        own = list(zip(part.column("item_id").to_pylist(), terms, strict=True))
        sent = spark.sparkContext.broadcast(Queries(own, dict(zip(terms, dfs, strict=True)), facts["n"] or 0, facts["total"] or 0))
        lists = scratch.put(f"lists-{turn}", impact_lists(blocks, sent).withColumn(
            "first", F.pmod(F.xxhash64(F.col("doc_ids")[0]), F.lit(FIRST)) == 0))
        known = spark.sparkContext.broadcast({})
        first = scratch.put(f"first-{turn}", _ranked(_searched(lists.where("first").select(*_LISTS), sent, known, k), k))
        # One row for each item of the round: the k-th best so far.
        scores = {r["item_id"]: r["score"] for r in first.where(F.col("rank") == k).select("item_id", "score").toLocalIterator()}
        known = spark.sparkContext.broadcast(scores)
        rest = _searched(lists.where("not first").select(*_LISTS), sent, known, k)
        one = rest.unionByName(first.select("item_id", "doc_id", "score"))
        found = one if found is None else found.unionByName(one)
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")
