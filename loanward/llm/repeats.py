"""Operator 1: long repeats by the common-prefix interval tree of an enhanced suffix array.

A corpus-wide suffix array is cut into parts that need not meet. Every string of ``size`` bytes has one anchor, the
least hashed SEED-byte gram in it, so equal strings meet at equal grams. The suffixes that start at anchors are
counted by gram and context; those whose gram stands in different contexts are sorted by gram and following bytes,
which is the suffix array of these suffixes. Longest common prefixes of neighbours are scanned with a stack, which
visits the intervals of the common-prefix tree from the leaves. When intervals join, the members' left contexts are
compared in sorted order: where they agree far enough, prefix and left extension together are a repeat, and every
member that has such a partner is an occurrence. Equal contexts are counted once and never gathered. A gram with too
many different contexts for one task is split by window hashes instead (``_crowded``).

Repeated passages of words are found in the same way, with words in place of bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import Scratch, slices
from loanward.llm.jaccard import Shingler

#: Bytes of a string that counts as repeated.
SIZE = 400
#: Bytes of the gram that anchors it.
SEED = 64
#: Different contexts of a gram up to which one task sorts them: 736 bytes each, so 30 MB.
CROWD = 40_000
#: A corpus also loses passages of more words than this that stand more than once, however few bytes they have.
WORDS = 50
#: Words of the gram that anchors a passage.
WORD_SEED = 8
#: Bytes of a word up to which contexts hold the word itself; of a longer one they hold a digest.
WORD_BYTES = 32
#: Bytes of the numbers that stand for words while contexts are scanned.
NUMBER = 4
#: Offsets of a window's anchor that are hashed together first, for crowded grams.
RANGE = 21
#: Texts up to this many are broadcast to their documents; beyond, documents are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Bytes hashed at once.
BLOCK = 1 << 21
_U = np.uint64
_B = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Hashes of byte ranges by prefix sums, and of all SEED-byte grams by doubling."""

    def __init__(self, most: int) -> None:
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))
        up, down = np.full(most + 1, _B, dtype=np.uint64), np.full(most + 1, pow(_B, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.up[:len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _U(0x632BE59BD9B4E019))

    def grams(self, data: np.ndarray) -> np.ndarray:
        """The hash of the SEED bytes (a power of two) from each place on."""
        h, size = self.letters[data], 1
        while size < SEED:
            h = h[:-size] * _U(pow(_B, size, 1 << 64)) + h[size:]
            size *= 2
        return _mix(h)


_HASHERS: list[Hasher] = []


def hasher(most: int) -> Hasher:
    """One for ranges up to ``most``, with 16 bytes for each place of the longest one asked for."""
    if not _HASHERS or len(_HASHERS[0].up) <= most:
        _HASHERS[:] = [Hasher(1 << max(16, most.bit_length()))]
    return _HASHERS[0]


def least_places(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the place of the least, the first of equals."""
    m, size = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < window:
        m = np.minimum(m[:len(m) - (window - size)], m[window - size:])
    return (m & _U(0xFFFFFF)).astype(np.int64)


def anchors(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: places of its anchors, hashes of their grams and of their contexts.

    The context of an anchor is what a repeat through it can reach: ``size`` - SEED bytes before it and ``size`` from
    it on, as far as the text goes.
    """
    near = size - SEED
    for text in texts:
        found, own = [], hasher(min(len(text), BLOCK + 4 * size))
        for at in range(0, max(0, len(text) - size + 1), BLOCK):
            # Strings that start at at..at+BLOCK-1, with what their anchors' contexts need around them.
            low, high = max(0, at - near), min(len(text), at + BLOCK + near + size)
            data = np.frombuffer(text, np.uint8, high - low, low)
            first, last = at - low, min(at + BLOCK, len(text) - size + 1) - low
            grams = own.grams(data[first:last - 1 + size])
            places = least_places(grams, near + 1)
            places = places[np.concatenate([[True], places[1:] != places[:-1]])]
            sums, place = own.sums(data), places + first
            context = own.ranges(sums, np.maximum(place - near, 0), np.minimum(place + size, len(data)))
            found.append((place + low, grams[places], context))
        if not found:
            yield np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        elif len(found) == 1:
            yield found[0]
        else:  # a string's anchor may lie in the next block
            place, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
            _, once = np.unique(place, return_index=True)
            yield place[once], gram[once], context[once]


_SHINGLER: list[Shingler] = []


def shingler() -> Shingler:
    """That of words as they are written."""
    if not _SHINGLER:
        _SHINGLER.append(Shingler(fold=False))
    return _SHINGLER[0]


def word_anchors(data: bytes, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of words, places of the anchors of passages of ``size`` words, hashes of grams and contexts.

    The anchor is the least hashed WORD_SEED-word gram, so equal passages have equal anchors. Words are what stands
    between ASCII spaces; which spaces, and how many, makes no difference.
    """
    words, near = shingler().words(data), size - WORD_SEED
    many = len(words) - size + 1
    if many <= 0:
        return len(words), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = np.zeros(len(words) - WORD_SEED + 1, dtype=np.uint64)
    for k in range(WORD_SEED):
        grams += words[k:k + len(grams)] * _U(pow(_B, k, 1 << 64))
    grams = _mix(grams)
    places = np.concatenate([at + least_places(grams[at:min(at + BLOCK, many) + near], near + 1)
                             for at in range(0, many, BLOCK)])
    places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    own = hasher(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * own.up[:len(words)], out=sums[1:])
    context = own.ranges(sums, np.maximum(places - near, 0), np.minimum(places + size, len(words)))
    return len(words), places, grams[places], context


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def interval_spans(right: list[bytes], left: list[bytes], size: int, unit: int = 1) -> list[tuple[int, int] | None]:
    """Bytes around each suffix's start that lie in repeats through it: (from, to), relative to it.

    All repeats through a suffix's gram overlap there, so they cover one stretch. Where ``unit`` bytes stand for a
    word, prefixes and extensions are cut to whole words.

    ``right`` are the suffixes in sorted order, ``left`` what stands before them, backwards. A stack holds, for each
    open interval of the common-prefix tree, its prefix length and its members by rank of their left contexts. When
    two intervals join at a prefix, each member of the smaller is held against its neighbours in the larger: of all
    members these extend furthest to the left with it. An interval whose members' left contexts differ at once
    (left-diverse) yields the prefix alone, others the prefix with its left extension.
    """
    many = len(right)
    by_left = sorted(range(many), key=left.__getitem__)
    rank = [0] * many
    for r, i in enumerate(by_left):
        rank[i] = r
    longest = [0] * many  # prefix of the first repeat found; later ones only get shorter
    reach = [-1] * many  # furthest left extension

    def join(a: list[int], b: list[int], prefix: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            at = bisect_left(a, r)
            if prefix + len(left[by_left[r]]) >= size:
                for other in a[max(0, at - 1):at + 1]:
                    i, j = by_left[r], by_left[other]
                    extension = common(left[i], left[j]) // unit * unit
                    if prefix + extension >= size:
                        for x in (i, j):
                            longest[x] = max(longest[x], prefix)
                            reach[x] = max(reach[x], extension)
            a.insert(at, r)
        return a

    stack: list[tuple[int, list[int]]] = []
    for i in range(many):
        prefix = common(right[i], right[i + 1]) // unit * unit if i + 1 < many else -1
        members = [rank[i]]
        while stack and stack[-1][0] >= prefix:
            length, before = stack.pop()
            members = join(before, members, length)
        stack.append((prefix, members))
    return [(-reach[i], longest[i]) if reach[i] >= 0 else None for i in range(many)]


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text")))


_CLASS = "gram long, context long, a int, b int"


def _classes(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                                      ["gram", "context", "a", "b"])


def _numbered(texts: list[bytes], numbers: dict[bytes, int]) -> list[bytes]:
    """The texts with NUMBER bytes for each word, which keeps texts with equal first words together."""
    return [b"".join([numbers.setdefault(w, len(numbers)).to_bytes(NUMBER, "big") for w in t.split()]) for t in texts]


def _scan(size: int, words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of contexts that come sorted by gram and following bytes; a gram's contexts are held together."""
    unit = NUMBER if words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group = None, []

        def close() -> Iterator[tuple[int, int, int, int]]:
            if len(group) > 1:
                right, left = [g[1] for g in group], [g[2] for g in group]
                if words:
                    numbers: dict[bytes, int] = {}
                    right, left = _numbered(right, numbers), _numbered(left, numbers)
                for (context, _, _), own in zip(group, interval_spans(right, left, size * unit, unit), strict=True):
                    if own:
                        yield gram, context, own[0] // unit, own[1] // unit

        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for g, context, right, left in zip(*(batch.column(c).to_pylist() for c in (
                    "gram", "context", "right", "left")), strict=True):
                if g != gram:
                    out += close()
                    gram, group = g, []
                if not group or group[-1][0] != context:  # a repeated row's context comes as often
                    group.append((context, right, left))
            yield _classes(out)
        yield _classes(list(close()))
    return run


def _crowded(contexts: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Spans (gram, context, a, b) of contexts whose gram has too many of them for one task.

    Windows are told apart by hash and counted, in two steps: first the bytes that all windows of a range of offsets
    share, then, where contexts that share those differ in the rest, each window. Counting combines on the map side.
    """
    near = size - SEED

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(4 * size)
        for batch in batches:
            out: list[tuple] = []
            for gram, context, right, left in zip(*(batch.column(c).to_pylist() for c in (
                    "gram", "context", "right", "left")), strict=True):
                sums = own.sums(np.frombuffer(left[::-1] + right, np.uint8))
                mid, end = len(left), len(left) + len(right)
                low = np.arange(0, near + 1, RANGE)
                high = np.minimum(low + RANGE - 1, near)
                # Offsets low..high share [mid - low, mid + size - high); all their windows are [mid - high, mid + size - low).
                fits = (mid - low >= 0) & (mid + size - high <= end)
                low, high = low[fits], high[fits]
                core = own.ranges(sums, mid - low, mid + size - high)
                whole = (mid - high >= 0) & (mid + size - low <= end)
                full = np.where(whole, own.ranges(sums, np.maximum(mid - high, 0), np.minimum(mid + size - low, end)), 0)
                out += zip([gram] * len(low), [context] * len(low), low.tolist(), high.tolist(),
                           core.view(np.int64).tolist(), full.view(np.int64).tolist(), whole.tolist(), strict=True)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                ["gram", "context", "low", "high", "core", "full", "whole"])

    ranged = scratch.put("cores", contexts.mapInArrow(
        cores, "gram long, context long, low int, high int, core long, full long, whole boolean"))
    shared = ranged.groupBy("low", "core").agg(
        F.count(F.lit(1)).alias("n"), (F.min("full") == F.max("full")).alias("same"), F.min("whole").alias("all_whole")
    ).where("n > 1")
    marked = ranged.join(shared, ["low", "core"])
    agreed = marked.where("same and all_whole").select(
        "gram", "context", (-F.col("high")).alias("a"), (F.lit(size) - F.col("low")).alias("b"))
    mixed = marked.where("not (same and all_whole)").groupBy("gram", "context").agg(F.collect_list(
        F.struct("low", "high")).alias("ranges"))  # at most near / RANGE + 1 of a context

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(4 * size)
        for batch in batches:
            for gram, context, right, left, ranges in zip(*(batch.column(c).to_pylist() for c in (
                    "gram", "context", "right", "left", "ranges")), strict=True):
                sums, mid = own.sums(np.frombuffer(left[::-1] + right, np.uint8)), len(left)
                offset = np.concatenate([np.arange(r["low"], r["high"] + 1) for r in ranges])
                offset = offset[(offset <= mid) & (size - offset <= len(right))]
                hashes = own.ranges(sums, mid - offset, mid - offset + size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * len(offset), pa.int64()), pa.array([context] * len(offset), pa.int64()),
                     pa.array(offset, pa.int32()), pa.array(hashes.view(np.int64))],
                    ["gram", "context", "offset", "window"])

    each = scratch.put("windows", contexts.join(mixed, ["gram", "context"]).mapInArrow(
        windows, "gram long, context long, offset int, window long"))
    # With the offset, for one place may be seen from two grams.
    twice = each.groupBy("offset", "window").count().where("count > 1").select("offset", "window")
    single = each.join(twice, ["offset", "window"]).select(
        "gram", "context", (-F.col("offset")).alias("a"), (F.lit(size) - F.col("offset")).alias("b"))
    # All windows of a context hold its gram, so together they are one stretch.
    return agreed.unionByName(single).groupBy("gram", "context").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def _crowded_words(contexts: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """``_crowded`` for contexts of words: digests (128 bits) of all their passages of ``size`` words are counted."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, context, right, left in zip(*(batch.column(c).to_pylist() for c in (
                    "gram", "context", "right", "left")), strict=True):
                before = left.split()[::-1]
                words, mid = before + right.split(), len(before)
                offset = [o for o in range(size - WORD_SEED + 1) if o <= mid and mid - o + size <= len(words)]
                digests = [hashlib.blake2b(b" ".join(words[mid - o:mid - o + size]), digest_size=16).digest() for o in offset]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * len(offset), pa.int64()), pa.array([context] * len(offset), pa.int64()),
                     pa.array(offset, pa.int32()), pa.array(digests, pa.binary())], ["gram", "context", "offset", "window"])

    each = scratch.put("windows", contexts.mapInArrow(windows, "gram long, context long, offset int, window binary"))
    twice = each.groupBy("gram", "offset", "window").count().where("count > 1").drop("count")
    return each.join(twice, ["gram", "offset", "window"]).groupBy("gram", "context").agg(
        (-F.max("offset")).alias("a"), (F.lit(size) - F.min("offset")).alias("b"))


def _context(data: bytes, places: list[int], size: int, words: bool) -> list[tuple[bytes, bytes]]:
    """What follows each place, and what stands before it, backwards. A space follows each word."""
    if not words:
        return [(data[at:at + size], data[max(0, at - size + SEED):at][::-1]) for at in places]
    parts = [w if len(w) <= WORD_BYTES else b"\1" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in data.split()]
    return [(b" ".join([*parts[at:at + size], b""]), b" ".join([*parts[max(0, at - size + WORD_SEED):at][::-1], b""]))
            for at in places]


def occurrences(documents: DataFrame, size: int = SIZE, scratch: Scratch | None = None,
                words: bool = False) -> tuple[DataFrame, DataFrame]:
    """What stands more than once in the corpus: (text_key, copies) of whole texts, and repeats in different texts.

    The second frame has text_key, gram, a, b: bytes a..b of the text are an occurrence of a repeat through that
    gram. Occurrences of a repeat in all texts are rows with the same gram; those in copies of a text are given once.
    With ``words``, ``size`` is a number of words, and words a..b are given. ``scratch`` holds what both read (TABLES).
    """
    scratch, near = scratch or Scratch(documents.sparkSession, "repeats"), size - (WORD_SEED if words else SEED)
    least = 2 * size - 1 if words else size  # bytes of that many words
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            if words:
                found = [word_anchors(t, size) for t in texts]
            else:
                found = [(len(t), *own) for t, own in zip(texts, anchors(texts, size), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.list_(pa.int64())),
                 pa.array([f[2].view(np.int64) for f in found], pa.list_(pa.int64())),
                 pa.array([f[3].view(np.int64) for f in found], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "extent", "place", "gram", "context"])

    anchored = scratch.put("anchored", rows.where(F.octet_length("text") >= least).withColumn("text_key", _text_key()).select(
        "doc_id", "text_key", "text").mapInArrow(
        find, "doc_id long, text_key binary, extent long, place array<long>, gram array<long>, context array<long>")
        .where(F.col("extent") >= size).withColumn("row", F.monotonically_increasing_id()))
    # One row stands for all copies of a text.
    texts = scratch.put("texts", anchored.groupBy("text_key").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")))
    found = anchored.join(texts.select("row"), "row").select(
        "row", "doc_id", "text_key", "extent", F.explode(F.arrays_zip("place", "gram", "context")).alias("x")).select(
        "row", "doc_id", "text_key", "extent", "x.*")
    found = scratch.put("found", found)
    classes = scratch.put("classes", found.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("one")))
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    # A context is cut from one text that has it.
    wanted = classes.join(grams, "gram").select("gram", "context", "contexts", "one.row", "one.place")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "contexts", "place")).alias("wanted"))
    wanted = scratch.put("wanted", wanted.join(anchored.select("row", "doc_id", "text_key"), "row").select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "wanted"))
    scratch.drop("anchored")
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                around = _context(text.encode(), [w["place"] for w in own], size, words)
                out += [(w["gram"], w["context"], w["contexts"], *x) for w, x in zip(own, around, strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["gram", "context", "contexts", "right", "left"])

    contexts = rows.join(some, (F.col("doc_id").eqNullSafe(F.col("id"))) & (_text_key() == F.col("key"))).select(
        "text", "wanted").mapInArrow(cut, "gram long, context long, contexts long, right binary, left binary")
    contexts = scratch.put("contexts", contexts)
    scratch.drop("wanted")
    sorted_suffixes = contexts.where(F.col("contexts") <= CROWD).repartition("gram").sortWithinPartitions(
        "gram", "right", "left")
    spans = sorted_suffixes.mapInArrow(_scan(size, words), _CLASS)
    crowd = contexts.where(F.col("contexts") > CROWD)
    if not crowd.isEmpty():
        crowd = scratch.put("crowd", crowd.dropDuplicates(["gram", "context"]))
        spans = spans.unionByName((_crowded_words if words else _crowded)(crowd, size, scratch))
    spans = scratch.put("spans", spans)
    for name in ("contexts", "crowd", "cores", "windows"):
        scratch.drop(name)
    # A context that stands twice is a repeat as a whole.
    whole = classes.where("n > 1").select(
        "gram", "context", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    before, behind = F.least(F.col("place"), F.lit(near)), F.least(F.col("extent") - F.col("place"), F.lit(size))
    hit = found.join(spans.unionByName(whole), ["gram", "context"]).where(
        F.col("a").isNotNull() | (before + behind >= size)).select(
        "text_key", "gram", (F.col("place") + F.coalesce("a", -before)).alias("a"),
        (F.col("place") + F.coalesce("b", behind)).alias("b"))
    return texts.where("copies > 1").select("text_key", "copies"), hit


#: What the results of ``occurrences`` read.
TABLES = "texts", "found", "classes", "spans"


def passages(documents: DataFrame) -> DataFrame:
    """text_key, a, b: bytes a..b of the text are words that stand in repeated passages of over WORDS words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text, key, own in zip(*(batch.column(c).to_pylist() for c in ("text", "text_key", "passages")), strict=True):
                spans = word_spans(text.encode(), own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(spans), pa.binary()), pa.array([x["a"] for x in spans], pa.int64()),
                     pa.array([x["b"] for x in spans], pa.int64())], ["text_key", "a", "b"])

    return marked(documents, None, words=True).select("text", _text_key().alias("text_key"), "passages").mapInArrow(
        run, "text_key binary, a long, b long").distinct()


def word_spans(data: bytes, passages: list[dict] | None) -> list[dict]:
    """The bytes of passages that are given by words."""
    if not passages:
        return []
    gap = np.concatenate([[True], shingler().space[np.frombuffer(data, np.uint8)], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]).tolist(), np.flatnonzero(~gap[:-1] & gap[1:]).tolist()
    return [{"a": starts[p["a"]], "b": ends[min(p["b"], len(ends)) - 1]} for p in passages]


def merged(spans: list[dict] | None, n_bytes: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans put together, in order."""
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], min(s[1], n_bytes))
        else:
            out.append([s[0], min(s[1], n_bytes)])
    return [(a, b) for a, b in out]


def remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def marked(documents: DataFrame, size: int | None = SIZE, words: bool = False) -> DataFrame:
    """``row`` (a struct of all columns), ``text`` (null: empty) and what of the text repeats: ``spans``, ``passages``.

    Spans are of bytes that lie in repeated strings of ``size`` bytes (None: not looked for). Passages are of words
    that lie in repeated passages of over WORDS words, however few bytes these have; they are looked for with
    ``words``. A text that stands in several rows is one span, or one passage, if it has that many bytes or words.
    """
    scratch, parts = Scratch(documents.sparkSession, "marks"), []
    for name, worded, least in (("repeats", False, size), ("passages", True, WORDS + 1 if words else None)):
        if least is not None:
            own = Scratch(documents.sparkSession, name)
            copies, hit = occurrences(documents, least, own, worded)
            found = hit.select("text_key", F.struct("a", "b").alias("s"), F.lit(False).alias("copied")).unionByName(
                copies.select("text_key", F.struct(F.lit(0).cast("long").alias("a"), F.lit(1 << 62).alias("b")).alias("s"),
                              F.lit(True).alias("copied")))
            parts.append(scratch.put(name, found).withColumn("worded", F.lit(worded)))
            for table in TABLES:
                own.drop(table)

    def together(worded: bool) -> Column:
        whole = F.max(F.when((F.col("worded") == worded) & F.col("copied"), F.col("s")))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.collect_set(F.when(F.col("worded") == worded, F.col("s"))))

    marks = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    marks = scratch.put("marks", marks.groupBy(F.col("text_key").alias("key")).agg(
        together(False).alias("spans"), together(True).alias("passages")))
    scratch.drop("repeats")
    scratch.drop("passages")
    some = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(some, _text_key() == F.col("key"), "left").select("row", "text", "spans", "passages")


def removal(documents: DataFrame, size: int = SIZE, words: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of every row.

    Each byte is removed that lies in a string of ``size`` bytes which also starts somewhere else. Null and empty
    texts have 0 bytes. The digest is of the remaining bytes, ``text`` is what they say: a character that lost some of
    its bytes goes as a whole there. Repeated rows repeat each other, so that all of their bytes go if there are ``size``. Other
    columns are ignored. With ``words`` there is also ``clean_text``, which lacks repeated passages of over WORDS
    words too, however few bytes they have; the other columns don't count these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, gone, runs, digests, texts, clean = [], [], [], [], [], []
            for text, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "passages")), strict=True):
                data = text.encode()
                cuts = merged(spans, len(data))
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in cuts))
                runs.append(len(cuts))
                kept = remaining(data, cuts)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode(errors="ignore") if cuts else text)
                clean.append(_without(text, data, spans, passages) if passages and kept else texts[-1])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                       pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                       pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[:len(names)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    schema += ", clean_text string" if words else ""
    names = [column.split()[0] for column in schema.split(", ")]
    return marked(documents.select("doc_id", "text"), size, words).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "text", "spans", "passages").mapInArrow(run, schema)


def _without(text: str, data: bytes, spans: list[dict] | None, passages: list[dict] | None) -> str:
    """The text without its spans and passages; a cut character goes as a whole."""
    cuts = merged([*(spans or ()), *word_spans(data, passages)], len(data))
    return remaining(data, cuts).decode(errors="ignore") if cuts else text


def without_repeats(documents: DataFrame, size: int = SIZE, words: bool = False) -> DataFrame:
    """The rows with the repeated bytes taken out of ``text``, in place; a cut character goes as a whole.

    With ``words`` also without repeated passages of over WORDS words. A null text stays null.
    """
    name = next(c for c in documents.columns if c.lower() == "text")
    names, schema = documents.columns, documents.schema
    place = names.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = []
            for text, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "passages")), strict=True):
                texts.append(_without(text, text.encode(), spans, passages))
            columns = batch.column("row").flatten()
            columns[place] = pa.compute.if_else(columns[place].is_null(), columns[place], pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked(documents, size, words).mapInArrow(run, schema)
