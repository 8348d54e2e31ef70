"""Operator 7: language by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary. Each language gives every piece a probability. A word's probability is
the sum over all ways to cut it into pieces, which a forward pass adds up; a text's is the product over its
words. Probabilities come from expectation-maximisation on the word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import Scratch, slices

VOCABULARY = "piece_bpe_32k.model"
#: Documents per language that the model is fitted on, about: rows whose hash is under the share this gives.
SAMPLE = 3000
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Probability of a letter outside the vocabulary, the same in each language.
UNKNOWN = 1e-8
#: Added to each expected count, so that no piece is impossible.
SMOOTH = 0.05
#: Posterior under which a filtering stage doesn't believe the prediction.
SURE = 0.5
#: Bytes of chunks, and of words, that a worker keeps scored, each counted with ENTRY for its place in the tables.
KEPT, ENTRY = 32 << 20, 200
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = regex.compile(r"\p{L}+")
_MARK = "▁"


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters, with or without the word mark, of any length."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if regex.fullmatch(rf"{_MARK}?\p{{L}}*", p)} - {""})


def held_out() -> Column:
    """Whether the row's id has remainder 0, so that nothing is learned from it; a missing id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Pieces:
    """Finds the pieces at each place of many words at once and sums over segmentations."""

    def __init__(self, pieces: list[str]) -> None:
        self.count = len(pieces)
        self.longest = max(map(len, pieces), default=1)  # in code points, with the word mark
        self.none, self.unknown = self.count, self.count + 1  # rows behind the table
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == length]
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], dtype=np.uint64).reshape(len(own), length)
            key = np.zeros(len(own), dtype=np.uint64)
            for k in range(length):
                key = key * _BASE + codes[:, k] + np.uint64(1)
            order = key.argsort()
            self.keys[length] = key[order], np.array(own, dtype=np.int64)[order]

    def groups(self, words: list[str], cells: int = 60_000) -> Iterator[tuple[np.ndarray, int]]:
        """Places and the common length (with the mark) of words of one length, a bounded number at a time."""
        size = np.array([len(w) for w in words])
        order = size.argsort(kind="stable")
        ends = np.flatnonzero(np.diff(size[order], append=-1)) + 1
        start = 0
        for end in ends.tolist():
            length = int(size[order[start]]) + 1
            most = max(1, cells // length)
            for at in range(start, end, most):
                yield order[at:min(end, at + most)], length
            start = end

    def found(self, words: list[str], length: int) -> np.ndarray:
        """Piece ids by piece length - 1, start and word, for words of ``length`` - 1 letters."""
        text = "".join(_MARK + w for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), length)
        codes = codes.T.astype(np.uint64) + np.uint64(1)
        most = min(self.longest, length)
        ids = np.full((most, length, len(words)), self.none, dtype=np.int64)
        key = np.zeros((length, len(words)), dtype=np.uint64)
        for k in range(most):
            key = key[:length - k] * _BASE + codes[k:]
            known, own = self.keys[k + 1]
            if not len(known):
                continue
            at = np.searchsorted(known, key)
            at[at == len(known)] = 0
            ids[k, :length - k] = np.where(known[at] == key, own[at], self.none)
        lone = ids[0]
        lone[lone == self.none] = self.unknown
        return ids

    def forward(self, ids: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum over segmentations of each prefix (place, word, language), and the log of its scale."""
        most, length, words = ids.shape
        alpha = np.zeros((length + 1, words, chance.shape[1]))
        scale = np.zeros((length + 1, words, 1))
        alpha[0] = 1
        for end in range(1, length + 1):
            for k in range(min(most, end)):
                alpha[end] += alpha[end - 1 - k] * chance[ids[k, end - 1 - k]]
            scale[end] = scale[end - 1]
            if end % 16 == 0:  # keep long words within the range of a double
                top = np.maximum(alpha[end].max(axis=1, keepdims=True), 1e-300)
                alpha[max(0, end - self.longest):end + 1] /= top
                scale[end] += np.log(top)
        return alpha, scale

    def score(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), chance.shape[1]))
        if not chance.shape[1]:
            return out
        for places, length in self.groups(words):
            alpha, scale = self.forward(self.found([words[i] for i in places], length), chance)
            out[places] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations, for one language; long words are left out."""
        total = np.zeros(self.count + 2)
        short = [i for i, w in enumerate(words) if len(w) < 40]
        words, counts = [words[i] for i in short], counts[short]
        for places, length in self.groups(words) if words else ():
            ids = self.found([words[i] for i in places], length)
            most = ids.shape[0]
            p = chance[ids]
            ahead = np.zeros((length + 1, len(places)))
            back = np.zeros((length + 1, len(places)))
            ahead[0] = back[length] = 1
            for end in range(1, length + 1):
                for k in range(min(most, end)):
                    ahead[end] += ahead[end - 1 - k] * p[k, end - 1 - k]
            for start in range(length - 1, -1, -1):
                for k in range(min(most, length - start)):
                    back[start] += back[start + 1 + k] * p[k, start]
            weight = counts[places] / np.maximum(ahead[length], 1e-300)
            for k in range(most):
                many = ahead[:length - k] * p[k, :length - k] * back[k + 1:] * weight
                total += np.bincount(ids[k, :length - k].ravel(), many.ravel(), minlength=len(total))
        return total[:self.count]


def fit(documents: DataFrame, scratch: Scratch, pieces: list[str], sample: int = SAMPLE,
        rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their piece probabilities (piece, language) and shares, from the rows not held out.

    About ``sample`` rows per language are used, chosen by a hash of the id; shares are counted on all rows.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return [], np.zeros((len(pieces) + 2, 0)), np.zeros(0)
    part = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    limit = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, sample / n))) for k, n in shares.items()))
    chosen = known.where(part < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            tally: dict[str, Counter[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tally.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
            rows = [(lang, w, n) for lang, own in tally.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    counts = scratch.put("words", chosen.mapInArrow(count, "lang string, word string, n long")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    chance = np.zeros((len(pieces) + 2, len(langs)))
    chance[:-2] = (np.array([float(len(p)) ** 2 for p in pieces]) / sum(len(p) ** 2 for p in pieces))[:, None]
    chance[-1] = UNKNOWN
    place = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        sent = documents.sparkSession.sparkContext.broadcast((pieces, place, chance))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, place, chance = sent.value
            table = Pieces(pieces)
            for batch in batches:
                lang, words = np.array(batch.column("lang").to_pylist()), batch.column("word").to_pylist()
                n = batch.column("n").to_numpy().astype(float)
                for own in sorted(set(lang.tolist())):
                    rows = np.flatnonzero(lang == own)
                    many = table.expected([words[i] for i in rows], n[rows], chance[:, place[own]])
                    used = np.flatnonzero(many)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([place[own]] * len(used), pa.int32()), pa.array(used, pa.int32()),
                         pa.array(many[used])], ["lang", "piece", "many"])

        # At most one row for each piece and language comes back.
        fresh = np.full((len(pieces), len(langs)), SMOOTH)
        for row in (counts.mapInArrow(expect, "lang int, piece int, many double")
                    .groupBy("lang", "piece").agg(F.sum("many").alias("many")).toLocalIterator()):
            fresh[row["piece"], row["lang"]] += row["many"]
        chance[:-2] = fresh / fresh.sum(axis=0) * (1 - UNKNOWN)
        sent.unpersist()
    scratch.drop("words")
    share = np.array([shares[k] for k in langs], dtype=float)
    return langs, chance, share / share.sum()


class Kept:
    """Rows of numbers by text, for texts seen lately; emptied when they would take more than KEPT bytes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.width))
        self.bytes = 0

    def missing(self, texts: set[str]) -> list[str]:
        """Those without a row; if they don't fit beside the others, all of them."""
        fresh = [t for t in texts if t not in self.at]
        if self.bytes + self._cost(fresh) > KEPT and self.at:
            self.clear()
            fresh = list(texts)
        return fresh

    def add(self, texts: list[str], rows: np.ndarray) -> None:
        start, end = len(self.at), len(self.at) + len(texts)
        if end > len(self.rows):
            grown = np.empty((max(end, 2 * len(self.rows)), self.width))
            grown[:start] = self.rows[:start]
            self.rows = grown
        self.rows[start:end] = rows
        self.at.update(zip(texts, range(start, end), strict=True))
        self.bytes += self._cost(texts)

    def of(self, texts: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, texts), np.int64, len(texts))]

    def trim(self) -> None:
        """A single batch may have been larger than what is kept."""
        if self.bytes > KEPT:
            self.clear()

    @staticmethod
    def _cost(texts: list[str]) -> int:
        return 4 * sum(map(len, texts)) + ENTRY * len(texts)


class Scorer:
    """Scores whole texts with a fitted model; chunks seen lately are looked up."""

    def __init__(self, pieces: list[str], langs: list[str], chance: np.ndarray, share: np.ndarray) -> None:
        self.table, self.langs, self.chance = Pieces(pieces), langs, chance
        self.prior = np.log(share)
        self.chunks = Kept(len(langs) + 1)  # log probabilities, and whether there are letters
        self.words = Kept(len(langs))

    def clear(self) -> None:
        self.chunks.clear()
        self.words.clear()

    def _learn(self, chunks: list[str]) -> None:
        split = [[low] if (low := c.lower()).isalpha() else _LETTERS.findall(low) for c in chunks]
        words = self.words.missing(set(chain.from_iterable(split)))
        if words:
            self.words.add(words, self.table.score(words, self.chance))
        rows = np.zeros((len(chunks), len(self.langs) + 1))
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        if sizes.sum():
            owner = np.repeat(np.arange(len(chunks)), sizes)
            flat = self.words.of([w for own in split for w in own])
            for j in range(len(self.langs)):
                rows[:, j] = np.bincount(owner, flat[:, j], minlength=len(chunks))
            rows[:, -1] = sizes > 0
        self.chunks.add(chunks, rows)
        self.words.trim()

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        parts = [(t or "").split() for t in texts]
        new = self.chunks.missing(set(chain.from_iterable(parts)))
        if new:
            self._learn(new)
        for chunks in parts:
            total = self.chunks.of(chunks).sum(axis=0)
            if not len(self.langs) or not total[-1]:
                yield "und", 0.0
                continue
            logs = total[:-1] + self.prior
            odds = np.exp(logs - logs.max())
            yield self.langs[int(odds.argmax())], float(odds.max() / odds.sum())
        self.chunks.trim()


_SCORERS: dict[str, Scorer] = {}


def identify(documents: DataFrame, path: str | None = None, sample: int = SAMPLE, carry: Sequence[str] | None = None,
             within: str | None = None) -> DataFrame:
    """The ``carry`` columns (all unless given) of the rows with held_out, lang_pred and score; columns of these names are replaced.

    A text that is null, empty or without letters is ``und`` with score 0, as is every text when no row has a
    language to learn from. Equal texts get equal predictions. Score is the posterior of the predicted language.
    Texts and words may have any length; what a worker remembers of them is bounded in bytes. With ``within``, a
    carried struct column that holds the text too, no column of its own takes the text to the workers.
    """
    spark = documents.sparkSession
    pieces = vocabulary(path)
    langs, chance, share = fit(documents, Scratch(spark, "language"), pieces, sample)
    # Size: pieces of the fixed vocabulary times languages.
    sent = spark.sparkContext.broadcast((pieces, langs, chance, share))
    kept = [c for c in (documents.columns if carry is None else carry) if c.lower() not in ("held_out", "lang_pred", "score")]
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], held_out().alias("held_out"), F.col("text").alias("__text"))
    rows = rows.drop("__text") if within else rows
    schema = rows.drop("__text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(*sent.value)
        names = [*kept, "held_out"]
        for batch in batches:
            texts = batch.column(within).field("text") if within else batch.column("__text")
            table = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], [*names, "__text"])
            for part in slices([table], "__text", 2 << 20):
                found = list(scorer.predict(part.column("__text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])
        scorer.clear()

    return rows.mapInArrow(run, schema)
