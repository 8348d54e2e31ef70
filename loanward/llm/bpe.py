"""Operator 9: word-level BPE with a contiguous rank array.

A word is a row of symbol ids and the merge ranks of neighbouring symbols. The least rank (the leftmost of
equals) is merged: its boundary is deleted, the row closes up, and the ranks beside the new symbol are looked
up again. The words of a batch are rows of one matrix, so each scan serves all of them. Words too long for
the quadratic scan keep their candidates in a heap, with the same order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import slices

VOCABULARY = "word_bpe_49k.json"
#: Symbols of a word up to which the rank array is scanned; beyond, a heap finds the least rank.
SHORT = 48
#: Words that a worker keeps encoded.
KEPT = 600_000
_NONE = np.iinfo(np.int32).max
#: White space, so no word begins with it.
_MARK = " "


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ids, merges and text patterns of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(ids.items(), self.special.items())}
        end = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int32)
        self.last = np.array([ids[c + end] for c in letters], dtype=np.int32)
        self.width = max(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        # A pair listed twice keeps its first rank.
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int32)
        self.made = made  # by rank
        self.pair_rank = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        split = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        # The tokenizer's \s is Unicode's White_Space, without the separators U+001C to U+001F.
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; the largest int where the pair doesn't merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most SHORT bytes, all merged at once on one matrix of symbols and ranks."""
        size = np.array([len(w) for w in words])
        wide = int(size.max())
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(len(words)), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.full((len(words), wide), -1, dtype=np.int32)
        symbols[row, col] = np.where(col == size[row] - 1, self.last[flat], self.inner[flat])
        ranks = np.full((len(words), wide), _NONE, dtype=np.int32)
        ranks[:, :-1] = self.rank_of(symbols[:, :-1], symbols[:, 1:])
        done: list[list[int]] = [[]] * len(words)
        live = np.arange(len(words))
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            ended = least == _NONE
            if ended.any():
                kept = symbols[ended]
                for place, length, ids in zip(live[ended].tolist(), (kept >= 0).sum(axis=1).tolist(), kept.tolist(),
                                              strict=True):
                    done[place] = ids[:length]
                go = ~ended
                live, symbols, ranks, at, least = live[go], symbols[go], ranks[go], at[go], least[go]
            if not len(live):
                return done
            # Every row merges one pair, so deleting the boundary behind it narrows the whole matrix by one.
            rows = np.arange(len(live))
            symbols[rows, at] = self.made[least]
            stay = np.arange(symbols.shape[1])[None, :] != (at + 1)[:, None]
            symbols = symbols[stay].reshape(len(live), -1)
            ranks[rows, np.minimum(at + 1, ranks.shape[1] - 1)] = _NONE
            ranks = ranks[stay].reshape(len(live), -1)
            behind = np.minimum(at + 1, symbols.shape[1] - 1)
            ranks[rows, at] = np.where(behind > at, self.rank_of(symbols[rows, at], symbols[rows, behind]), _NONE)
            b = rows[at > 0]
            a = at[b]
            ranks[b, a - 1] = self.rank_of(symbols[b, a - 1], symbols[b, a])

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: the same merges in the same order, found by a heap of ranks."""
        symbols = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        get, width = self.pair_rank.get, self.width
        heap = [(r, i) for i in range(len(symbols) - 1)
                if (r := get(symbols[i] * width + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or get(symbols[i] * width + symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := get(symbols[a] * width + symbols[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [s for s in symbols if s >= 0]

    def words_of(self, text: str) -> list[str]:
        """Lower-case words of a text; a special token stands as it is, with a mark no word can hold."""
        if "<|" in text:
            words, place = [], 0
            for m in self.specials.finditer(text):
                words += self._plain(text[place:m.start()])
                words.append(_MARK + m[0])
                place = m.end()
            return words + self._plain(text[place:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # Lower case without the final-sigma rule, as the tokenizer has it.
            text = text.replace("Σ", "σ")
        return self.words.findall(text.lower())

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, in order."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        done: list[list[int]] = [[]] * len(raw)
        short = []
        for i, w in enumerate(raw):
            if words[i][0] == _MARK:
                done[i] = [self.special[words[i][1:]]]
            elif len(w) > SHORT:
                done[i] = self.merge_long(w)
            else:
                short.append(i)
        short.sort(key=lambda i: len(raw[i]))
        for start in range(0, len(short), 4096):  # words of like length share a matrix
            part = short[start:start + 4096]
            for i, ids in zip(part, self.merge_short([raw[i] for i in part]), strict=True):
                done[i] = ids
        return done


class Encoder:
    """Encodes whole texts to little-endian 32-bit ids. Words seen lately are looked up."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.vocabulary, self.kept = Vocabulary(path), kept
        self.known: dict[str, bytes] = {}
        spaced = [f"{self.vocabulary.tokens.get(i, '')} " for i in range(self.vocabulary.width)]
        self.names = pa.array(spaced, pa.large_string())
        self.digits = pa.array([f"{i} " for i in range(self.vocabulary.width)], pa.large_string())

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        parts = list(map(self.vocabulary.words_of, texts))
        if len(self.known) > self.kept:
            self.known.clear()
        fresh: set[str] = set()
        for words in parts:
            fresh.update(words)
        words = list(fresh.difference(self.known))
        self.known.update(zip(words, map(packed, self.vocabulary.encode_words(words)), strict=True))
        get = self.known.__getitem__
        for words in parts:
            yield b"".join(map(get, words))

    def decimals(self, ids: np.ndarray) -> memoryview:
        """Decimal ids joined by one space."""
        return _joined(self.digits, ids)

    def decode(self, ids: np.ndarray) -> memoryview:
        """The tokens in UTF-8. The vocabulary has no decoder, so they are joined by one space."""
        return _joined(self.names, ids)


def _joined(words: pa.LargeStringArray, ids: np.ndarray) -> memoryview:
    """Words that end in a space, picked by ``ids`` and put together, without the last space."""
    picked = words.take(pa.array(ids))
    size = pa.compute.sum(pa.compute.binary_length(picked)).as_py() or 1
    return memoryview(picked.buffers()[2] or b"")[:size - 1]


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for that vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(documents: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, the ids themselves.

    Null and empty texts have no tokens. Repeated rows are encoded once each. Other columns are ignored.
    Nothing is shuffled; a worker holds a few megabytes of text and about KEPT encoded words at a time.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, "text"):
            counts, digests, decoded, lists = [], [], [], []
            for raw in own.encode(t or "" for t in batch.column("text").to_pylist()):
                found = np.frombuffer(raw, dtype="<u4")
                counts.append(len(found))
                digests.append(hashlib.sha256(own.decimals(found)).hexdigest())
                decoded.append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    lists.append(found)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def detokenize(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids: the tokens of the ids joined by one space; ids outside the vocabulary go."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path).vocabulary.tokens
        for batch in batches:
            texts = [" ".join(names[i] for i in row or () if i in names) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
