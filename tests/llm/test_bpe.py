"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loanward.llm.bpe import SHORT, VOCABULARY, Encoder, detokenize, tokenize
from tests.llm.conftest import table

ODD = [
    "", " ", "\n\t", "a<|endoftext|>B", "<|startoftext|><|endoftext|>", "<|END|>", "ΟΔΟΣ Σς", "x\x1cy", "İ Ǆ ß ẞ",
    "don't WE'LL 'S i'd", "12३४ x²y ªº", "漢字かな交じり文", "é ́a", "q" * 3000, "the" * 400 + "!" * 90,
    "&&&&### a,b;c", "a b　c\x85d", "\x00\x01", "𝒜 𐐀 😀😀", "naïve café NAÏVE",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return Encoder(public_tokenizers.path(VOCABULARY))


def _ids(own, texts):
    return [np.frombuffer(raw, "<u4").tolist() for raw in own.encode(texts)]


def test_odd_texts_match_the_library(own, library):
    assert _ids(own, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_random_texts_match_the_library(own, library):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ABC .,!éßñ'12\n") for _ in range(r.randrange(200))) for _ in range(300)]
    assert _ids(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_short_and_long_words_merge_alike(own):
    r = random.Random(6)
    words = ["".join(r.choice("thean") for _ in range(r.randrange(1, SHORT + 1))).encode() for _ in range(500)]
    vocabulary = own.vocabulary
    assert vocabulary.merge_short(words) == [vocabulary.merge_long(w) for w in words]


def test_a_small_cache_gives_the_same(library):
    small = Encoder(public_tokenizers.path(VOCABULARY), kept=3)
    for t in ODD:
        assert _ids(small, [t]) == [library.encode(t, add_special_tokens=False).ids]


def test_tokenize_and_decode(spark, docs, library):
    texts = [*ODD, None, "again", "again"]
    frame = docs(list(enumerate(texts))).withColumnRenamed("lang", "n_tokens")
    out = tokenize(frame)
    found = {r.doc_id: r for r in out.collect()}
    back = {r.doc_id: r.text for r in detokenize(out).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert found[i].ids == ids and found[i].n_tokens == len(ids) and back[i] == text
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert tokenize(docs([])).collect() == []


def test_whole_table_matches_the_library(spark, small, library):
    rows = table(spark, small, "documents").select("doc_id", "text").collect()
    found = {r.doc_id: r.ids for r in tokenize(table(spark, small, "documents")).collect()}
    assert all(found[r.doc_id] == library.encode(r.text, add_special_tokens=False).ids for r in rows)
