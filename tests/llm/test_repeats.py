"""Repeats against all windows."""

import hashlib
import random

import pytest

from loanward.llm import common
from loanward.llm import repeats as rp
from tests.llm.conftest import table

SIZE = 100


def plain(rows, size):
    starts = {}
    for n, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for at in range(len(data) - size + 1):
            starts.setdefault(data[at:at + size], []).append((n, at))
    hit = [bytearray(len((t or "").encode())) for _, t in rows]
    for found in starts.values():
        if len(found) > 1:
            for n, at in found:
                hit[n][at:at + size] = b"\1" * size
    out = []
    for (doc, text), mask in zip(rows, hit):
        data = (text or "").encode()
        kept = bytes(b for b, m in zip(data, mask) if not m)
        runs = sum(m and not before for m, before in zip(mask, b"\0" + mask))
        out.append((str(doc), len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame, size=SIZE):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rp.removal(frame, size).collect())


def passages(seed, n=40, letters="abcdé "):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(letters) for _ in range(k))
    shared = [text(r.choice([60, 98, 101, 150, 400])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(80))]
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            cut = r.randrange(len(p) // 2) if r.random() < 0.5 else 0
            parts += [p[cut:], text(r.randrange(60))]
        rows.append((i, "".join(parts)))
    return rows + [(900 + i, rows[i][1]) for i in range(3)]


@pytest.mark.parametrize("seed, letters", [(1, "abcdé "), (2, "ab"), (3, "abcdefgh漢\n")])
def test_passages_match_all_windows(docs, seed, letters):
    rows = passages(seed, letters=letters)
    assert got(docs(rows).repartition(3)) == plain(rows, SIZE)


def test_crowded_grams_match_all_windows(docs, monkeypatch):
    monkeypatch.setattr(rp, "CROWD", 2)
    monkeypatch.setattr(rp, "RANGE", 5)
    monkeypatch.setattr(rp, "BROADCAST_ROWS", 0)
    rows = passages(4, 60)
    assert got(docs(rows)) == plain(rows, SIZE)


def test_long_texts_are_hashed_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK", 256)
    rows = passages(5)
    assert [tuple(a.tolist() for a in x) for x in rp.anchors([b"ab" * 900], SIZE)]
    assert got(docs(rows).coalesce(1)) == plain(rows, SIZE)


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, "x" * 99), (3, "x" * 99), (4, "y" * 100), (5, "z" * 101), (6, "period " * 60),
            (7, "same" * 30), (7, "same" * 30), (None, "null id " * 13), (9, "ab\0" * 40), (10, "ab\0" * 20 + "c" * 200)]
    frame = docs(rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "row")
    assert got(frame) == plain(rows, SIZE)
    assert got(docs([])) == []


def test_intervals_against_all_pairs():
    r = random.Random(6)
    for _ in range(60):
        size = 8
        rows = sorted({("".join(r.choice("ab") for _ in range(r.randrange(9))).encode(),
                        "".join(r.choice("ab") for _ in range(r.randrange(7))).encode()) for _ in range(r.randrange(1, 25))})
        right, left = [a for a, _ in rows], [b for _, b in rows]
        found = rp.interval_spans(right, left, size)
        for i in range(len(rows)):
            want = set()
            for k in range(len(rows)):
                if k != i:
                    a, b = -rp.common(left[i], left[k]), rp.common(right[i], right[k])
                    if b - a >= size:
                        want |= set(range(a, b))
            assert set(range(*found[i]) if found[i] else ()) == want


def test_cleaned_texts(docs):
    rows = [(1, "é" * 60 + "one"), (2, "two" + "é" * 60), (3, None), (4, "plain")]
    clean = {r.doc_id: r.text for r in rp.without_repeats(docs(rows), SIZE).collect()}
    assert clean == {1: "one", 2: "two", 3: None, 4: "plain"}


def test_whole_table(spark, small):
    frame = table(spark, small, "documents")
    assert got(frame, 400) == plain([(r.doc_id, r.text) for r in frame.collect()], 400)


def worded(rows):
    """Texts without the words that lie in a passage of 51 words which stands more than once."""
    starts, lists = {}, {i: (t or "").split() for i, t in rows}
    for i, words in lists.items():
        for at in range(len(words) - 50):
            starts.setdefault(tuple(words[at:at + 51]), []).append((i, at))
    gone = {(i, k) for found in starts.values() if len(found) > 1 for i, at in found for k in range(at, at + 51)}
    return {i: [w for k, w in enumerate(words) if (i, k) not in gone] for i, words in lists.items()}


@pytest.mark.parametrize("joined, block", [(True, 1 << 21), (False, 16)])
def test_word_passages_match_all_windows(docs, monkeypatch, joined, block):
    if not joined:
        monkeypatch.setattr(rp, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(rp, "BLOCK", block)
    r = random.Random(8)
    word = lambda: r.choice("ab") * r.randrange(1, 4)
    shared = [[word() for _ in range(k)] for k in (50, 51, 52, 60, 120)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            words += r.choice(shared) + [word() for _ in range(r.randrange(20))]
        rows.append((i, r.choice([" ", "  ", "\n"]).join(words)))
    rows += [(90, "x " * 51), (91, "x " * 52), (92, rows[3][1]), (93, None), (94, "")]
    spans = {}
    for s in rp.passages(docs(rows)).collect():
        spans.setdefault(bytes(s.text_key), []).append({"a": s.a, "b": s.b})
    left = {}
    for i, text in rows:
        data = (text or "").encode()
        left[i] = rp.remaining(data, rp.merged(spans.get(hashlib.md5(data).digest()), len(data))).decode().split()
    assert left == worded(rows)


def test_the_text_is_what_the_remaining_bytes_say(docs):
    plain = rp.removal(docs(passages(5, letters="abcd ")), 100).collect()
    assert sum(r.n_removed for r in plain) > 0
    for r in plain:
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and len(r.text) == r.n_bytes - r.n_removed
    for r in rp.removal(docs(passages(6)), 100).collect():
        # A cut may leave one byte of a character of two at each of its ends.
        assert 0 <= r.n_bytes - r.n_removed - len(r.text.encode()) <= 2 * r.n_spans and "�" not in r.text


def test_only_the_marks_stay_on_disk(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    r = random.Random(13)
    shared = [f"s{k}" for k in range(70)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(r.randrange(9))] + shared * (i % 3 > 0))) for i in range(20)]
    rows += [(30, rows[1][1]), (31, None), (32, "")]
    frame = rp.without_repeats(docs(rows), words=True)
    assert {f"{p.parent.name.split('-')[0]}/{p.name}" for p in tmp_path.glob("*/*")} == {"marks/marks"}
    assert {x.doc_id: (x.text or "").split() for x in frame.collect()} == worded(rows)


def test_short_passages_of_many_words_leave_the_clean_text_only(docs):
    r = random.Random(14)
    words = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 7))) for _ in range(k))
    passage, fifty, long, short = words(51), words(50), words(120), words(60)
    assert len(passage) < rp.SIZE < len(long) and len(short) < rp.SIZE
    texts = [f"{words(9)} {passage} {words(9)}", f"{words(30)}\n{passage.replace(' ', '  ')} é", f"{words(9)} {passage.upper()}",
             f"{words(9)} {fifty} {words(9)}", f"{words(3)} {fifty} {words(3)}", f"{words(9)} {long} {words(9)}",
             f"{words(2)} {long}", short, short, words(80), None, ""]
    rows = list(enumerate(texts)) + [(None, f"{passage} {words(5)}")]
    found = rp.removal(docs(rows), words=True).collect()
    columns = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found)
    assert columns == plain(rows, rp.SIZE) == got(docs(rows), rp.SIZE)
    left, want = {x.doc_id: (x.text, x.clean_text.split()) for x in found}, worded(rows)
    assert all(left[i][1] == want[i] for i, _ in rows)
    assert passage in left[0][0] and passage not in " ".join(left[0][1]) and left[7] == (short, [])
    assert left[2][1] == texts[2].split() and left[3][1] == texts[3].split() and left[9][1] == texts[9].split()


@pytest.mark.parametrize("crowd, letters", [(2, "ab"), (40_000, "aAé"), (2, "a漢")])
def test_passages_in_crowded_grams_and_of_long_words(docs, monkeypatch, crowd, letters):
    monkeypatch.setattr(rp, "CROWD", crowd)
    monkeypatch.setattr(rp, "BROADCAST_ROWS", 0)
    r = random.Random(crowd)
    word = lambda: r.choice(letters) * r.choice([1, 2, 3, 32, 33, 40])
    shared = [[word() for _ in range(k)] for k in (50, 51, 52, 70, 130)] + [["x", "y"] * 60]
    rows = []
    for i in range(50):
        words = [word() for _ in range(r.randrange(30))]
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            words += p[r.choice([0, 0, 1, 15]):] + [word() for _ in range(r.randrange(20))]
        rows.append((i, " ".join(words)))
    left = {x.doc_id: x.clean_text.split() for x in rp.removal(docs(rows).repartition(3), 1 << 20, words=True).collect()}
    assert left == worded(rows)
