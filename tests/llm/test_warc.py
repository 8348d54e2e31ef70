"""WARC archives: what is read back is what was written."""

import gzip
import hashlib

import pytest

from loanward.llm.common import Scratch
from loanward.llm.warc import Digests, Parser, chunks_of, read_chunks, read_records, record_rows, write_archives
from tests.llm.conftest import table


def test_chunks_don_t_cut_characters():
    data = "aé漢😀".encode() * 500
    for size in (4, 5, 7, 64):
        parts = [bytes(p) for p in chunks_of(data, size)]
        assert b"".join(parts) == data and all(p.decode() or True for p in parts) and max(map(len, parts)) <= size
    assert [bytes(p) for p in chunks_of(b"")] == [b""]


def test_parser_at_any_piece_size():
    pages = [(1, "http://a/ b", b"x" * 300), (2, None, b""), (3, "u", "é\r\n\r\nWARC/1.1\r\n".encode() * 40)]
    stream = "\r\n\r\n".join([r for i, u, p in pages for r in record_rows(i, u, p, None, False, "0", 100)] + [""]).encode()
    for step in (1, 7, 1000, len(stream)):
        parser, digests, done = Parser(), Digests(), []
        for at in range(0, len(stream), step):
            for fields, data in parser.feed(stream[at:at + step]):
                from loanward.llm.warc import _ARROW, _chunk_row
                done += [r for r in [digests.take(dict(zip(_ARROW.names, _chunk_row(fields, data))))] if r]
        parser.close()
        assert [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in done] == [
            (i, len(p), hashlib.sha256(p).hexdigest()) for i, _, p in pages]


def test_damage_is_noticed():
    text = next(record_rows(1, "u", b"abcdef" * 50, None, False, "0"))
    parser = Parser()
    with pytest.raises(ValueError, match="within a record"):
        list(parser.feed(text.encode()[:-5]))
        parser.close()
    from loanward.llm.warc import _ARROW, _chunk_row
    fields, data = next(Parser().feed((text.replace("abc", "abd", 1) + "\r\n\r\n").encode()))
    with pytest.raises(ValueError, match="damaged"):
        Digests().take(dict(zip(_ARROW.names, _chunk_row(fields, data))))


def _round_trip(spark, pages, size, per_file=1024):
    folder = Scratch(spark, "warc-test").root
    write_archives(pages, folder, size, per_file)
    return folder, read_records(read_chunks(spark, folder)).collect()


@pytest.mark.parametrize("size, per_file", [(64, 3), (1 << 16, 1024)])
def test_round_trip_of_odd_pages(spark, size, per_file):
    long = "漢字 <p>\r\n\r\n</p>" * 3000
    rows = [(1, "u", "short"), (2, "u", "short"), (3, None, None), (4, "", ""), (9, "http://x/?a b\r\nWARC-Type: x", long),
            (5, "y", long), (6, "z", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20), (7, "a", "y" * 99), (8, "a", "y" * 99),
            (10, "a", "y" * 100), (11, "b", "y" * 100), (11, "b", "y" * 100), (None, "n", "null id"), (None, "n", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, got = _round_trip(spark, pages.withColumnRenamed("url", "url"), size, per_file)
    assert len(got) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and h in least and i != least[h]
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                     least[h] if again else None))
    assert sorted(map(repr, want)) == sorted(repr((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type,
                                                   r.refers_to)) for r in got)


def test_empty_table_and_missing_url(spark):
    assert _round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"), 64)[1] == []
    assert len(_round_trip(spark, spark.createDataFrame([(1, "x")], "page_id long, html string"), 64)[1]) == 1


def test_files_are_gzip_warc(spark, small):
    folder, rows = _round_trip(spark, table(spark, small, "pages"), 1 << 16)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect()
    text = b"".join(gzip.decompress(f.content) for f in files)
    assert text.count(b"WARC/1.1\r\n") >= len(rows) and text.endswith(b"\r\n\r\n")
    assert {r.page_id for r in rows} == {r.page_id for r in table(spark, small, "pages").select("page_id").collect()}
