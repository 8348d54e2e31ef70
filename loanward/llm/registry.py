"""The operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanward.llm.bpe import tokenize
from loanward.llm.chat import CLOSE, CONTROL, EXTRA, LEARNED, MIDDLE, OPEN, format_turns, read_back, with_extra
from loanward.llm.common import Scratch, send_package
from loanward.llm.html import extract
from loanward.llm.jaccard import components
from loanward.llm.language import identify
from loanward.llm.lexical import search as lexical_search
from loanward.llm.negatives import mine
from loanward.llm.packing import pack
from loanward.llm.quality import METRICS, judge
from loanward.llm.repeats import removal
from loanward.llm.urls import RULES, judge_urls, stated_rules
from loanward.llm.vectors import search
from loanward.llm.warc import read_chunks, read_records, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"), words=True)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").root
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(read_chunks(spark, folder))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_turns(with_extra(table(spark, sf_dir, "conversations"))))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), ids=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", *METRICS, "base_failed", "kept")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), stated_rules(spark))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OPERATORS = (op1_repeats, op2_html, op3_jaccard, op4_packing, op5_warc, op6_vectors, op7_language, op8_chat, op9_bpe, op10_quality,
             op11_lexical, op12_urls, op13_negatives)
#: Queries that SQL cannot express; tests hold them against brute force, a library or held-out labels.
WITHOUT_SQL = {"op1_repeats", "op2_html", "op4_packing", "op7_language", "op9_bpe"}


def _sent(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        send_package(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {query.__name__: _sent(query) for query in OPERATORS}


#: Shingle sets, pairs by shared shingles, and components by a recursive walk: for small tables.
_OP3 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

_OP5 = """
SELECT p.page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM pages p LEFT JOIN (
  SELECT html AS h, min(page_id) AS first FROM pages WHERE octet_length(encode(html)) >= 100 GROUP BY html) f ON f.h = p.html
"""

_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def _op8() -> str:
    """Each match of a control string adds a backslash, and a turn with one the number of its escapes."""
    marks = " + ".join(f"len(regexp_extract_all(t, '{pattern}'))" for pattern in (
        "".join(re.sub(r"([\[\]|/<>])", r"\\\1", x) for x in (c[0], "\x00", c[1:])).replace("\x00", "\\\\*") for c in CONTROL))
    plain = "|".join(re.sub(r"([\[\]|/<>])", r"\\\1", c) for c in CONTROL)
    frame = len(OPEN) + len(MIDDLE) + len(CLOSE)
    return f"""
WITH every AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES {', '.join(f"({c}, {n}, '{r}', '{t}')" for c, n, r, t in EXTRA)}) x),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM every),
measured AS (SELECT *, CASE WHEN regexp_matches(t, '{plain}') THEN {marks} ELSE 0 END AS m FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN r = '{LEARNED}' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE r = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({frame} + length(r) + length(t) + m + CASE WHEN m > 0 THEN 2 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""


_OP10 = """
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT a.doc_id, a.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words a LEFT JOIN lines l ON l.doc_id = a.doc_id LEFT JOIN covered c ON c.doc_id = a.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY source),
prior AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v FROM hosts),
weights AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END, 1), 1e6) AS k FROM prior)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (h.f + m * k) / (h.n + k) <= 0.5 AS kept
FROM judged j JOIN hosts h ON h.source IS NOT DISTINCT FROM j.source, weights
"""


_OP11 = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
held AS (SELECT d, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM words GROUP BY d, t),
sizes AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY d),
facts AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(all_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, facts GROUP BY t),
scored AS (
  SELECT a.item_id, h.d, any_value(h.doc_id) AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_n) // all_l)))) AS BIGINT) AS score
  FROM asked a JOIN held h ON h.t = a.t JOIN weights g ON g.t = a.t JOIN sizes s ON s.d = h.d, facts GROUP BY a.item_id, h.d)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

_OP12 = f"""
WITH urls AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) r(h, p, v)),
judged AS (
  SELECT page_id, host, path, (SELECT arg_max({{'name': h || p, 'v': v}}, length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM urls)
SELECT page_id, host, path, best.name AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""


_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS s
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, c) AS n FROM scored WHERE same) WHERE n <= 5),
negatives AS (
  SELECT p.a, p.c AS p, x.c, p.s AS ps, x.s AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY x.s DESC, x.c) AS rank
  FROM positives p JOIN scored x ON x.a = p.a AND NOT x.same AND 30 * p.s <= 100 * x.s AND 100 * x.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score
FROM negatives WHERE rank <= 10
"""


def oracles() -> dict[str, str]:
    return {"op11_lexical": _OP11, "op12_urls": _OP12, "op13_negatives": _OP13, "op3_jaccard": _OP3, "op5_warc": _OP5, "op6_vectors": _OP6, "op8_chat": _op8(), "op10_quality": _OP10}
