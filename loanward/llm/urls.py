"""Operator 12: url rules by a sort-merge range join.

A url lies in its host and in the domains around it. Each of these, labels reversed, with the path behind it is a
canonical key of the url; a rule has one such key too, and fits every url key that begins with its own. So a rule is
an interval of the sorted keys, and intervals are nested or apart. Keys are dealt into ranges at sampled cuts; a rule
goes to all ranges that its interval touches. In a range, sorted with rules before urls, a sweep keeps the stack of
rules that are open: the top one is the longest that fits. The best rule over a url's keys is its verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanward.llm.common import slices

#: The verdict where no rule fits.
DEFAULT = "allow"
#: The rules of the registered query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Keys in a range, about, most ranges, sampled keys for each, and sampled keys in all at least.
RANGE_KEYS, RANGES, PER_RANGE, SAMPLED = 20_000, 8192, 16, 8000
#: Bytes of a key that a cut holds; it may lie anywhere, so a part of a key does as well.
_CUT = 200
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What stands behind the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split(".")))


def domains(host: str, most: int) -> Iterator[str]:
    """The reversed host cut behind each of its labels, to ``most`` labels: the domains that it lies in."""
    labels = host.rsplit(".", most)[-most:] if most else []
    back = labels[::-1]
    for many in range(1, len(back) + 1):
        yield ".".join(back[:many])
    if host.count(".") >= most:  # its own key too, by which it is found even where no rule is near
        yield reversed_host(host)


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, name, size, labels, verdict: one row for each host and path; a block goes before an allow."""
    host, path = lowered(F.coalesce(F.col("host"), F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    same = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").alias("verdict")).groupBy(
        "host", "path").agg(F.max("verdict").alias("verdict"))
    back = F.array_join(F.reverse(F.split("host", r"\.", -1)), ".")
    return same.select(F.concat(back, F.lit("/"), "path").cast("binary").alias("key"), F.concat("host", "path").alias("name"),
                       (F.length("host") + F.length("path")).cast("long").alias("size"), F.length("host").cast("long").alias("host_size"),
                       F.size(F.split("host", r"\.", -1)).alias("labels"), "verdict")


def _place(cuts: Sequence[tuple[bytes, int]], key: bytes, tie: int) -> int:
    return bisect_right(cuts, (key[:_CUT], tie))


def _spread(cuts: Sequence[tuple[bytes, int]], key: bytes) -> range:
    """The ranges that hold keys beginning with ``key``."""
    if len(key) > _CUT:  # urls with this start are dealt by their first bytes alone
        key = key[:_CUT]
    first = bisect_left(cuts, (key, -1))
    after = key.rstrip(b"\xff")
    beyond = (after[:-1] + bytes([after[-1] + 1]), -(1 << 63) - 1) if after else None
    return range(first, (bisect_left(cuts, beyond) if beyond else len(cuts)) + 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, carry: Sequence[str] = ("page_id",),
               range_keys: int = RANGE_KEYS) -> DataFrame:
    """The ``carry`` columns of all rows with host, path, rule and verdict; other columns are left out.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's path begins with its
    path; the longest (host and path together, then host) decides, and of equal ones with two verdicts the greatest
    in alphabetical order. A url that is null or has no ``://`` has an empty host and path, and as other urls without
    a rule gets ``default`` and a null rule. Repeated rows are each judged. Carried columns with a name of the result
    are replaced. Urls and hosts may have any length: a host gets no more keys than the rules' hosts have labels.
    Empty tables give no rows, or only defaults.
    """
    spark = pages.sparkSession
    fixed = ("host", "path", "rule", "verdict")
    kept = [c for c in carry if c.lower() not in fixed]
    url = F.col("url").cast("string")
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    # Equal rows are judged once; a frequent one is combined before the shuffle.
    folded = urls.groupBy("row", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    keys = rule_keys(rules)
    facts = keys.agg(F.max("labels").alias("labels"), F.count(F.lit(1)).alias("n")).first()
    most = facts["labels"] or 0
    narrow = urls.select("host", "path")
    total = narrow.count() * (most + 1) + facts["n"]
    ranges = min(RANGES, max(1, -(-total // range_keys)))
    cuts = _cuts(narrow, keys, most, ranges, total)
    sent = spark.sparkContext.broadcast(cuts)  # at most RANGES keys of _CUT bytes

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            for part in slices([batch], "path"):
                at, out, parts, own = [], [], [], []
                for i, (host, path, tie) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "path", "tie")), strict=True)):
                    for n, domain in enumerate(domains(host, most)):
                        key = f"{domain}/{path}".encode("utf-8", "surrogatepass")
                        at.append(i)
                        out.append(key)
                        parts.append(_place(cuts, key, tie))
                        own.append(n == 0)
                taken = part.select(["row", "host", "path", "copies"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary()), *taken.columns,
                                                  pa.array(own, pa.bool_())],
                                                 ["part", "key", "row", "host", "path", "copies", "own"])

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            at, parts = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                for part in _spread(cuts, key):
                    at.append(i)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.take(pa.array(at, pa.int64())).columns],
                                             ["part", *batch.schema.names])

    tie = F.pmod(F.xxhash64("row", "host", "path"), F.lit(1 << 40))
    asked = folded.withColumn("tie", tie)
    kind = asked.schema["row"].dataType.simpleString()
    asked = asked.mapInArrow(dealt, f"part int, key binary, row {kind}, host string, path string, copies long, own boolean")
    given = keys.drop("labels").mapInArrow(reaching, "part int, key binary, name string, size long, host_size long, verdict string")
    both = asked.withColumn("kind", F.lit(1)).unionByName(given.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", "size")
    swept = both.select("part", "key", "kind", "row", "host", "path", "copies", "own", "name", "size", "host_size", "verdict").mapInArrow(
        _sweep, f"row {kind}, host string, path string, copies long, name string, size long, host_size long, verdict string")
    best = swept.groupBy("row", "host", "path").agg(
        F.max("copies").alias("copies"), F.max_by(F.struct("name", "verdict"), F.struct("size", "host_size")).alias("best"))
    # A row for each copy: two steps keep the arrays at the square root of their number.
    step = F.ceil(F.sqrt("copies")).cast("long")
    best = best.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(step, F.col("copies") - F.col("first")))))
    return best.select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", F.col("best.name").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _cuts(urls: DataFrame, rules: DataFrame, most: int, ranges: int, total: int) -> list[tuple[bytes, int]]:
    """Where the ranges begin: a sample of the keys of urls and rules, each with its tie, evenly cut."""
    if ranges < 2:
        return []
    share = min(1.0, max(ranges * PER_RANGE, SAMPLED) / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f"{d}/{p}".encode("utf-8", "surrogatepass")[:_CUT], t)
                    for h, p, t in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "tie")), strict=True)
                    for d in domains(h, most)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                                             ["key", "tie"])

    tie = (F.rand(12) * (1 << 40)).cast("long")
    found = urls.sample(share, seed=12).select("host", "path", tie.alias("tie")).mapInArrow(run, "key binary, tie long")
    found = found.unionByName(rules.sample(share, seed=12).select(F.substring("key", 1, _CUT).alias("key"), F.lit(0).cast("long").alias("tie")))
    # PER_RANGE rows for each of at most RANGES ranges, or SAMPLED in all; where they lie changes the work of tasks, not the result.
    table = found.toArrow()
    all_cuts = sorted(zip(table.column("key").to_pylist(), table.column("tie").to_pylist(), strict=True))
    step = max(1, len(all_cuts) // ranges)
    return sorted(set(all_cuts[step::step]))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by range and key, rules first: urls with the innermost open rule; without one only the first key."""
    part: int | None = None
    stack: list[tuple[bytes, tuple]] = []
    for batch in batches:
        at, found = [], []
        columns = [batch.column(c).to_pylist() for c in ("part", "key", "kind", "own", "name", "size", "host_size", "verdict")]
        for i, (here, key, kind, own, *rule) in enumerate(zip(*columns, strict=True)):
            if here != part:
                part, stack = here, []
            while stack and not key.startswith(stack[-1][0]):  # its interval has ended
                stack.pop()
            if kind == 0:
                stack.append((key, tuple(rule)))
            elif stack or own:
                at.append(i)
                found.append(stack[-1][1] if stack else (None, None, None, None))
        taken = batch.select(["row", "host", "path", "copies"]).take(pa.array(at, pa.int64()))
        rules = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*taken.columns, *rules], ["row", "host", "path", "copies", "name", "size", "host_size", "verdict"])


def stated_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")
