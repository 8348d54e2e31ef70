"""Operator 3: n-gram Jaccard join by prefix filter. It replaces a token-group matrix, which is not built.

Texts are sets of hashed 5-word shingles; equal sets are one node. Nodes that share a min-hash are held against a
leader, the one with the fewest tokens of its own, and exact links to leaders make the groups. Each node then has a
cell for each token by which it can be found at all (its prefix under a global order, rare tokens first). Nodes of
different groups make a pair where they share a token that stands early enough in both for their sizes; pairs with
enough such tokens are compared, whole set with whole set. So every link between different groups is found, and links
inside a group, which cannot change the components, are not enumerated. A copy that is too far from its leader has so
many tokens of its own that these fill the places where a link would have to show, and makes no pairs. No group is
ruled out as a whole: where many sets of different groups share early tokens, their pairs are enumerated, which grows
with the square of their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import Scratch, slices
from loanward.llm.components import stars

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Min-hashes by which leaders are chosen, and how many must agree. They decide how much is left to the cells, not
#: the result.
HASHES, AGREE = 5, 2
#: Tokens that a linked pair must share in the first places of both sets, if their sizes allow to ask for so many.
EARLY = 3
#: One document in this many is counted for the token order, which decides speed, not results.
ORDER_SAMPLE = 16
#: Sampled documents that make a token frequent, and most tokens so ranked (8 bytes each, broadcast).
FREQUENT, RANKED = 3, 1_000_000
#: Node keys up to this many are broadcast to fetch texts; beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Cells of a token that one task holds; those of a more frequent token are dealt into pieces, and pieces meet in pairs.
HELD = 8192
_BLOCK = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Those of the base and of its inverse, which all shinglers of a worker share."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(_BLOCK + 1, base, dtype=np.uint64), np.full(_BLOCK + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Shingler:
    """Word and shingle hashes of whole texts, by prefix sums over blocks of bytes; with ``fold`` A-Z are as a-z."""

    def __init__(self, fold: bool = True) -> None:
        letters = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        if fold:
            letters[65:91] = letters[97:123]
        self.letters, self.fold = letters, fold
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.up, self.down = _powers()
        self.factors = _mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | _U(1)

    def words(self, text: bytes) -> np.ndarray:
        """A hash for each word, in order."""
        out, at = [], 0
        while at < len(text):
            end = min(at + _BLOCK, len(text))
            if end < len(text):  # cut between words
                part = np.frombuffer(text, np.uint8, end - at, at)
                spaces = np.flatnonzero(self.space[part])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:  # a word longer than a block: its own digest
                    rest = np.frombuffer(text, np.uint8, len(text) - at, at)
                    stop = np.flatnonzero(self.space[rest])
                    end = at + (int(stop[0]) if len(stop) else len(rest))
                    word = text[at:end].lower() if self.fold else text[at:end]
                    raw = hashlib.blake2b(word, digest_size=8).digest()
                    out.append(np.frombuffer(raw, "<u8"))
                    at = end
                    continue
            out.append(self._block(np.frombuffer(text, np.uint8, end - at, at)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _block(self, part: np.ndarray) -> np.ndarray:
        gap = np.concatenate([[True], self.space[part], [True]])
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(self.letters[part] * self.up[:len(part)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text: all of it if it has fewer words, none without words."""
        words = self.words((text or "").encode("utf-8", "surrogatepass"))
        if not len(words):
            return words
        size = min(WORDS, len(words))
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total += words[k:k + len(total)] * self.factors[k]
        return np.unique(_mix(total))


_SHINGLER: list[Shingler] = []


def shingler() -> Shingler:
    if not _SHINGLER:
        _SHINGLER.append(Shingler())
    return _SHINGLER[0]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct arrays are similar enough."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def prefix_size(n: int) -> int:
    """Tokens of a set of n by which it is found.

    The overlap of a linked pair is at least PERCENT/100 of either set, and sets that share o tokens share one among
    the first n - o + 1 of each in any common order.
    """
    return n - -(-PERCENT * n // 100) + 1


class Order:
    """The global token order: unranked tokens by hash, then ranked ones from rare to frequent."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        by = tokens.argsort()
        self.tokens = tokens[by]
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        self.rank = rank[by]

    def known(self, tokens: np.ndarray) -> int:
        """How many of the tokens are ranked."""
        if not len(self.tokens):
            return 0
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        return int((self.tokens[at] == tokens).sum())

    def first(self, tokens: np.ndarray, many: int) -> np.ndarray:
        if not len(self.tokens):
            return tokens[:many]
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        ranked = self.tokens[at] == tokens
        plain = tokens[~ranked]
        if len(plain) >= many:
            return plain[:many]
        late = tokens[ranked][self.rank[at[ranked]].argsort()]
        return np.concatenate([plain, late])[:many]


def token_order(documents: DataFrame) -> Order:
    """The order from the tokens of one document in ORDER_SAMPLE."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingler().shingles(t) for t in batch.column("text").to_pylist()]
            tokens, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "n"])

    sampled = documents.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(ORDER_SAMPLE)) == 0)
    counts = sampled.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(RANKED).toArrow()
    return Order(top.column("token").to_numpy().astype(np.int64).view(np.uint64),
                 top.column("n").to_numpy().astype(np.int64))


def _signatures(rows: DataFrame, order: Order) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(order)  # at most RANKED tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _mix(np.arange(1, HASHES + 1, dtype=np.uint64))
        for batch in slices(batches, "text"):
            sizes, known, keys, least, prefixes = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingler().shingles(text)
                sizes.append(len(tokens))
                known.append(sent.value.known(tokens))
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                least.append([int(_mix(tokens ^ s).min().view(np.int64)) for s in salts] if len(tokens) else [])
                prefixes.append(sent.value.first(tokens, prefix_size(len(tokens))).view(np.int64)
                                if len(tokens) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64())),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "known", "set_key", "least", "prefix"])

    return rows.mapInArrow(run, "doc_id long, text_key binary, n long, known long, set_key binary, least array<long>, "
                                "prefix array<long>").withColumn("row", F.monotonically_increasing_id())


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text")))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets are linked."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    keys = scratch.put(f"{label}-keys", nodes.join(wanted, "node").select("node", "doc_id", "text_key"))
    some = keys.select("node", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    if keys.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    texts = rows.join(some, F.col("doc_id").eqNullSafe(F.col("id")) & (_text_key() == F.col("key")))
    texts = scratch.put(f"{label}-texts", texts.select("node", "text").dropDuplicates(["node"]))
    both = (pairs.join(texts.withColumnsRenamed({"node": "u", "text": "text_u"}), "u")
            .join(texts.withColumnsRenamed({"node": "v", "text": "text_v"}), "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in slices(batches, "text_u"):
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for i in range(len(u)):
                if v[i] != last:  # rows of a leader mostly stand together
                    last, held = v[i], shingler().shingles(batch.column("text_v")[i].as_py())
                keep.append(linked(shingler().shingles(batch.column("text_u")[i].as_py()), held))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    links = scratch.put(f"{label}-links", both.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long"))
    scratch.drop(f"{label}-keys")
    scratch.drop(f"{label}-texts")
    return links


def _grouped(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """node, comp: the node's group, itself where it has no other."""
    return nodes.select("node").join(forest.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left") \
        .select("node", F.coalesce("comp", "node").alias("comp"))


def _dealt(cells: DataFrame, frequent: DataFrame) -> DataFrame:
    """The cells with ``side``, those of ``frequent`` tokens (often, pieces) once for each pair of pieces they are in.

    Such a pair has its own key for a token. Cells of one side of it don't meet, but for side 0, a piece with itself.
    """
    pieces = cells.join(frequent, F.col("token") == F.col("often"), "left").withColumn(
        "piece", F.pmod(F.xxhash64("node", F.lit("piece")), "pieces"))
    other = F.explode(F.expr("if(pieces is null, array(cast(null as long)), sequence(0l, pieces - 1))")).alias("other")
    place = [c for c in cells.columns if c == "place"]
    pieces = pieces.select("token", "comp", "node", "n", *place, "piece", other)
    key = F.xxhash64("token", F.least("piece", "other"), F.greatest("piece", "other"))
    side = F.when(F.col("piece") < F.col("other"), 1).when(F.col("piece") > F.col("other"), 2).otherwise(0)
    return pieces.select(F.when(F.col("other").isNull(), F.col("token")).otherwise(key).alias("token"), "comp", "node",
                         "n", *place, side.alias("side"))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token: pairs of nodes of different groups, and how many tokens of the batch they share.

    Rows of the last token wait for the next batch. Only sets within the size bound meet, and where rows have a
    ``place`` only at a token that is early enough in both.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        tokens = table.column("token").to_numpy()
        if not len(tokens):
            continue
        cut = int(np.searchsorted(tokens, tokens[-1]))
        rest = table.slice(cut)
        if cut:
            yield from _met(table.slice(0, cut))
    if rest is not None:
        yield from _met(rest)


def overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Tokens that linked sets of n and m have in common at least."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def early(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Tokens that linked sets of n and m share at least among the first n - overlap + early of one and m - overlap +
    early of the other.

    The last of their first few common tokens is followed by the rest of the overlap in both. No more than EARLY, and
    so few that these places are in the prefixes.
    """
    most = np.maximum(n, m)
    return np.minimum(EARLY, overlap(n, m) + (-PERCENT * most // 100) + 1)


def _met(table: pa.Table, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    token, comp, node, size = (table.column(c).to_numpy() for c in ("token", "comp", "node", "n"))
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    mixed = np.minimum.reduceat(comp, edges[:-1]) < np.maximum.reduceat(comp, edges[:-1])
    order = np.lexsort((size, token))
    keep = np.repeat(mixed, np.diff(edges))[order]
    order = order[keep]
    end = np.repeat(np.cumsum(np.diff(edges)[mixed]), np.diff(edges)[mixed])
    n, c, d = size[order], comp[order], node[order]
    s = table.column("side").to_numpy()[order] if "side" in table.column_names else None
    p = table.column("place").to_numpy()[order] if "place" in table.column_names else None
    found: list[np.ndarray] = []
    held, step, low = 0, 0, np.arange(len(order))
    while len(low):  # each row with the next one of its token, then the next but one; sizes only get further apart
        step += 1
        low = low[low + step < end[low]]
        low = low[100 * n[low] >= PERCENT * n[low + step]]
        high = low + step
        meet = c[low] != c[high]
        if s is not None:
            meet &= (s[low] != s[high]) | (s[low] == 0)
        if p is not None:
            spare = early(n[low], n[high]) - overlap(n[low], n[high])
            meet &= (p[low] < n[low] + spare) & (p[high] < n[high] + spare)
        a, b = low[meet], high[meet]
        if len(a):
            swap = d[a] > d[b]
            found.append(np.stack([np.where(swap, d[a], d[b]), np.where(swap, d[b], d[a]),
                                   np.where(swap, n[a], n[b]), np.where(swap, n[b], n[a])]))
            held += len(a)
        if held > most:
            yield _counted(found)
            found, held = [], 0
    if found:
        yield _counted(found)


def _counted(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    first = np.flatnonzero(np.concatenate([[True], (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)]))
    shared = np.diff(np.append(first, pairs.shape[1]))
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in pairs[:, first]), pa.array(shared)],
                                      ["u", "v", "nu", "nv", "shared"])


def _can_link(nu: Column, nv: Column, shared: Column) -> Column:
    """Whether sets that share so many early tokens can overlap enough (``early``)."""
    least = F.ceil(PERCENT * (nu + nv) / (100 + PERCENT)) - F.ceil(PERCENT * F.greatest(nu, nv) / 100) + 1
    return shared >= F.least(F.lit(EARLY), least)


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null, empty and wordless texts have no shingles and are alone. Rows with equal sets are linked, so repeated
    rows share a component. component_id is the least id of the component; where no row of it has an id it is
    null, as for a lone row without one. Other columns are ignored.
    """
    return labelled(documents).select("doc_id", "n_shingles", "component_id")


def labelled(documents: DataFrame) -> DataFrame:
    """``components`` with text_key, the text's md5, and comp, a key of the component; null if there are no shingles."""
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(documents.sparkSession, "jaccard")
    order = token_order(rows)
    signed = scratch.put("signed", _signatures(rows.withColumn("text_key", _text_key()).select(
        "doc_id", "text", "text_key"), order))
    full = signed.where("n > 0")
    nodes = scratch.put("nodes", full.groupBy("set_key").agg(
        F.min("row").alias("node"), F.min_by(F.struct("doc_id", "text_key"), "row").alias("one"),
        F.min_by("least", "row").alias("least"), F.min(F.struct(-F.col("known") / F.col("n"), -F.col("known")))
        .alias("own"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"]
        .alias("least_id")).select("set_key", "node", "one.doc_id", "one.text_key", "least", "own", "least_id"))
    # Leaders: of each min-hash the node with the largest share of ranked tokens, which is nearest to the most others
    # of a large group, or the first; pairs that agree in one min-hash alone are mostly chance.
    hashed = nodes.select("node", "own", F.posexplode("least").alias("which", "value"))
    leaders = hashed.groupBy("which", "value").agg(
        F.min(F.struct("own", "node"))["node"].alias("leader"), F.count(F.lit(1)).alias("n"))
    close = hashed.join(leaders.where("n > 1"), ["which", "value"]).where("node <> leader").groupBy(
        F.col("node").alias("u"), F.col("leader").alias("v")).agg(F.count(F.lit(1)).alias("agree"))
    close = scratch.put("close", close.where(F.col("agree") >= AGREE).select("u", "v"))
    links = verified(close, nodes, rows, scratch, "leaders")
    forest = stars(links, scratch, "groups")
    # Cells: tokens of each node's prefix with its group. Groups meet where a token stands in several.
    cells = signed.select(F.col("row").alias("node"), "n", "prefix").join(_grouped(nodes, forest), "node").select(
        F.posexplode("prefix").alias("place", "token"), "comp", "node", "n")
    frequent = scratch.put("frequent", cells.groupBy(F.col("token").alias("often")).count().where(
        F.col("count") > HELD).select("often", F.ceil(2 * F.col("count") / HELD).alias("pieces")))
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    met = _dealt(cells, frequent).repartition("token").sortWithinPartitions("token").mapInArrow(
        _meetings, "u long, v long, nu long, nv long, shared long")
    met = met.groupBy("u", "v", "nu", "nv").agg(F.sum("shared").alias("shared"))
    candidates = scratch.put("candidates", met.where(_can_link(F.col("nu"), F.col("nv"), F.col("shared"))).select(
        "u", "v", "shared"))
    sized = scratch.put("sized", signed.select("doc_id", "text_key", "n", "set_key"))
    scratch.drop("signed")  # prefixes are most of what is on disk
    for turn in range(2):  # for two groups the most promising pair first, then what still lies between groups
        side = _grouped(nodes, forest)
        open_pairs = (candidates.join(side.withColumnsRenamed({"node": "u", "comp": "cu"}), "u")
                      .join(side.withColumnsRenamed({"node": "v", "comp": "cv"}), "v").where("cu <> cv"))
        if turn == 0:
            open_pairs = open_pairs.groupBy(F.least("cu", "cv"), F.greatest("cu", "cv")).agg(
                F.max_by(F.struct("u", "v"), F.struct("shared", "u", "v")).alias("pair")).select("pair.*")
        else:
            open_pairs = open_pairs.select("u", "v").join(tried, ["u", "v"], "left_anti")
        tried = scratch.put(f"open-{turn}", open_pairs.select("u", "v"))
        more = verified(tried, nodes, rows, scratch, f"open-{turn}-checked")
        links = scratch.put(f"links-{turn}", links.unionByName(more).distinct())
        forest = stars(links, scratch, f"merged-{turn}")
    scratch.drop("candidates")
    group = nodes.select("set_key", "node", "least_id").join(_grouped(nodes, forest), "node")
    least = group.groupBy("comp").agg(F.min("least_id").alias("component"))
    named = group.join(least, "comp").select(F.col("set_key").alias("of"), "component", "comp")
    return sized.join(
        named, (F.col("set_key") == F.col("of")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_key", "comp", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
