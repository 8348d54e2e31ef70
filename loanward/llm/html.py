"""Operator 2: main text of web pages by the maximum-scoring subsequence.

A page is read as a row of words and tags. Words score positive and tags negative, with weights learned from
pages whose markup labels the article; one linear scan (the running best of Kadane) finds the contiguous run of
highest score. Elements that are never article text (scripts, menus, forms, adverts, reader comments and the
like) are passed over before, so they neither score nor appear.
"""

from __future__ import annotations

import html as references
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import column_or_null, send_package, slices

#: Labelled pages that the weights are fitted on, at most.
SAMPLE = 500
#: Tags that get a weight of their own, at most: the most frequent ones, ties by name. Others weigh as unknown.
FEATURES = 5000
#: Bounds of the weights: a word never costs, a tag never gains.
WORD, TAG = (0.05, 3.0), (-3.0, -0.001)
#: Elements whose content is never article text. Fixed names of HTML.
DROPPED = frozenset((
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select",
    "option", "textarea", "input", "label", "fieldset", "iframe", "object", "embed", "svg", "canvas", "audio", "video",
    "map", "menu", "dialog", "datalist",
))
#: A header is dropped outside the article and the main part only: inside it may hold the headline.
OUTER = frozenset(("header",))
#: Elements without content or end tag. Fixed names of HTML.
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
#: Elements that don't end a block. Fixed names of HTML.
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
))
#: Elements whose end tag may be left out: the start tags that end them, and the elements in which these don't. Fixed
#: rules of HTML.
_CELL = frozenset(("td", "th", "tr", "tbody", "thead", "tfoot"))
IMPLIED = {
    "p": (frozenset((
        "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
        "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li",
        "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "dd", "dt")), frozenset(("button", "object"))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (_CELL, frozenset(("table",)))),
    "tr": (_CELL - {"td", "th"}, frozenset(("table",))),
}
#: Elements whose content is not markup, up to their end tag.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
#: Words in class, id or role that mark what is not the article.
_MARKED = re.compile(
    r"(?:^|\s|(?<!no)(?<!has)(?<!with)[_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|newsletter"
    r"|subscribe|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|toolbar|footer|comments?|comment-?list|disqus"
    r"|respond|reply|replies|related|recommend\w*|share|sharing|social|widget|skip|search|login|signup|pagination|pager"
    r"|masthead|contentinfo|complementary)(?:$|[\s_-])", re.I)
#: The same for an article element, which otherwise is never passed over.
_REMARK = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|respond|related|promo\w*|sponsor\w*|adv\w*)(?:$|[\s_-])", re.I)
#: Page headers by class, outside the article.
_PAGE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[_-]?)?header(?:$|\s)", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$|[^>]*+(?:>|$))|</[^>]*(?:>|$)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*)(?=[\s/>])")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
#: Block markers in the token rows.
_BREAK = "\n"


class _Open:
    """Open elements in order, with the number of each name: membership doesn't search the list."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def pop_to(self, name: str) -> list[str]:
        """Close elements down to the last one of the name; the closed ones."""
        gone = []
        while not gone or gone[-1] != name:
            gone.append(self.names.pop())
            self.count[gone[-1]] -= 1
        return gone

    def clear(self) -> None:
        self.names.clear()
        self.count.clear()

    def any_of(self, names: frozenset[str], inside: bool = False) -> bool:
        """Whether one of the names is open; ``inside``: below the first element."""
        return any(self.count[n] > (inside and n == self.names[0]) for n in names)


class _Tags:
    """Where elements of a name begin and end in a page; gathered in one pass when first asked."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.places: dict[str, list[int]] | None = None
        self.steps: dict[str, list[int]] = {}
        self.least: dict[str, list[tuple[int, int]]] = {}

    def closed(self, name: str, place: int, depth: int) -> bool:
        """Whether ``depth`` open elements of the name all have end tags after ``place``."""
        if self.places is None:
            self.places = {}
            for m in _TAG.finditer(self.page):
                own = m[2].lower()
                self.places.setdefault(own, []).append(m.start())
                self.steps.setdefault(own, []).append(-1 if m[1] else 1)
        if name not in self.places:
            return False
        if name not in self.least:
            # For each tag, the balance before it and the least balance from it on.
            balance, rows = 0, []
            for step in self.steps[name]:
                rows.append(balance)
                balance += step
            least, out = balance, []
            for step, before in zip(reversed(self.steps[name]), reversed(rows), strict=True):
                least = min(least, before + step)
                out.append((before, least))
            self.least[name] = out[::-1]
        at = bisect_left(self.places[name], place)
        if at == len(self.places[name]):
            return False
        before, least = self.least[name][at]
        return least <= before - depth


#: Elements whose content is labelled as the article; an article is a closer label than the main part.
LEVELS = {"main": 1, "article": 2}


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(feature, text, label) of what may be article text: runs of text, and tags, in page order; linear in the page.

    A text run has its words' feature, ``word`` or ``link``; a tag has its name, text ``\\n`` if it ends a block.
    ``label`` is 2 in an article element, 1 in a main element only, else 0.
    """
    stack, skipping = _Open(), _Open()  # the second: open elements since the one that is passed over
    tags = _Tags(page)
    label, links, place, end = 0, 0, 0, len(page)

    def level() -> int:
        return 0 if not label else 2 if stack.count["article"] else 1

    while place < end:
        m = _TOKEN.search(page, place)
        start = m.start() if m else end
        if start > place and not skipping.names:
            yield ("link" if links else "word"), page[place:start], level()
        if not m:
            return
        place = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, rest = bool(m[1]), m[3]
        if skipping.names:
            if closing and skipping.count[name]:
                skipping.pop_to(name)
                if not skipping.names:
                    yield name, _BREAK, level()
                continue
            first = skipping.names[0]
            if closing and stack.count[name] and _ends_outer(name, skipping) or not closing and _implies_end(name, skipping):
                skipping.clear()
            elif not closing and name not in VOID and not rest.endswith("/"):
                if name == "body" or name in LEVELS and (
                        first in ("nav", "header", "menu", "form") or not label and not tags.closed(first, place, skipping.count[first])):
                    # An unclosed head, menu or header, or whatever is never closed, doesn't swallow the article.
                    skipping.clear()
                else:
                    skipping.push(name)
                    if name in RAW:
                        place = _raw_end(page, place, name)
            if skipping.names:
                continue
        if not closing:
            drop = name in DROPPED or (name in OUTER and not label)
            if not drop and rest and name not in ("body", "html"):
                marks = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(rest))
                if name in LEVELS:
                    drop = bool(_REMARK.search(marks))
                else:
                    drop = bool(_MARKED.search(marks) or _HIDDEN.search(rest) or not label and _PAGE_HEADER.search(marks))
            if name in RAW:
                place = _raw_end(page, place, name)
            if drop:
                if name not in VOID and not rest.endswith("/"):
                    skipping.push(name)
                    yield name, _BREAK, level()
                continue
        if name in VOID:
            yield name, (" " if name in INLINE else _BREAK), level()
            continue
        if closing:
            if stack.count[name]:
                for gone in stack.pop_to(name):
                    label -= gone in LEVELS
                    links -= gone == "a"
        else:
            stack.push(name)
            label += name in LEVELS
            links += name == "a"
        yield name, ("" if name in INLINE else _BREAK), level()


def _ends_outer(name: str, skipping: _Open) -> bool:
    """Whether the end tag of an element around the skipped one ends that too."""
    if name == "p" or name in INLINE:  # what a block has closed, or what doesn't close one
        return skipping.names[0] in INLINE
    return not (name in IMPLIED and skipping.any_of(IMPLIED[name][1]))


def _implies_end(name: str, skipping: _Open) -> bool:
    """Whether the start tag ends the skipped element, whose end tag was left out."""
    enders, within = IMPLIED.get(skipping.names[0], ((), frozenset()))
    return name in enders and not skipping.any_of(within, inside=True)


def _raw_end(page: str, place: int, name: str) -> int:
    """Where the end tag of an element without markup begins."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, place)
    return m.start() if m else len(page)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of highest sum, the longest of equals; empty if none is positive."""
    best = total = 0.0
    start = begin = end = 0
    for i, score in enumerate(scores, 1):
        total += score
        if total > best or (total == best and best > 0):
            best, begin, end = total, start, i
        if total < 0:
            total, start = 0.0, i
    return begin, end


def whole_elements(labels: list[int], begin: int, end: int) -> tuple[int, int]:
    """The run extended to the labelled elements that it touches: articles, or the main part if it touches none."""
    nearest = max(labels[begin:end], default=0)
    if nearest:
        if labels[begin] >= nearest:
            while begin and labels[begin - 1] >= nearest:
                begin -= 1
        if labels[end - 1] >= nearest:
            while end < len(labels) and labels[end] >= nearest:
                end += 1
    return begin, end


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the best run: blocks joined by newlines, white space in a block turned into single spaces.

    Nothing of an article or main element goes because it scores low: a run inside one is extended to all of it, and
    tags that the weights don't know cost nothing there.
    """
    row = list(tokens(page))
    unknown = weights.get("", TAG[0] / 2)
    scores = []
    for feature, text, label in row:
        weight = weights.get(feature, WORD[0] if feature in ("word", "link") else 0.0 if label else unknown)
        scores.append(weight * len(text.split()) if feature in ("word", "link") else weight)
    begin, end = best_run(scores)
    if begin < end:
        begin, end = whole_elements([label for _, _, label in row], begin, end)
    blocks, block = [], []
    for feature, text, _ in row[begin:end]:
        if feature in ("word", "link"):
            block.append(text)
        elif text == _BREAK:
            blocks.append("".join(block))
            block = []
        elif text:
            block.append(text)
    blocks.append("".join(block))
    clean = (_SPACE.sub(" ", references.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights: the log odds of each feature inside against outside labelled articles.

    Fitted on at most ``sample`` different pages that have an article or main element, those with the least hash of
    their id; copies of a row count again. Only ids and digests are ordered: pages are read where they lie. Words count only what is positive and tags what is negative of their odds. Without labelled pages all
    words weigh the same, and so do all tags.
    """
    send_package(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            tally: dict[str, list[int]] = {}
            for page in batch.column("html").to_pylist():
                for feature, text, labelled in tokens(page):
                    pair = tally.setdefault(feature, [0, 0])
                    pair[labelled > 0] += len(text.split()) if feature in ("word", "link") else 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tally), pa.string()), pa.array([p[0] for p in tally.values()], pa.int64()),
                 pa.array([p[1] for p in tally.values()], pa.int64())], ["feature", "outside", "inside"])

    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select(
        F.col("page_id").cast("string").alias("page"), F.col("html").cast("string"), F.sha2(F.col("html").cast("string").cast("binary"), 256).alias("digest"))
    chosen = marked.select("page", "digest").distinct().orderBy(F.xxhash64("page"), "page", "digest").limit(sample).select(
        F.col("page").alias("own_page"), F.col("digest").alias("own_digest"))
    labelled = marked.join(F.broadcast(chosen), F.col("page").eqNullSafe(F.col("own_page")) & (F.col("digest") == F.col("own_digest")), "left_semi")
    rows = labelled.select("html").mapInArrow(count, "feature string, outside long, inside long").groupBy(
        "feature").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).orderBy(
        F.expr("outside + inside").desc(), "feature").limit(FEATURES).collect()
    total_out = sum(r["outside"] for r in rows) + 1
    total_in = sum(r["inside"] for r in rows) + 1
    weights = {"word": 1.0, "link": 0.5, "": -0.02}
    for r in rows:
        odds = math.log((r["inside"] + 0.5) / total_in) - math.log((r["outside"] + 0.5) / total_out)
        low, high = WORD if r["feature"] in ("word", "link") else TAG
        weights[r["feature"]] = min(max(odds, low), high)
    return weights


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; null and empty pages have an empty text.

    Malformed and cut pages are read as far as they go: an unclosed element lasts to the end. Pages of any length take
    time in proportion to it, however their tags are nested or unmatched. Repeated rows give repeated results. Other columns are ignored; nothing is shuffled.
    """
    send_package(pages.sparkSession)
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(p, weights) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), column_or_null(pages, "url", "string").alias("url"),
                        F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
