"""Main text: the scan against all runs, and pages of many shapes."""

import random
import time

import pytest

from loanward.llm import html
from loanward.llm.html import best_run, extract, fit, main_text, whole_elements
from tests.llm.conftest import table

WEIGHTS = {"word": 1.0, "link": 0.5, "": -0.02}


def test_scan_against_all_runs():
    r = random.Random(4)
    for _ in range(200):
        scores = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(r.randrange(12))]
        begin, end = best_run(scores)
        best = max([sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)], default=0)
        assert sum(scores[begin:end]) == max(best, 0)


CASES = [
    ("", ""),
    ("just words", "just words"),
    ("<p>a\n  b</p><p>c", "a b\nc"),
    ("<article><h1>T</h1><p><b>x<br><p>y &amp; z&#8364;</article>", "T\nx\ny & z€"),
    ("<nav><a href=/>Home</a></nav><main><p>one</p></main><footer>f</footer>", "one"),
    ("<script>var t='</p>';x<y</script><style>p{}</style><p>text</p>", "text"),
    ("<div class='ad'>buy</div><article><p>t</p><aside>s</aside><p>u</p></article>", "t\nu"),
    ("<article><p>t</p></article><section id=comments><p>first!</p><div>no</div></section>", "t"),
    ("<div class='cookie-notice'><p>we use <b>cookies</b></p></div><p>t</p>", "t"),
    ("<form><p>name</p><input name=q></form><article>t<!-- <p>no</p> --></article>", "t"),
    ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>t</p></article>", "T\nt"),
    ("<nav><ul><li>Home<article><p>t</p></article>", "t"),
    ("<p title='a>b'>t</p>", "t"),
    ("<article><p>cut off here &am", "cut off here &am"),
    ("<article><p>cut off in <foot", "cut off in"),
    ("<div hidden>no</div><p>yes</p><P CLASS=x>Two</P>", "yes\nTwo"),
    ("<article><ul><li>a</li><li>b</li></ul><table><tr><td>c</td><td>d</td></tr></table></article>", "a\nb\nc\nd"),
    ("<p>a<em>b</em>c <a href=x>link</a>.</p>", "abc link."),
    ("<article><p>t</p></article><section id=comments><article><p>first</p></article></section>", "t"),
    ("<article><p>t</p><article class=comment><p>no</p></article></article>", "t"),
    ("<div class='page has-sidebar'><p>t</p><div class=site-header>no</div></div>", "t"),
    ("<head><title>x</title><body><p>t", "t"),
    ("<div class=sidebar><p>s</p></div><div class='downloads shadow'><p>t</p></div>", "t"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert main_text(page, WEIGHTS) == text


def test_whole_table(spark, small):
    pages = table(spark, small, "pages")
    rows = {r.page_id: r for r in extract(pages).collect()}
    assert len(rows) == pages.count() and set(rows[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    for p in pages.collect():
        text = rows[p.page_id].text
        assert rows[p.page_id].n_chars == len(text)
        assert "track(" not in text and "©" not in text and "<" not in text.replace("<3", "")
    weights = fit(pages)
    assert weights["word"] > 0 > weights["nav"] if "nav" in weights else weights["word"] > 0
    assert all(v < 0 for k, v in weights.items() if k not in ("word", "link"))


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (3, "u", "<p>t" * 20000), (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "html AS text", "1 AS n_chars")
    found = extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in found) == [("1", 0), ("3", 39999), ("4", 1), ("4", 1), ("None", 0)]
    assert extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page, want", [
    ("<article><p class=notice>n<p>Article text</article>", "Article text"),
    ("<article><p class=notice>n <b>b<div>Article</div></article>", "Article"),
    ("<article><ul><li class=share>s<ul><li>inner</ul><li>b</ul><p>t</article>", "b\nt"),
    ("<article><ul><li class=share>s</ul><p>t</article>", "t"),
    ("<article><table><tr><td class=ad>s<td>c<tr><td class=ad>x</table><p>t</article>", "c\nt"),
    ("<article><dl><dt class=ad>s<dd>d</dl></article>", "d"),
    ("<main><section><aside>s</section><p>t</main>", "t"),
    ("<div class=ad>s<article><p>t</article>", "t"),
    ("<aside>s<main><p>t</main>", "t"),
    ("<p>t<p>u<div class=ad>s</p>s</div>", "t\nu"),
    ("<div class=related><article>teaser</article></div><article>t</article>", "t"),
    ("<p>t <span class=share>s</p><p>u", "t\nu"),
])
def test_what_is_skipped_ends_without_its_end_tag(page, want):
    assert main_text(page, WEIGHTS) == want


#: Weights as a fit gives them: words gain much, and frequent tags of the frame cost as much.
FITTED = {"word": 3.0, "link": 0.8, "": -0.02, "div": -3.0, "nav": -3.0, "article": -3.0, "body": -3.0, "p": -0.001}
_HEAVY = ("<table>" + "<tr><td></td><td></td></tr>" * 300 + "</table>", "<ul>" + "<li><i></i></li>" * 400 + "</ul>",
          "<div><figure><img></figure></div>" * 200)


@pytest.mark.parametrize("heavy", _HEAVY)
@pytest.mark.parametrize("element", ["article", "main"])
@pytest.mark.parametrize("place", [0, 1, 2])
def test_nothing_of_a_labelled_element_is_lost_to_heavy_markup(heavy, element, place):
    parts = ["<p>Short intro.</p>", "<p>The long second part, with more words.</p>"]
    parts.insert(place, heavy)
    page = f"<body><div>Menu</div><{element}>{''.join(parts)}</{element}><div>Copyright</div></body>"
    for weights in (FITTED, WEIGHTS):
        text = main_text(page, weights).split("\n")
        assert "Short intro." in text and "The long second part, with more words." in text


def test_runs_are_extended_to_the_nearest_element_they_touch():
    labels = [0, 1, 2, 2, 2, 1, 1, 0, 2, 2]
    assert whole_elements(labels, 3, 4) == (2, 5)
    assert whole_elements(labels, 5, 6) == (1, 7)
    assert whole_elements(labels, 0, 3) == (0, 5)
    assert whole_elements(labels, 3, 9) == (2, 10)
    assert whole_elements(labels, 0, 1) == (0, 1)


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "</i>" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<div class=ad>" + "<div>" * n + "</p>" * n,
    lambda n: "<article class=comment>" * n, lambda n: "<div class=ad>" + "<article>" * n, lambda n: "<b " * n + '"',
    lambda n: "<a href='x" * n, lambda n: "<ul class=ad>" * n + "<li class=ad><ul>" * n, lambda n: "<p class=ad>" + "<button><p>" * n,
    lambda n: "<x%d>" * n % tuple(range(n)), lambda n: "<!-- " * n, lambda n: "<script>" * n, lambda n: "</" * n])
def test_time_is_in_proportion_to_the_page(make):
    def least(n):
        page, runs = make(n), []
        for _ in range(3):
            start = time.process_time()
            main_text(page, WEIGHTS)
            runs.append(time.process_time() - start)
        return min(runs)
    assert least(40_000) < 3 * least(20_000) + 0.1


def test_a_stray_quote_ends_with_its_tag():
    assert main_text('<p>a</p><p class="x>b</p><p>c</p>', WEIGHTS) == "a\nb\nc"


def test_fit_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    rows = [(i % 7 if i % 3 else None, f"<nav>{'m ' * (i % 5)}</nav><article><h1>t</h1><p>{'w ' * i}</p></article><x{i}></x{i}>") for i in range(60)]
    pages = spark.createDataFrame(rows + rows[:5], "page_id long, html string")
    fits = [fit(p, 10) for p in (pages, pages.repartition(7), pages.orderBy("html").coalesce(1))]
    assert fits[0] == fits[1] == fits[2] and fits[0]["word"] > 0
    monkeypatch.setattr(html, "FEATURES", 4)
    assert len(fit(pages, 10)) <= 4 + 3 and fit(pages, 10) == fit(pages.repartition(5), 10)
