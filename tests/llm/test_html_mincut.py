import html
import itertools
import random
import re

import pytest

from foldwise.llm.html_mincut import extract_text, main_text, minimum_cut

from .cases import clash


def test_cut_equals_enumeration():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        price = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(cost, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: E731, B023
        best = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert price(minimum_cut(cost, edges)) == pytest.approx(best, abs=1e-6)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p", ""), ("<p>", ""), ("   \n ", ""), ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""), ("a &lt; b &#233; &amp;amp; <b>x", "a < b é &amp; x"),
    ("<article><h1>T</h1><p>One <i>two</i>\n three<br>four</p><p>five<!-- no --> six<div class='ad'>Buy this now</div><p>seven</article><footer>&copy; us</footer>", "T\nOne two three four\nfive six\nseven"),
    ("<nav><a href=/a>Home</a> <a href=/b>News</a></nav><main><p>Text of the page that goes on for a while.</p></main><aside>Read also this other long article of ours, please</aside>", "Text of the page that goes on for a while."),
    ("<article><p>Long text of an article, for all.</p></article><section id=comments><p>I liked this article so much that I write this comment of many words.</p></section>", "Long text of an article, for all."),
    ('<article title="a > b"><p data-x=\'"\'>A text with quotes in tags.</p></article>', "A text with quotes in tags.")])
def test_pages(page, text):
    assert main_text(page)[0] == text


def test_unbalanced_quotes_take_linear_time():
    assert main_text("<a href=\"x>" * 20000)[0] == ""
    assert "words" in main_text("<div>" * 3000 + "<p>Some words in a deep place of the page, for all to read." + "</div>" * 3000)[0]


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.split(r"</?(?:p|h1|div)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", x)).split()) for x in inside]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>Some words on a page without an id.</p>"), (4, "u", "<article><p>" + "word " * 60000 + "</p></article>")]
    pages = clash(spark.createDataFrame([*rows, rows[2]], "page_id long, url string, html string"))
    got = extract_text(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in sorted(got, key=lambda r: (r["page_id"] or 0))] == [(None, 35), (None, 35), (1, 0), (2, 0), (4, 299999)]
    assert extract_text(pages.limit(0)).count() == 0
