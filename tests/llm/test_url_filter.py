import random
import re

import pytest

from foldwise.llm.queries import BLOCK_GLOBS, URL_RULES
from foldwise.llm.url_filter import GlobAutomaton, Rule, judge_urls

from .cases import clash


def as_regex(glob):
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob)))


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]  # several words of states
    urls = ["".join(rng.choice("ab/é.") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "a" * 5000]
    found = GlobAutomaton(globs).match([u.encode() for u in urls])
    for u, g in zip(urls, found, strict=True):
        assert g == next((i for i, x in enumerate(globs) if as_regex(x).fullmatch(u)), -1), u


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.text.split("/")[0] or host.endswith("." + r.text.split("/")[0])) and path.startswith(r.text[r.text.index("/"):])]
    if fits:
        r = max(fits, key=lambda r: len(r.text))
        return host, path, r.text, r.verdict
    return host, path, None, "block" if any(as_regex(g).fullmatch(host + path) for g in BLOCK_GLOBS) else "allow"


def test_verdicts_and_edge_cases(spark):
    urls = [None, "", "no scheme/x.net/", "http://a.net/", "http://A.NET", "http://b.example.net/en/1?x#y", "http://example.net/en", "http://xexample.com/de/", "https://www.EXAMPLE.com/de/1",
            "http://x.org/fr/", "http://x.org/a.net/", "http://adult-x.org/p", "http://m.casino.org", "x://y://z.net/", "http://é.org/é", "http://a.org/" + "b" * 50000, "http://u@a.net:80/", "http://a.net/", "http://\n.net/\n"]
    pages = clash(spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.net/")], "page_id long, url string"))
    got = judge_urls(pages, URL_RULES, BLOCK_GLOBS).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        if r["page_id"] is not None:
            assert tuple(r)[1:] == expected(urls[r["page_id"]]), urls[r["page_id"]]
    assert judge_urls(pages.limit(0), URL_RULES, BLOCK_GLOBS).count() == 0


@pytest.mark.parametrize("order", [0, 1])
def test_ties_go_to_block(spark, order):
    rules = [Rule("allow", "x.net/a"), Rule("block", "net/aaa")]
    pages = spark.createDataFrame([(1, "http://x.net/aaa")], "page_id long, url string")
    got = judge_urls(pages, rules[::-1] if order else rules).first()
    assert (got["rule"], got["verdict"]) == ("net/aaa", "block")
