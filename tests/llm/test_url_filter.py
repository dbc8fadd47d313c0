import random

from boardframe.llm import url_filter as u
from boardframe.llm.components import connected_components
from boardframe.llm.queries import RULES
from boardframe.llm.store import Scratch


def judge(url):
    """Host, path, rule and its verdict, plainly."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((i for i, c in enumerate(path) if c in "?#"), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://A.Example.com/en/7?x", "http://example.com/en/1#t", "https://www.example.net/de/8/a", "http://net/de/", "x://org/es/?q", "http://notorg/es/", "http://example.com?en/", "http://b.com/en/\n9", "http://example.com/EN/7", "://com/en/", "a://b://com/en/"]


def test_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(i, x, None, "h") for i, x in enumerate(URLS)] + [(0, URLS[4], None, "h"), (None, URLS[5], "", "h")], "page_id long, url string, html string, host string")
    for most in (200, 2):
        monkeypatch.setattr(u, "PLAN_RULES", most)
        rows = u.url_filter(pages, RULES).collect()
        assert len(rows) == len(URLS) + 2
        for r in rows:
            url = URLS[5] if r["page_id"] is None else URLS[4] if r["page_id"] == 0 and r["host"] else URLS[r["page_id"]]
            host, path, rule, verdict = judge(url)
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert u.url_filter(pages.where("false"), RULES).count() == 0
    assert {r["verdict"] for r in u.url_filter(pages, []).collect()} == {"allow"}


def test_aliases(spark):
    link = lambda to: f"<html><head><LINK rel='canonical' href='{to}'></head>"
    pages = [
        (1, "http://good.example.de/a", link("http://bad.com/en/x")),  # an alias that was never fetched is blocked
        (2, "https://good.example.de/b", '<meta http-equiv="Refresh" content="0; url=/a">'),  # through page 1
        (3, "http://other.example.de/c", link("//free.example.com/en/7")),
        (4, "http://free.example.com/en/7", link("http://worse.com/en/y")),  # its own rule allows
        (5, "http://worse.com/en/y", None),
        (6, "http://alone.example.de/z", "<link rel=stylesheet href=a>"),
        (7, "http://good.example.de/dir/p", link("../q?x=1&amp;y=2")),
    ]
    more = [("http://seed.example.de/s", "http://alone.example.de/z"), ("http://seed.example.de/s", "http://org/es/1"), (None, "http://a.b/"), ("http://a.b/", "http://a.b/#x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["reason"]) for r in u.url_filter(frame, RULES, spark.createDataFrame(more, "a string, b string")).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("allow", "rule"), 5: ("block", "rule"), 6: ("block", "alias"), 7: ("allow", "default")}


def test_base_addresses_and_several_links(spark):
    """A relative link is seen from the base address; every link of a page counts."""
    pages = [
        (1, "http://one.de/x/y", "<base target=_top href='http://bad.org/es/'><link rel=canonical href='p'>"),  # http://bad.org/es/p is blocked
        (2, "http://two.de/x/y", "<base href=sub/ ><meta http-equiv=refresh content='0;url=../z'><link rel='canonical' href='http://fine.de/'>"),
        (3, "http://two.de/x/z", None),
        (4, "http://three.de/", "<link rel='canonical' href='http://fine.de/4'><link href='http://bad.org/es/q' rel='canonical'>"),
        (5, "http://fine.de/4", ""),
        (6, "http://six.de/x", "<base href='//com/en/'><link rel=canonical href='#top'>"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["component"]) for r in u.url_filter(frame, RULES).collect()}
    assert got == {1: ("block", "bad.org/es/p"), 2: ("allow", "fine.de/"), 3: ("allow", "fine.de/"), 4: ("block", "bad.org/es/q"), 5: ("block", "bad.org/es/q"), 6: ("block", "com/en/")}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(None, 1), (5, 5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in rows.collect()} == {x: top(x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}
