"""Url rules and alias classes against plain loops."""

import re

import numpy as np
import pytest

from basketspark.llm import url_rules
from basketspark.llm.components import components
from basketspark.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, rule string, verdict string"


def loop_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def split_url(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def loop_rule(host, path, rules):
    fits = [(len(h + (p or "")), v == "allow", h + (p or ""), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return max(fits)[2:] if fits else (None, None)


def loop_judge(rows, links, rules):
    named = [(url_rules.resource(a), url_rules.resource(b)) for a, b in links]
    root = loop_components([(a, b) for a, b in named if a and b and a != b])
    bad = {root[x] for x in root if loop_rule(*split_url("http://" + x), rules)[1] == "block"}
    out = []
    for page, url in rows:
        host, path = split_url(url)
        rule, says = loop_rule(host, path, rules)
        method = "block" if root.get(url_rules.resource(url)) in bad else "allow"
        out.append((page, host, path, rule, says or method))
    return out


def judged(spark, rows, rules=URL_RULES, redirects=None):
    pages = spark.createDataFrame([(p, u, h, "clash", "clash", "clash") for p, u, h in rows], PAGES)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    logged = None if redirects is None else spark.createDataFrame(redirects, "url string, target string")
    got = url_rules.judge_urls(pages, table, logged)
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str)


def test_components_of_paths_stars_and_hubs(spark, monkeypatch):
    monkeypatch.setattr("basketspark.llm.components.HUB_LINKS", 5)
    r = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(200, 260)] + [(500, 600 + i) for i in range(80)] + [(610, 2000), (2000, 1)]
    links += [(int(a), int(b)) for a, b in r.integers(3000, 3400, (150, 2))] + [(7, 7), (None, 8), (9, None), (500, 601)]
    got = {x.v: x.root for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == loop_components([(a, b) for a, b in links if a is not None and b is not None and a != b])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rules_alone(spark):
    urls = [
        "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/fr/", "http://net/", "http://net", "http://a.net?x/",
        "http://badnet/", "http://x.example.com/de/a#b", "http://example.com/den", "http://example.com/DE/", "ftp://q.org/fr/x?y=1",
        "http://org.fr/fr/", "no scheme net/", None, "", "://net/x", "http://a.b.c.d.e.f.g.example.net/en/x/../y", "http://example.net:80/en/",
        "http://u@example.net/en/", "http://É.net/", "http://" + "x." * 3000 + "net/" + "y" * 100_000, "a://b://c.net/", "http://a.net/\n/x",
    ]
    rows = [(i, u, "<p>x</p>") for i, u in enumerate(urls)] + [(0, urls[0], None), (None, urls[0], ""), (0, urls[0], None)]
    want = sorted(loop_judge([r[:2] for r in rows], [], URL_RULES), key=str)
    assert judged(spark, rows) == want


def test_ties_nulls_and_no_rules(spark):
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("block", "com", None), ("allow", None, "/"), ("block", "b.com", ""), (None, "c.com", "/")]
    rows = [(i, u, None) for i, u in enumerate(["http://a.com/x", "http://a.com/y", "http://b.com", "http://c.com/"])]
    known = [r for r in rules if r[0] and r[1]]
    assert judged(spark, rows, rules) == sorted(loop_judge([r[:2] for r in rows], [], known), key=str)
    assert {r[4] for r in judged(spark, rows, [])} == {"allow"}
    assert judged(spark, []) == []


def canonical(to):
    return f'<html><head><LINK href="{to}" data-x="1" rel="Canonical"></head></html>'


def refresh(to):
    return f"<meta http-equiv=refresh content='0; URL=\"{to}\"'>"


def test_blocks_reach_aliases_but_not_allowed_urls(spark):
    rows = [
        (1, "http://p.org/en/1?utm_source=a#top", canonical("https://bad.net/x")),  # names a blocked url that no page has
        (2, "https://p.org/en/1", None),  # the same resource as 1
        (3, "http://q.org/a/b", refresh("../en/1")),  # another host's page
        (4, "http://p.org/en/9", refresh("1")),
        (5, "http://p.org/fr/9", refresh("/en/1")),  # an allowing rule of its own
        (6, "http://z.org/", "<!-- " + canonical("http://p.org/en/1") + "-->"),
        (7, "http://z.org/s", "<script>'" + canonical("http://p.org/en/1") + "'</script>"),
        (8, "http://y.org/", canonical("http://z.org/s")),
        (9, "http://x.org/", canonical("mailto:bad@bad.net") + canonical("#top") + canonical("") + "<link rel=canonical>"),
        (10, "http://w.org/", canonical("//p.org/en/1?&amp;gclid=5")),
        (11, None, canonical("http://bad.net/x")),
        (12, "http://example.net/en/ok", canonical("http://v.org/")),
        (13, "http://v.org/", None),
        (14, "http://u.org/", "<!-- unclosed " + canonical("http://bad.net/x")),
        (15, "http://t.org/", "<link rel='next' href='http://bad.net/x'><meta name=refresh content='0;url=http://bad.net/x'>"),
        (16, "http://hub.org/", "<canonical" * 50_000),
    ]
    verdicts = {r[0]: r[4] for r in judged(spark, rows)}
    assert {k for k, v in verdicts.items() if v == "block"} == {1, 2, 4, 10}
    assert verdicts == {r[0]: r[4] for r in loop_judge([r[:2] for r in rows], [
        (rows[0][1], "https://bad.net/x"), (rows[2][1], "http://q.org/en/1"), (rows[3][1], "http://p.org/en/1"),
        (rows[4][1], "http://p.org/en/1"), (rows[7][1], "http://z.org/s"), (rows[9][1], "http://p.org/en/1"),
        (rows[11][1], "http://v.org/"),
    ], URL_RULES)}


def test_redirect_log_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr("basketspark.llm.components.HUB_LINKS", 8)
    r = np.random.default_rng(8)
    urls = [f"http://h{i % 40}.{'net' if i % 97 == 0 else 'com'}/{'en' if i % 3 else 'fr'}/{i}" for i in range(400)]
    log = [(urls[int(a)], urls[int(b)]) for a, b in r.integers(0, 400, (120, 2))] + [(u, urls[5]) for u in urls[100:140]]
    log += [(None, urls[0]), (urls[1], None), (urls[2], urls[2])]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[5], None)] * 30
    want = sorted(loop_judge([r[:2] for r in rows], [x for x in log if x[0] and x[1]], URL_RULES), key=str)
    assert judged(spark, rows, redirects=log) == want
    assert {v[4] for v in want if v[3] is None} == {"allow", "block"}


@pytest.mark.parametrize(
    "url, name",
    [
        ("HTTP://A.com:80", "a.com/"),
        ("https://a.com:443/x/./y/../z?b=1&utm_campaign=q&a=2#f", "a.com/x/z?b=1&a=2"),
        ("http://a.com/..", "a.com/"),
        ("http:///x", None),
        ("a.com/x", None),
    ],
)
def test_resources(url, name):
    assert url_rules.resource(url) == name
