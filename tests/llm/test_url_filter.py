from __future__ import annotations

import re
from collections import defaultdict

import pytest

from liftwise.llm.queries import URL_RULES
from liftwise.llm.url_filter import host_links, judge_urls
from tests.llm.conftest import with_clashes

PAGES = "page_id long, url string, html string"


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    best = None
    for what, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, what)
    return host, path, *(best or (None, None))


def test_rules(spark):
    urls = [
        "http://example.com/en/1", "http://www.example.com/en/2", "https://WWW.Example.COM/en/x?q#f", "http://a.www.example.com/en/", "http://m.example.com/en",
        "http://m.example.com/de/3", "http://example.com", "http://example.com?x=/en/", "ftp://x.net/es/1", "http://x.net/esx", "http://net/fr/", "http://xnet/fr/",
        "http://x.org/1", "no scheme/com/", "", None, "http:///en/", "a://b://c.com/", "http://y.com:80/", "http://İ.com/Path/UP", "http://x.net/es/\nnext",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    rows = {r["page_id"]: r for r in judge_urls(with_clashes(pages), URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), u
        if verdict:
            assert rows[i]["verdict"] == verdict


def plain_propagation(seeds, links, damping=0.85, steps=400):
    hosts = set(seeds) | {h for e in links for h in e}
    out, into = defaultdict(list), defaultdict(list)
    for a, b in links:
        out[a].append(b)
        into[b].append(a)
    t, d = ({h: seeds.get(h, (0, 0))[k] for h in hosts} for k in (0, 1))
    for _ in range(steps):
        nt = {h: seeds.get(h, (0, 0))[0] + damping * sum(t[a] / len(out[a]) for a in into[h]) for h in hosts}
        nd = {h: seeds.get(h, (0, 0))[1] + damping * sum(d[b] / len(into[b]) for b in out[h]) for h in hosts}
        t, d = nt, nd
    return t, d


def test_propagation_against_brute_force(spark):
    rules = (("allow", "good.com", "/"), ("block", "bad.net", "/"))
    link = {
        "good.com": ["a.org", "b.org"], "a.org": ["b.org", "good.com"], "b.org": ["c.org"], "c.org": [], "d.org": ["bad.net"], "e.org": ["d.org", "a.org"],
        "f.org": ["d.org"], "bad.net": ["f.org", "g.org"], "g.org": [],
    }
    rows = []
    for i, (h, to) in enumerate(link.items()):
        html = "".join(f'<a HREF = "https://user@{x.upper()}:443/p?q">x</a><a href=\'//{x}\'>y</a><a href="/local">z</a>' for x in to)
        rows.append((i, f"http://{h}/{i}", html))
    pages = spark.createDataFrame(rows, PAGES)
    got_links = {(r["src"], r["dst"].split(":")[0]) for r in host_links(pages).collect()}
    want_links = [(a, b) for a, to in link.items() for b in to]
    assert got_links == set(want_links)
    t, d = plain_propagation({"good.com": (1, 0), "bad.net": (0, 1)}, want_links)
    got = {r["host"]: r for r in judge_urls(pages, rules, tolerance=1e-9, most_steps=200).collect()}
    for h in link:
        assert got[h]["trust"] == pytest.approx(t[h], abs=1e-6) and got[h]["distrust"] == pytest.approx(d[h], abs=1e-6)
        if h not in ("good.com", "bad.net"):
            assert got[h]["verdict"] == ("block" if d[h] - t[h] >= 0.5 else "allow")
    assert got["d.org"]["verdict"] == "block" and got["c.org"]["verdict"] == "allow"


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], PAGES), URL_RULES).count() == 0
    repeated = spark.createDataFrame([(1, "http://x.net/es/1", "<p>"), (1, "http://x.net/es/1", "<p>"), (None, None, None)], PAGES)
    assert judge_urls(repeated, URL_RULES).count() == 3


def test_a_slow_cycle_is_run_to_the_tolerance(spark):
    """Two hosts that link to each other: the scores near 1 / (1 - damping) by small steps."""
    rules = (("allow", "a.com", "/"), ("allow", "b.com", "/"))
    rows = [(1, "http://a.com/", '<a href="http://b.com/">'), (2, "http://b.com/", '<a href="http://a.com/">')]
    got = judge_urls(spark.createDataFrame(rows, PAGES), rules).collect()
    assert all(abs(r["trust"] - 1 / 0.15) < 1e-4 * 0.85 / 0.15 for r in got)


def test_stopping_early_is_an_error(spark):
    rows = [(1, "http://a.com/", '<a href="http://b.com/">'), (2, "http://b.com/", '<a href="http://a.com/">')]
    with pytest.raises(RuntimeError, match="still move"):
        judge_urls(spark.createDataFrame(rows, PAGES), (("allow", "a.com", "/"),), most_steps=2)


def test_ports_and_users_are_no_part_of_a_host_in_the_graph(spark):
    rules = (("block", "seed.net", "/"),)
    rows = [
        (1, "http://me@bad.org:8080/x", '<a href="http://seed.net:80/">'),
        (2, "http://near.org/", '<a href="http://BAD.org:8080/">'),
        (3, "http://seed.net/", None),
        (4, "http://bad.org/", ""),
    ]
    links = {tuple(r) for r in host_links(spark.createDataFrame(rows, PAGES)).collect()}
    assert links == {("bad.org", "seed.net"), ("near.org", "bad.org")}
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got[1]["host"] == "me@bad.org:8080" and got[1]["distrust"] == got[4]["distrust"] == pytest.approx(0.85, abs=1e-3)
    assert got[1]["verdict"] == got[4]["verdict"] == got[2]["verdict"] == "block"
