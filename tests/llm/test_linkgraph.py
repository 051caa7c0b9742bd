import pytest

from textloom.llm.linkgraph import RULES, filter_urls, host_edges

PAGES = "page_id bigint, url string, html string, host string"
ROWS = [
    (1, "HTTP://A.Good.org/fr/x?y#z", '<a href="https://hub.com/a">l</a><a href="//hub.com/b">', "clash"),
    (2, "https://hub.com/x", '<a HREF=http://leaf.com>', "clash"),
    (3, "https://bad.net", "", None),
    (4, "https://bad.net/", None, None),
    (5, "https://spam.com/p", '<a href="http://bad.net/q"> <img src="http://bad.net/i.png">', None),
    (6, "https://leaf.com/p#a://b/c", "", None),
    (7, None, "", None),
    (8, "no scheme", "", None),
    (9, "https://www.example.net/en/1", "", None),
    (10, "https://example.net/de/1", "", None),
    (11, "https://x.example.com/de/", "", None),
    (12, "https://notexample.com/de/", "", None),
    (13, "ftp://lonely.test/a", "", None),
    (13, "ftp://lonely.test/a", "", None),
]


def brute_rule(host, path):
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def brute_rank(edges, seeds, damping=0.85, rounds=12):
    rank = dict(seeds)
    for _ in range(rounds):
        new = {h: s * (1 - damping) for h, s in seeds.items()}
        for src, dst, w in edges:
            if src in rank:
                new[dst] = new.get(dst, 0) + damping * rank[src] * w / sum(x for s, _, x in edges if s == src)
        rank = new
    return rank


def test_rules_hosts_and_paths(spark):
    got = filter_urls(spark.createDataFrame(ROWS, PAGES)).collect()
    assert len(got) == len(ROWS)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.good.org", "/fr/x", "org/fr/", "allow")
    assert (by[3].host, by[3].path, by[3].rule) == ("bad.net", "", None) and by[3].verdict == "block"
    assert (by[7].host, by[7].path, by[7].verdict) == ("", "", "allow") and by[8].host == ""
    assert by[6].path == "/p"
    for r in got:
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)


def test_scores_equal_brute_force(spark):
    frame = spark.createDataFrame(ROWS, PAGES)
    by = {r.host: r for r in filter_urls(frame).collect()}
    rows = filter_urls(frame).collect()
    edges = [tuple(r) for r in host_edges(spark.createDataFrame([(r.host, h) for r, (_, _, h, _) in zip(sorted(rows, key=lambda r: r.page_id), sorted(ROWS, key=lambda r: r[0]))], "host string, html string")).collect()]
    assert ("a.good.org", "hub.com", 1.0) in edges and ("spam.com", "bad.net", 1.0) in edges and ("a.good.org", "good.org", 1.0) in edges
    for kind, column, flow in (("allow", "trust", edges), ("block", "distrust", [(d, s, w) for s, d, w in edges])):
        seeds = {}
        for r in rows:
            if r.rule and brute_rule(r.host, r.path)[1] == kind:
                seeds[r.host] = seeds.get(r.host, 0) + 1
        total = sum(seeds.values())
        want = brute_rank(flow, {h: s / total for h, s in seeds.items()})
        for h, r in by.items():
            assert r[column] == pytest.approx(want.get(h, 0), abs=1e-9)
    assert by["spam.com"].verdict == "block" and by["leaf.com"].verdict == "allow" and by["hub.com"].verdict == "allow" and by["lonely.test"].verdict == "allow"


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0
