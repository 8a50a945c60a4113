"""op13 against plain loops over hosts; its SQL is in test_oracles."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataspan.llm import queries, urls

from ..compare import assert_same, connect

SCHEMA = "page_id long, url string, html string, verdict string"
ODD = [
    (1, None, None, "x"), (2, "", "<a href='//x.org'>", "x"), (3, "no scheme.org/a", "", "x"), (4, "http://ORG/", None, "x"), (5, "http://a.org", None, "x"), (6, "http://a.org?x=/es/", None, "x"),
    (7, "http://example.org/es/1#a?b", "", "x"), (8, "https://deep.www.example.org/en/1234?q", "", "x"), (9, "http://notexample.org/es/", "", "x"), (10, "http://x.com/fr/a://b/c", "", "x"),
    (11, "http://x.com/de/", "", "x"), (11, "http://x.com/de/", "", "x"), (12, "http://user@10.0.0.1:80/de/", '<a HREF = "https://X.com/">', "x"), (13, "a\nb://h.net/p\nq", "", "x"), (14, "http://y.com/es/", "<a href=//x.com>" * 3, "x"),
    (None, "http://y.com/es/", "", "x"), (15, "http:///path", "", "x"), (16, "http://good.net/", '<a href="http://a.org/1">', "x"), (17, "http://w.a.org/", '<a href="http://good.net:81/1"><a href="/local"><link href="ftp://b.good.net">', "x"),
    (18, "http://b.good.net/", "", "x"), (19, "http://farm.net/", '<a href="http://x.com/de/">' * 5, "x"),
]


def plain_scores(pages, rounds=urls.ROUNDS):
    """trust and distrust by host, from (host, verdict by rule or None, linked hosts)."""
    w = Counter((h, d) for h, _, links in pages if h for d in links if d != h)
    for h in {x for e in w for x in e} | {h for h, _, _ in pages if h}:
        labels = h.split(".")
        if any("a" <= c <= "z" for c in labels[-1]):
            for i in range(len(labels) - 2):
                w[".".join(labels[i:]), ".".join(labels[i + 1 :])] |= 0
    tree = {e for e in w if e[0].endswith("." + e[1]) and e[0].count(".") == e[1].count(".") + 1 and "." in e[1] and any("a" <= c <= "z" for c in e[1].rsplit(".", 1)[1])}
    for a, b in tree:
        w[a, b] += 1
        w[b, a] += 1
    out = []
    for want, flip in (("allow", False), ("block", True)):
        ways = defaultdict(dict)
        for (a, b), n in w.items():
            if n:
                ways[b if flip else a][a if flip else b] = n
        n = Counter(h for h, v, _ in pages if h and v == want)
        seed = {h: urls.MASS * k // sum(n.values()) for h, k in n.items()}
        score = dict(seed)
        for _ in range(rounds):
            inflow = Counter()
            for h, s in score.items():
                for d, k in ways[h].items():
                    inflow[d] += s * k // sum(ways[h].values())
            score = {h: (15 * seed.get(h, 0) + 85 * inflow[h]) // 100 for h in {*seed, *inflow}}
        out.append(score)
    return out


def test_odd_pages(spark):
    pages = spark.createDataFrame(ODD, SCHEMA)
    rows = urls.judge(pages, queries.URL_RULES).collect()
    assert len(rows) == len(ODD)
    by = {r.page_id: r for r in rows}
    said = {i: (by[i].host, by[i].path, by[i].rule) for i in by}
    assert said[1] == said[2] == said[3] == ("", "", None) and by[1].verdict == by[3].verdict == "allow"
    assert said[4] == ("org", "/", "org/") and said[5] == said[6] == ("a.org", "", None)
    assert said[7] == ("example.org", "/es/1", "example.org/es/") and said[8] == ("deep.www.example.org", "/en/1234", "example.org/en/1")
    assert said[9] == ("notexample.org", "/es/", "org/") and said[10] == ("x.com", "/fr/a://b/c", "com/fr/")
    assert said[13] == ("h.net", "/p\nq", None) and said[15] == ("", "/path", None) and by[15].verdict == "allow"
    links = {12: ["x.com"], 14: ["x.com"] * 3, 16: ["a.org"], 17: ["good.net:81", "b.good.net"], 19: ["x.com"] * 5}
    plain = [(r.host, r.verdict if r.rule else None, links.get(r.page_id, [])) for r in rows]
    trust, distrust = plain_scores(plain)
    for r in rows:
        assert (r.trust, r.distrust) == (trust.get(r.host, 0), distrust.get(r.host, 0)), r
        if not r.rule:
            assert r.verdict == ("block" if r.distrust > r.trust else "allow"), r
    # Who links to blocked hosts is distrusted, who is linked from trusted ones is trusted.
    assert by[19].verdict == "block" and by[19].distrust > 0 == by[19].trust and by[18].trust > 0


def test_sql_on_odd_pages(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert_same(queries.op13_url_filter(spark, str(tmp_path)), queries.oracle_sql()["op13_url_filter"], con)


def test_empty_and_rules(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert urls.judge(none, queries.URL_RULES).count() == 0
    assert urls.judge(spark.createDataFrame(ODD, SCHEMA), []).filter("verdict <> 'allow' or trust <> 0").count() == 0
    with pytest.raises(ValueError):
        urls.rule_of([("a", "/", "allow")] * 1001, F.lit("a"), F.lit("/"))
