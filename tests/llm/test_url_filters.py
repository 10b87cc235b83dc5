import re

import pytest
from pyspark.sql import functions as F

from cardflow.llm import url_filters as u
from cardflow.llm.queries import HOST_RULES

RULES = [u.host_path_rule(n, a) for n, a in HOST_RULES] + list(u.UNWANTED)


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def judged(spark, urls, rules=RULES):
    rows = u.judge(frame(spark, urls), rules).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


@pytest.mark.parametrize("url, want", [
    ("http://a.NET/x?y", ("a.net", "/x", "net/", "block")),
    ("http://Example.net/en/1#a", ("example.net", "/en/1", "example.net/en/", "allow")),
    ("http://m.example.net/EN/1", ("m.example.net", "/EN/1", "net/", "block")),
    ("http://badexample.com/de/", ("badexample.com", "/de/", None, "allow")),
    ("http://x.org/fr/", ("x.org", "/fr/", "org/fr/", "allow")),
    ("http://a.net", ("a.net", "", None, "allow")),
    ("ftp://b.net?x=/y", ("b.net", "", None, "allow")),
    ("m.casino-win.example.com/en", ("", "", None, "allow")),
    ("http://m.casino-win.example.com/en", ("m.casino-win.example.com", "/en", "casino", "block")),
    ("http://x://y.net/", ("x:", "//y.net/", None, "allow")),
    ("http://a.net/\nb", ("a.net", "/\nb", "net/", "block")),
    ("://h.net/", ("h.net", "/", "net/", "block")),
    (None, ("", "", None, "allow")),
    ("", ("", "", None, "allow")),
])
def test_contract(spark, url, want):
    assert judged(spark, [url]) == [want]


def test_wildcards_and_rules_without_token(spark):
    rules = [u.Rule("gif", "*.gif^", "block"), u.Rule("any", "*z*", "block", 1), u.Rule("mid", "/ads/*/x", "block", 2)]
    assert u.literal_tokens("*.gif^") == ["gif"] and u.literal_tokens("*z*") == []
    urls = ["http://h/a.gif", "http://h/a.gifs", "http://h/zoo", "http://h/ads/1/x", "http://h/ads1/x"]
    assert [r[2] for r in judged(spark, urls, rules)] == ["gif", None, "any", "mid", None]


def test_index_finds_what_all_rules_find(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    urls = [r.url for r in pages.collect()]
    compiled = [(r, re.compile(u.to_regex(r.pattern))) for r in RULES]
    for (host, path, rule, _), url in zip(judged(spark, urls), urls, strict=True):
        hits = [r for r, p in compiled if p.search(host + path)]
        best = max(hits, key=lambda r: (r.rank, len(r.name), r.name), default=None)
        assert rule == (best.name if best else None), url


def test_rarest_token_is_the_index():
    rule = u.host_path_rule("example.net/en/", "allow")
    assert u.rarest_tokens([rule], {"example": 9, "net": 4, "en": 7}) == ["net"]


def test_empty_table_clashing_columns_repeats_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "old", 3)] * 2, "page_id long, url string, host string, extra int")
    out = u.judge(df, RULES)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "rank", "verdict"]
    assert {(r.host, r.extra, r.verdict) for r in out.collect()} == {("a.net", 3, "block")} and out.count() == 2
    assert u.judge(df.limit(0), RULES).count() == 0
    assert u.judge(df, []).first().verdict == "allow"


def test_a_table_of_rules_judges_alike(spark, monkeypatch):
    rules = RULES + [u.Rule("gif", "*.gif^", "block"), u.Rule("any", "*z*", "block", 1), u.Rule("none", "/never/", "block", 9)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "http://h/zoo.gif"), (-3, "http://h/zoo.gif")], pages.schema))
    pages = pages.withColumns({"_best": F.lit(1), "subject": F.lit("s"), "token": F.lit("t")})
    want = sorted(map(repr, u.judge(pages, rules).collect()))
    monkeypatch.setattr(u, "LITERAL_RULES", 0)
    assert sorted(map(repr, u.judge(pages, rules).collect())) == want
    assert u.judge(pages.limit(0), rules).count() == 0


def test_fifty_thousand_rules(spark):
    rules = [u.host_path_rule(f"h{i}.net/p{i % 7}/", "block") for i in range(50_000)] + RULES
    urls = [f"http://www.h{i}.net/p{i % 5}/x" for i in range(0, 50_000, 997)]
    for i, (_, _, rule, verdict) in zip(range(0, 50_000, 997), judged(spark, urls, rules), strict=True):
        own = f"h{i}.net/p{i % 7}/" if i % 7 == i % 5 else "net/"
        assert (rule, verdict) == (own, "block")
