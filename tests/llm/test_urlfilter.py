"""URL filters against plain regular expressions."""

import re

import pytest

from rowmend.llm import urlfilter
from rowmend.llm.queries import QUERIES, URL_RULES

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/", "http://example.net/EN/1", "http://example.net", "http://net/", "http://internet/", "http://x.org/fr/a?b=1", "http://x.org/fr", "http://w.example.com/de/#t",
    "http://example.com:80/de/1", "no scheme example.net/en/", "://example.net/", "a://b://example.net/", "http://x.de/login", "http://x.de/login-help", "http://x.de/help/login/", "http://x.de/a?PHPSESSID=4", "http://x.de/a?phpsessid=4#y",
    "http://bestcasino24.de/", "http://x.de/casino/1", "http://x.de/wiki/casino", "http://pornx.co.uk/a", "http://xxx.de", "http://axxx.de/", "http://x.de/tag/a/b/page/2", "http://x.de/feed/", "http://x.de/feed/1", "http://x.de/\n/cart",
    "http://bücher.net/ä", "http://x.de/" + "a/" * 50_000 + "cart?x", "", None, "http://x.de/login", "http://x.de/login",
]


def plain(url):
    """(host, path, pattern, verdict) by running every rule."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path, after = re.match(r"[^?#]*", rest[len(host) :])[0], rest[len(host) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    if fit:
        rule = max(fit, key=len)
        return host, path, "||" + rule, URL_RULES[rule]
    best = []
    for verdict, patterns in urlfilter.PATTERNS.items():
        for p in patterns:
            body = "".join({"^": r"(?:[^0-9A-Za-z_.%-]|\Z)", "*": ".*"}.get(c, re.escape(c)) for c in p.strip("|"))
            if re.search((r"\A//(?:[^/?#]*\.)?" if p.startswith("||") else "") + body + (r"\Z" if p.endswith("|") else ""), "//" + host + after, re.S):
                best.append((-len(p), verdict != "allow", p, verdict))
    return host, path, *(min(best)[2:] if best else (None, "allow"))


def given(spark):
    return urlfilter.host_rules(spark, URL_RULES).unionByName(urlfilter.rules(spark, urlfilter.PATTERNS, tier=1))


def test_same_as_every_rule_on_every_url(spark):
    df = spark.createDataFrame([(i, u, "p", 1) for i, u in enumerate(URLS)], "page_id long, url string, path string, tier int")
    out = urlfilter.judge(df, given(spark))
    assert sorted(out.columns) == ["host", "page_id", "path", "pattern", "tier", "url", "verdict"]
    got = {r.page_id: (r.host, r.path, r.pattern, r.verdict) for r in out.collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "small", lambda df: df)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.pattern, r.verdict) for r in urlfilter.judge(df, given(spark)).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_the_rarest_literal_is_the_key(spark):
    urls = spark.createDataFrame([("//a.de/shop/cart/1",), ("//a.de/shop/2",), (None,)], "address string")
    got = {r.pattern: (r.token, r.literals) for r in urlfilter.compiled(urlfilter.rules(spark, {"block": ["/shop/cart^", "/shop*", "||a.de^"]})).join(urlfilter.indexed(urlfilter.rules(spark, {"block": ["/shop/cart^", "/shop*", "||a.de^"]}), urls).select("pattern", "token"), "pattern").collect()}
    assert got["/shop/cart^"] == ("cart", ["shop", "cart"]) and got["/shop*"] == (None, []) and got["||a.de^"][0] in ("a", "de")


def test_no_python_on_the_path(spark, tmp_path):
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = QUERIES["op11_urls"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    assert urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), given(spark)).count() == len(rows)
