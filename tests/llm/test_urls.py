import re

from strataline.llm import urls as U

from .helpers import DATA

PAGES = "page_id long, url string, html string"


def brute(url, rules=U.HOST_RULES, patterns=U.PATTERN_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h) + len(p), -i, v, h + p) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hit = url is not None and any(re.search(U.to_regex(r), url.lower()) for r in patterns)
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "block" if hit else "allow"


URLS = [
    "http://A.Example.org/es/1", "https://example.org/en/12?x#y", "http://example.org/en/2", "http://badexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/de",
    "http://casino-win.example.net/a", "http://mycasino.example.net/a", "http://x.net/poker", "http://ads.x.net/", "http://x.net/uploads/1", "http://doubleclick.net/x", "http://x.net/doubleclick.net",
    None, "", "no scheme", "http://", "://x.net/casino", "http://a://b.org/c", "http://ünï.net/CASINO?x", "http://x.net/wp-login.php?a=1", "http://x.net/free/spins", "http://x.net/free/x/spins", "http://ads-track.example.net/a", "http://x.net/ads-track.example.net", "http://x.net/track/1/pixel.gif", "http://x.net/track/1/pixel.gif?", "ftp://x.net/a.exe", "http://a.metrics.x.net/collect",
    "http://lotto.x.example.net/", "http://x.net/cgi-bin/a.cgi?x", "http://spam-farm.example.net/en/1", "http://x.net?casino", "http://x.org?casino", "HTTP://X.NET/a\nb casino",
]


def test_verdicts_match_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://x.net/casino", None), (3, URLS[3], "h")]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted(map(tuple, U.filter_urls(pages.selectExpr("*", "'clash' as host", "'c' as token", "'c' as candidates")).drop("n_candidates").collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, _ in rows), key=str)


def test_join_path_equals_literal_path(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], PAGES)
    one = sorted(map(tuple, U.filter_urls(pages).collect()), key=str)
    monkeypatch.setattr(U, "LITERAL_RULES", 0)
    assert sorted(map(tuple, U.filter_urls(pages).collect()), key=str) == one


def test_every_rule_has_a_token_and_few_run(spark):
    assert all(U.tokens_of(r) for r in U.PATTERN_RULES)
    pages = spark.createDataFrame([(1, "http://x.net/casino/poker", "h"), (2, "http://x.net/none", "h")], PAGES)
    assert {r.page_id: r.n_candidates for r in U.filter_urls(pages).collect()} == {1: 2, 2: 0}


def test_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://x.net/login/{i}", "h") for i in range(5)] + [(9, "http://x.net/wp", "h")], PAGES)
    index, _ = U.rule_index(pages.select("page_id", "url"), ("/wp-login/",))
    assert list(index) == ["wp"]


def test_rules_of_several_tokens_go_by_the_rarest(spark):
    """On the driver's pages `example` is everywhere, so no rule is filed under it; the file has rules of up to four tokens."""
    assert len([r for r in U.PATTERN_RULES if len(U.tokens_of(r)) > 1]) >= 12
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    index, without = U.rule_index(pages.select("page_id", "url"))
    assert "example" not in index and not without and sum(map(len, index.values())) == len(U.PATTERN_RULES)
    got = sorted(map(tuple, U.op8_url_filter(spark, DATA).collect()))
    assert got == sorted((r.page_id, *brute(r.url)) for r in pages.collect())


def test_empty(spark):
    assert U.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    assert U.filter_urls(spark.createDataFrame([(1, "http://x.net/casino", "h")], PAGES), patterns=()).first().verdict == "allow"
