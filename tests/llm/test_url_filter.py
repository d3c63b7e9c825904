import random
import re

import pytest

from tallyloom.llm import url_filter as uf

LOWER = str.maketrans(uf.UPPER, uf.LOWER)


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
    fit = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in ((h or "", p or "", v) for h, p, v in rules) for h in [h.translate(LOWER)] if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, _, rule, verdict = max(fit, default=(0, 0, False, None, default))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "https://", "http://com", "http://com/", "http://COM/x", "https://www.Example.com/en/1", "https://m.example.com/en/1", "https://example.com/en", "https://example.com/en/", "https://example.com?x=/en/", "https://example.com#/en/",
    "https://www.example.com/en?/en/", "https://badexample.com/en/", "ftp://user@example.com:80/en/", "http://a.net/es/x", "http://net/fr/", "http://net/fr", "http://a.net/ES/", "http://a..net/es/", "http://.com/", "http://com./", "a://b://c.com/d", "http://é.com/ü/\nx", "://com/", "http://x.com//en/", "http://İ.com/",
]


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_contract(spark, trie_bytes):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[7]), (7, URLS[7])], "page_id long, url string")
    got = uf.judge(pages, uf.rules_of(spark, uf.RULES), trie_bytes=trie_bytes).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, uf.RULES), r.url


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    """Hosts below each other, paths within segments, the same rule twice, rules without host or path; by trie and by join."""
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(["a", "b", "www", "B"]) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/a", "/ab", "/b", "a", "é", "//"]) for _ in range(rnd.randint(0, 4)))
    rules = [(host() if rnd.random() < 0.9 else rnd.choice(["", None]), path() or rnd.choice(["", None]), rnd.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"x://{host()}{'/' + path() if rnd.random() < 0.9 else ''}{rnd.choice(['', '?q=/a', '#/a/b'])}" for _ in range(400)] + ["x://b.a/a/ab"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    for trie_bytes in (1 << 20, 0):
        for r in uf.judge(pages, uf.rules_of(spark, rules), default="block", trie_bytes=trie_bytes).collect():
            host_, path_, rule, verdict = brute(r.url, rules, "block")
            assert (r.host, r.path, r.rule, r.verdict) == (host_, path_, rule, verdict), (r.url, rules)


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_edges(spark, trie_bytes, tmp_path):
    long = "http://" + "a." * 3000 + "com/" + "x/" * 3000
    pages = spark.createDataFrame([(1, "http://x.com/a"), (1, "http://x.com/a"), (2, None), (3, long)], "page_id long, url string").selectExpr("*", "1 as Host", "2 as PATH", "3 as rule_host", "4 as _judged", "5 as Verdict", "6 as _row")
    rules = uf.rules_of(spark, uf.RULES)
    out = uf.judge(pages, rules, trie_bytes=trie_bytes) if trie_bytes else uf.judge(pages.where("page_id < 3"), rules, trie_bytes=0)
    assert out.columns == ["page_id", "url", "rule_host", "_judged", "_row", "host", "path", "rule", "verdict"]
    out.write.parquet(f"file://{tmp_path}/out")
    rows = out.collect()
    assert sorted(r.page_id for r in rows) == ([1, 1, 2, 3] if trie_bytes else [1, 1, 2]) and all((r.rule_host, r._judged, r._row) == (3, 4, 6) for r in rows)
    assert uf.judge(pages.limit(0), rules, trie_bytes=trie_bytes).count() == 0
    assert {r.verdict for r in uf.judge(pages, rules.limit(0), trie_bytes=trie_bytes).collect()} == {"allow"}


def test_keep_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/1", "x"), (2, "http://a.net/en/1", "y"), (3, None, "z"), (4, "http://example.com/en/", "w")], "page_id long, url string, Verdict string")
    kept = uf.keep_allowed(pages, uf.rules_of(spark, uf.RULES))
    assert kept.columns == pages.columns and sorted((r.page_id, r.Verdict) for r in kept.collect()) == [(2, "y"), (3, "z")]
    assert "html" not in uf.op13(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
