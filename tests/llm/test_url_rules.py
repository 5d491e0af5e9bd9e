import re

import pytest

from residuum.llm import url_rules as U

SITES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

URLS = [
    "http://example.com/en/7", "https://a.example.com/en/71?x", "http://EXAMPLE.com/en/8#t", "http://x.net/de/8", "http://example.net/de/8/9",
    "http://notexample.net/de/8", "http://com/en/", "http://acom/en/", "http://example.com/EN/7", "http://x.org", "http://x.org/es/", "ftp://a.b/c://d.com/en/",
    None, "", "example.com/en/7", "http://", "http:///en/7", "http://user@example.com/en/7", "http://example.com:80/en/7", "http://my-spam.example.org/fr/1",
    "http://spam.net/de/1", "http://spamming.example.org/", "http://example.org/spam/", "http://x.com/en", "http://x.com?/en/", "http://a\nb.com/en/7", "http://é.com/en/",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(r), r, v) for r, v in SITES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    bad = any(x in [w.text[1:] for w in U.WORD_RULES] for x in re.split("[.-]", host))
    return host, path, None, "block" if bad else "allow"


@pytest.mark.parametrize("inline", [2000, 0])
def test_verdicts_match_brute_force(spark, inline):
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(URLS)] + [(0, URLS[0], "old"), (None, URLS[1], None)], "page_id long, url string, host string")
    rules = U.SITE_RULES + U.WORD_RULES
    hit = U.match_urls(df, rules, inline_rules=inline)
    rows = hit.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule, verdict = plain(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        found = r["rule_hit"]
        assert (found["text"] if found and found["rank"] >= 1000 else None) == rule
        assert (found["verdict"] if found else "allow") == verdict


def test_both_paths_keep_all_columns_and_agree(spark):
    hosts = ["free-casino.com", "x.casino-club.org", "poker.net", "my-best-slots-online.com", "slotsonline.com", "casino", "a-b.free.com", "real-poker-now.de"]
    rows = [(k, f"http://{h}/p{k}", "s", "t") for k, h in enumerate(hosts * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, subject string, _subject0 string")
    rules = U.SITE_RULES + U.WORD_RULES
    assert len(U.WORD_RULES) > 1000
    near, far = (U.match_urls(df, rules, inline_rules=n).collect() for n in (len(rules), 0))
    names = ["page_id", "url", "subject", "_subject0", "host", "path", "rule_hit"]
    assert near[0].asDict().keys() == set(names) and [near[0].__fields__, far[0].__fields__] == [names, names]
    key = lambda r: (r["page_id"], r["subject"], r["host"], r["path"], r["rule_hit"])
    assert sorted(map(key, near), key=str) == sorted(map(key, far), key=str)
    text = {r["host"]: r["rule_hit"] and r["rule_hit"]["text"] for r in near}
    assert text == {"free-casino.com": "~free-casino", "x.casino-club.org": "~casino-club", "poker.net": "~poker", "my-best-slots-online.com": "~slots-online",
                    "slotsonline.com": None, "casino": "~casino", "a-b.free.com": None, "real-poker-now.de": "~real-poker"}


def test_tokens_are_those_that_every_match_has():
    assert U.literal_tokens(r"^(?:[^/]*\.)?example\.com/en/7") == {"example", "com", "en"}
    assert U.literal_tokens(r"foo.*bar/baz/") == {"baz"}
    assert U.literal_tokens(r"a|b") == set()
    assert U.literal_tokens(r"/x[0-9]+/login(?=/|$)") == {"login"}


def test_rules_are_filed_under_the_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.com/en/",)] * 3 + [("b.example.net/de/",)], "s string")
    index = U.index_rules(urls, (U.site_rule("block", "example.com/en/"), U.site_rule("block", "example.net/de/")))
    assert sorted(index) == ["com", "de"]
    with pytest.raises(ValueError):
        U.index_rules(urls, (U.UrlRule("x", "a|b", "block", 1),))


def test_no_rows_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(df).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert U.judge_urls(one, rules=()).first()["verdict"] == "allow"
