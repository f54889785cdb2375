import re

import pytest
from docmill.llm import queries
from docmill.llm.url_rules import MOST_RULES, Rule, RuleIndex, judge, split_url

URLS = [
    "http://a.example.net/en/1", "http://EXAMPLE.net/en/", "http://example.net/de/1", "http://net/x", "http://net", "http://x.internet/", "https://example.com/de/1?q=/fr/",
    "https://example.com/den", "https://m.example.org/fr/2#top", "ftp://org/fr/", "https://org/f", "no scheme", "", None, "http://example.net:80/en/", "http://free-bets.example.com/en/1",
    "http://a.example.com/de", "https://xn.example.com/DE/1", "://example.net/en/x", "http://ÉX.net/é", "http:///path", "http://alphabets.example.com/", "http://a.com/Casino/x", "http://a.com/myCASINO", "http://a.com/ADULT",
]
SITES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute(url):
    m = re.search(r"://", url or "")
    rest = (url or "")[m.end() :] if m else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in SITES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    bad = any(re.search(rf"(?<![0-9a-zA-Z]){w}(?![0-9a-zA-Z])", host + path, re.IGNORECASE | re.ASCII) for w in queries.BLOCKED_WORDS)
    return host, path, None, "block" if bad else "allow"


def test_query_rules_match_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"rule": F.lit(1), "host": F.lit(2)})
    rules = queries.SITE_RULES + [Rule.word("block", w) for w in queries.BLOCKED_WORDS]
    got = judge(df, rules).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in sorted(got, key=lambda r: (r.page_id is None, r.page_id))] == [brute(u) for u in [*URLS, URLS[0]]]
    assert judge(df.limit(0), rules).collect() == []


def test_only_rules_of_present_tokens_run():
    index = RuleIndex([Rule.site("block", "rare.example.com/"), Rule.site("block", "example.com/x/"), Rule("any", "allow", "^q", (), 1)])
    assert {t: [r.name for r in rs] for t, rs in index.by_token.items()} == {"rare": ["rare.example.com/"], "x": ["example.com/x/"]}
    index.best(*split_url("http://other.org/y"))
    assert set(index.compiled) == {"^q"}


def test_equal_word_rules_block():
    for rules in ([("block", "adult"), ("allow", "birds")], [("allow", "birds"), ("block", "adult")], [("block", "birds"), ("allow", "adult")]):
        index = RuleIndex([Rule.word(v, w) for v, w in rules])
        assert index.best("x.com", "/adult/birds").verdict == "block"


def test_rules_have_a_bound():
    with pytest.raises(ValueError):
        RuleIndex([Rule.word("block", "a")] * (MOST_RULES + 1))
