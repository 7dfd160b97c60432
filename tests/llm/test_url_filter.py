from __future__ import annotations

import random
import re

import pytest

from tessera.llm.queries import URL_RULES
from tessera.llm.url_filter import Rule, filter_urls, index_rules, rule_tokens

URLS = [
    None, "", "no scheme", "http://", "http://A.COM/x", "https://com", "http://com/", "http://example.com/en/1", "http://www.Example.com/en/", "http://notexample.com/en/",
    "http://m.www.example.com/en/a?b=/es/", "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://x.net?/es/", "http://x.net#/es/", "ftp://user@x.net:80/es/",
    "a://b.net/fr/://c.com/", "http://.com/", "http://x.com.net/fr/é", "http://x.com/" + "a" * 5000, "http://é.com/ä\nb",
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and re.match("(?s)" + ".*".join(map(re.escape, r.path.split("*"))), path)]
    best = min(fits, key=lambda r: (-len(r.text), -len(r.host), r.text), default=None)
    return host, path, best and best.text, best.verdict if best else default


def judged(spark, urls, rules, **options):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = filter_urls(df, rules, **options).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


@pytest.mark.parametrize("inline", [2000, 0])
def test_filter_WHEN_odd_urls_SHOULD_equal_brute_force(spark, inline):
    assert judged(spark, URLS + URLS[:9], URL_RULES, inline_rules=inline) == [brute(u, URL_RULES) for u in URLS + URLS[:9]]


@pytest.mark.parametrize("inline", [2000, 0])
def test_filter_WHEN_random_rules_SHOULD_equal_brute_force(spark, inline):
    random.seed(4)
    pick = lambda n, m: [random.choice(["a", "bb", "c-d", "e1"]) for _ in range(random.randint(n, m))]
    paths = ["/", "/a", "/a*", "/*/a/", "/bb/*c", "", "/a/bb/", "*"]
    rules = [Rule(random.choice(["allow", "block"]), ".".join(pick(1, 3)), random.choice(paths)) for _ in range(40)]
    rules = list({r.text: r for r in rules}.values())
    urls = [f"http://{'.'.join(pick(1, 4))}{random.choice(['', '/', '/' + '/'.join(pick(0, 4)), '/ab?x'])}" for _ in range(150)]
    assert judged(spark, urls, rules, inline_rules=inline) == [brute(u, rules) for u in urls]


def test_filter_WHEN_no_rules_or_rows_SHOULD_default(spark):
    assert judged(spark, ["http://a.com/"], [], default="block") == [("a.com", "/", None, "block")]
    assert judged(spark, [], URL_RULES) == []


def test_index_WHEN_tokens_are_shared_SHOULD_take_the_rarest():
    index = index_rules(URL_RULES)
    assert index["es"] == [URL_RULES[3]] and index["www"] == [URL_RULES[2]]
    assert rule_tokens(Rule("block", "a.com", "/en")) == ["a", "com"]  # 'en' may go on
    assert index_rules([Rule("block", "-", "*")]) == {"": [Rule("block", "-", "*")]}


def test_plan_WHEN_inline_SHOULD_have_no_python_or_exchange(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = filter_urls(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_rules_WHEN_repeated_or_in_capitals_SHOULD_count_the_first_in_small_letters(spark):
    rules = [Rule("block", "A.com", "/x"), Rule("allow", "a.com", "/x"), Rule("allow", "a.com", "/X")]
    for inline in (100, 0):
        assert judged(spark, ["http://a.com/xy", "http://B.a.COM/X"], rules, inline_rules=inline) == [("a.com", "/xy", "a.com/x", "block"), ("b.a.com", "/X", "a.com/X", "allow")]


def test_filter_WHEN_rules_are_thousands_SHOULD_equal_brute_force(spark):
    rules = [Rule("block" if i % 2 else "allow", f"h{i % 700}.org", f"/p{i}/" if i % 3 else f"/p{i}*z") for i in range(3000)] + [Rule("block", "", "/")]
    urls = [f"http://{'w.' * (i % 2)}h{i * 7 % 3000 % 700 + (i % 5 == 0)}.org/p{i * 7 % 3000}/{'z' * (i % 4)}" for i in range(400)] + ["http://x.net/"]
    want = [brute(u, rules) for u in urls]
    assert sum(w[2] not in (None, "/") for w in want) > 20
    for inline in (20_000, 900):
        assert judged(spark, urls, rules, inline_rules=inline) == want


def test_url_WHEN_one_is_a_third_or_very_long_SHOULD_be_judged(spark):
    urls = ["http://net/fr/x"] * 300 + [f"http://net/{i}" for i in range(300)] + ["http://net/fr/" + "a/" * 500_000]
    got = judged(spark, urls, URL_RULES)
    assert [g[2] for g in got] == ["net/fr/"] * 300 + [None] * 300 + ["net/fr/"] and judged(spark, urls, URL_RULES, inline_rules=0) == got
