import random

from gapwise.llm.urls import RULES, contract_rules, judge_urls

RULE = "rule string, verdict string"


def parts(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute(url, rules, default):
    host, path = parts(url)
    fits = []
    for rule, verdict in rules:
        if not rule or rule.startswith("/"):
            continue
        at = rule.find("/") if "/" in rule else len(rule)
        h, p = rule[:at].lower(), rule[at:]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, verdict))
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in urls], "page_id long, url string, host string, rule string, h string")
    got = judge_urls(pages, spark.createDataFrame(rules, RULE), default).collect()
    want = [(i, *brute(u, rules, default)) for i, u in urls]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_contract_rules_and_odd_urls(spark):
    urls = [
        "http://org/", "http://ORG", "http://a.org/x", "http://a.org?x=/", "http://a.org#/", "http://aorg/", "http://org./", "http://.org/", "http://x..org/a",
        "http://example.org/es/", "http://example.org/es", "http://b.EXAMPLE.org/ES/", "http://b.example.org/es/a?b#c", "https://example.org/en/1", "https://example.org/en/12", "https://example.org/en/2",
        "http://x.com/fr/a", "http://com/de/", "http://x.com/de", "http://user@x.com:80/de/", "http://x.com/de/://y.org/", "no scheme", "", None, "://", "://com/fr/", "http://é.com/fr/ü", "a://b://c.org/",
    ]
    check(spark, list(enumerate(urls)) + [(None, "http://a.org/x"), (3, "http://a.org/x"), (3, "http://a.org/x")], RULES)


def test_nested_rules_over_many_ranges(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("ab") for _ in range(rng.randrange(k)))
    host = lambda: ".".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(1, 5)))
    rules = list({f"{host()}/{word(7)}": rng.choice(["allow", "block"]) for _ in range(250)}.items())
    rules += [("a", "block"), ("a.cc", "allow"), ("B.a/é", "block"), (None, "block"), ("/x", "block"), ("", "block")]
    rules += [("b/" + "a" * k, "block") for k in range(40)]
    urls = [(k, f"http://{host()}/{word(12)}") for k in range(1500)] + [(k, "http://cc.b/" + "a" * (k % 60)) for k in range(300)]
    check(spark, urls, rules, "block")


def test_same_rule_twice_blocks_and_ties_take_the_longer_host(spark):
    rules = [("a.b/", "allow"), ("A.b/", "block"), ("c.d/e", "allow"), ("d/efg", "block")]
    pages = spark.createDataFrame([(1, "x://a.b/c"), (2, "x://c.d/efg")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, RULE)).collect()}
    assert got == {1: ("a.b/", "block"), 2: ("c.d/e", "allow")}


def test_hot_url_long_url_no_rows_no_rules(spark):
    urls = [(k, "http://hot.example.org/es/1") for k in range(3000)] + [(0, "http://" + "a." * 5000 + "org/" + "x" * 200_000), (1, "y" * 300_000)]
    check(spark, urls, RULES)
    check(spark, [], RULES)
    check(spark, urls[:3], [])


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(1, "x://a.org/c")], "page_id long, url string")
    plan = judge_urls(pages, contract_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
