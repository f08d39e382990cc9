import random
import re

from graphloom.llm import url_filter as op


def glob(rule):
    host, slash, path = rule.partition("/")
    part = lambda s, star: "".join(star + "*" if c == "*" else star if c == "?" else re.escape(c) for c in s)
    return re.compile(rf"[^#]*\.{part(host, '[^#]')}#{part(slash + path, '(?s:.)')}", re.S)


def naive(url, rules, default="allow"):
    host, path = op.split_url(url)
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), x)):
        if glob(rule).match(f".{host}#{path}"):
            return host, path, rule, verdict
    return host, path, None, default


URLS = [None, "", "example.org/es/", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/x?y#z", "https://notexample.org/es/1", "https://a.example.org/en/1?q", "https://x.com/de/1", "http://com/fr/",
        "http://x.COM/FR/", "ftp://h?://b.org/", "http://É.org/a", "://org/", "http://e.net/.example.org/es/", "http://example.org/" + "a" * 200_000, "http://" + "b." * 5000 + "org/x"]


def test_contract_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op.filter_urls(pages).collect()}
    assert got == {i: naive(u, op.RULES) for i, u in enumerate(URLS)}
    assert op.filter_urls(pages.limit(0)).count() == 0


def test_automaton_with_many_globs():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    rules = [(rng.choice([f"{word(2)}.org/", f"*{word(2)}.org/{word(2)}", f"{word(1)}?/{word(2)}*{word(1)}"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list(dict(rules).items())
    urls = [f"http://{word(3)}.{rng.choice(['org', word(2)])}/{word(5)}" for _ in range(500)]
    masks = op.compile_rules(rules)
    assert masks["words"] > 2
    first = op.run_automaton([".{}#{}".format(*op.split_url(u)).encode() for u in urls], masks)
    assert [masks["rules"][k] if k >= 0 else (None, "allow") for k in first] == [naive(u, rules)[2:] for u in urls]


def test_odd_ids_and_an_own_split(spark):
    """Null and repeated ids; hosts and paths by hand."""
    cases = [("http://A.example.org/es/q?x#y", "a.example.org", "/es/q", "example.org/es/", "block"), ("x://Com/fr/", "com", "/fr/", "com/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://h.net#f/x", "h.net", "", None, "allow")]
    rows = [(i, u) for u, *_ in cases for i in (None, 7, 7)]
    got = [tuple(r) for r in op.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert sorted(got, key=repr) == sorted(((i, *rest) for _, *rest in cases for i in (None, 7, 7)), key=repr)
