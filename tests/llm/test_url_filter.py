import random

from linewright.llm.url_filter import QUERY_RULES, GlobAutomaton, Rule, filter_urls

SCHEMA = "page_id long, url string, rule string"


def by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_rules_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["net", "a.net", "EXAMPLE.net", "x.example.net", "notexample.net", "example.com", "m.example.com", "org", "b.org", "borg", "net.com", "é.net", ""]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/a?x=/de/", "/a.net/", "?q=/en/", "#/en/", "/en/é/日"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://net/" + "a" * 5000]
    many = [Rule(rng.choice(["allow", "block"]), rng.choice(hosts[:6] + ["c%d.net" % k for k in range(40)]).lower(), rng.choice(["/", "/en/", "/fr/x"])) for _ in range(60)]
    for rules in (QUERY_RULES, list({r.name: r for r in many}.values()), []):
        got = filter_urls(spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], SCHEMA), rules, keep=("page_id",)).collect()
        assert {r["page_id"]: tuple(r)[1:] for r in got} == {k: by_hand(u, rules) for k, u in enumerate(urls)}


def test_wildcards_and_words():
    automaton = GlobAutomaton(["a*c", "**x/y", "ab" * 40, "é*"])
    assert automaton.words > 1
    assert automaton.first_match(["abc", "a/c", "q/zx/y", "ab" * 40, "éé", "", "ac", "ab" * 41]).tolist() == [0, -1, 1, 2, 3, -1, 0, -1]


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], SCHEMA), QUERY_RULES, keep=("page_id",)).count() == 0
