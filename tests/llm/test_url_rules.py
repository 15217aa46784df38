import random

import pytest

from tessera.llm import url_rules as U

PAGES = "page_id long, url string, html string, host string, rule string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:k], rest[k:]
    j = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:j]


def brute(data, rules):
    out = []
    for page, url in data:
        host, path = split(url)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((page, host, path, best and best[1], best[2] if best else U.DEFAULT))
    return sorted(out, key=repr)


def check(spark, data, rules, salts=4):
    df = spark.createDataFrame([(p, u, "h", "x", "y") for p, u in data], PAGES)
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    got = U.apply_rules(df, table, salts=salts).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, rules)


def test_the_given_rules(spark):
    urls = [
        "http://www.example.com/en/1?x=/fr/", "https://EXAMPLE.com/en/", "https://example.com/en", "http://a.net/es/1#y", "http://net/fr/", "http://xnet/fr/", "ftp://b.c.example.com/en/z",
        "http://com", "http://com/", "no scheme", None, "", "://", "http://?q", "http://É.Example.NET/fr/", "http://x.example.com//en/", "http://a://b/c", "http://www.example.com/en/1?x=/fr/",
    ]
    check(spark, list(enumerate(urls)), U.RULES)


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_rules_and_hot_hosts(spark, seed):
    rng = random.Random(seed)
    part = lambda: "/" + "/".join(rng.choice(["a", "ab", "b", "é"]) for _ in range(rng.randint(0, 4)))
    hosts = ["com", "x.com", "y.x.com", "net", "a.net", "xcom"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), part()) for _ in range(40))}.values())
    data = [(k, f"http://{rng.choice(['', 'z.', 'y.'])}{rng.choice([*hosts, 'x.com', 'x.com', 'x.com'])}{part()}") for k in range(400)]
    check(spark, data, rules)


def test_empty_tables_and_repeats(spark):
    check(spark, [], U.RULES)
    check(spark, [(1, "http://com/"), (1, "http://com/"), (None, "http://com/")], [])
    check(spark, [(1, "http://com/"), (1, "http://com/"), (None, "http://com/")], U.RULES)
