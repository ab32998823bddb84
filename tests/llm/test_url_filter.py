import random

from linework.llm.url_filter import RULES, url_filter


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:] if rest[n : n + 1] == "/" else ""
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, key=lambda x: (-x[0], x[1]), default=(0, None, default))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    rules = RULES + [("a.example.net", "/", "allow"), ("example.net", "/en/x", "block"), ("a.b.c", "", "block"), ("b.c", "/q", "allow")]
    hosts = ["net", "example.net", "A.Example.NET", "a.example.net.", "xexample.net", "b.org", "org", "a.b.c", "z.a.b.c", "b.c", "q-.b.c", "c", "a..net", "net-x"]
    paths = ["", "/", "/en/", "/en/x?y=/de/", "/de/1#/en/", "?/fr/", "#", "/fr/", "/q/w", "/en"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nohost/en/", "http://", "x://y://net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls)], "page_id long, url string")
    rows = url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute((urls + urls)[r.page_id], rules)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/", "q")], "page_id long, url string, host string")
    assert url_filter(pages.limit(0), rules).count() == 0
    assert [(r.rule, r.verdict) for r in url_filter(pages, rules.limit(0)).collect()] == [(None, "allow")]
    assert [(r.rule, r.verdict) for r in url_filter(pages, rules).collect()] == [("net/", "block")]


def test_many_nested_rules_long_urls_and_nulls(spark):
    rng = random.Random(4)
    hosts = ["a", "b.a", "c.b.a", "c.a", "..", "", "x" * 200]
    rules = [(rng.choice(hosts), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 8))), rng.choice(["allow", "block"])) for _ in range(300)]
    rules = [(h, p, min(v for g, q, v in rules if (g, q) == (h, p))) for h, p, _ in rules]
    urls = [f"x://{rng.choice(hosts + ['z.c.b.a', 'z'])}/" + "".join(rng.choices("ab/", k=rng.randint(0, 12))) for _ in range(500)]
    urls += ["x://" + "." * 100_000 + "a/b", "x://a/" + "a" * 100_000, "x://" + "y" * 100_000 + ".b.a/a/"]
    pages = spark.createDataFrame([(None if i % 9 == 0 else i % 50, u, "x", i) for i, u in enumerate(urls)], "page_id long, url string, key string, row int")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, table).collect()), key=key)
    assert got == sorted(((None if i % 9 == 0 else i % 50, *brute(u, rules)) for i, u in enumerate(urls)), key=key)
    assert len({r[3] for r in got}) > 30
