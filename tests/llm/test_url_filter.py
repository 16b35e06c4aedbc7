from itertools import combinations
from math import ceil

from pyspark.sql import functions as F
from stopwise.llm import url_filter as m

PAGES = "page_id long, url string, html string, host string, verdict string"


def judged(spark, urls, labels=(), rules=m.RULES):
    pages = spark.createDataFrame([(i, u, "", "x", "y") for i, u in urls], PAGES)
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in m.judge(pages, marks, rules).collect()}


def test_longest_rule_of_host_and_path_wins(spark):
    got = judged(spark, [
        (1, "http://a.example.com/en/x"), (2, "http://www.example.com/en/x?q#f"),
        (3, "https://Sub.WWW.Example.com/en/"), (4, "http://example.com/fr/"),
        (5, "http://notexample.net/fr/x"), (6, "http://net/es/"), (7, "http://x.com"),
        (8, "http://anet/es/"), (9, "no url"), (10, None), (11, "http://x.com?a=/"), (12, "://com/"),
    ])
    rule = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert rule[1] == ("example.com/en/", "block")
    assert rule[2] == rule[3] == ("www.example.com/en/", "allow")
    assert rule[4] == ("com/", "allow")
    assert rule[5] == ("net/fr/", "block") and rule[6] == ("net/es/", "block")
    assert {rule[i] for i in (7, 8, 9, 10, 11)} == {(None, "allow")}
    assert rule[12] == ("com/", "allow")
    assert (got[2].host, got[2].path) == ("www.example.com", "/en/x")
    assert (got[3].host, got[3].path) == ("sub.www.example.com", "/en/")
    assert (got[10].host, got[10].path, got[11].path) == ("", "", "")


def test_mined_rules_are_confident_supported_and_minimal(spark):
    urls = [(i, f"http://{'casino-' if i % 5 == 0 else ''}s{i % 7}.example.org/{i}") for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(150)] + [(5, None, None), (None, 0, 1)]
    got = judged(spark, urls, labels)
    assert {i for i, r in got.items() if r.verdict == "block"} == set(range(0, 200, 5))
    assert {r.mined_rule for r in got.values() if r.verdict == "block"} == {"part:casino"}


def brute_rules(baskets, support, confidence, lift):
    """(items, outcome) -> (confidence, support) by counting every combination of tokens."""
    n, whole, right, base = len(baskets), {}, {}, {}
    for words, outcome in baskets:
        base[outcome] = base.get(outcome, 0) + 1
        for size in range(1, len(words) + 1):
            for items in combinations(sorted(words), size):
                whole[items] = whole.get(items, 0) + 1
                right[items, outcome] = right.get((items, outcome), 0) + 1
    rules = {
        (items, o): (k / whole[items], k / n)
        for (items, o), k in right.items()
        if k >= ceil(support * n) and k / whole[items] >= confidence
        and k / whole[items] / (base[o] / n) >= lift
    }
    return {
        (items, o): r for (items, o), r in rules.items()
        if not any(
            rules.get((tuple(x for x in items if x != left), o), (-1, 0))[0] >= r[0] for left in items
        )
    }


def test_rules_of_both_outcomes_against_counting(spark):
    """Given rules and labels teach; pages that no given rule fits follow the best mined rule."""
    urls = [
        (i, f"http{'s' * (i % 2)}://{('www.', 'blog.', '')[i % 3]}s{i % 4}.example.{('com', 'net', 'org')[i % 7 % 3]}"
            f"/{('en', 'es', 'fr', 'de')[i * i % 11 % 4]}/{i}") for i in range(240)
    ] + [(3, "http://s3.example.org/de/3"), (999, "http://unseen.info/"), (500, None), (501, "x")]
    labels = [(i, int(i % 5 != 0), int(i % 9 == 0)) for i in range(0, 240, 2)] + [(2, 1, 1), (999, None, None)]
    got = judged(spark, urls[:-4], labels)
    pages = spark.createDataFrame(urls, "page_id long, url string")
    words = {r.url: r.t for r in pages.select("url", m.tokens(F.col("url")).alias("t")).collect()}
    told = {}
    for i, q, toxic in labels:
        if q is not None:
            told[i] = "block" if q == 0 or toxic == 1 or told.get(i) == "block" else "allow"
    whole = judged(spark, urls[:240], labels)
    seen = [(words[u], whole[i].verdict if whole[i].rule else told.get(i)) for i, u in urls[:240]]
    seen = [(w, o) for w, o in seen if o]
    rules = brute_rules(seen, max(m.MIN_SUPPORT, m.MIN_COUNT / len(seen)), m.MIN_CONFIDENCE, m.MIN_LIFT)
    assert {o for _, o in rules} == {"allow", "block"}
    decided = set()
    for i, u in urls[:240]:
        fits = [(c, s, o, list(x)) for (x, o), (c, s) in rules.items() if set(x) <= set(words[u])]
        if got[i].rule is None:
            best = max(fits, default=(None, 0, "allow", []))
            assert (got[i].verdict, got[i].confidence) == (best[2], best[0]), u
            assert got[i].mined_rule == " ".join(best[3])
            decided.add(best[2] if fits else None)
    assert {"allow", "block"} <= decided


def test_repeated_and_very_long_urls(spark):
    """Repeated pages are judged alike, a long url like a short one, equal rules in text order."""
    long = "http://a.org/" + "x/" * 50_000
    got = judged(spark, [(1, long), (2, long), (3, "http://b.org/")], rules=(("a.org", "/x", "block"), ("b.org", "/", "allow"), ("org", "/x/x/", "allow")))
    assert got[1].verdict == got[2].verdict == "allow" and got[1].rule == "org/x/x/"
    same = judged(spark, [(1, "http://b.a.org/y")], rules=(("a.org", "/", "block"), ("org", "/y/", "block"), ("a.org", "/", "allow")))
    assert same[1].verdict == "allow"


def test_empty_tables(spark):
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://a.org/")])[1].verdict == "allow"
