import random

import pytest

from sparkweave.llm import urls as U

CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme/en/", "", "", None), ("http://", "", "", "-"),
    ("HTTP://A.Example.NET/en/x?q=/de/", "a.example.net", "/en/x", "example.net/en/"), ("http://example.net", "example.net", "", None),
    ("http://example.net/", "example.net", "/", "net/"), ("http://badexample.net/en/", "badexample.net", "/en/", "net/"),
    ("http://x.example.com/de/1#a", "x.example.com", "/de/1", "example.com/de/"), ("http://x.example.com/DE/1", "x.example.com", "/DE/1", None),
    ("http://org/fr/", "org", "/fr/", "org/fr/"), ("http://a.org?x=/fr/", "a.org", "", None), ("x://é.org/fr/ü#", "é.org", "/fr/ü", "org/fr/"),
    ("a://b://c/d", "b:", "//c/d", None), ("http://" + "a" * 50000 + ".net/x", "a" * 50000 + ".net", "/x", "net/"),
]


def test_rules(spark):
    rows = [(i, u, "clash") for i, (u, *_) in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = U.judged(pages.select("page_id", "url"), U.train(pages)).collect()
    verdicts = {h + p: v for h, p, v in U.RULES}
    assert len(got) == 2 * len(CASES)
    for r in got:
        _, host, path, rule = CASES[r["page_id"]]
        rule = None if rule == "-" else rule
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == verdicts[rule])


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_learn_and_column_equals_python(spark, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfaeiou") for _ in range(8))
    rows = [(i, f"http://cheap-{name()}-pills.example.com/{i}?a=1&b=2" if i % 4 == 0 else f"https://{name()}.{'org' if i % 2 else 'net'}/{'fr' if i % 2 else 'xx'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    trees = U.train(pages)
    unseen = spark.createDataFrame([(1, "http://hot-offer-now.example.com/12?a=5&b=6"), (2, f"https://{name()}.org/en/3")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in U.judged(unseen, trees).collect()} == {1: "block", 2: "allow"}
    rows, columns = U._with_features(U.labelled(pages), trees.suffixes)
    for r in rows.limit(50).select(*(c.alias(k) for k, c in columns.items()), trees.column(columns).alias("z")).collect():
        assert abs(trees.value(r.asDict()) - r["z"]) < 1e-9
    # Hosts that the trees never saw, without the seed words.
    measured = U.held_out(pages)
    assert measured["urls"] > 200 and measured["bad"] == 100 and measured["precision"] > 0.9 and measured["recall"] > 0.9


def test_suffixes_cover_all_rows(spark):
    """Statistics do not depend on the sample, and rare suffixes have none. Ties and repeated rows count."""
    rows = [(i, f"http://{'cheap-' if i % 4 == 0 else ''}h{i}.aa/") for i in range(400)] + [(i, f"http://h{i}.bb/") for i in range(9)] + [(1, None)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string")
    few, all_ = (U.train(pages, sample=n) for n in (20, 1000))
    assert few.suffixes.collect() == all_.suffixes.collect()
    assert {r["suffix"] for r in all_.suffixes.collect()} <= {"aa"} and abs(all_.suffixes.first()["blocked"] - 25) <= 4
    assert U.judged(pages, few).count() == len(rows)


def test_only_nulls_and_a_very_long_url(spark):
    for rows in ([(1, None), (2, None)], [(1, "http://a.com/" + "x/" * 200_000), (2, "http://cheap.com/")]):
        pages = spark.createDataFrame(rows, "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in U.judged(pages, U.train(pages)).collect()}
        assert set(got) == {1, 2} and set(got.values()) <= {"allow", "block"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judged(pages, U.train(pages)).count() == 0
