"""The similarity join against plain loops over all pairs."""

import random

import numpy as np

from sparkweave.llm import buckets
from sparkweave.llm import jaccard as J
from sparkweave.llm.neardup import _words, shingles


def sets(texts):
    out = []
    for words in map(_words, texts):
        out.append({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    return out


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row."""
    s = sets(t for _, t in rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(s[i]), len(s[j])))
            if small and 100 * small >= 90 * large and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, node string").repartition(4)
    return sorted((tuple(r) for r in J.joined(docs).collect()), key=repr)


def edited(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_against_all_pairs(spark):
    """Near copies on both sides of the limit, drift, appended texts, templates, a hot group, nulls, short texts, repeated ids."""
    rng = random.Random(1)
    words = lambda n: [f"w{int(3000 * rng.random() ** 2)}" for _ in range(n)]
    texts = []
    for _ in range(25):  # edits of 1 to 6 words change 3 to 18 of about 200 shingles
        base = words(rng.randint(60, 250))
        texts += [base, *(edited(rng, base, n) for n in (1, 2, 3, 6)), base + words(len(base) // 12), base[len(base) // 20 :]]
    now = words(300)
    for _ in range(40):
        texts.append(now)
        now = edited(rng, now, 2)
    hot = words(400)
    texts += [edited(rng, hot, rng.randint(1, 8)) for _ in range(150)]
    sentences = [[f"s{k}w{i}" for i in range(12)] for k in range(8)]
    texts += [[w for s in rng.sample(sentences, 4) for w in s] for _ in range(120)]
    texts = [" ".join(t) for t in texts]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), None, "", " \x0b ", "one", "ONE", "one two", "one two three", "two one", "one two", " ".join(words(20_000)), "a b a b a b", "a b a b", " x y"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another text of this id here"), (None, texts[5]), (None, "only here without an id"), (None, None)]
    rng.shuffle(rows)
    want = brute(rows)
    assert 100 < len({c for _, _, c in want}) < 350
    assert found(spark, rows) == want


def test_no_links_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a b c d"), (2, "e f g h"), (4, None)]) == [(1, 2, 1), (2, 2, 2), (4, 0, 4)]


def test_similar_sets_share_first_shingles_under_every_order():
    """The filters lose nothing: at exactly the limit as well."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 10, 19, 20, 100, 333):
        for _ in range(20):
            common = rng.integers(1, 1 << 62, n).astype(np.uint64)
            more = rng.integers(1, 1 << 62, n // 9).astype(np.uint64)
            k = int(rng.integers(0, len(more) + 1))
            a, b = np.unique(np.r_[common, more[:k]]), np.unique(np.r_[common, more[k:]])
            for factor in J.ORDERS:
                firsts = [J.by_order(x, factor)[: buckets.prefix(90, len(x))] for x in (a, b)]
                assert len(np.intersect1d(*firsts))
    assert buckets.prefix(90, 0) == 0 and len(shingles([], 3)) == 0
