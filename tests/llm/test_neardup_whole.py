"""Classes that must equal those of brute force, without any miss."""

import random

from sparkweave.llm import neardup as N


def brute(texts):
    """The least index of the class of each text."""
    s = []
    for words in map(N._words, texts):
        s.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if min(len(s[i]), len(s[j])) >= 0.8 * max(len(s[i]), len(s[j])) and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def found(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))]


def words(rng, n, vocabulary=5000):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_pairs_within_a_hot_group(spark):
    rng = random.Random(2)
    template, texts = words(rng, 250), []
    for _ in range(150):
        variant = edited(rng, template, 14)
        texts += [" ".join(variant), " ".join(edited(rng, variant, 3))]
    rng.shuffle(texts)
    want = brute(texts)
    assert len(set(want)) >= 100
    assert found(spark, texts) == want


def test_groups_with_drift(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        now = words(rng, 200)
        for _ in range(25):
            texts.append(" ".join(now))
            now = edited(rng, now, 3)
    # Large classes whose members have copies of their own that are not similar to the root.
    for _ in range(6):
        base = words(rng, 200)
        for _ in range(12):
            near = edited(rng, base, 3)
            texts += [" ".join(near), " ".join(edited(rng, near, 3))]
    rng.shuffle(texts)
    want = brute(texts)
    assert max(want.count(c) for c in set(want)) > 20
    assert found(spark, texts) == want


def test_appended_and_cut_copies(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = words(rng, 200, 600)
        texts += [" ".join(base), " ".join(base + words(rng, 40, 600))]
        base = words(rng, 240, 600)
        texts += [" ".join(base), " ".join(base[40:])]
    rng.shuffle(texts)
    want = brute(texts)
    assert len(set(want)) == 120
    assert found(spark, texts) == want


def test_open_buckets_without_a_link(spark):
    """Texts of shuffled sentences share many shingles, but no two are similar."""
    rng = random.Random(5)
    sentences = [[f"s{k}w{i}" for i in range(12)] for k in range(8)]
    texts = [" ".join(w for s in rng.sample(sentences, 4) for w in s) for _ in range(20)]
    texts = list(dict.fromkeys(texts))
    assert found(spark, texts) == brute(texts)
