import random

import numpy as np

from sparkweave.llm import neardup as N


def sets(text):
    words = N._words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_classes_against_brute_force(spark):
    rng = random.Random(1)
    new = lambda n: [f"w{rng.randrange(5000)}" if rng.random() < 0.6 else rng.choice(["the", "of", "a"]) for _ in range(n)]
    texts = [None, "", " \t", "one two", "One  two", "one three"]
    for i in range(60):
        base = new(rng.randint(60, 300))
        texts.append(" ".join(base))
        for _ in range(25 if i == 7 else rng.choice([0, 1, 1, 2])):
            near = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 80))):
                near[rng.randrange(len(near))] = "edit"
            texts.append(" ".join(near).upper() if rng.random() < 0.3 else "\n".join(near))
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x") for i, t in zip(ids, texts)]
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()}
    assert set(got) == set(ids)
    s = [sets(t) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            same = N._words(texts[i]) == N._words(texts[j])
            if same or (s[i] | s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
                links += not same
    want = {i: find(i) for i in ids}
    assert links > 100
    assert got == want


def test_rows_without_ids_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "A b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4), (3, None, 5), (4, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = N.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"]) for r in got.collect()) == [(False, 1, 1), (False, 3, 5), (True, 0, 3), (True, 0, 4)]
    assert N.deduplicated(docs.limit(0)).count() == 0


def test_one_id_with_different_texts(spark):
    """They are documents of their own; of similar ones with the least id one stays."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(100)) for x in "abc")
    rows = [(1, a, 1), (1, b, 2), (1, b, 3), (2, b, 4), (1, a + " more", 5), (3, c, 6), (3, c.upper(), 7), (None, a, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r["doc_id"] or 0, r["text"].lower()[0], r["n"]) for r in N.deduplicated(docs).collect())
    assert [x[:2] for x in got] == [(0, "a"), (1, "a"), (1, "b"), (3, "c")]
    assert N.deduplicated(docs).columns == docs.columns


def test_sketches_never_exclude_similar_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.r_[rng.permutation(x)[: len(x) - int(rng.integers(0, 1 + len(x) // 5))], rng.integers(0, 1 << 63, int(rng.integers(0, 2 + n // 9)), dtype=np.uint64)])
        apart = sum(int(a ^ b).bit_count() for a, b in zip(N.sketch(x).view(np.uint64), N.sketch(y).view(np.uint64)))
        assert apart <= len(np.setxor1d(x, y))
