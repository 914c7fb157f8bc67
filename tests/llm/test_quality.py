import itertools
import random

import numpy as np

from sparkweave.llm import quality as Q


def test_em_recovers_accuracies():
    """Simulated heuristics: EM finds how they vote, and the posteriors are those of the true model."""
    rng = np.random.default_rng(1)
    accuracy, speaks = np.array([0.9, 0.7, 0.8, 0.65, 0.95]), np.array([1.0, 0.8, 0.9, 0.7, 0.5])
    y = rng.random(40000) < 0.7
    right = rng.random((40000, 5)) < accuracy
    v = np.where(rng.random((40000, 5)) < speaks, np.where(right, y[:, None], ~y[:, None]).astype(int), -1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    good, found, share = Q.em([(p.tolist(), int(n)) for p, n in zip(patterns, counts)])
    assert abs(share - 0.7) < 0.02
    assert np.abs(found - accuracy).max() < 0.03
    for p, g in zip(patterns, good):
        odds = 0.7 / 0.3
        for vote, a in zip(p, accuracy):
            odds *= 1 if vote < 0 else a / (1 - a) if vote else (1 - a) / a
        assert abs(g - odds / (1 + odds)) < 0.06


def corpus():
    rng = random.Random(1)
    good = "the old house of stone and wood is near to the river that runs in this valley".split()
    out = []
    for i in range(400):
        ws = [rng.choice(good) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(20, 150))]
        if i % 8 == 0:
            ws = [w + rng.choice(["###", "$$$", "&&&"]) for w in ws]
        elif i % 8 == 1:
            ws = [w.upper() + "!!" for w in ws[:6]] * 10
        out.append((i, " ".join(ws) + ".", i % 8 > 1))
    return out


def test_scorer_separates_junk(spark):
    rows = [(i, t, 0.5) for i, t, _ in corpus()]
    got = {r["doc_id"]: r for r in Q.classify(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()}
    assert all(got[i]["keep"] == good for i, _, good in corpus())


def test_nulls_and_empty_table(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "word " * 40000), (3, "\n \t")]
    got = Q.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r["score"] == 0 and not r["keep"] for r in got if r["doc_id"] != 2)
    assert Q.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_votes_have_ten_entries():
    for text in ("", "a", "a b", "x\n" * 50, "UP! " * 30):
        assert len(Q.votes(text)) == 10 and set(Q.votes(text)) <= {-1, 0, 1}
    assert len(list(itertools.product(range(3), repeat=2))) == 9


def test_copies_of_one_text_come_to_the_driver_once(spark):
    """A text that most rows have is sampled as one row with a weight, and ties do not change its scores."""
    rows = [(i, t, 0) for i, t, _ in corpus()] + [(1000 + i, corpus()[3][1], 1) for i in range(2000)] + [(7, corpus()[7][1], 2)] * 5
    got = Q.classify(spark.createDataFrame(rows, "doc_id long, text string, keep int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert len({r["score"] for r in got if r["doc_id"] >= 1000 or r["doc_id"] == 3}) == 1
    assert sum(by[i]["keep"] != good for i, _, good in corpus()) <= 4


def test_votes_against_counting_characters():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "Of ", "#", "WORD ", "a-b ", "x_y ", "! ", "\n", "don't ", ". "]) for _ in range(rng.randint(0, 80)))
        words = text.split()
        if not words:
            assert Q.votes(text) == [0] * 10
            continue
        n, letters = len(words), sum(c.isalpha() for c in text)
        v = Q.votes(text)
        assert v[0] == (0 if sum(c in "#$%&*|{}<>=~^@\\_" for c in text) / n > 0.1 else -1)
        assert v[2] == (0 if sum(c.isupper() for c in text) / max(1, letters) > 0.5 else -1)
        assert v[3] == (0 if text.count("!") / n > 0.2 else -1)
        odd = sum(not w.lower().strip(".,;:!?'\"()-").replace("-", "").replace("'", "").isalnum() for w in words)
        assert v[1] == (0 if odd / n > 0.2 else -1)
