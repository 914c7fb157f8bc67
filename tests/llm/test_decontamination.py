import itertools
import math
import random
import re

from sparkweave.llm import decontamination as D


def tokens(text):
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if t]


def test_masks_leave_a_hit_for_all_pairs_of_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(all(s + p not in bad for p in m) for m in D.MASKS for s in range(13 - D.SPAN + 1))


def brute(docs, items):
    """Over all alignments of all pairs that share a masked window."""
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = tokens(text), tokens(item)
        if len(b) < D.SPAN:
            continue
        for start in range(-len(b), len(a)):
            flags = [0 <= start + j < len(a) and a[start + j] == b[j] for j in range(len(b))]
            hit = any(all(0 <= start + s and start + s + D.SPAN <= len(a) and flags[s + p] for p in m) for m in D.MASKS for s in range(len(b) - D.SPAN + 1))
            long = min(13, len(b))
            best = max(sum(flags[k : k + long]) for k in range(len(b) - long + 1))
            if hit and best >= math.ceil(long * 0.8):
                key = (sum(flags), best, -start)
                if (d, i) not in out or out[(d, i)][:3] < key:
                    out[(d, i)] = (*key, len(b))
    return {(d, i, m, b, -e, n) for (d, i), (m, b, e, n) in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(200)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 10, 12, 13, 20, 40])))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(0, None), (1, ""), (2, "short"), (3, "z " * 3000)]
    for i in range(4, 60):
        ws = [word() for _ in range(rng.randint(0, 80))]
        if i % 2:
            leak = tokens(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = "sub"
            at = rng.randint(0, len(ws))
            ws[at:at] = leak[rng.randint(0, 3) :]
        docs.append((i, ", ".join(ws).upper() + ".\n"))
    rows = [(d, t, 1) for d, t in docs] + [(5, docs[5][1], 2)]
    got = D.overlaps(spark.createDataFrame(rows, "doc_id long, text string, start int"), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, seed string")).collect()
    want = brute(docs, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) >= 4


def test_shuffled_join_and_empty_tables(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs, items = spark.createDataFrame([(7, "x y " + text), (None, text)], "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert {tuple(r)[:5] for r in D.overlaps(docs, items).collect()} == {(7, 1, 13, 13, 2), (None, 1, 13, 13, 0)}
    assert D.overlaps(docs.limit(0), items).count() == 0 == D.overlaps(docs, items.limit(0)).count()
