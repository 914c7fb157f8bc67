import hashlib
import random

import numpy as np

from sparkweave.llm import recompression as R


def brute(texts, window=20):
    """doc index -> (n_words, n_removed, sha256)."""
    words = [(t or "").encode().split() for t in texts]
    seen, out = set(), []
    for ws in words:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest()))
    return out


def corpus(rng):
    common = ["the", "of", "a", "b", "c"]
    new = lambda n: [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(3000)}" for _ in range(n)]
    passages = [new(rng.randint(15, 70)) for _ in range(6)]
    texts = [None, "", " \t ", "short text", "a " * 100, "a " * 57, "x y " * 60, " ".join(["the of"] * 33)]
    for _ in range(60):
        ws = new(rng.randint(1, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        texts.append(" ".join(ws))
        if rng.random() < 0.3:
            texts.append(texts[-1])
        if rng.random() < 0.3:
            near = list(ws)
            near[rng.randrange(len(near))] = "edit"
            texts.append("\n".join(near))
    rng.shuffle(texts)
    return texts


def test_interior_symbols_depend_on_their_range_only():
    """Every symbol appears again, at the same place, when its range is put between other words."""
    rng = random.Random(2)
    words = np.array([rng.choice([1, 2, 3, 7, 1 << 40]) for _ in range(300)], np.uint64)
    doc = np.zeros(300, np.int64)
    for level, (name, starts, ends, lo, hi, _) in enumerate(R.rounds(words, doc, 6)):
        for i in rng.sample(range(len(name)), min(40, len(name))):
            if lo[i] < 0 or hi[i] > 300:
                continue
            before = np.array([rng.choice([1, 2, 3, 7]) for _ in range(30)], np.uint64)
            other = np.r_[before, words[lo[i] : hi[i]], before]
            levels = list(R.rounds(other, np.zeros(len(other), np.int64), 6))
            at = starts[i] - lo[i] + 30
            k = np.flatnonzero(levels[level][1] == at)
            assert len(k) and levels[level][0][k[0]] == name[i] and levels[level][2][k[0]] == ends[i] - lo[i] + 30


def test_against_brute_force(spark):
    for seed in range(3):
        texts = corpus(random.Random(seed))
        rows = [(i * 7 - 20, t, 5) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, low int").repartition(3)
        got = {r["doc_id"]: r for r in R.deduplicate(docs).collect()}
        assert len(got) == len(rows)
        for (key, text, _), want in zip(rows, brute(texts)):
            r = got[key]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want, (seed, key)
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == want[2]


def test_words_and_names():
    rng = random.Random(4)
    texts = [b"", b" \t", b"one", b"  two  words\n", *(" ".join(rng.choice(["a", "bb", "", "\r\x0b", "\u00e9"]) for _ in range(50)).encode() for _ in range(30))]
    words = R.Words(texts)
    flat = [w for t in texts for w in t.split()]
    assert words.sizes.tolist() == [len(t.split()) for t in texts]
    assert [words.text[a : b - 1] for a, b in zip(words.begin[:-1], words.begin[1:])] == flat
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len(set(flat)) and all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(40) for j in range(40))
    low = np.array([rng.randrange(len(flat) - 60) for _ in range(2000)])
    high = low + np.array([rng.choice([1, 2, 3, 7, 8, 20]) for _ in low])
    for named in (R.names(hashes, low, high).tolist(), list(map(tuple, words.digests(low, high).tolist()))):
        by = {}
        for name, a, b in zip(named, low, high):
            assert by.setdefault(name, tuple(flat[a:b])) == tuple(flat[a:b])
        assert len(by) == len({tuple(flat[a:b]) for a, b in zip(low, high)})


def test_words_that_polynomial_hashes_confuse(spark):
    """Words of 2048 letters that are each other's complement in the Thue-Morse sequence: every polynomial hash modulo 2**64 takes them for equal."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(30)]
    text = lambda w: " ".join([*rest[:15], w, *rest[15:]])
    docs = [(1, text(word)), (2, text(other)), (3, text(word)), (4, " ".join([word, other] * 40)), (5, " ".join([other, word] * 40))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = dict(zip((i for i, _ in docs), brute([t for _, t in docs])))
    assert got == want and got[2][1] == 0 and got[3][1] == 31


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (0, "z " + text), (None, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in R.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 0, 31, 0), (False, 1, 30, 30), (False, 1, 30, 30), (True, 0, 0, 0), (True, 0, 30, 30)]


def test_empty_table(spark):
    assert R.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
