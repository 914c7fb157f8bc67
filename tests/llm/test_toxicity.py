import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import toxicity as T

CLEAN = "the river runs past old stone houses and people walk along water while birds sing over green fields of barley or rye".split()
BAD = ["moronic", "idiot", "scumbag", "loser"]


def corpus(n=300):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return T.fit(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), T.third(F.col("doc_id")) != 1)


def test_held_out_accuracy(spark, model):
    docs, labels = corpus()
    got = T.scored(spark.createDataFrame(docs, "doc_id long, text string, score string"), model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and all((r["score"] >= T.THRESHOLD) == bool(labels[r["doc_id"]][2]) for r in held)


def test_disguises_are_restored(model):
    restore = T.Restorer(model["letters"])
    for hidden in ("1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "l0$er", "l-o-s-e-r", "sc|_|mbag"[:2] + "umb@g"):
        word = {"l": "loser", "s": "scumbag"}.get(hidden[0], "idiot")
        assert restore(f"the {hidden} runs") == f"the {word} runs"
    scorer = T.Scorer(model)
    assert scorer.score("you 1d10t and l 0 s e r and l o s e r m0r0n1c") > 0.7 > scorer.score("the river runs past old stone houses")


def test_disguises_together(model):
    """Leetspeak, gaps and repeats, each with each, and signs at a word's end."""
    restore = T.Restorer(model["letters"])
    for hidden in ("1 d 1 o t", "1.d.i.0.t", "i d 1 o +", "i-d-i-o-o-o-t", "1d1oooot", "1d1000t", "idi0+", "1diot!"):
        assert restore(f"the {hidden} runs").startswith("the idiot"), hidden
    assert restore("i d i o t head") == "idiot head" and restore("see a b head") == "see a b head" and restore("i_d_i_o_t_") == "idiot_"
    for plain in ("1 2 3 4", "see 3 - 4 - 5", "great!", "12:30", "5 + 6 = 11"):
        assert restore(plain) == plain


@pytest.mark.parametrize("token", ["1234567890" * 100_000, "_1" * 500_000, "a1" * 500_000, "a b " * 250_000, "1 " * 500_000, "a_" * 500_000 + "ab", "!" * 1_000_000, "a" * 1_000_000 + "1", "ab!" * 333_000, "a_*" * 333_000 + "zz", "a* " * 333_000, "a_*" * 333_000, "a.-_" * 250_000])
def test_long_tokens_take_linear_time(model, token):
    import time

    began = time.time()
    T.Scorer(model).score(token)
    assert time.time() - began < 20  # about 5 s where nothing else runs


def test_one_text_for_each_id_is_learned_from(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, "c"), (3, "d"), (3, "d")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    found, share = T.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", F.lit(True), 1000)
    assert sorted((r["text"], r["y"]) for r in found.collect()) == [("a", 1), ("c", 0), ("d", 0)] and abs(share - 1 / 3) < 1e-9


def test_viterbi_is_the_best_path(model):
    """Against all paths of the lattice."""
    import itertools

    restore, lm = T.Restorer(model["letters"]), model["letters"]
    for span in ("1d10t", "l05er", "sttt1ll", "b00k5"):
        paths = []
        for path in itertools.product(*restore.lattice(span)):
            s = [0, 0, *(T.symbol(c) for letters, _ in path for c in letters), 0]
            paths.append((sum(cost for _, cost in path) + sum(lm[a][b][c] for a, b, c in zip(s, s[1:], s[2:])), "".join(x for x, _ in path)))
        assert restore.decode(span) == max(paths)[1]
    rng = random.Random(7)
    long = "".join(rng.choice("a1e3i!50stz2") for _ in range(5000))
    text = restore.decode(long)
    assert len(text) > 1000 and text[:200] == restore.decode(long[:400])[:200]


def test_nulls_repeats_and_missing_labels(spark, model):
    rows = [(1, None), (1, None), (None, ""), (2, "x" * 100000), (3, "é" * 5)]
    got = T.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == 5 and all(0 <= r["score"] < 0.7 for r in got)
    empty = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, None)], "doc_id long, toxic int"), F.lit(True))
    assert T.Scorer(empty).score("idiot") < 1e-6
    assert T.scored(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert np.isfinite(T.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))["letters"]).all()
