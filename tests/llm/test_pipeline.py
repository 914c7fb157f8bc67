"""The stages one after the other on a small corpus with known cases."""

import random

import pytest

import corpus_pipeline as C


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("corpus"))
    new = lambda n: [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['a', 'e', 'is', 'on'])}" for _ in range(n)]
    item = " ".join(new(25))
    docs, labels = [], []
    for i in range(240):
        words = new(rng.randint(60, 200))
        toxic = i % 6 == 0
        if toxic:
            for word in rng.sample(["idiot", "moron", "loser", "scum"], 3):
                words.insert(rng.randrange(len(words)), word)
        labels.append((i, 1, int(toxic)))
        docs.append([i, " ".join(words), "en", "s", 0])
    docs[7][1] = docs[7][1] + " " + item
    docs[9][1] = "mail jo.doe@mail.example.com or call +1 (017) 555-7713 " + docs[9][1]
    docs.append([300, docs[1][1], "en", "s", 0])
    near = docs[2][1].split()
    near[30] = "changed"
    docs.append([301, " ".join(near), "en", "s", 0])
    docs += [[302, None, "en", "s", None], [303, "one two", None, None, 7]]
    docs = [(d, t, lang, s, len(t or "")) for d, t, lang, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_decisions_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    expected = [{i for i in range(240) if i % 6 == 0}, {300, 301}, {7}, set()]
    for (name, stage), gone in zip(C.STAGES[:4], expected):
        after = C.written(stage(spark, docs, corpus), name)
        assert after.columns == docs.columns
        now = {r["doc_id"] for r in after.collect()}
        assert kept - now == gone, name
        docs, kept = after, now
    text = {r["doc_id"]: r for r in docs.collect()}
    assert text[9]["text"].startswith("mail [EMAIL] or call [PHONE] ") and text[9]["n_chars"] == len(text[9]["text"])
    assert text[302]["text"] is None and text[303]["text"] == "one two"
    packed = C.STAGES[4][1](spark, docs, corpus).collect()
    assert {r["doc_id"] for r in packed} == kept
    room = {}
    for r in packed:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 2048


def test_empty_table(spark, corpus):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, empty, corpus)
        assert out.count() == 0, name


def test_clashing_columns_survive(spark, corpus):
    extra = {"score": 0.9, "key": "k", "pii_spans": "p", "label": "l", "f": "f", "text_": "t", "start": 3, "h": "h", "dk": "d", "y": 5, "__score": 0.9, "__found": 1, "__pii": "p", "__text": "t", "__key": 1, "__holds": 2, "__words": "w", "__spans": "s", "__gone": 3, "__kept": 4, "__t0": 5, "__t1": 6, "node": 7, "hits": 8, "size": 9}
    from pyspark.sql import functions as F

    docs = C.written(spark.read.parquet(f"{corpus}/documents.parquet").withColumns({k: F.lit(v) for k, v in extra.items()}), "clash")
    for name, stage in C.STAGES[:4]:
        docs = C.written(stage(spark, docs, corpus), name)
    row = docs.where("doc_id = 9").first().asDict()
    assert {k: row[k] for k in extra} == extra and "[EMAIL]" in row["text"]
    assert C.STAGES[4][1](spark, docs, corpus).count() >= docs.count()


def brute_near(texts):
    """For each text whether an earlier one (by class) makes it go: classes of five-word shingles with a similarity of 0.8 or more."""
    s = []
    for t in texts:
        words = (t or "").lower().split()
        s.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if s[i] == s[j] or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_run_against_brute_force(spark, tmp_path):
    """All stages with ties, repeated rows, nulls and a very long text, against plain loops for the stages that loops can express."""
    rng = random.Random(9)
    new = lambda n: [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(90)}" for _ in range(n)]
    item = " ".join(new(25))
    texts = [" ".join(new(rng.randint(30, 150))) for _ in range(60)] + [" ".join(new(60_000)), None, "", "x"]
    texts += [texts[3], texts[3], texts[4].upper(), texts[60] + " more words", texts[5] + " " + item, "call +1 (017) 555-7713 " + texts[6][:50]]
    for k in (7, 8, 9):
        near = texts[k].split()
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[3], "en", "s", 1)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")  # nothing is toxic
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = {i for i, c in enumerate(brute_near(texts)) if i == c and item not in (texts[i] or "")}
    got = C.run(spark, path).collect()
    assert {r["doc_id"] for r in got} == kept | {None}
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 2048
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for found in pieces.values():
        found.sort()
        assert [p for p, *_ in found] == list(range(len(found))) and all(s + n == t for (_, s, n), (_, t, _) in zip(found, found[1:]))


def test_contaminated_rows_go_and_no_others(spark, tmp_path):
    """Rows without an id, and rows of one id, are judged each for itself."""
    item = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"see {item}"), (None, "nothing of it"), (None, None), (7, item), (7, "another text of this id"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r for r in rows if item not in (r[1] or "")), key=repr)
