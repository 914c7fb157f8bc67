import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkweave.llm import packing as P


def smallest(items, capacity):
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        tried = set()
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in tried:
                tried.add(room)
                rooms[k] -= items[i]
                place(i + 1, rooms)
                rooms[k] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_reduction_never_loses_the_optimum():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, left = P.reduce_by_dominance(dict(Counter(items)), capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sum(fixed.values()) + smallest(rest, capacity) == smallest(items, capacity), items


def test_plan_packs_every_piece_once():
    rng = random.Random(4)
    for _ in range(300):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 300)))
        got = Counter()
        for pattern, many in P.plan(dict(counts), 64).groups:
            assert sum(w * n for w, n in pattern) <= 64
            for w, n in pattern:
                got[w] += n * many
        assert got == counts


@pytest.fixture(scope="module")
def texts():
    return [None, "", "a", "word " * 5000, "<|endoftext|> is a string", "日本語 text", "same text", "same text", "x" * 9000, "tab\tand\nline ça"]


def test_places_are_gapless_and_pieces_exact(spark, texts):
    from tokenizers import Tokenizer

    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "no id", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    out = P.pack(docs, P.public_path("byte_bpe_50k.json"), P.public_path("byte_bpe_50k.tiktoken"), capacity=128, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(P.public_path("byte_bpe_50k.json"))
    for key, text in [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in out if r["doc_id"] == key), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids
        assert all(r["length"] == 128 for r in mine[1:]) and [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    for sequence in {r["sequence_id"] for r in out}:
        end = 0
        for r in sorted((r for r in out if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 128


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), P.public_path("byte_bpe_50k.json")).count() == 0


def test_fast_encoder_gives_the_tokenizers_ids():
    rng = random.Random(5)
    letters = "abc XYZ 0129 ,.;:!?'\"()[]{}#$%&*+-/<=>@^_`~| \n\t éèçßüñÑ “”–—…€'s't're"
    slow, both = P.encoder(P.public_path("byte_bpe_50k.json"), None), P.encoder(P.public_path("byte_bpe_50k.json"), P.public_path("byte_bpe_50k.tiktoken"))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(600)]
    assert slow(texts) == both(texts)
