import random
import re

import xxhash

from sparkweave.llm import simhash as S


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_property():
    masks = S.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            diff = 1 << i | 1 << j
            assert any(diff & m & (2**64 - 1) == 0 for m in masks)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "Of", "ÄND", "x", "yy", "zeta", "q\x0bw", "a b"]
    texts = [None, "", "  \t\n", "one", "one two", "ONE two", "nbsp joins words here"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append("  ".join(near))
    rows = [(i * 3, t, 1.0) for i, t in enumerate(texts)] + [(0, None, 2.0), (None, "one", 1.0)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp double")).collect()
    fps = {i * 3: plain(t) for i, t in enumerate(texts)}
    assert len(got) == len(rows)
    label = dict(zip(fps, fps))
    reach = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and reach[b] < reach[a]:
                    reach[a] = reach[b]
                    changed = True
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] & (2**64 - 1) == fps[r["doc_id"]] and r["component_id"] == reach[r["doc_id"]]
    assert label


def test_chain_of_fingerprints_is_one_component(spark):
    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << i))
    links = S.links_within_two(spark.createDataFrame([(c,) for c in chain], "fp long"))
    assert {r["label"] for r in S.components(links).collect()} == {0}


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
