"""Disclosing terms against counting by plain loops, and documents that are full of values."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from sparkweave.llm import pii as P

BREAK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BREAK.split(text.lower()) if w]


def brute(docs):
    """The terms, from e-mail addresses alone."""
    n, places, together, n_e, near = len(docs), {}, {}, {}, {}
    n_t: dict = {}
    for _, text in docs:
        for w in set(words(text)):
            n_t[w] = n_t.get(w, 0) + 1
    held = {}
    for key in set(docs):
        text = key[1]
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(P.PATTERNS["email"].replace(r"\G|", ""), text)]
        cover = list(text)
        for a, b, _ in found:
            cover[a:b] = "\x03" * (b - a)
        cover = "".join(cover)
        for a, b, value in found:
            low = max(0, a - P.REACH)
            context = text[low:a], text[b : b + P.REACH]
            places.setdefault(value, set()).add(context)
            left, right = cover[low:a], cover[b : b + P.REACH]
            left = re.sub(r"^[^\x20\x09-\x0D]*", "", left) if low else left
            right = re.sub(r"[^\x20\x09-\x0D]+$", "", right) if len(right) == P.REACH else right
            for w in words(left)[-P.CONTEXT_WORDS :] + words(right)[: P.CONTEXT_WORDS]:
                if "\x03" not in w:
                    near.setdefault((value, w), set()).add(context)
            first = held.setdefault((value, key), context)
            held[value, key] = min(first, context)
        for value in {v for _, _, v in found}:
            n_e[value] = n_e.get(value, 0) + 1
            for w in {w for w in words(cover) if "\x03" not in w}:
                together.setdefault((value, w), []).append(key)
    out = set()
    for (value, w), keys in together.items():
        if len(places[value]) < P.SUPPORT or n_e[value] >= n:
            continue
        information = math.log2(n / n_e[value])
        share = math.log2(n * len(keys) / (n_t[w] * n_e[value])) / information
        enough = len({held[value, k] for k in keys}) >= P.SUPPORT or len(near.get((value, w), ())) >= P.SUPPORT
        if share >= P.DISCLOSURE and enough:
            out.add(w)
    return out


def found(spark, docs):
    got = P.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("text", "pii_spans").collect()
    return {r["text"][s["start"] : s["end"]].lower() for r in got for s in r["pii_spans"] if s["kind"] == "term"}


def test_terms_equal_plain_counting(spark):
    rng = random.Random(11)
    filler = [f"w{i}" for i in range(30)]
    people = [(f"p{i}@mail.example.org", [f"name{i}", f"town{i}", f"team{i // 3}"]) for i in range(25)]
    docs = []
    for i in range(260):
        text = [rng.choice(filler) for _ in range(rng.randint(10, 60))]
        for mail, names in rng.sample(people, rng.choice([0, 0, 1, 1, 2, 5])):
            at = rng.randrange(len(text))
            text[at:at] = [mail, *rng.sample(names, rng.randint(0, 3))]
            for name in rng.sample(names, rng.randint(0, 2)):
                text.insert(rng.randrange(len(text)), name)
        docs.append((i, " ".join(text)))
    docs += docs[:20] + [(1000 + i, docs[i][1]) for i in range(10)]  # repeated rows, and copies
    listing = [w for mail, names in people for w in (mail, names[0])]
    docs += [(2000 + i, " ".join(listing[i:] + [f"only{i}", "directory"])) for i in range(4)]
    want = brute(docs)
    assert len(want) > 20
    assert found(spark, docs) == want


def test_a_directory_that_occurs_three_times(spark):
    """20,000 addresses in the same three documents: one class of values and one of terms."""
    people = [f"surname{i} u{i}@mail.example.com" for i in range(20_000)]
    rng = random.Random(3)
    docs = [(k, f"edition {k} " + " ".join(rng.sample(people, len(people)))) for k in range(3)] + [(10 + i, f"nothing of the kind {i}") for i in range(300)]
    began = time.time()
    got = found(spark, docs)
    assert time.time() - began < 120  # 60 s where nothing else runs
    assert "surname5" in got and "surname19999" in got and "nothing" not in got
