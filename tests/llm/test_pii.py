import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkweave.llm import pii as P

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def card(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "_x@d.e", "x.y%z@", "q-1", "é", "\U0001f600", " ", "-", "+", "1", "22", "256", "10.0.0.1", "0010.1.2.3", "1.2.3.4.5", "+1 (017) 555-7713", "+44", "(", ")", "\x01", "\n", "word", "4111 1111-1111 1111"]
    out = [None, "", "  ", "1 2 3 " * 4000, "a" * 30000, "9" * 20000, "+" * 1000, "a.b" * 5000 + "@c.d", "+1" + "2" * 13, "x@y.z" * 50]
    for _ in range(600):
        out.append("".join(rng.choice([*pieces, card(rng)]) for _ in range(rng.randint(1, 14))))
    return out


def test_base_spans_equal_the_plain_patterns(spark, texts):
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    for r in docs.select("doc_id", P.written_as(P.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect():
        assert [x for x in r["s"].split(",") if x] == plain(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


@pytest.mark.parametrize("piece, n", [("{} ", 200_000), ("{:04}-{:04} ", 100_000), ("10.{}.1.2 ", 40_000), ("a{}@b.co, +1 555 {:07} 4111 1111 1111 1111\n", 10_000)])
def test_many_matches_take_linear_time(spark, piece, n):
    text = "".join(piece.format(*[i % 256 if "10." in piece else i] * 2) for i in range(n))
    want = plain(text)
    docs = spark.createDataFrame([(1, text), (2, "a@b.co " + text[:5000])], "doc_id long, text string").repartition(1)
    began = time.time()
    got = {r["doc_id"]: r for r in P.with_spans(docs).select("doc_id", P.written_as("pii_spans").alias("s"), P.sanitised(F.col("text"), F.col("pii_spans")).alias("clean")).collect()}
    took = time.time() - began
    assert [x for x in got[1]["s"].split(",") if x and not x.startswith("term")] == want
    assert took < 60, took  # most of it for counting; the spans take less than 10 s
    for kind in ("email", "ip", "card", "phone"):
        assert got[1]["clean"].count(f"[{kind.upper()}]") == sum(x.startswith(kind) for x in want)


def test_disclosing_terms_against_counting(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(filler) for _ in range(n)]
    docs = []
    for i in range(200):
        words = say(30)
        if i % 20 == 0:
            words[10:10] = ["Nickname", "jo@mail.example.com", "seen"]
        elif i % 7 == 0:
            words[5:5] = ["seen", "at", f"10.0.0.{i}"]
        docs.append((i, " ".join(words)))
    docs += [(7, docs[7][1]), (None, None), (500, "")]
    got = P.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", "pii_spans", P.sanitised(F.coalesce("text", F.lit("")), F.col("pii_spans")).alias("clean")).collect()
    assert len(got) == len(docs)
    for r in got:
        terms = {r["text"][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "term"}
        assert terms == ({"Nickname"} if "jo@mail" in (r["text"] or "") else set())
        assert "@" not in r["clean"] and "Nickname" not in r["clean"] and "10.0.0" not in r["clean"]
        if not r["pii_spans"]:
            assert r["clean"] == (r["text"] or "")


def test_digest_and_empty_table(spark, tmp_path):
    text = "mail a@b.co or +1 (017) 555-7713 and 10.1.2.3"
    spark.createDataFrame([(1, text, 5), (2, None, 6)], "doc_id long, text string, n_email int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in P.op9_pii(spark, str(tmp_path)).collect()}
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(plain(text)).encode()).hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 1)
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert P.with_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps_are_replaced_once(spark):
    row = spark.range(1).select(P.sanitised(F.lit("abcdefghij"), F.expr("array(named_struct('kind','ip','start',1,'end',5,'value','x'), named_struct('kind','card','start',3,'end',7,'value','x'), named_struct('kind','term','start',8,'end',9,'value','i'))")).alias("t")).first()
    assert row["t"] == "a[IP]hj"
