"""Disclosing terms far from the value, and at every place."""

import random

from pyspark.sql import functions as F

from sparkweave.llm import pii as P


def test_terms_far_away_and_in_other_documents(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    docs = [(i, " ".join(say(60))) for i in range(200)]
    for i in range(0, 200, 20):
        docs[i] = (i, " ".join(["Dear", "A.Name|\\E", *say(50), "jo@mail.example.com", *say(50), "a.name|\\e"]))
    docs[5] = (5, " ".join([*say(20), "A.Name|\\E", *say(20)]))
    docs[6] = (6, " ".join([*say(20), "A.Name|\\E,", *say(20)]))
    got = P.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", "pii_spans", P.sanitised(F.col("text"), F.col("pii_spans")).alias("clean")).collect()
    for r in got:
        terms = [r["text"][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "term"]
        assert terms == (["Dear", "A.Name|\\E", "a.name|\\e"] if r["doc_id"] % 20 == 0 else ["A.Name|\\E"] if r["doc_id"] == 5 else [])
