"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import text as T


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_type_inference(spark):
    cases = {
        "Form I-485": "form", "I 130": "form", "G-28": "form", "DS-260": "form", "H-1B": "applicant_category", "J-1": "applicant_category", "TN": "applicant_category", "W-2": "applicant_category", "1040": "evidence_or_document",
        "INA section 245": "statute", "USCIS": "agency", "filing fee": "fee", "Advance Parole": "benefit_or_status", "immediate relative": "applicant_category", "admissible": "eligibility_condition",
        "birth certificate": "evidence_or_document", "xyz": "evidence_or_document", "coffee": "fee", "Form I-864EZ": "evidence_or_document",
    }
    assert apply(spark, T.infer_type, cases) == list(cases.values())


@pytest.mark.parametrize("name", ["I-485", "Form I-485", "Form I 485", "form i-485", "I 485", "Form I‑485"])
def test_variants_are_one_form(spark, name):
    canon, i, j = spark.range(1).select(T.canonical_name(F.lit(name), F.lit("form")), T.entity_id(F.lit(name), F.lit("form")), T.entity_id(F.lit("I-485"), F.lit("form"))).first()
    assert canon == "Form I-485" and i == j and len(i) == 16


def test_names_and_ids(spark):
    assert apply(spark, lambda x: T.canonical_name(x, F.lit("agency")), ["  USCIS   National   Benefits  "]) == ["USCIS National Benefits"]
    assert apply(spark, lambda x: T.canonical_name(x, F.lit("form")), ["i-130a"]) == ["Form I-130A"]
    a, b, c = spark.range(1).select(T.entity_id(F.lit("x"), F.lit("form")), T.entity_id(F.lit("x"), F.lit("fee")), T.entity_id(F.lit("y"), F.lit("form"))).first()
    assert len({a, b, c}) == 3


def test_scores_and_refusals(spark):
    cases = {"": 0.0, "0.8": 0.8, '{"score": 0.8}': 0.8, "score: 7": 0.7, "85": 0.85, "-2": 0.0, "none": 0.0, "Score = 150": 1.0}
    assert apply(spark, T.parse_score, cases) == pytest.approx(list(cases.values()))
    assert apply(spark, T.is_refusal, ["The sources do not say", "Sure.", None, "couldn't find it", "outside my scope"]) == [True, False, False, True, True]


def test_substantial_chunks(spark):
    prose = "This is a sentence of prose that goes on. " * 8
    footer = "Form I-485 Instructions 04/01/24 Page 3 of 42 " + prose
    assert apply(spark, T.is_substantial, [prose, footer, "short", "12345 67890 " * 30, "   ", None]) == [True, False, False, False, False, None]
    assert apply(spark, lambda x: T.is_substantial(x, 100), ["letters " * 15]) == [True]


def test_tolerant_json(spark):
    deep = '{"entities": [{"name": "A", "aliases": "not a list"}, {"name": "I-90", "entity_type": "FORM", "aliases": ["x", "y"]}], "relations": "none"}'
    got = apply(spark, T.json_entities, [deep, None, "[1, 2]", '{"entities": {"name": "x"}}'])
    assert [(e["name"], e["entity_type"], e["aliases"]) for e in got[0]] == [("A", "evidence_or_document", []), ("I-90", "form", ["x", "y"])]
    assert not got[1] and not got[2] and not got[3]
    assert apply(spark, T.json_relations, [deep, "{"]) == [[], []]
