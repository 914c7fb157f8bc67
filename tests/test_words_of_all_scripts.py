"""A pattern's word boundary: letters of all scripts are word characters on both sides."""

import duckdb
import pytest

from sparkweave.plans import registry

NAMES = list(enumerate(["ÍN 8 cfr", "Prä I-485", "éI-485 fee", "I-485é", "ÄH-1B", "TNß", "é1040", "W-2ñ fee", "(I-485)", "ä I 485b ö", "_N-400"]))


@pytest.mark.parametrize("name", ["canonicalize_names", "infer_types", "entity_ids"])
def test_a_letter_with_an_accent_is_a_letter(spark, name):
    sql, _, function = registry.OVER[name]
    got = function(spark.createDataFrame(NAMES, "id int, name string"))
    want = duckdb.sql(sql.replace("REL", registry.values(NAMES, "id", "name")))
    at = [got.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in at) for r in got.collect()) == sorted(want.fetchall())


def test_a_form_beside_a_letter_with_an_accent_is_none(spark):
    got = registry.infer_types(spark.createDataFrame(NAMES[:4], "id int, name string"))
    assert [r["type"] for r in got.orderBy("id").collect()] == ["statute", "form", "fee", "evidence_or_document"]
