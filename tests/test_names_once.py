"""Types, canonical names and ids are made once for each different name."""

from sparkweave.operators import graph
from sparkweave.schema import EXTRACTION


def test_names_are_made_once(spark):
    entities = [("Form I-485", "form", "d", []), ("Form I-485", "form", "d", ["x"]), ("Form I-485", None, "", [])]
    relations = [("form i-485", "requires", " form i-485 ", "e"), (None, "requires", "  ", "e"), ("form i-485", "requires", "USCIS", "e")]
    rows = spark.createDataFrame([(f"c{i}", i, entities, relations) for i in range(20)], EXTRACTION)
    typed, ends = graph.typed_entities(rows), graph.relation_ends(graph.relation_rows(rows))
    assert typed.count() == 60 and typed.select("id", "canon", "type").distinct().count() == 1
    assert ends.count() == 80 and sorted(r["key"] for r in ends.select("key").distinct().collect()) == ["form i-485", "uscis"]
    for made in (typed, ends):
        assert "Aggregate" in made._jdf.queryExecution().optimizedPlan().toString()
