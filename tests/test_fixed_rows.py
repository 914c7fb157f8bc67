"""The queries over one relation, run over fixed rows that hold the rare cases, against their SQL."""

import duckdb
import pytest

from sparkweave.plans import registry


def numbered(texts: list) -> list[tuple]:
    return list(enumerate(texts))


PARAGRAPHS = numbered(["one", "one\n\ntwo", "one\ntwo\n\n\nthree  \n\n", "\n\n  lead\n\nlast", "", "a\n\n\n\nb\n\nc d\ne"])
NAMES = numbered([
    "I-485", "Form I-485", "Form I 485", "form i-485", "I 485", "i-130a", "Form I‑485", "  USCIS   National   Benefits  ", "H-1B", "TN", "W-2", "1040EZ", "941", "INA section 245",
    "section 213A of Form I-864", "8 CFR 245.2", "Department of State", "filing fee", "coffee", "green card", "immediate relative", "approved petition", "birth certificate", "DS-260", "ETA-9089",
    "Form I-864EZ", "something else", "G-28", "AR-11", "eb-1 preference", "h-1b",
])
PATHS = numbered(["/x/i-485instr.pdf", "C:\\docs\\I-130A.pdf", "i-864ez.pdf", "n-400.tar.pdf", "notes.txt", "", "ds260.html", "/a/b/g28", "/x/i-485instr", ".pdf"])
SAID = numbered([
    "File I-485 with I‑693 and I-485.", "No forms here", "DS-260, N-400A and AB-1", "i-485 lower", "The sources do not cover this.", "I could not find it", "We couldn't find that", "It does not include fees",
    "Yes: file it.", "No information is available", "outside the scope", "", "score: 0.8", '{"score": 7}', "I rate this 85 of 100", "-3", "Score = 1.5", "none", "about 0.25 then 9",
])
RESPONSES = numbered([
    '{"entities": ["Form I-485", {"name": "H-1B", "entity_type": "form"}, {"value": "USCIS", "category": "Agency"}], "relations": [{"subject": "Form I-485", "predicate": "Requires", "object": "I-693", "evidence": "must"}]}',
    '```json\n{"entities": [{"name": "filing fee", "type": "nonsense", "description": "cost", "aliases": ["fee"]}], "relations": []}\n```',
    'Here it is: {"entities": [{"name": "  "}, 5, {"name": "Green Card", "entity_type": "benefit or status"}], "relations": [{"source": "a", "relation": "references", "target": "b"}, {"subject": "a", "predicate": "likes", "object": "b"}, {"subject": "x", "predicate": "requires", "object": "x"}]} done',
    "garbage without braces", "", '{"relations": [{"subject": "", "predicate": "requires", "object": "b"}, "text"]}', "{broken",
])
SPANS = [
    ("a", 1, 0, 0, 0, "The Guide", 20.0, 16), ("a", 1, 1, 0, 0, "Some", 10.0, 0), ("a", 1, 1, 0, 1, "text here.", 10.0, 0), ("a", 1, 1, 1, 0, "   ", 10.0, 0),
    ("a", 1, 2, 0, 0, "Part One", 14.0, 0), ("a", 1, 3, 0, 0, "Body of one.", 10.0, 0), ("a", 2, 0, 0, 0, "A detail", 10.0, 16), ("a", 2, 1, 0, 0, "Body of the detail.", 10.0, 0),
    ("a", 2, 2, 0, 0, "Part Two", 13.0, 16), ("a", 2, 3, 0, 0, "Body of two,", 10.0, 0), ("a", 3, 0, 0, 0, "and more.", 10.0, 0), ("b", 1, 0, 0, 0, "No headings", 9.0, 0), ("b", 1, 1, 0, 0, "at all", 9.0, 0),
]

#: By relation: rows, their columns for the oracle, and for Spark.
ROWS = {
    id(registry.PARAGRAPHS): (PARAGRAPHS, ("id", "text"), "id int, text string"),
    id(registry.NAMES): (NAMES, ("id", "name"), "id int, name string"),
    id(registry.PATHS): (PATHS, ("id", "path"), "id int, path string"),
    id(registry.SAID): ([*SAID, (99, None)], ("id", "said"), "id int, said string"),
    id(registry.RESPONSES): (RESPONSES, ("id", "text"), "id int, text string"),
}
SPAN_ROWS = (SPANS, ("doc_id", "page", "block", "line", "span", "text", "size", "flags"), "doc_id string, page int, block int, line int, span int, text string, size double, flags int")


@pytest.mark.parametrize("name", sorted(registry.OVER))
def test_fixed_rows(spark, name):
    sql, relation, function = registry.OVER[name]
    rows, columns, ddl = ROWS.get(id(relation), SPAN_ROWS)
    if name == "parse_score":
        rows = rows[:-1]
    got = function(spark.createDataFrame(rows, ddl))
    quoted = tuple(f'"{c}"' for c in columns)
    found = duckdb.sql(sql.replace("REL", registry.values(rows, *quoted)))
    order = sorted(got.columns)
    assert order == sorted(found.columns)
    at = [found.columns.index(c) for c in order]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted(want, key=repr)
