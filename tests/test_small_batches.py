"""Python sees Arrow batches of bounded size, whatever the session's number of rows is."""

import pyarrow as pa

from sparkweave import tables


def test_batches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(tables, "BATCH", 1000)
    whole = pa.RecordBatch.from_pydict({"id": list(range(90)), "text": ["x" * 30] * 89 + ["y" * 5000]})
    parts = list(tables.small(whole))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(90))
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts)
    assert list(tables.small(whole.slice(0, 0))) == [whole.slice(0, 0)]


def test_a_task_takes_small_batches(spark):
    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    got = [r["n"] for r in tables.in_arrow(rows, sizes, "n long").collect()]
    assert sum(got) > 30_000_000 and max(got) <= tables.BATCH
