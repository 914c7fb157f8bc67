"""The incremental graph against one that is built anew, after every batch."""

import random

from pyspark.sql import functions as F

from sparkweave.operators import graph, increment
from sparkweave.schema import EXTRACTION


def rows_of(g):
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return [order(df) for df in (g.entities, g.mentions, g.relates, g.chunks)]


def test_batches_equal_a_rebuild(spark, tmp_path):
    """Documents that are replaced, emptied and brought back; names that become known, change their owner or vanish; ends that move to other entities."""
    rng = random.Random(1)
    names = ["Form I-485", "I-485", "form i 485", "I-693", "H-1B", "USCIS", "Uscis", "green card", "Medical Exam", "medical exam", "filing fee", "DS-260", "applicant"]
    kinds = ["form", "agency", "fee", "evidence_or_document", "applicant_category"]

    def extracted(doc, batch):
        entities = [(rng.choice(names), rng.choice(kinds), "d" * rng.randrange(4), rng.sample(["a", "b", "c"], rng.randrange(3))) for _ in range(rng.randrange(4))]
        relations = [(rng.choice(names + ["", " "]), rng.choice(["requires", "references"]), rng.choice(names), f"e{batch}") for _ in range(rng.randrange(4))]
        return (f"{doc}-{batch}", batch * 1000 + int(doc[1:]), entities, relations)

    paths, alive = {}, {}
    for batch in range(1, 4):
        docs = [f"d{i}" for i in rng.sample(range(9), 6 if batch < 3 else 4)]
        came = {d: extracted(d, batch) for d in docs if rng.random() < 0.85}
        alive = {d: r for d, r in alive.items() if d not in docs} | came
        with_doc = lambda found: spark.createDataFrame(list(found.values()), EXTRACTION).withColumn("doc_id", F.split("chunk_id", "-")[0])
        extraction = with_doc(came)
        documents = spark.createDataFrame([(d,) for d in docs], "doc_id string")
        read = lambda name, b: spark.read.parquet(f"{tmp_path}/{b}/{name}")
        log = increment.GraphLog(read, lambda df, name: df.write.parquet(f"{tmp_path}/{batch}/{name}"), list(paths))
        log.add(extraction, documents, extraction.select("doc_id", F.col("chunk_id").alias("id"), F.lit("h").alias("heading_path"), F.lit("f").alias("filepath")))
        paths[batch] = docs
        got = increment.GraphLog(read, None, list(paths)).graph()
        every = with_doc(alive)
        want = graph.build(every.drop("doc_id"), every.select("chunk_id", F.lit("h").alias("heading_path"), F.lit("f").alias("filepath")))
        assert rows_of(got) == rows_of(want), batch
    # What a batch does not touch is not written again.
    written = {r["id"] for r in spark.read.parquet(f"{tmp_path}/3/entities").collect()}
    assert written < {r["id"] for r in got.entities.collect()} | written and len(written) < sum(spark.read.parquet(f"{tmp_path}/{b}/entities").count() for b in range(1, 3))
    increment.GraphLog(read, None, list(paths)).compacted(lambda df, name: df.write.parquet(f"{tmp_path}/9/{name}"))
    assert rows_of(increment.GraphLog(read, None, [9]).graph()) == rows_of(got)
