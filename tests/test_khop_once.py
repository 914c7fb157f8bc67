"""A traversal for all questions computes the edges once, however many hops it has."""

from sparkweave.operators import graph


def test_edges_are_computed_once(spark):
    n, seen = 30, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = [(i, "next", (i + 1) % n, 1.0 + i, "") for i in range(n)] + [(i, "jump", (i * 7 + 3) % n, 0.5, "") for i in range(n)]
    ddl = "src long, predicate string, dst long, weight double, evidence string"
    entities = spark.createDataFrame([(i, f"n{i}", "node") for i in range(n)], "id long, name string, type string")
    g = graph.Graph(entities, None, spark.createDataFrame(edges, ddl).mapInArrow(counted, ddl))
    seeds = spark.createDataFrame([(q, q * 5, 0) for q in range(4)], "question long, id long, pos int")
    nodes, found = graph.k_hop_many(g, seeds, 3, 12, 3, 10)
    got = {(r["question"], r["id"]) for r in nodes.collect()}
    assert found.count() > 0 and seen.value == len(edges)
    plain = graph.Graph(entities.withColumn("aliases", entities["name"]), None, spark.createDataFrame(edges, ddl))
    for q in range(4):
        assert {i for p, i in got if p == q} == {r["id"] for r in graph.k_hop(plain, [q * 5], 3, 12, 3, 10)[0].collect()}
