"""The graph: weights, traversal against the sequential algorithm, retrieval, engine."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import evaluate, extract, graph, retrieve, vector
from sparkweave.plans.engine import NOTHING_FOUND, Engine
from sparkweave.schema import EXTRACTION


def one_by_one(nodes, edges, seeds, hops, max_nodes, fanout, hub):
    """Breadth first, one edge at a time."""
    known = [s for s in dict.fromkeys(seeds) if s in nodes]
    front, out = list(known), {}
    for _ in range(max(1, hops)):
        if len(known) >= max_nodes:
            break
        fresh = []
        for n in front:
            mine = sorted((e for e in edges if n in (e[0], e[2])), key=lambda e: (-e[3], e[0], e[1], e[2]))
            for rank, e in enumerate(mine, 1):
                other = e[2] if e[0] == n else e[0]
                if other not in known:
                    if len(mine) > hub or rank > fanout or len(known) >= max_nodes:
                        continue
                    known.append(other)
                    fresh.append(other)
                out[e[:3]] = e[3]
        front = fresh
    return known, out


@pytest.mark.parametrize("seed", range(4))
def test_k_hop_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(25)]
    edges = {}
    for _ in range(rng.randint(20, 90)):
        a, b = rng.sample(nodes, 2)
        edges[(a, rng.choice("pq"), b)] = float(rng.randint(1, 4))
    rows = [(*k, w) for k, w in edges.items()]
    g = graph.Graph(spark.createDataFrame([(n, n.upper(), "t") for n in nodes], "id string, name string, type string"), None, spark.createDataFrame([(*r, "") for r in rows], "src string, predicate string, dst string, weight double, evidence string"))
    limits = dict(hops=rng.randint(0, 3), max_nodes=rng.choice([6, 12, 60]), fanout=rng.choice([1, 3, 10]), hub_degree=rng.choice([4, 8, 40]))
    seeds = [*rng.sample(nodes, 3), "missing", nodes[0]]
    got_nodes, got_edges = graph.k_hop(g, seeds, **limits)
    want_nodes, want_edges = one_by_one(nodes, rows, seeds, limits["hops"], limits["max_nodes"], limits["fanout"], limits["hub_degree"])
    assert [r["id"] for r in got_nodes.orderBy("pos").collect()] == want_nodes
    assert {(r["source"], r["predicate"], r["target"]): r["weight"] for r in got_edges.collect()} == want_edges


@pytest.mark.parametrize("limits", [dict(hops=2, max_nodes=60, fanout=10, hub_degree=8), dict(hops=3, max_nodes=9, fanout=2, hub_degree=5), dict(hops=0, max_nodes=4, fanout=1, hub_degree=40)])
def test_k_hop_of_many_questions(spark, limits):
    """Every question as if it were alone; hubs, full budgets, missing and repeated seeds, weights that are null."""
    rng = random.Random(limits["hops"])
    nodes = [f"n{i:02}" for i in range(40)]
    edges = {}
    for _ in range(110):
        a, b = rng.choice(nodes[:6]) if rng.random() < 0.3 else rng.choice(nodes), rng.choice(nodes)
        if a != b:
            edges[(a, rng.choice("pq"), b)] = rng.choice([None, 1.0, 2.0, 3.0])
    g = graph.Graph(spark.createDataFrame([(n, n.upper(), "t") for n in nodes], "id string, name string, type string"), None, spark.createDataFrame([(*k, w, "") for k, w in edges.items()], "src string, predicate string, dst string, weight double, evidence string"))
    asked = {q: [*rng.sample(nodes, rng.choice([1, 2, 5])), "missing", nodes[q]] for q in range(12)} | {20: ["missing"]}
    rows = [(q, s, i) for q, seeds in asked.items() for i, s in enumerate(seeds)] + [(3, asked[3][0], 9), (None, nodes[0], 0), (21, None, 0)]
    got_nodes, got_edges = graph.k_hop_many(g, spark.createDataFrame(rows, "question long, id string, pos int"), **limits)
    found, links = {}, {}
    for r in got_nodes.orderBy("question", "pos").collect():
        found.setdefault(r["question"], []).append(r["id"])
    for r in got_edges.collect():
        links.setdefault(r["question"], set()).add((r["source"], r["predicate"], r["target"]))
    plain = [(a, p, b, w or 0.0) for (a, p, b), w in edges.items()]
    for q, seeds in asked.items():
        want_nodes, want_edges = one_by_one(nodes, plain, seeds, limits["hops"], limits["max_nodes"], limits["fanout"], limits["hub_degree"])
        assert found.get(q, []) == want_nodes and links.get(q, set()) == set(want_edges)


def test_many_questions_are_evaluated(spark):
    """Both modes, a question without seeds and one without vectors near it."""
    g = graph.Graph(spark.createDataFrame([("a", "A", "t"), ("b", "B", "t")], "id string, name string, type string"), spark.createDataFrame([(10, "b"), (11, "b"), (11, "a"), (1, "a")], "chunk_id long, entity_id string"), spark.createDataFrame([("a", "requires", "b", 1.0, "")], "src string, predicate string, dst string, weight double, evidence string"))
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [1.0]), (7, [float("nan"), 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.1]), (2, [0.0, 0.0]), (9, None)], "question long, embedding array<double>")
    seeds = spark.createDataFrame([(1, "a", 0), (9, "b", 0)], "question long, id string, pos int")
    got = sorted((r["question"], r["mode"], r["pos"], r["chunk_id"], r["retrieval_source"]) for r in retrieve.retrieve_many(g, vectors, asked, seeds, 2, 2).collect())
    near = {1: [(1, 2, "vector"), (2, 3, "vector")], 2: [(1, 1, "vector"), (2, 3, "vector")], 9: []}
    more = {1: [(3, 1, "graph"), (4, 11, "graph")], 2: [], 9: [(1, 10, "graph"), (2, 11, "graph")]}
    assert got == sorted((q, m, *r) for q in near for m in ("naive", "hybrid") for r in near[q] + (more[q] if m == "hybrid" else []))
    chunks = spark.createDataFrame([(i, f"Form I-{i}", f"/x/i-{i}0.pdf") for i in (1, 2, 3, 10, 11)], "chunk_id long, content string, filepath string")
    questions = spark.createDataFrame([(1, ["I-110", "I-20"], "multi"), (2, ["I-10"], "single"), (9, ["I-10"], "multi")], "question_id long, gold array<string>, hops string")
    metrics = {(r["question_id"], r["mode"]): r for r in evaluate.evaluated(retrieve.retrieve_many(g, vectors, asked, seeds, 2, 2), chunks, questions).collect()}
    assert metrics[1, "naive"]["doc_recall"] == 0.5 and metrics[1, "hybrid"]["doc_recall"] == 1.0 and metrics[1, "hybrid"]["graph_share"] == 0.5 and (9, "naive") not in metrics


def extraction(spark):
    rows = [
        ("c1", 1, [("Form I-485", "form", "d", ["AOS"]), ("H-1B", "form", "", [])], [("Form I-485", "requires", "Form I-693", "must file"), ("I-485", "requires", "I-693", "again"), ("I-485", "requires", "Form I-485", "self")]),
        ("c2", 2, [("I-485", "form", "longer", ["AOS", "x"])], [("I-693", "evidence_for", "green card", "")]),
    ]
    return spark.createDataFrame(rows, EXTRACTION)


def test_build(spark):
    g = graph.build(extraction(spark))
    entities = {r["name"]: r for r in g.entities.collect()}
    assert set(entities) == {"Form I-485", "H-1B", "Form I-693", "green card"}
    first = entities["Form I-485"]
    assert (first["description"], first["aliases"], first["mention_count"]) == ("longer", ["AOS", "x"], 2)
    assert entities["H-1B"]["type"] == "applicant_category" and entities["Form I-693"]["description"] == ""
    weights = {(r["predicate"], r["weight"], r["evidence"], r["source_chunk"]) for r in g.relates.collect()}
    assert weights == {("requires", 2.0, "must file", "c1"), ("evidence_for", 1.0, "", "c2")}
    assert graph.stats(g).first().asDict() == {"entities": 4, "chunks": 2, "mentions": 3, "relations": 2}
    old = g.entities.select("id", "name", F.lit(1).alias("at"))
    assert {r["name"] for r in graph.latest(old.unionByName(old.withColumns({"name": F.lit("new"), "at": F.lit(2)})), ["id"], "at").collect()} == {"new"}


def test_matching(spark):
    g = graph.build(extraction(spark))
    asked = spark.createDataFrame([("form i-693", "form", 0), ("I-48", "form", 1), ("card", "fee", 2), ("I-4", "form", 3)], "name string, type string, seq int")
    names = spark.createDataFrame([("H-1B",)], "name string")
    got = [r["name"] for r in retrieve.matched_entities(g.entities, asked, names).join(g.entities, "id").orderBy("pos").select("name").collect()]
    assert got == ["Form I-693", "Form I-485", "H-1B"]


def test_names_in_all_contents(spark):
    """Against a search of every content for every name: case, parts of words, signs, line breaks, short names, nulls and repeats."""
    contents = [(1, "See Form I-485 and\nForm I-693."), (2, "form i-4850"), (3, None), (4, ""), (5, "aaaaaaa"), (6, "ÜBER die Straße"), (6, "ab"), (7, "line\nbreak here")]
    names = ["Form I-485", "FORM I-693", "aaaaa", "aaaaaaaaa", "über d", "e\nbreak", "abcd", "I-48", None, "Form I-485", "nothing", "(.*)+x"]
    got = retrieve.names_in_all(spark.createDataFrame(contents, "chunk_id long, content string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = [(i, n) for i, c in contents if c for n in sorted({n for n in names if n and len(n) >= 5}) if n.lower() in c.lower()]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 6


def test_failures_are_not_cached(spark):
    def broken(content, heading, context):
        if "bad" in content:
            raise ValueError("no answer")
        return '{"entities": ["I-90"]}'

    rows = spark.createDataFrame([("a", 1, "k1", "good", None, None), ("b", 2, "k2", "bad", None, None)], "chunk_id string, seq long, key string, content string, heading_path string, context string")
    got = {r["chunk_id"]: r for r in extract.answered(rows, broken).collect()}
    assert got["a"]["error"] is None and got["b"]["answer"] is None and "no answer" in got["b"]["error"]


def test_engine_end_to_end(spark, tmp_path):
    text = "Form I-485 requires Form I-693 for every applicant in the country. " * 6
    sections = spark.createDataFrame([("d1", "/x/i-485instr.pdf", 0, "A", text, {"page_number": "3"}), ("d2", "/x/i-693.pdf", 0, "B", text.replace("I-485", "I-765"), {}), ("d3", "/x/n.pdf", 0, "C", "too short", {})], "doc_id string, filepath string, section_no int, heading_path string, text string, metadata map<string,string>")
    engine = Engine(spark, str(tmp_path), vector.HashingEmbedder(), extract.RuleExtractor(), lambda q, c: f"answer to {q}: {len(c)}", lambda q: [("Form I-485", "form")])
    stats = engine.ingest(sections).first().asDict()
    assert stats == {"entities": 3, "chunks": 2, "mentions": 4, "relations": 2}
    assert engine.ingest(sections).first().asDict() == stats
    answer = engine.query("  What does I-485 require? ", top_k=1)
    assert answer.chunks_used == 2 and [c["retrieval_source"] for c in answer.citations] == ["vector", "graph"]
    assert answer.answer.startswith("answer to What") and any(c["page"] == "3" and c["source_url_with_page"].endswith("i-485instr.pdf#page=3") for c in answer.citations)
    assert engine.query("x", use_graph=False).citations[0]["retrieval_source"] == "unknown"
    nodes, edges = engine.graph()
    assert nodes.count() == 3 and edges.count() == 2
    failing = Engine(spark, str(tmp_path), vector.HashingEmbedder(), None, lambda q, c: 1 / 0)
    assert "division" in failing.query("x").error
    with pytest.raises(RuntimeError):
        failing.ingest(sections)
    assert NOTHING_FOUND


def test_batches_add_up(spark, tmp_path):
    """A second batch adds to the first, replaces its documents, and asks about new texts only."""
    ddl = "doc_id string, filepath string, section_no int, heading_path string, text string, metadata map<string,string>"
    text = lambda a, b: f"Form {a} requires Form {b} for every applicant in the country. " * 6
    section = lambda doc, t: (doc, "/x/notes.pdf", 0, "A", t, {})
    calls = str(tmp_path / "calls")

    def asked(content, heading, context):
        if "BROKEN" in content:
            raise ValueError("no answer")
        with open(calls, "a") as f:
            f.write(content[:40] + "\n")
        return extract.RuleExtractor()(content, heading, context)

    engine = Engine(spark, str(tmp_path / "e"), vector.HashingEmbedder(), asked)
    with pytest.raises(RuntimeError):
        engine.stats()
    engine.ingest(spark.createDataFrame([section("d1", text("I-485", "I-693")), section("d2", text("I-90", "I-131"))], ddl))
    assert engine.stats().first().asDict() == {"entities": 4, "chunks": 2, "mentions": 4, "relations": 2}
    second = engine.ingest(spark.createDataFrame([section("d3", text("I-485", "I-693")), section("d2", text("N-400", "I-131"))], ddl)).first().asDict()
    assert second == {"entities": 4, "chunks": 3, "mentions": 6, "relations": 2}
    g = engine.load_graph()
    names = {r["id"]: r["name"] for r in g.entities.collect()}
    weights = {(names[r["src"]], names[r["dst"]]): r["weight"] for r in g.relates.collect()}
    assert weights == {("Form I-485", "Form I-693"): 12.0, ("Form N-400", "Form I-131"): 6.0}
    assert {r["doc_id"] for r in engine._table("chunks").collect()} == {"d1", "d2", "d3"} and engine._table("embeddings").count() == 3
    assert len((tmp_path / "calls").read_text().splitlines()) == 3  # d3 has the text of d1 and no label of its own
    # A batch that fails changes nothing; an answer that fails is asked for again.
    bad = Engine(spark, str(tmp_path / "e"), None, asked)
    with pytest.raises(RuntimeError):
        bad.ingest(spark.createDataFrame([], ddl))
    engine.ingest(spark.createDataFrame([section("d4", "BROKEN words of some length. " * 20), section("d1", "short")], ddl))
    assert engine.batches() == [1, 2, 3] and {r["doc_id"] for r in engine._table("chunks").collect()} == {"d2", "d3", "d4"}
    assert spark.read.parquet(str(tmp_path / "e" / "answers")).where("error is not null").count() == 1
    # Compaction changes nothing but the number of batches; an ingest that began before it fails.
    rows = lambda: [sorted(map(str, df.collect())) for g in [engine.load_graph()] for df in (g.entities, g.mentions, g.relates, g.chunks, engine._table("chunks"), engine._table("embeddings"))]
    was, commits = rows(), engine._commits()
    engine.compact()
    assert engine.batches() == [4] and rows() == was and len([p for p in (tmp_path / "e").iterdir() if p.name.startswith("batch-")]) == 1
    with pytest.raises(RuntimeError, match="another ingest"):
        engine._commit(commits, {"batch": 4, "base": 1, "folder": "x"})
    assert engine.ingest(spark.createDataFrame([section("d5", text("I-485", "I-693"))], ddl)).first()["chunks"] == was[3].__len__() + 1 and engine.batches() == [4, 5]


def test_hubs_and_aliases(spark):
    edges = [("hub", "p", f"n{i}", float(i)) for i in range(100)] + [("n1", "p", "a", 1.0), ("a", "q", "hub", 1.0)]
    ids = {x for e in edges for x in (e[0], e[2])}
    g = graph.Graph(spark.createDataFrame([(i, i, "t") for i in ids], "id string, name string, type string"), None, spark.createDataFrame([(*e, "") for e in edges], "src string, predicate string, dst string, weight double, evidence string"))
    nodes, found = graph.k_hop(g, ["a"], 3, 60, 10, 40)
    want_nodes, want = one_by_one(ids, edges, ["a"], 3, 60, 10, 40)
    assert [r["id"] for r in nodes.orderBy("pos").collect()] == want_nodes and {(r["source"], r["predicate"], r["target"]): r["weight"] for r in found.collect()} == want
    rows = [("x", "c", "t", "d", ["b", "a"], 2, 0), ("x", "c", "t", "dd", ["a"], 1, 0), ("x", "c", "t", "ee", None, 3, 0), ("y", "c", "t", None, None, 1, 1)]
    got = {r["id"]: r for r in graph.entity_registry(spark.createDataFrame(rows, "id string, canon string, type string, description string, aliases array<string>, seq long, pos int")).collect()}
    assert got["x"]["aliases"] == ["a", "b"] and got["x"]["description"] == "dd" and got["x"]["mention_count"] == 3 and got["y"]["aliases"] == []
    assert graph.entity_by_id(g.entities, "a").count() == 1


def test_metrics(spark):
    chunks = spark.createDataFrame([("q1", "hybrid", "see I-485 and I-693", "/x/i-485instr.pdf", "vector"), ("q1", "hybrid", "", None, "graph"), ("q1", "naive", "I-90", "/x/i-90.pdf", None)], "question_id string, mode string, content string, filepath string, retrieval_source string")
    questions = spark.createDataFrame([("q1", ["i-485", "I-693"], "multi")], "question_id string, gold array<string>, hops string")
    answers = spark.createDataFrame([("q1", "hybrid", "File I-485.", "score: 9"), ("q1", "naive", "", "")], "question_id string, mode string, answer string, judgement string")
    got = {r["mode"]: r.asDict() for r in evaluate.question_metrics(chunks, questions, answers).collect()}
    assert got["hybrid"] | {"question_id": 0, "mode": 0, "hops": 0} == {"question_id": 0, "mode": 0, "hops": 0, "retrieval_recall": 1.0, "doc_recall": 0.5, "answer_recall": 0.5, "citation_precision": 0.5, "judge_accuracy": 0.9, "graph_share": 0.5}
    assert got["naive"]["citation_precision"] == 0 == got["naive"]["retrieval_recall"]
    report = evaluate.report(evaluate.question_metrics(chunks, questions, answers), 8, 2)
    assert "| retrieval_recall | 0.000 | 1.000 | +1.000 |" in report


def test_judge_refusals_and_sinks(spark, tmp_path):
    rows = [("q1", "naive", "which?", ["I-485"], "File I-485."), ("q1", "hybrid", "which?", ["I-485"], None)]

    def judge(question, gold, answer):
        return f'{{"score": {int(gold[0] in answer)}}}'

    got = {r["mode"]: r["judgement"] for r in evaluate.judged(spark.createDataFrame(rows, "question_id string, mode string, question string, gold array<string>, answer string"), judge).collect()}
    assert got == {"naive": '{"score": 1}', "hybrid": None}
    refused = evaluate.refusal_run(spark, ["a", "b"], lambda q: "The sources do not cover this." if q == "a" else "Yes.")
    assert {r["question"]: r["refused"] for r in refused.collect()} == {"a": True, "b": False} and evaluate.refusal_rate(refused).first()["rate"] == 0.5
    metrics = spark.createDataFrame([("q1", m, "multi", v) for m, v in (("naive", 0.0), ("hybrid", 1.0))], "question_id string, mode string, hops string, retrieval_recall double")
    evaluate.write_results(metrics, str(tmp_path), 8, 2)
    assert spark.read.json(str(tmp_path / "results.json")).count() == 2
    assert "| retrieval_recall | 0.000 | 1.000 | +1.000 |" in [r["value"] for r in spark.read.text(str(tmp_path / "results.md")).collect()]


def test_streaming_ingest(spark, tmp_path):
    from sparkweave.streaming.ingest import SECTIONS, stream_chunks

    rows = lambda k: spark.createDataFrame([(f"d{k}", "f", 0, "h", "A sentence of words. " * 20, {})], SECTIONS)
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    for k in range(2):
        rows(k).write.mode("append").parquet(paths[0])
        stream_chunks(spark, *paths).awaitTermination(120)
    assert {r["doc_id"] for r in spark.read.parquet(paths[1]).collect()} == {"d0", "d1"}
