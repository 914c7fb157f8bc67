"""The engine as one object: ingest, query, graph, stats, compaction.

Every ingest is a batch with a folder of its own, and counts only when its commit is written; so a failure half-way changes nothing. Commits are
numbered files that are created and never overwritten: of two ingests that began at the same state the second one to end gets an
error and changes nothing. A document belongs to the last batch that has it: earlier rows are left out when tables are read. The graph is
a log of writes by key (``increment``), to which a batch adds what its keys touch. ``compact`` writes the present state as one batch, after
which reads touch that batch alone, and removes folders that no longer count. Answers of the extractor are kept by a key of context and
content, also of batches that failed, so no chunk is asked about twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import chunk, extract, graph, increment, retrieve, vector
from sparkweave.schema import DOMAIN, DomainSchema
from sparkweave.functions import text as T

NOTHING_FOUND = "No passage of the documents matches this question."
TABLES = ("documents", "chunks", "embeddings", "extraction")


@dataclass
class Settings:
    """What a deployment may change."""

    top_k_vector: int = 10
    top_k_graph: int = 10
    graph_hops: int = 2
    max_chars: int = 1500
    min_chars: int = 500
    overlap: int = 100
    clean: bool = True
    min_substantial: int = 200
    concurrency: int = 8


@dataclass
class Answer:
    answer: str
    citations: list = field(default_factory=list)
    chunks_used: int = 0
    error: str | None = None


class Engine:
    """``embedder``, ``extractor``, ``generator`` and ``query_entities`` are the models; what needs a missing one raises."""

    def __init__(self, spark: SparkSession, path: str, embedder=None, extractor=None, generator=None, query_entities=None, domain: DomainSchema = DOMAIN, settings: Settings | None = None) -> None:
        self.spark, self.path, self.embedder, self.extractor, self.generator = spark, path.rstrip("/"), embedder, extractor, generator
        self.query_entities, self.domain, self.settings = query_entities, domain, settings or Settings()

    def _read(self, path: str) -> DataFrame | None:
        """A table, or null before it is written."""
        try:
            return self.spark.read.parquet(f"{self.path}/{path}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commits(self) -> list[dict]:
        """The commits that count, in order: number, batch, base (the first batch that counts since) and folder. One small row a batch comes to the driver."""
        try:
            found = self.spark.read.schema("number int, batch int, base int, folder string").json(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        rows = sorted((r.asDict() for r in found.collect()), key=lambda r: r["number"])
        return [r for r in rows if r["batch"] >= rows[-1]["base"]]

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        return [r["batch"] for r in self._commits()]

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _commit(self, before: list[dict], row: dict) -> None:
        row = {"number": max((r["number"] for r in before), default=0) + 1} | row
        fs, target = self._hadoop(f"{self.path}/commits/{row['number']:08}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            raise RuntimeError("another ingest ended since this one began; nothing was changed") from e
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def _reader(self, commits: list[dict]):
        folders = {r["batch"]: r["folder"] for r in commits}
        return lambda name, batch: self.spark.read.parquet(f"{self.path}/{folders[batch]}/{name}")

    def _table(self, name: str, commits: list[dict] | None = None) -> DataFrame:
        """The rows that count: of each document those of its last batch."""
        commits = self._commits() if commits is None else commits
        if not commits:
            raise RuntimeError("nothing was ingested yet")
        read = lambda n: self.spark.read.parquet(*(f"{self.path}/{r['folder']}/{n}" for r in commits))
        rows = read(name)
        if len(commits) > 1:
            last = read("documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
            rows = rows.join(last, ["doc_id", "batch"], "left_semi")
        return rows.drop("batch")

    def _answers(self, asked: DataFrame) -> DataFrame:
        """key, answer for what is asked: kept answers, and new ones, which are kept."""
        one = asked.select("key", "content", "heading_path", "context").dropDuplicates(["key"])
        kept = self._read("answers")
        if kept is not None:
            one = one.join(kept.where("answer is not null").select("key"), "key", "left_anti")
        extract.answered(one, self.extractor, self.settings.concurrency).select("key", "answer", "error").write.mode("append").parquet(f"{self.path}/answers")
        return self._read("answers").where("answer is not null").select("key", "answer").dropDuplicates(["key"])

    def ingest(self, sections: DataFrame) -> DataFrame:
        """Adds sections (doc_id, filepath, section_no, heading_path, text, metadata) to all tables, in place of earlier ones of their documents; returns the stats."""
        if self.embedder is None or self.extractor is None:
            raise RuntimeError("ingest needs an embedder and an extractor")
        s, before = self.settings, self._commits()
        batch = max((r["batch"] for r in before), default=0) + 1
        folder = f"batch-{batch:06}-{uuid.uuid4().hex[:8]}"

        def write(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{self.path}/{folder}/{name}")
            return self.spark.read.parquet(f"{self.path}/{folder}/{name}")

        documents = write(sections.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("batch", F.lit(batch)), "documents")
        chunks = chunk.sections_to_chunks(sections, s.max_chars, s.min_chars, s.overlap)
        if s.clean:
            chunks = chunks.where(T.is_substantial(F.col("content"), s.min_substantial, self.domain))
        chunks = write(chunks.withColumn("batch", F.lit(batch)), "chunks")
        vectors = vector.embedded(chunks, self.embedder).join(chunks.select("chunk_id", "doc_id", "batch"), "chunk_id")
        write(vectors, "embeddings")
        context = F.coalesce(T.form_label(F.coalesce("filepath", F.lit(""))), F.lit(""))
        # The order in which chunks were read decides what comes first in the graph.
        asked = chunks.withColumns({"context": context, "seq": F.struct("batch", "doc_id", "section_no", "ordinal")})
        asked = asked.withColumn("key", T.cache_key(F.col("context"), F.col("content")))
        found = extract.parsed(asked.join(self._answers(asked), "key"), self.domain)
        found = write(found.select("chunk_id", "doc_id", "batch", "seq", "entities", "relations"), "extraction")
        nodes = chunks.join(found.select("chunk_id"), "chunk_id", "left_semi").select("doc_id", F.col("chunk_id").alias("id"), "heading_path", "filepath")
        row = {"batch": batch, "base": before[0]["batch"] if before else batch, "folder": folder}
        log = increment.GraphLog(self._graph_reader([*before, row]), lambda df, name: write(df, f"graph_{name}"), [r["batch"] for r in before], self.domain)
        log.add(found, documents, nodes)
        self._commit(before, row)
        return self.stats()

    def _graph_reader(self, commits: list[dict]):
        read = self._reader(commits)
        return lambda name, batch: read(f"graph_{name}", batch)

    def compact(self) -> None:
        """Writes the present state as one batch, and removes the folders and commits that no longer count; readers must read again."""
        before = self._commits()
        if len(before) < 2:
            return
        batch = before[-1]["batch"] + 1
        folder = f"batch-{batch:06}-{uuid.uuid4().hex[:8]}"
        for name in TABLES:
            self._table(name, before).withColumn("batch", F.lit(batch)).write.parquet(f"{self.path}/{folder}/{name}")
        log = increment.GraphLog(self._graph_reader(before), None, [r["batch"] for r in before], self.domain)
        log.compacted(lambda df, name: df.write.parquet(f"{self.path}/{folder}/graph_{name}"))
        self._commit(before, {"batch": batch, "base": batch, "folder": folder})
        fs, root = self._hadoop(self.path)
        for status in fs.listStatus(root):
            if status.getPath().getName().startswith("batch-") and status.getPath().getName() != folder:
                fs.delete(status.getPath(), True)
        for r in before:
            fs.delete(self._hadoop(f"{self.path}/commits/{r['number']:08}.json")[1], False)

    def load_graph(self) -> graph.Graph:
        """The graph of all documents."""
        commits = self._commits()
        if not commits:
            raise RuntimeError("nothing was ingested yet")
        return increment.GraphLog(self._graph_reader(commits), None, [r["batch"] for r in commits], self.domain).graph()

    def stats(self) -> DataFrame:
        return graph.stats(self.load_graph())

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """All nodes and all edges."""
        g = self.load_graph()
        return g.entities.select("id", "name", "type"), graph.full_graph(g.relates)

    def retriever(self) -> retrieve.Retriever:
        if self.embedder is None:
            raise RuntimeError("retrieval needs an embedder")
        return retrieve.Retriever(self._table("chunks"), self._table("embeddings"), self.load_graph(), self.embedder, self.query_entities)

    def query(self, question: str, top_k: int | None = None, hops: int | None = None, use_graph: bool = True) -> Answer:
        s = self.settings
        question = question.strip()
        found = self.retriever().retrieve(question, top_k or s.top_k_vector, top_k or s.top_k_graph, hops or s.graph_hops, use_graph)
        cited = [r.asDict() for r in retrieve.citations(found.merged).collect()]
        if not cited:
            return Answer(NOTHING_FOUND)
        if self.generator is None:
            raise RuntimeError("an answer needs a generator")
        context = retrieve.context_text(found.merged).first()["context"]
        if found.nodes is not None:
            context += "\n\n" + retrieve.graph_text(found.nodes, found.edges)
        try:
            return Answer(self.generator(question, context), cited, len(cited))
        except Exception as e:  # noqa: BLE001  the caller gets the error as an answer
            return Answer(f"An error occurred while generating the answer: {e}", error=str(e))
