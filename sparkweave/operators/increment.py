"""The graph kept up to date batch by batch: what a batch of documents does not touch is neither shuffled nor written again.

Every table is a log of writes by key: a row of a later batch takes the place of earlier ones with its key, and a row that is ``gone`` takes
them away. A batch brings documents, new or in place of earlier versions. From the extracted rows that come and go follow the keys
that they touch, and only the state of these keys is computed anew, from rows that a semi join with the touched keys picks before anything is
shuffled; what that changes touches the keys of the next table:

    mentioned (an extracted entity)  ->  entities by id
                                     ->  names  ->  index by name: where the id of a name changes,
    ends (an end of a relation)      ->  the ends written so, and all ends of their canonical names, are resolved again
                                     ->  asserted (a relation between two ids)  ->  edges by (src, predicate, dst)

Firsts and longest texts have no inverse, so a key that loses a row is computed from its remaining rows, not by subtraction. The result equals
``graph.build`` over all documents, row by row.

``compacted`` writes the present state as one batch. Ties, nulls and empty batches are those of ``graph.build``; a batch without rows for a document
takes its earlier ones away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators import graph as G
from sparkweave.schema import DOMAIN, DomainSchema
from sparkweave.tables import written

#: The key of each table. The key of an assertion holds its edge, so that a row that moves to another edge leaves a mark at the old one.
KEYS = {
    "mentioned": ["seq", "pos"],
    "entities": ["id"],
    "names": ["key", "seq", "pos", "k"],
    "index": ["key"],
    "relations": ["seq", "pos"],
    "ends": ["seq", "pos", "end"],
    "made": ["ckey"],
    "asserted": ["seq", "pos", "src", "predicate", "dst"],
    "edges": ["src", "predicate", "dst"],
    "chunks": ["id"],
}


class GraphLog:
    """``read(name, batch)`` gives a table of a batch, ``write(df, name)`` writes one of the batch that is being made; ``batches``: those that count."""

    def __init__(self, read: Callable[[str, int], DataFrame], write: Callable[[DataFrame, str], object] | None = None, batches: list[int] = (), domain: DomainSchema = DOMAIN) -> None:
        self._read, self._write, self.batches, self.domain = read, write, list(batches), domain
        self.batch = max(self.batches, default=0) + 1

    def current(self, name: str, touched: DataFrame | None = None, on: list[str] | None = None, also_new: bool = True) -> DataFrame | None:
        """The rows that count, or those of them whose columns ``on`` are among ``touched``; null before the first batch."""
        batches = [*self.batches, *([self.batch] if also_new and self._write is not None else [])]
        rows = None
        for batch in batches:
            one = self._read(name, batch).withColumn("batch", F.lit(batch))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return None
        if touched is not None:
            rows = rows.join(touched.select(*on).distinct(), on, "left_semi")
        if len(batches) > 1:
            rows = G.latest(rows, KEYS[name], "batch")
        return rows.where("not gone").drop("batch", "gone")

    def _put(self, name: str, came: DataFrame, went: DataFrame | None = None) -> DataFrame:
        """Writes rows that come, and marks for rows that go unless a row with their key comes."""
        out = came.withColumn("gone", F.lit(False))
        if went is not None:
            lost = went.join(came.select(*KEYS[name]), KEYS[name], "left_anti").withColumn("gone", F.lit(True))
            out = out.unionByName(lost, allowMissingColumns=True)
        self._write(out, name)
        return self._read(name, self.batch)

    def _before(self, name: str, touched: DataFrame, on: list[str]) -> DataFrame | None:
        return self.current(name, touched, on, also_new=False)

    def add(self, extraction: DataFrame, documents: DataFrame, chunks: DataFrame) -> None:
        """A batch: ``extraction`` (doc_id, chunk_id, seq, entities, relations) and ``chunks`` (doc_id, id, heading_path, filepath) of ``documents`` (doc_id), whose earlier rows go.

        ``seq`` orders all rows, and two versions of a document never share one (the engine's begins with the batch).
        """
        self._chunks(documents, chunks)
        changed = self._entities(extraction, documents)
        edges = self._relations(extraction, documents, changed)
        rows = self.current("asserted", edges, KEYS["edges"])
        self._put("edges", G.relation_weights(rows), edges)

    def _chunks(self, documents: DataFrame, chunks: DataFrame) -> None:
        self._put("chunks", chunks, self._before("chunks", documents, ["doc_id"]))

    def _entities(self, extraction: DataFrame, documents: DataFrame) -> DataFrame:
        """Entities and names; returns the names (key) whose id changed."""
        rows = self._put("mentioned", G.typed_entities(extraction, self.domain, "doc_id"), self._before("mentioned", documents, ["doc_id"]))
        ids = rows.select("id").distinct()
        self._put("entities", G.entity_registry(self.current("mentioned", ids, ["id"])), ids)
        names = G.name_keys(rows, "doc_id", "gone")
        self._write(names, "names")
        keys = names.select("key").distinct()
        now = G.last_ids(self.current("names", keys, ["key"]))
        before = self._before("index", keys, ["key"])
        both = keys.join(now, "key", "left")
        if before is not None:
            both = both.join(before.withColumnRenamed("id", "was"), "key", "left").where(~F.col("id").eqNullSafe(F.col("was"))).drop("was")
        return self._put("index", both.where("id is not null"), both.where("id is null")).select("key")

    def _relations(self, extraction: DataFrame, documents: DataFrame, changed: DataFrame) -> DataFrame:
        """Ends and assertions; returns the keys of the edges that assertions came to or went from."""
        rows = self._put("relations", G.relation_rows(extraction, "doc_id"), self._before("relations", documents, ["doc_id"]))
        # What several of the next steps read is written, so that none of them makes it again.
        came = written(G.relation_ends(rows.where("not gone"), self.domain, "doc_id"), "came")
        went = self._before("ends", documents, ["doc_id"])
        went = None if went is None else written(went, "went")
        # Ends are resolved by whole groups of one canonical name.
        groups = came.select("ckey").unionByName(changed.select(F.col("key").alias("ckey")))
        if went is not None:
            groups = groups.unionByName(went.select("ckey")).unionByName(self._before("ends", changed, ["key"]).select("ckey"))
        groups = written(groups.distinct(), "groups")
        again = came
        if went is not None:
            stay = self._before("ends", groups, ["ckey"]).join(documents.select("doc_id").distinct(), "doc_id", "left_anti")
            again = came.unionByName(written(stay.drop("id"), "stay"))
        wanted = again.select(F.explode(F.array("key", "ckey")).alias("key"))
        ids, made = G.resolved_ends(again, self.current("index", wanted, ["key"]), lambda df: written(df, "found"))
        ends = self._put("ends", ids, went)
        self._put("made", made, groups)
        touched = ends.select("seq", "pos").distinct()
        now = G.asserted_relations(self.current("relations", touched, ["seq", "pos"]), self.current("ends", touched, ["seq", "pos"]))
        return self._put("asserted", now, self._before("asserted", touched, ["seq", "pos"])).select(*KEYS["edges"]).distinct()

    def graph(self) -> G.Graph:
        """The graph of the batches that count."""
        made = self.current("made").select("id", "name", "type").dropDuplicates(["id"])
        entities = self.current("entities").select("id", "name", "type", "description", "aliases", "mention_count")
        mentions = self.current("mentioned").select("chunk_id", F.col("id").alias("entity_id")).distinct()
        chunks = self.current("chunks").select("id", "heading_path", "filepath")
        return G.Graph(G.with_made(entities, made), mentions, self.current("edges").select("src", "predicate", "dst", "evidence", "source_chunk", "weight"), chunks)

    def compacted(self, write: Callable[[DataFrame, str], object]) -> None:
        """Writes the present state of every table by ``write(df, name)``, as one batch."""
        for name in KEYS:
            write(self.current(name).withColumn("gone", F.lit(False)), name)
