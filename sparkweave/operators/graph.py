"""The typed knowledge graph as tables: entities, mentions, relates; and its traversal as set operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.functions import text as T
from sparkweave.schema import DOMAIN, DomainSchema
from sparkweave.tables import written


@dataclass
class Graph:
    """entities: id, name, type, ...; mentions: chunk_id, entity_id; relates: src, predicate, dst, evidence, source_chunk, weight; chunks: id, heading_path, filepath."""

    entities: DataFrame
    mentions: DataFrame
    relates: DataFrame
    chunks: DataFrame | None = None


def typed_entities(extraction: DataFrame, domain: DomainSchema = DOMAIN, *extra: str) -> DataFrame:
    """One row for each extracted entity, in order (seq, pos), with corrected type, canonical name and id; ``extra``: more columns of the extraction.

    Types, names and ids are made once for each different name.
    """
    rows = extraction.select("chunk_id", "seq", *extra, F.posexplode("entities").alias("pos", "e")).select("chunk_id", "seq", *extra, "pos", "e.*")
    known = rows.select(F.col("name").alias("known"), F.col("entity_type").alias("declared")).distinct()
    known = known.withColumn("type", T.corrected_type(F.col("known"), F.col("declared"), domain))
    known = known.withColumns({"canon": T.canonical_name(F.col("known"), F.col("type"), domain), "id": T.entity_id(F.col("known"), F.col("type"), domain)})
    same = F.col("name").eqNullSafe(F.col("known")) & F.col("entity_type").eqNullSafe(F.col("declared"))
    return rows.join(known, same, "left").drop("known", "declared")


def _place() -> Column:
    return F.struct("seq", "pos")


def entity_registry(rows: DataFrame) -> DataFrame:
    """Entities from rows id, canon, type, description, aliases, seq (of any type with an order), pos.

    The first name and type; the longest description, the first of equal ones; aliases in the order in which they were seen; mentions.
    Aliases are made distinct before they are gathered, so what comes together for an entity does not grow with its mentions.
    """
    text = F.coalesce("description", F.lit(""))
    main = rows.groupBy("id").agg(
        F.min_by("canon", _place()).alias("name"),
        F.min_by("type", _place()).alias("type"),
        F.min_by(text, F.struct(-F.length(text), "seq", "pos")).alias("description"),
        F.count(F.lit(1)).alias("mention_count"),
    )
    each = rows.select("id", "seq", "pos", F.posexplode("aliases").alias("k", "alias"))
    seen = each.groupBy("id", "alias").agg(F.min(F.struct("seq", "pos", "k")).alias("at"))
    listed = seen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    out = main.join(listed, "id", "left")
    return out.select("id", "name", "type", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "mention_count")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last write for each key; ``order`` tells the writes apart."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def name_keys(rows: DataFrame, *extra: str) -> DataFrame:
    """key, id, seq, pos, k: the canonical and the written name of each row, lower-cased."""
    return rows.select("id", "seq", "pos", *extra, F.posexplode(F.array(F.lower("canon"), F.lower(T.strip(F.col("name"))))).alias("k", "key"))


def last_ids(keys: DataFrame) -> DataFrame:
    """key, id: the last writer of each key, and of one row the written name."""
    return keys.groupBy("key").agg(F.max_by("id", F.struct("seq", "pos", "k")).alias("id"))


def name_index(rows: DataFrame) -> DataFrame:
    """key, id: canonical and written names, lower-cased; the last writer wins, and of one row the written name."""
    return last_ids(name_keys(rows))


def mentions(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", F.col("id").alias("entity_id")).distinct()


def relation_rows(extraction: DataFrame, *extra: str) -> DataFrame:
    """One row for each extracted relation, in order (seq, pos)."""
    return extraction.select("chunk_id", "seq", *extra, F.posexplode("relations").alias("pos", "r")).select("chunk_id", "seq", *extra, "pos", "r.*")


def relation_ends(rows: DataFrame, domain: DomainSchema = DOMAIN, *extra: str) -> DataFrame:
    """seq, pos, end (0: subject, 1: object), key and ckey (its written and canonical name), and what it is made of if it is unknown: made, canon, type.

    All but the places is made once for each different name as it is written.
    """
    more = [F.col(c) for c in extra]
    ends = rows.select(F.explode(F.array(F.struct("seq", "pos", *more, F.lit(0).alias("end"), F.col("subject").alias("name")), F.struct("seq", "pos", *more, F.lit(1).alias("end"), F.col("object").alias("name")))).alias("x")).select("x.*")
    known = ends.select(F.col("name").alias("known")).where("known is not null").distinct()
    known = known.withColumn("bare", T.strip(F.col("known"))).where("bare <> ''")
    known = known.withColumn("type", T.infer_type(F.col("bare"), domain))
    known = known.withColumns({"canon": T.canonical_name(F.col("bare"), F.col("type"), domain)})
    known = known.withColumns({"key": F.lower("bare"), "ckey": F.lower("canon"), "made": T.entity_id(F.col("canon"), F.col("type"), domain)})
    return ends.join(known, F.col("name") == F.col("known")).drop("name", "known", "bare")


def resolved_ends(ends: DataFrame, index: DataFrame, kept=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """``ends`` with id, and for each ckey of unknown ends the entity made for it: ckey, id, name, type.

    An end is looked up as written, then under its canonical name. Unknown ends with one canonical key are one entity: that of the first of
    them. So an end depends on the index at two keys, and on the other ends of its ckey. ``kept`` may write what is read more than once.
    """
    as_written = index.select(F.col("key"), F.col("id").alias("id1"))
    as_canon = index.select(F.col("key").alias("ckey"), F.col("id").alias("id2"))
    found = kept(ends.join(as_written, "key", "left").join(as_canon, "ckey", "left"))
    fresh = found.where("id1 is null and id2 is null")
    first = kept(fresh.groupBy("ckey").agg(F.min_by(F.struct("made", "canon", "type"), F.struct("seq", "pos", "end")).alias("m")))
    ids = found.join(first.select("ckey", F.col("m.made").alias("id3")), "ckey", "left").select(*ends.columns, F.coalesce("id1", "id2", "id3").alias("id"))
    return ids, first.select("ckey", F.col("m.made").alias("id"), F.col("m.canon").alias("name"), F.col("m.type").alias("type"))


def asserted_relations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with entity ids at both ends, which differ. ``ids``: seq, pos, end, id."""
    sides = ids.groupBy("seq", "pos").agg(F.max(F.when(F.col("end") == 0, F.col("id"))).alias("src"), F.max(F.when(F.col("end") == 1, F.col("id"))).alias("dst"))
    out = rows.join(sides, ["seq", "pos"]).where("src is not null and dst is not null and src <> dst")
    return out.select("chunk_id", "seq", "pos", "src", "predicate", "dst", "evidence")


def resolved_relations(extraction: DataFrame, index: DataFrame, domain: DomainSchema = DOMAIN) -> tuple[DataFrame, DataFrame]:
    """Relations with entity ids at their ends, and the entities that had to be made for unknown ends."""
    each = relation_rows(extraction)
    ids, made = resolved_ends(relation_ends(each, domain), index)
    return asserted_relations(each, ids), made.select("id", "name", "type").dropDuplicates(["id"])


def relation_weights(asserted: DataFrame) -> DataFrame:
    """One row for each (src, predicate, dst): weight counts assertions; evidence and source are the first's. Self loops go."""
    rows = asserted.where("src <> dst")
    return rows.groupBy("src", "predicate", "dst").agg(
        T.evidence_stored(F.coalesce(F.min_by("evidence", _place()), F.lit(""))).alias("evidence"),
        F.min_by("chunk_id", _place()).alias("source_chunk"),
        F.count(F.lit(1)).cast("double").alias("weight"),
    )


def with_known_ends(relates: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = entities.select("id")
    return relates.join(ids, relates["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")


def with_made(entities: DataFrame, made: DataFrame) -> DataFrame:
    """Extracted entities and, where no such entity was extracted, those made for unknown ends."""
    extra = made.join(entities, "id", "left_anti").select("id", "name", "type", F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"), F.lit(0).cast("long").alias("mention_count"))
    return entities.unionByName(extra)


def build(extraction: DataFrame, chunks: DataFrame | None = None, domain: DomainSchema = DOMAIN) -> Graph:
    """The graph of an extraction table (chunk_id, seq, entities, relations). Made-up entities never override extracted ones."""
    rows = typed_entities(extraction, domain)
    entities = entity_registry(rows)
    asserted, made = resolved_relations(extraction, name_index(rows), domain)
    entities = with_made(entities, made)
    nodes = None
    if chunks is not None:
        nodes = chunks.join(extraction.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), "heading_path", "filepath")
    return Graph(entities, mentions(rows), with_known_ends(relation_weights(asserted), entities), nodes)


def stats(graph: Graph) -> DataFrame:
    """One row: entities, chunks, mentions, relations."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    chunks = graph.chunks if graph.chunks is not None else graph.mentions.select("chunk_id").distinct()
    return count(graph.entities, "entities").crossJoin(count(chunks, "chunks")).crossJoin(count(graph.mentions, "mentions")).crossJoin(count(graph.relates, "relations"))


def relations_by_predicate(relates: DataFrame) -> DataFrame:
    return relates.groupBy("predicate").agg(F.count(F.lit(1)).alias("relations"))


def full_graph(relates: DataFrame) -> DataFrame:
    """All edges; a missing or zero weight is 1."""
    weight = F.when(F.col("weight").isNull() | (F.col("weight") == 0), 1.0).otherwise(F.col("weight"))
    return relates.select(F.col("src").alias("source"), F.col("dst").alias("target"), "predicate", weight.alias("weight"))


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.lower("name") == name.lower()).orderBy("id").limit(1)


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    """The entity with the id, or no row."""
    return entities.where(F.col("id") == F.lit(entity_id))


def search_entities(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities whose name or an alias contains the query, by id."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("name"), q) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), q))
    return entities.where(hit).orderBy("id").limit(limit)


def top_typed_edges(relates: DataFrame, entities: DataFrame, predicate: str, src_type: str, dst_type: str, limit: int = 15) -> DataFrame:
    """The heaviest edges of a predicate between entities of two types: src_name, dst_name, weight."""
    a = entities.where(F.col("type") == src_type).select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = entities.where(F.col("type") == dst_type).select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    edges = relates.where(F.col("predicate") == predicate).join(a, "src").join(b, "dst")
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(limit).select("src_name", "dst_name", "weight")


def incident(relates: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """node, other and the edge for all edges that touch the nodes; the direction stays in src and dst."""
    out = relates.withColumns({"node": F.col("src"), "other": F.col("dst")})
    back = relates.withColumns({"node": F.col("dst"), "other": F.col("src")})
    return out.unionByName(back).join(nodes.select(F.col(node).alias("node")).distinct(), "node", "left_semi")


def degrees(relates: DataFrame) -> DataFrame:
    """node, degree: in and out edges, parallel predicates apart."""
    ends = relates.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def k_hop(graph: Graph, seeds: list, hops: int = 2, max_nodes: int = 60, fanout: int = 10, hub_degree: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, pos) and edges (source, target, predicate, weight, evidence) around the seeds.

    Seeds are all taken, in order; unknown ids are no nodes. In each hop the frontier's edges are ranked by weight; nodes
    of more than ``hub_degree`` edges admit no neighbour, others at most those among their first ``fanout`` edges, until ``max_nodes``
    are reached. Edges to known nodes are kept for hubs too. The last frontier is not expanded.

    What is collected is bounded by ``max_nodes`` and the seeds: their degrees, the edges that nodes other than hubs are ranked by, and
    the edges among known nodes. A hub's edges are counted and joined with known nodes, but never ranked or gathered.
    """
    spark = graph.entities.sparkSession
    key_type = graph.entities.schema["id"].dataType.simpleString()
    order = list(dict.fromkeys(seeds))
    wanted = spark.createDataFrame([(s, i) for i, s in enumerate(order)], f"id {key_type}, pos int")
    found = {r["id"] for r in graph.entities.join(F.broadcast(wanted), "id", "left_semi").select("id").collect()}
    nodes = [s for s in order if s in found]
    frontier, seen = list(nodes), {}
    columns = ["src", "predicate", "dst", "weight", "evidence"]
    heavy = Window.partitionBy("pos").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "src", "predicate", "dst")
    # Both directions from one scan of the edges.
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    for _ in range(max(1, hops)):
        if len(nodes) >= max_nodes or not frontier:
            break

        def touching(some: list) -> DataFrame:
            front = spark.createDataFrame([(n, frontier.index(n)) for n in some], f"node {key_type}, pos int")
            return graph.relates.select(*columns, ends.alias("end")).select(*columns, "end.node", "end.other").join(F.broadcast(front), "node")

        degree = {r["node"]: r["n"] for r in touching(frontier).groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
        small, hubs = ([n for n in frontier if n in degree and (degree[n] > hub_degree) == hub] for hub in (False, True))
        ranked = touching(small).withColumn("rn", F.row_number().over(heavy)).select(*columns, "other", "pos", "rn").collect() if small else []
        places = {n: (-1, -1) for n in nodes}
        for r in sorted((r for r in ranked if r["rn"] <= fanout), key=lambda r: (r["pos"], r["rn"])):
            if r["other"] not in places and len(places) < max_nodes:
                places[r["other"]] = r["pos"], r["rn"]
        rows = [r for r in ranked if r["other"] in places]
        if hubs:
            known = spark.createDataFrame([(n,) for n in places], f"other {key_type}")
            rows += touching(hubs).join(F.broadcast(known), "other", "left_semi").select(*columns, "other", "pos", F.lit(0).alias("rn")).collect()
        for r in rows:
            if places[r["other"]] <= (r["pos"], r["rn"]):
                seen[r["src"], r["predicate"], r["dst"]] = tuple(r[c] for c in columns)
        frontier = [n for n in places if places[n] != (-1, -1)]
        nodes += frontier
    places = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], f"id {key_type}, pos int"))
    out_nodes = graph.entities.join(places, "id").select("id", "name", "type", "pos")
    edges = spark.createDataFrame(list(seen.values()), f"source {key_type}, predicate string, target {key_type}, weight double, evidence string")
    return out_nodes, edges.select("source", "target", "predicate", "weight", "evidence")


def _ends(relates: DataFrame) -> DataFrame:
    """node, other and the edge, once for each end, from one scan."""
    columns = ["src", "predicate", "dst", "weight", "evidence"]
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    return relates.select(*columns, F.explode(ends).alias("end")).select("end.node", "end.other", "src", "predicate", "dst", "weight", "evidence")


def k_hop_many(graph: Graph, seeds: DataFrame, hops: int = 2, max_nodes: int = 60, fanout: int = 10, hub_degree: int = 40) -> tuple[DataFrame, DataFrame]:
    """``k_hop`` for all questions of ``seeds`` (question, id, pos) at once: nodes (question, id, name, type, pos) and edges (question, source, target, predicate, weight, evidence).

    Nothing comes to the driver. A hop is one step for all questions: the frontier (question, node, place) meets the edges of its nodes,
    which are ranked once for each node, however many questions have it; windows by question apply the budgets, over at most
    ``max_nodes * fanout`` rows of each. Nodes beyond ``hub_degree`` are counted but never ranked or joined by themselves: their edges to known nodes are looked
    up by both ends. The state after a hop, at most ``max_nodes`` nodes a question, is written, so the plan doesn't grow with the hops.

    Edges are made and written once. A hop reads them once, against its different nodes, whose written table has a known size: while it is small
    no edge is shuffled, and else every edge once. What is ranked, counted and looked up are the edges of these nodes, which are written too.

    Null questions and ids take no part; of a seed that a question has several times the first place counts; without seeds there are no rows.
    """
    first = seeds.where("question is not null and id is not null").groupBy("question", "id").agg(F.min("pos").alias("at"))
    first = first.join(graph.entities.select("id"), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("question").orderBy("at", "id")) - 1
    nodes = written(first.select("question", "id", place.alias("pos"), F.lit(0).alias("hop")), "khop")
    ends, found = _ends(written(graph.relates.select("src", "predicate", "dst", "weight", "evidence"), "relates")), None
    for hop in range(max(1, hops)):
        count = nodes.groupBy("question").agg(F.count(F.lit(1)).alias("known"))
        front = nodes.where(F.col("hop") == hop).join(count.where(F.col("known") < max_nodes), "question").select("question", F.col("id").alias("node"), F.col("pos").alias("place"), "known")
        front = written(front, "khop")
        asked = written(front.select("node").distinct(), "khop")
        mine = written(ends.join(asked, "node", "left_semi"), "khop")
        degree = mine.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        heavy = Window.partitionBy("node").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "src", "predicate", "dst")
        ranked = mine.join(degree.where(F.col("degree") <= hub_degree).select("node"), "node").withColumn("rn", F.row_number().over(heavy))
        met = written(front.join(ranked, "node").join(nodes.select("question", F.col("id").alias("other"), F.lit(True).alias("old")), ["question", "other"], "left"), "khop")
        order = F.struct("place", "rn")
        new = met.where((F.col("rn") <= fanout) & F.col("old").isNull()).groupBy("question", "other").agg(F.min(order).alias("k"), F.first("known").alias("known"))
        new = new.withColumn("nth", F.row_number().over(Window.partitionBy("question").orderBy("k"))).where(F.col("nth") <= max_nodes - F.col("known"))
        new = written(new.select("question", "other", "k", (F.col("known") + F.col("nth") - 1).alias("pos")), "khop")
        kept = met.join(new.select("question", "other", "k"), ["question", "other"], "left").where(F.coalesce(F.col("old"), F.lit(False)) | (F.col("k") <= order))
        # Of a hub the edges to nodes that its question knows by its turn: looked up by both ends.
        hubs = front.join(degree.where(F.col("degree") > hub_degree).select("node"), "node")
        reach = nodes.select("question", F.col("id").alias("other"), F.lit(-1).alias("since")).unionByName(new.select("question", "other", F.col("k.place").alias("since")))
        pairs = hubs.join(reach, "question").where(F.col("since") < F.col("place")).select("question", "node", "other")
        columns = ["question", "src", "predicate", "dst", "weight", "evidence"]
        step = kept.select(*columns).unionByName(pairs.join(mine, ["node", "other"]).select(*columns))
        step = written(step.distinct(), "khop")
        found = step if found is None else found.unionByName(step)
        nodes = nodes.unionByName(new.select("question", F.col("other").alias("id"), "pos", F.lit(hop + 1).alias("hop")))
    edges = found.groupBy("question", "src", "predicate", "dst").agg(F.first("weight").alias("weight"), F.first("evidence").alias("evidence"))
    edges = edges.select("question", F.col("src").alias("source"), F.col("dst").alias("target"), "predicate", "weight", "evidence")
    return nodes.drop("hop").join(graph.entities.select("id", "name", "type"), "id").select("question", "id", "name", "type", "pos"), edges


def display_links(relates: DataFrame, nodes: DataFrame, limit: int = 80) -> DataFrame:
    """The heaviest links with both ends among the nodes."""
    ids = nodes.select("id")
    inner = relates.join(ids, relates["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")
    return inner.orderBy(F.desc("weight"), "src", "predicate", "dst").limit(limit)


def legend(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct()
