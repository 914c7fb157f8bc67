"""Hybrid retrieval: nearest chunks, entities in query and chunks, graph expansion, fusion, citations and prompt texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.functions import text as T
from sparkweave.operators import graph as G
from sparkweave.operators import vector as V
from sparkweave.tables import written

SCANNED, MIN_NAME, MIN_SUBSTRING, SUBSTRING_LIMIT = 5, 5, 4, 2


def names_in_contents(contents: DataFrame, entities: DataFrame) -> DataFrame:
    """Different names of forms, of at least five characters, that the contents contain. Contents are few (the top hits), so they are broadcast."""
    forms = entities.where((F.col("type") == "form") & (F.length("name") >= MIN_NAME)).select("name")
    low = F.broadcast(contents.select(F.lower("content").alias("low")))
    return forms.join(low, F.contains(F.col("low"), F.lower("name"))).select("name").distinct()


def grams(text: Column, size: int) -> Column:
    """The different parts of ``size`` characters of a text, read in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def tokens(text: Column) -> Column:
    """The different lower-cased parts of a text between white space."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: w != "")


def parts_in_tokens(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """part, token for every part that a token contains. ``parts``: part; ``vocabulary``: token; both of different values.

    Postings of grams of up to ``MIN_NAME`` characters take the place of a search of every token for every part: a token is searched for a part only if it has the part's
    rarest gram. Postings are made for grams that parts have.
    """
    size = lambda part: F.least(F.length(part), F.lit(MIN_NAME))
    sized = parts.withColumn("size", size(F.col("part")))
    found = None
    for n in sorted(r["size"] for r in sized.select("size").distinct().collect()):  # at most MIN_NAME numbers
        wanted = written(sized.where(F.col("size") == n).select("part", F.explode(grams(F.col("part"), n)).alias("gram")), "grams")
        postings = vocabulary.where(F.length("token") >= n).select("token", F.explode(grams(F.col("token"), n)).alias("gram"))
        postings = written(postings.join(wanted.select("gram").distinct(), "gram", "left_semi"), "postings")
        count = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rare = wanted.join(count, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).where("k.n > 0")
        hits = postings.join(rare.select("part", F.col("k.gram").alias("gram")), "gram").where(F.contains("token", "part")).select("part", "token")
        found = hits if found is None else found.unionByName(hits)
    return parts.select("part", F.lit("").alias("token")).limit(0) if found is None else found


def names_in_all(contents: DataFrame, names: DataFrame, least: int = MIN_NAME) -> DataFrame:
    """chunk_id, name for every name of at least ``least`` characters (three or more) that a content contains, case aside. ``contents``: chunk_id, content; ``names``: name.

    A content that contains a name has a token (what lies between white space) that contains the name's longest part between white space. So parts are searched
    in the different tokens of all contents, whose number grows more slowly than the contents do, and a content takes the parts of its tokens. Only names of several
    parts, or with white space at an end, are then looked for in contents themselves. Nothing is broadcast that grows with either table.
    Null contents and names are in no row; equal names count once.
    """
    longest = F.reduce(tokens(F.col("name")), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    named = written(names.where(F.length("name") >= max(3, least)).select("name").distinct().withColumn("part", longest), "names")
    parts = named.where("part <> ''").select("part").distinct()
    of_contents = contents.where("chunk_id is not null").select("chunk_id", F.explode(tokens(F.col("content"))).alias("token"))
    hits = written(parts_in_tokens(parts, written(of_contents.select("token").distinct(), "vocabulary")), "hits")
    found = of_contents.join(hits, "token").select("chunk_id", "part").distinct().join(named, "part").select("chunk_id", "name", "part")
    whole = F.lower("name") == F.col("part")
    several = found.where(~whole).select("chunk_id", "name")
    inside = contents.select("chunk_id", "content").join(several, "chunk_id").unionByName(contents.select("chunk_id", "content").crossJoin(named.where("part = ''").select("name")))
    inside = inside.where(F.col("chunk_id").isNotNull() & F.contains(F.lower("content"), F.lower("name"))).select("chunk_id", "name").distinct()
    return found.where(whole).select("chunk_id", "name").unionByName(inside)


def matched_entities(entities: DataFrame, query_entities: DataFrame, chunk_names: DataFrame) -> DataFrame:
    """id, pos: graph entities of the query's entities (name, type, seq) in their order, then of the names in chunks.

    Equal names first; a form or statute without one takes the first two entities that contain its name.
    """
    q = F.broadcast(query_entities.select("seq", "type", F.lower("name").alias("q")))
    low = F.lower(entities["name"])
    exact = entities.join(q, low == F.col("q")).groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq", F.lit(0).alias("n"))
    open_ = F.broadcast(query_entities.select("seq", "type", F.lower("name").alias("q")).join(exact.select("seq"), "seq", "left_anti").where(F.col("type").isin("form", "statute") & (F.length("q") >= MIN_SUBSTRING)).select("seq", "q"))
    aliases = F.coalesce(entities["aliases"], F.array().cast("array<string>"))
    inside = entities.join(open_, F.contains(low, F.col("q")) | F.exists(aliases, lambda a: F.contains(F.lower(a), F.col("q"))))
    some = inside.withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("id"))).where(F.col("n") <= SUBSTRING_LIMIT).select("id", "seq", "n")
    named = entities.join(F.broadcast(chunk_names.select(F.lower("name").alias("c"), F.col("name").alias("c_name"))), low == F.col("c")).groupBy("c_name").agg(F.min("id").alias("id"))
    late = named.select("id", F.lit(1 << 30).alias("seq"), F.dense_rank().over(Window.orderBy("c_name")).alias("n"))
    first = exact.unionByName(some).unionByName(late).groupBy("id").agg(F.min(F.struct("seq", "n")).alias("k"))
    return first.select("id", (F.row_number().over(Window.orderBy("k", "id")) - 1).alias("pos"))


def graph_chunks(mentions: DataFrame, nodes: DataFrame, seeds: DataFrame, vector_ids: DataFrame, k: int = 10) -> DataFrame:
    """chunk_id, graph_score: chunks that mention a node and are not among the nearest, by how many seeds they mention. Nodes and seeds are bounded, so broadcast."""
    reached = mentions.join(F.broadcast(nodes.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi")
    marked = reached.join(F.broadcast(seeds.select(F.col("id").alias("entity_id"), F.lit(1).alias("seed"))), "entity_id", "left")
    scores = marked.groupBy("chunk_id").agg(F.count_distinct(F.when(F.col("seed") == 1, F.col("entity_id"))).alias("graph_score"))
    new = scores.join(F.broadcast(vector_ids.select("chunk_id")), "chunk_id", "left_anti")
    return new.orderBy(F.desc("graph_score"), "chunk_id").limit(k)


def merged(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """chunk_id, retrieval_source, citation_id, pos from ranked channels (chunk_id, rank): nearest chunks first, each chunk once."""
    both = vector.select("chunk_id", "rank", F.lit("vector").alias("retrieval_source"), F.lit(0).alias("channel")).unionByName(
        graph.select("chunk_id", "rank", F.lit("graph").alias("retrieval_source"), F.lit(1).alias("channel"))
    )
    first = both.groupBy("chunk_id").agg(F.min(F.struct("channel", "rank", "retrieval_source")).alias("k"))
    pos = F.row_number().over(Window.orderBy("k.channel", "k.rank", "chunk_id"))
    return first.select("chunk_id", F.col("k.retrieval_source").alias("retrieval_source"), pos.alias("pos")).withColumn("citation_id", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))


def graph_chunks_many(mentions: DataFrame, nodes: DataFrame, seeds: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """question, chunk_id, graph_score, rank: ``graph_chunks`` for all questions at once.

    ``nodes`` and ``seeds``: question, id; ``vectors``: question, chunk_id. Mentions of other entities go before anything is shuffled, scores are summed before the
    shuffle, and k rows a question leave each task.
    """
    ids = nodes.select("question", F.col("id").alias("entity_id"))
    seed = seeds.select("question", F.col("id").alias("entity_id"), F.lit(1).alias("seed")).distinct()
    marked = ids.join(seed, ["question", "entity_id"], "left")
    marked = written(marked, "marked")  # its size is known to the joins
    touched = mentions.select("chunk_id", "entity_id").join(marked.select("entity_id").distinct(), "entity_id", "left_semi")
    reached = touched.distinct().join(marked, "entity_id")
    scores = reached.groupBy("question", "chunk_id").agg(F.count("seed").alias("graph_score"))
    new = scores.join(vectors.select("question", "chunk_id"), ["question", "chunk_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("graph_score"), "chunk_id"))
    return new.withColumn("rank", rank).where(F.col("rank") <= k)


def merged_many(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """question, chunk_id, retrieval_source, pos, citation_id: ``merged`` for all questions, from channels (question, chunk_id, rank)."""
    both = vector.select("question", "chunk_id", "rank", F.lit("vector").alias("retrieval_source"), F.lit(0).alias("channel")).unionByName(
        graph.select("question", "chunk_id", "rank", F.lit("graph").alias("retrieval_source"), F.lit(1).alias("channel"))
    )
    first = both.groupBy("question", "chunk_id").agg(F.min(F.struct("channel", "rank", "retrieval_source")).alias("k"))
    pos = F.row_number().over(Window.partitionBy("question").orderBy("k.channel", "k.rank", "chunk_id"))
    return first.select("question", "chunk_id", F.col("k.retrieval_source").alias("retrieval_source"), pos.alias("pos")).withColumn("citation_id", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))


def retrieve_many(graph: G.Graph, vectors: DataFrame, questions: DataFrame, seeds: DataFrame, k_vector: int = 8, k_graph: int = 8, hops: int = 2, **limits) -> DataFrame:
    """question, mode, chunk_id, retrieval_source, pos for all questions and both modes (naive: nearest chunks; hybrid: with the graph channel).

    ``vectors``: chunk_id, embedding; ``questions``: question, embedding; ``seeds``: question, id, pos, the entities that each question names. A chunk
    whose id is the question itself is not among its nearest.
    """
    near = V.knn_many(vectors, questions.select(F.col("question").alias("query"), F.col("embedding").alias("v")), k_vector, "chunk_id")
    near = written(near.select(F.col("query").alias("question"), "chunk_id", "rank"), "near")
    nodes, _ = G.k_hop_many(graph, seeds, hops, **limits)
    known = nodes.join(seeds.select("question", "id").distinct(), ["question", "id"], "left_semi")
    found = graph_chunks_many(graph.mentions, nodes, known, near, k_graph)
    hybrid = merged_many(near, found).select("question", F.lit("hybrid").alias("mode"), "chunk_id", "retrieval_source", "pos")
    return near.select("question", F.lit("naive").alias("mode"), "chunk_id", F.lit("vector").alias("retrieval_source"), F.col("rank").alias("pos")).unionByName(hybrid)


def citations(chunks: DataFrame) -> DataFrame:
    """What an answer's sources show, from merged chunks with filepath, heading_path, content, retrieval_source, citation_id, metadata."""
    page = F.try_element_at(F.col("metadata"), F.lit("page_number"))
    path = F.coalesce("filepath", F.lit(""))
    return chunks.select(
        "citation_id",
        "chunk_id",
        path.alias("filepath"),
        F.coalesce("heading_path", F.lit("")).alias("heading_path"),
        F.coalesce("retrieval_source", F.lit("unknown")).alias("retrieval_source"),
        T.preview(F.col("content")).alias("preview"),
        T.source_url(path).alias("source_url"),
        page.alias("page"),
        T.page_url(path, page).alias("source_url_with_page"),
    )


def channel_counts(merged_chunks: DataFrame) -> DataFrame:
    return merged_chunks.groupBy(F.coalesce("retrieval_source", F.lit("unknown")).alias("retrieval_source")).agg(F.count(F.lit(1)).alias("n"))


def context_text(chunks: DataFrame) -> DataFrame:
    """One row, context: the chunks' texts under their citations, in order. Chunks are the merged ones, at most twenty. The format is fixed."""
    part = F.concat(
        F.lit("--- Source "), F.col("citation_id"), F.lit(" ["), F.coalesce("retrieval_source", F.lit("unknown")), F.lit("] ---\nDocument: "), F.coalesce("filepath", F.lit("")),
        F.lit("\nSection: "), F.coalesce("heading_path", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return chunks.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("context"))


def edge_lines(edges: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """n, line: the heaviest edges as sentences, with names for ids where they are known."""
    names = F.broadcast(nodes.select(F.col("id").alias("_id"), "name"))
    top = edges.orderBy(F.desc("weight"), "source", "predicate", "target").limit(limit)
    named = top.join(names.select(F.col("_id").alias("source"), F.col("name").alias("s")), "source", "left").join(names.select(F.col("_id").alias("target"), F.col("name").alias("t")), "target", "left")
    shown = T.evidence_shown(F.col("evidence"))
    line = F.concat(
        F.lit("  - "), F.coalesce("s", F.col("source").cast("string")), F.lit(" — "), T.predicate_shown(F.col("predicate")), F.lit(" → "), F.coalesce("t", F.col("target").cast("string")),
        F.when(shown != "", F.concat(F.lit('   ("'), shown, F.lit('")'))).otherwise(""),
    )
    n = F.row_number().over(Window.orderBy(F.desc("weight"), "source", "predicate", "target"))
    return named.select(n.alias("n"), line.alias("line"))


def node_groups(nodes: DataFrame) -> DataFrame:
    """type, names, first: the nodes' names by type, in the order of their positions."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return nodes.groupBy("type").agg(F.transform(listed, lambda x: x["name"]).alias("names"), F.min("pos").alias("first"))


def graph_text(nodes: DataFrame, edges: DataFrame) -> str:
    """The subgraph as text for a prompt; at most ``max_nodes`` nodes and twenty edges come to the driver."""
    lines = ["These entities and relations belong to the question:", ""]
    for g in node_groups(nodes).orderBy("first").collect():
        lines += [f"{g['type'].upper()}:", *(f"  - {n}" for n in g["names"])]
    told = [r["line"] for r in edge_lines(edges, nodes).orderBy("n").collect()]
    return "\n".join(lines + (["", "RELATIONS (subject — predicate → object):", *told] if told else []))


@dataclass
class Retrieval:
    """What a query found; merged has pos, citation_id and retrieval_source besides the columns of the chunks."""

    vector: DataFrame
    merged: DataFrame
    graph: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    query_entities: list = field(default_factory=list)
    matched: DataFrame | None = None


class Retriever:
    """Two channels over tables of chunks, embeddings and a graph."""

    def __init__(self, chunks: DataFrame, embeddings: DataFrame, graph: G.Graph | None, embedder: V.Embedder, query_entities=None) -> None:
        """``query_entities``: a function from the query to (name, type) pairs; without it only the nearest chunks are found."""
        self.chunks, self.embeddings, self.graph, self.embedder, self.query_entities = chunks, embeddings, graph, embedder, query_entities

    def retrieve(self, query: str, k_vector: int = 10, k_graph: int = 10, hops: int = 2, use_graph: bool = True) -> Retrieval:
        spark = self.chunks.sparkSession
        near = V.knn(self.embeddings, self.embedder.embed_one(query), k_vector)
        near = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))
        ids = [(r["chunk_id"], r["rank"]) for r in near.select("chunk_id", "rank").collect()]  # k rows
        key = self.chunks.schema["chunk_id"].dataType.simpleString()
        ranked = spark.createDataFrame(ids, f"chunk_id {key}, rank int")
        vector = self.chunks.join(F.broadcast(ranked), "chunk_id")
        if not use_graph or self.graph is None or self.query_entities is None:
            plain = vector.withColumns({"pos": F.col("rank"), "citation_id": F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")), "retrieval_source": F.lit(None).cast("string")})
            return Retrieval(vector, plain.drop("rank"))
        try:
            asked = list(self.query_entities(query))
        except Exception:  # noqa: BLE001  without the model's entities the chunks' names still anchor the graph
            asked = []
        wanted = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(asked)], "name string, type string, seq int")
        names = names_in_contents(vector.where(F.col("rank") <= SCANNED), self.graph.entities)
        matched = matched_entities(self.graph.entities, wanted, names)
        seeds = [r["id"] for r in matched.orderBy("pos").collect()]
        nodes, edges = G.k_hop(self.graph, seeds, hops)
        scored = graph_chunks(self.graph.mentions, nodes, matched, ranked, k_graph)
        scored = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("graph_score"), "chunk_id")))
        both = merged(ranked, scored)
        return Retrieval(vector, self.chunks.join(F.broadcast(both), "chunk_id"), scored, nodes, edges, asked, matched)
