"""A Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf; the leaves of a source are ordered, and every ``FAN`` consecutive nodes become one of the level above, until
one is left, the source's subroot. Subroots make the root in the same way. A node is labelled with the interval of leaf ranks that it
covers, so the node above it on a level is the one whose interval contains its own; as intervals of a level have one length, that is
one bucket of the level: the least rank divided by the length. From the top level downward, joins on these buckets attach the ancestors: every node takes over its
parent's proof and adds its own siblings, which are what the parent's interval holds beside its own. Proofs reach the leaves' parents this way,
one row for ``FAN`` leaves; only in the end each leaf gets its own. No bucket has more than ``FAN`` rows, whatever a source holds.

Ranks come from a sort by ranges: places within a task's sorted rows, and sums of counts of the tasks before it. The last sort key is
a row number, so that a source, an id or a group of equal rows can lie in many tasks.

Cases: null fields are written as ``-``; a null source is a source of its own, the first; null ids come first in their source and are never
tampered with; rows of one source and id are ordered by their leaves, and repeated rows are leaves of their own with one digest; a source of one row has its leaf as
subroot, one source's subroot is the root; empty texts have the length 0; long texts are hashed whole; an empty table gives no rows;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.llm.common import ascii_lower, dropped, table, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of a node's siblings the digests before and after it, joined.
_PROOF = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex of sha256 over the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*(field(c) for c in fields.values()))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A written table of ``rows`` with ``rank``, from 0 in each group (null is one) by ``order``. Columns at, task and first are its own."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(placed.withColumns({"at": F.monotonically_increasing_id(), "task": F.spark_partition_id()}), "placed")
    # One row for each group in each task: tasks hold ranges, so these are at most as many as groups and tasks together.
    parts = placed.groupBy(group, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select(F.col(group).alias("part_group"), F.col("task").alias("part_task"), (before - F.col("first")).alias("shift")), "parts")
    joined = placed.join(parts, placed[group].eqNullSafe(parts["part_group"]) & (placed["task"] == parts["part_task"]))
    out = written(joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank")), "ranked")
    dropped(placed, parts)
    return out


def _parents(nodes: DataFrame, length: int) -> DataFrame:
    """The level above: grp, bucket, low, high, hash and parts (the nodes below, by rank), of groups that have several nodes."""
    part = F.struct("low", "high", "hash")
    up = nodes.withColumn("bucket", F.floor(F.col("low") / length).cast("long")).groupBy("grp", "bucket")
    up = up.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(part)).alias("parts"))
    return up.withColumn("hash", digest(F.array_join(F.transform("parts", lambda p: p["hash"]), "")))


def _siblings(low: Column, high: Column, parts: Column) -> Column:
    """The parent's interval less the node's own: what is before and what is after it, as digests."""
    joined = lambda keep: F.array_join(F.transform(F.filter(parts, keep), lambda p: p["hash"]), "")
    return F.struct(joined(lambda p: p["high"] < low).alias("before"), joined(lambda p: p["low"] > high).alias("after"))


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (grp, rank, hash), one for each grp, which is not null.

    Returns the subroots (grp, hash, n) and, for every run of FAN leaves, grp, bucket, parts (its leaves by rank: low, high, hash) and
    above: the proof of the run's own node, from below. A single leaf is a run without a node.
    """
    sizes = written(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    top = sizes.agg(F.max("n")).first()[0] or 0
    levels, nodes, length = [], leaves.select("grp", F.col("rank").alias("low"), F.col("rank").alias("high"), "hash"), FAN
    while length < FAN * top or not levels:
        # A group is on a level as long as the one below had several of its nodes; the first level holds single leaves too.
        below = nodes if not levels else nodes.join(sizes.where(F.col("n") > length // FAN).select("grp"), "grp", "left_semi")
        nodes = written(_parents(below, length), "level")
        levels.append((nodes, length))
        length *= FAN
    roots = levels[0][0].join(sizes.where("n = 1"), "grp").select("grp", F.get("parts", F.lit(0))["hash"].alias("hash"), "n")
    for level, length in levels:
        ends_here = sizes.where((F.col("n") > length // FAN) & (F.col("n") <= length))
        roots = roots.unionByName(level.where("low = 0").join(ends_here, "grp").select("grp", "hash", "n"))
    roots = written(roots, "subroots")
    proofs = None
    for place in reversed(range(len(levels))):
        level, length = levels[place]
        own = level.select("grp", "bucket", "low", "high", "parts")
        if proofs is None:
            attached = own.withColumn("above", F.array().cast(_PROOF))
        else:
            parents = proofs.select("grp", F.col("bucket").alias("up"), F.col("low").alias("from"), F.col("high").alias("to"), F.col("parts").alias("run"), F.col("above").alias("more"))
            contained = own.withColumn("up", F.floor(F.col("low") / (length * FAN)).cast("long")).join(parents, ["grp", "up"], "left")
            inside = (F.col("from") <= F.col("low")) & (F.col("high") <= F.col("to"))
            step = F.concat(F.array(_siblings(F.col("low"), F.col("high"), F.col("run"))), F.col("more"))
            attached = contained.select("grp", "bucket", "low", "high", "parts", F.when(inside, step).otherwise(F.array().cast(_PROOF)).alias("above"))
        last, proofs = proofs, written(attached, "proofs")
        dropped(level, *([last] if last is not None else []))
    dropped(sizes)
    return roots, proofs


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to with the siblings of a proof."""
    return F.aggregate(proof, start, lambda acc, step: digest(step["before"], acc, step["after"]))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, rank, leaf, subroot, root, proof (array of before and after, from the leaf upward) and folded_root.

    ``docs``: the columns of FIELDS. ``tampered``: columns that replace fields before a leaf is folded to its root with the original siblings.
    """
    own = {name: F.col(name) for name in FIELDS}
    rows = docs.select("doc_id", "source", leaf(own).alias("leaf"), leaf(own | (tampered or {})).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    rows = written(rows, "leaves")
    sources = rows.select("source").distinct().withColumn("one", F.lit(0))
    # Sources get numbers in their order, so a null one needs no further care.
    sources = ranked(sources, "one", ["source"])
    numbered = ranked(rows, "source", ["doc_id", "leaf", "tie"])
    names = sources.select(F.col("source").alias("name"), F.col("rank").alias("grp"))
    leaves = numbered.join(names, numbered["source"].eqNullSafe(names["name"])).select("grp", "rank", "doc_id", "source", F.col("leaf").alias("hash"), "changed")
    leaves = written(leaves, "leaves")
    dropped(rows, sources, numbered)
    subroots, runs = forest(leaves)
    roots, tops = forest(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("rank"), "hash"))
    each = tops.select("grp", "parts", "above", F.explode("parts").alias("p"))
    own_step = lambda p: F.array(_siblings(F.col(p + ".low"), F.col(p + ".high"), F.col("parts")))
    # A run of a single leaf has no node above it, unless the tree has more leaves.
    many = lambda n: F.when(n, F.concat(own_step("p"), F.col("above"))).otherwise(F.array().cast(_PROOF))
    root = F.broadcast(roots.select("grp", F.col("hash").alias("root"), F.col("n").alias("sources")))  # one row
    outer = each.join(root, "grp").select(F.col("p.low").alias("grp"), "root", many(F.col("sources") > 1).alias("outer"))
    known = written(subroots.select("grp", F.col("hash").alias("subroot"), "n").join(outer, "grp"), "known")
    inner = runs.join(known, "grp").select("grp", "bucket", "parts", "above", "n", "subroot", "root", "outer")
    # The leaves of a run meet its proof: one row of a run on one side, at most FAN on the other.
    mine = leaves.select("grp", "rank", F.floor(F.col("rank") / FAN).cast("long").alias("bucket"), "doc_id", "source", F.col("hash").alias("leaf"), "changed")
    both = mine.join(inner, ["grp", "bucket"])
    step = F.array(_siblings(F.col("rank"), F.col("rank"), F.col("parts")))
    proof = F.concat(F.when(F.col("n") > 1, F.concat(step, F.col("above"))).otherwise(F.array().cast(_PROOF)), F.col("outer"))
    out = both.select("doc_id", "source", "rank", "leaf", "changed", "subroot", "root", proof.alias("proof"))
    return out.select("doc_id", "source", "rank", "leaf", "subroot", "root", "proof", folded(F.col("changed"), F.col("proof")).alias("folded_root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = manifest(docs, {"text": text})
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
#: crc32, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a forest over ``leaves`` (g, k, hash): {name}{level} with the nodes of a level, m (nodes of their group there), before and after."""
    out, source = [], f"(SELECT g, k, hash, count(*) OVER (PARTITION BY g) AS m FROM {leaves})"
    run = f"OVER (PARTITION BY g, k // {FAN} ORDER BY k ROWS BETWEEN"
    for level in range(levels):
        out.append(f"""{name}{level} AS (SELECT *, coalesce(string_agg(hash, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(hash, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {source})""")
        source = f"""(SELECT *, count(*) OVER (PARTITION BY g) AS m FROM (SELECT g, k // {FAN} AS k, CASE WHEN any_value(m) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY k)) END AS hash FROM {name}{level} GROUP BY g, k // {FAN}))"""
    out.append(f"{name}_top AS (SELECT g, hash FROM {source})")
    return ",\n".join(out)


def _climb_sql(name: str, start: str, key: str, group: str, levels: int) -> str:
    """CTEs {name}_c{level}: acc and proof of every document of ``start``, with the siblings of the levels below."""
    out = []
    for level in range(levels):
        out.append(f"""{name}_c{level} AS (SELECT d.* EXCLUDE (acc, proof), CASE WHEN t.m = 1 THEN acc ELSE sha256(t.before || acc || t.after) END AS acc, CASE WHEN t.m = 1 THEN proof ELSE proof || t.before || t.after END AS proof
  FROM {start} d JOIN {name}{level} t ON t.g = {group} AND t.k = d.{key} // {FAN**level})""")
        start = f"{name}_c{level}"
    return ",\n".join(out)


def _sql(levels: int = 7) -> str:
    """``levels``: enough for FAN ** levels rows of a source, and as many sources."""
    plain = " || ".join(_FIELD.format(c) for c in FIELDS)
    changed = " || ".join(_FIELD.format("(CASE WHEN " + _CRC + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)" if c == "text" else c) for c in FIELDS)
    return f"""
WITH l AS (SELECT doc_id, sha256({plain}) AS leaf, sha256({changed}) AS changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, source FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, changed AS acc, '' AS proof FROM l),
{_tree_sql("s", "(SELECT g, k, leaf AS hash FROM d)", levels)},
{_tree_sql("r", "(SELECT 0 AS g, g AS k, hash FROM s_top)", levels)},
{_climb_sql("s", "d", "k", "d.g", levels)},
{_climb_sql("r", f"s_c{levels - 1}", "g", "0", levels)}
SELECT doc_id, leaf, s_top.hash AS subroot, r_top.hash AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r_top.hash AS verified
FROM r_c{levels - 1} c JOIN s_top ON s_top.g = c.g CROSS JOIN r_top"""


OP13_SQL = _sql()
