"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.

Cases: a null text is kept by the filters and stays null; documents without an id are never dropped as copies; equal rows leave
the near-duplicate stage as one, rows of one id with different texts stay apart; the personal-data stage keeps all rows; columns whose names
clash with a stage's own pass through; very long texts are judged whole; an empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import decontamination, neardup, packing, pii, toxicity
from sparkweave.llm.common import dropped, free_names, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.7 go. The scorer learns from the labels that op8 may use."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.third(F.col("doc_id")) != 1)
    (score,) = free_names(docs.columns, "__score")
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the least id stays."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; others with the same id, or without one, stay."""
    (name,) = free_names(docs.columns, "__found")
    found = decontamination.contaminated_keys(docs, table(spark, sf_dir, "benchmark")).select(F.col("dk").alias(name))
    found = written(found, "contaminated")  # its size is known to the join
    return docs.join(found, decontamination.document_key() == F.col(name), "left_anti")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and terms that disclose it are generalised; n_chars follows."""
    (spans,) = free_names(docs.columns, "__pii")
    marked = pii.with_spans(docs, spans)
    clean = F.when(F.col("text").isNotNull(), pii.sanitised(F.col("text"), F.col(spans)))
    marked = marked.withColumn("text", clean)
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, packing.public_path("byte_bpe_50k.json"), packing.public_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: No SQL can express the tokenizer, the learned scorer or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table in the shared folder, which goes when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*last)
        last = [docs]
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
