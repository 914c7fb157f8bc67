"""Extraction of entities and relations from chunks through an injected model, with a keyed cache."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkweave.functions import text as T
from sparkweave.schema import DOMAIN, DomainSchema

SYSTEM_PROMPT = (
    "You read a part of a document and name the entities and the directed relations that it states. "
    "Use the entity types {types} and the predicates {predicates} only. Give each relation the sentence that states it. "
    'Answer with one JSON object: {{"entities": [...], "relations": [...]}}.'
)


class Extractor(Protocol):
    """Answers a prompt about one chunk with JSON text."""

    def __call__(self, content: str, heading_path: str, context: str) -> str: ...


def prompt(content: str, heading_path: str, context: str, domain: DomainSchema = DOMAIN) -> list[dict]:
    system = SYSTEM_PROMPT.format(types=", ".join(domain.entity_types), predicates=", ".join(domain.predicates))
    user = f"DOCUMENT: {context or 'unknown'}\nSECTION: {heading_path or 'unknown'}\n\n{content}"
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


class RuleExtractor:
    """A deterministic stand-in without a model: form numbers become entities, and ``X requires Y`` within a sentence a relation."""

    _form = re.compile(r"\b(?:Form )?([A-Z]{1,3}-\d{2,4}[A-Z]?)\b")

    def __call__(self, content: str, heading_path: str, context: str) -> str:
        entities, relations = [], []
        for sentence in re.split(r"(?<=[.!?])\s+", content):
            names = ["Form " + n for n in self._form.findall(sentence)]
            entities += [{"name": n, "entity_type": "form"} for n in names]
            for verb, predicate in (("requires", "requires"), ("filed with", "filed_with"), ("supersedes", "supersedes"), ("see", "references")):
                if verb in sentence and len(names) > 1:
                    relations.append({"subject": names[0], "predicate": predicate, "object": names[1], "evidence": sentence})
        return json.dumps({"entities": entities, "relations": relations})


def parsed(answers: DataFrame, domain: DomainSchema = DOMAIN) -> DataFrame:
    """Adds entities and relations to rows with a column answer."""
    return answers.withColumns({"entities": T.json_entities(F.col("answer"), domain), "relations": T.json_relations(F.col("answer"), domain)})


def cache_split(chunks: DataFrame, cache: DataFrame, context: str = "context", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Chunks with a cached answer (key, answer), and the others."""
    keyed = chunks.withColumn("key", T.cache_key(F.coalesce(context, F.lit("")), F.col(content)))
    return keyed.join(cache.select("key", "answer"), "key"), keyed.join(cache.select("key"), "key", "left_anti")


def answered(chunks: DataFrame, extractor: Extractor, concurrency: int = 8, calls=None) -> DataFrame:
    """All columns of ``chunks`` (content, heading_path, context among them), answer and error. A failure leaves no answer, so it is not cached.

    A task has at most ``concurrency`` calls in flight. ``calls``: an accumulator that counts finished calls as they come.
    """
    names = chunks.columns

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def ask(row) -> tuple:
            try:
                return extractor(*(x or "" for x in row)), None
            except Exception as e:  # noqa: BLE001  a failed call concerns its chunk only
                return None, f"{type(e).__name__}: {e}"
            finally:
                if calls is not None:
                    calls.add(1)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(ask, zip(*(batch.column(n).to_pylist() for n in ("content", "heading_path", "context")))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names=[*names, "answer", "error"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, *StructType.fromDDL("answer string, error string").fields]))


def extraction_totals(extraction: DataFrame) -> DataFrame:
    """One row: entities, relations, names (different ones)."""
    flat = extraction.select(F.size("entities").alias("e"), F.size("relations").alias("r"), F.transform("entities", lambda x: F.lower(T.strip(x["name"]))).alias("n"))
    sums = flat.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("entities"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("relations"))
    return sums.crossJoin(flat.select(F.explode("n").alias("n")).agg(F.count_distinct("n").alias("names")))
