"""Retrieval metrics as DataFrame operations over (question, mode, chunk) rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkweave.functions import text as T

METRICS = ("retrieval_recall", "doc_recall", "answer_recall", "citation_precision", "judge_accuracy", "graph_share")


def recall(gold: Column, found: Column) -> Column:
    """Share of the gold items that were found; 0 without gold items."""
    return T.fraction(F.size(F.array_intersect(gold, found)), F.size(F.array_distinct(gold)))


def question_metrics(chunks: DataFrame, questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """question_id, mode and the metrics.

    ``chunks``: question_id, mode, content, filepath, retrieval_source; ``questions``: question_id, gold (array), hops;
    ``answers``: question_id, mode, answer, judgement. Citations without a known document count in the precision's denominator.
    """
    rows = chunks.withColumns({"doc": T.form_of_path(F.coalesce("filepath", F.lit(""))), "forms": T.forms_in_text(F.coalesce("content", F.lit("")))})
    gold = questions.select("question_id", "hops", F.transform("gold", F.upper).alias("gold"))
    joined = rows.join(gold, "question_id")
    out = joined.groupBy("question_id", "mode").agg(
        F.first("gold").alias("gold"),
        F.first("hops").alias("hops"),
        F.array_distinct(F.flatten(F.collect_set("forms"))).alias("found"),
        F.collect_set("doc").alias("docs"),
        F.coalesce(F.avg(F.coalesce(F.array_contains("gold", F.col("doc")), F.lit(False)).cast("double")), F.lit(0.0)).alias("citation_precision"),
        F.coalesce(F.avg(F.coalesce(F.col("retrieval_source") == "graph", F.lit(False)).cast("double")), F.lit(0.0)).alias("graph_share"),
    )
    out = out.withColumns({"retrieval_recall": recall(F.col("gold"), F.col("found")), "doc_recall": recall(F.col("gold"), F.col("docs"))})
    if answers is not None:
        out = out.join(answers, ["question_id", "mode"], "left")
        out = out.withColumns({"answer_recall": recall(F.col("gold"), T.forms_in_text(F.coalesce("answer", F.lit("")))), "judge_accuracy": T.parse_score(F.coalesce("judgement", F.lit("")))})
    return out.select("question_id", "mode", "hops", *(m for m in METRICS if m in out.columns))


def aggregated(metrics: DataFrame) -> DataFrame:
    """mode, metric, value, multi: means over all questions and over those with several hops."""
    names = [m for m in METRICS if m in metrics.columns]
    long = metrics.select("mode", "hops", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("x")).select("mode", "hops", "x.*")
    return long.groupBy("mode", "metric").agg(F.avg("v").alias("value"), F.avg(F.when(F.col("hops") == "multi", F.col("v"))).alias("multi"))


def evaluated(retrieved: DataFrame, chunks: DataFrame, questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Metrics of each question and mode from what ``retrieve.retrieve_many`` found; ``aggregated`` and ``report`` go on from there.

    ``chunks``: chunk_id, content, filepath; ``questions``: question_id, gold, hops. A question for which a mode found nothing has no row in it.
    """
    rows = retrieved.join(chunks.select("chunk_id", "content", "filepath"), "chunk_id")
    return question_metrics(rows.select(F.col("question").alias("question_id"), "mode", "content", "filepath", "retrieval_source"), questions, answers)


def refusal_rate(answers: DataFrame) -> DataFrame:
    """One row, rate: share of the answers that decline; 0 without answers."""
    return answers.agg(F.coalesce(F.avg(T.is_refusal(F.col("answer")).cast("double")), F.lit(0.0)).alias("rate"))


def judged(answers: DataFrame, judge, concurrency: int = 8) -> DataFrame:
    """Adds judgement to rows question, gold (array), answer: what an injected judge says, as text; a failing judge gives none, which counts as 0.

    A task has at most ``concurrency`` calls in flight.
    """
    names = answers.columns

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def ask(row) -> str | None:
            try:
                return judge(*row)
            except Exception:  # noqa: BLE001  a failing judge must not end an evaluation
                return None

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = zip(*(batch.column(n).to_pylist() for n in ("question", "gold", "answer")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(pool.map(ask, rows)), pa.string())], names=[*names, "judgement"])

    return answers.mapInArrow(run, StructType([*answers.schema.fields, StructField("judgement", StringType())]))


def refusal_run(spark: SparkSession, probes: list[str], ask) -> DataFrame:
    """question, answer, refused for questions that the corpus does not cover; ``ask`` answers one question, as ``Engine.query`` does."""
    rows = spark.createDataFrame([(q, ask(q)) for q in probes], "question string, answer string")
    return rows.withColumn("refused", T.is_refusal(F.col("answer")))


def write_results(metrics: DataFrame, path: str, top_k: int, hops: int) -> None:
    """The metrics of each question as JSON lines, and the report as Markdown, below ``path``."""
    metrics.write.mode("overwrite").json(f"{path}/results.json")
    text = metrics.sparkSession.createDataFrame([(report(metrics, top_k, hops),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/results.md")


def report(metrics: DataFrame, top_k: int, hops: int) -> str:
    """The aggregate as a Markdown table; two numbers a metric come to the driver."""
    values = {(r["metric"], r["mode"]): r for r in aggregated(metrics).collect()}
    lines = ["# Retrieval: graph and vectors against vectors alone", "", f"top_k={top_k}, hops={hops}", ""]
    for title, column in (("All questions", "value"), ("Questions of several hops", "multi")):
        lines += [f"## {title}", "", "| Metric | Naive | Hybrid | Difference |", "|---|---:|---:|---:|"]
        for m in METRICS:
            pair = [values[(m, mode)][column] for mode in ("naive", "hybrid") if (m, mode) in values]
            if len(pair) == 2 and None not in pair:
                lines.append(f"| {m} | {pair[0]:.3f} | {pair[1]:.3f} | {pair[1] - pair[0]:+.3f} |")
        lines.append("")
    return "\n".join(lines)
