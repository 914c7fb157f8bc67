"""Quality classification from weak labels.

Overlapping heuristics call a document good (1), bad (0) or abstain (-1); most of them know signs of junk only and
abstain otherwise. How often each combination of votes occurs is counted over all documents: at most 3**10
combinations, whatever the corpus. Expectation-maximisation on these counts estimates each heuristic's accuracy and the share of
good documents. The posterior of a combination labels its documents. A linear scorer on hashed features - words, and
shapes of words such as ``Aa.`` - is then trained on posterior labels, so that it also judges where the heuristics abstain.

The scorer is fitted on at most about ``SAMPLE`` different texts, chosen by their hash and weighted by their copies; votes and posteriors
cover all documents.

Cases: null and empty texts have no words, so they are bad by definition (score 0, not kept); repeated rows are scored each; null
ids come back as they are; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import dropped, in_arrow, table, written

SAMPLE, DIMS = 4_000, 1 << 15

#: Frequent words of English, French, German and Spanish.
COMMON = frozenset(
    "the of and to in a is that it was for on are as with he be at by this from or an not"
    " de la le et les des en un une du que est pour qui dans sur par au avec ne se pas"
    " der die und den das von zu mit sich auf für ist im dem nicht ein eine als auch es"
    " el los y del las por con para como más su al lo no si".split()
)
_SIGNS = frozenset("#$%&*|{}<>=~^@\\_")
_ENDS = re.compile(r"[.!?:;\"')\]]$")
_AGAIN = re.compile(r"(.)\1+")


class Memo(dict):
    """A function's values, kept for words that a worker meets again; forgotten when there are too many."""

    MOST = 100_000

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, word: str):
        if len(self) >= self.MOST:
            self.clear()
        self[word] = out = self.function(word)
        return out


def _kind(word: str) -> tuple[bool, bool]:
    """Whether a lower-case word is a common one, and whether it has signs in it."""
    return word.strip(".,;:!?") in COMMON, not word.strip(".,;:!?'\"()-").replace("-", "").replace("'", "").isalnum()


def _form(code: int) -> str:
    """What stands for a character in a shape."""
    c = chr(code)
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def _shape(form: str) -> int:
    """The hashed shape of a word whose characters were replaced by what stands for them."""
    return zlib.crc32(b"s" + _AGAIN.sub(r"\1", form).encode()) % DIMS


def _buckets(word: str) -> int:
    """The hashed shape and, above it, the hashed word; above these, whether the word is a common one and whether it has signs in it."""
    low = word.lower()
    common, odd = _kinds[low]
    return _shapes[word.translate(_forms)] + zlib.crc32(b"w" + low.encode()) % DIMS * DIMS + DIMS * DIMS * (common + 2 * odd)


_kinds, _shapes, _places, _forms = Memo(_kind), Memo(_shape), Memo(_buckets), Memo(_form)


def _bad(hit: bool) -> int:
    return 0 if hit else -1


#: Whether a character below LAST is a capital, a letter, a sign.
LAST = 0x3000
_classes = np.array([[chr(i).isupper(), chr(i).isalpha(), chr(i) in _SIGNS] for i in range(LAST)], np.int64)


def _characters(text: str) -> tuple[int, int, int]:
    """How many capitals, letters and signs a text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    most = int(codes.max(initial=0)) + 1
    found = np.bincount(codes if most <= LAST else codes[codes < LAST], minlength=1)
    upper, letters, signs = (found @ _classes[: len(found)]).tolist()
    if most > LAST:
        rest = [chr(c) for c in codes[codes >= LAST].tolist()]
        upper, letters = upper + sum(map(str.isupper, rest)), letters + sum(map(str.isalpha, rest))
    return upper, letters, signs


def places(text: str | None) -> np.ndarray:
    """What ``_buckets`` gives for each word of a text."""
    words = (text or "").split()
    return np.fromiter(map(_places.__getitem__, words), np.int64, len(words))


def votes(text: str | None, at: np.ndarray | None = None) -> list[int]:
    """The heuristics' votes on a text. ``at``: its places, if they are known."""
    text = text or ""
    low = text.lower().split()
    n = len(low)
    if not n:
        return [0] * 10
    upper, letters, signs = _characters(text)
    capitals, shouts, signs = upper / max(1, letters), text.count("!") / n, signs / n
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(low)
    triples_again = 1 - len(set(zip(low, low[1:], low[2:]))) / (n - 2) if n > 2 else 0.0
    if at is None:
        kinds = [(k, *_kinds[w]) for w, k in counts.items()]
        common, odd = sum([k for k, c, _ in kinds if c]) / n, sum([k for k, _, o in kinds if o]) / n
    else:
        common, odd = int(np.count_nonzero(at & DIMS * DIMS)) / n, int(np.count_nonzero(at & 2 * DIMS * DIMS)) / n
    ends = sum(1 for x in lines if _ENDS.search(x)) / len(lines)
    return [
        _bad(signs > 0.1),  # signs
        _bad(odd > 0.2),  # words with signs in them
        _bad(capitals > 0.5),  # capitals
        _bad(shouts > 0.2),  # exclamation marks
        _bad(len(lines) >= 4 and 1 - len(set(lines)) / len(lines) > 0.3),  # repeated lines
        _bad(n >= 20 and max(counts.values()) / n > 0.25),  # one word again and again
        _bad(n >= 30 and triples_again > 0.3),  # repeated triples
        _bad(n >= 20 and len(counts) < 0.25 * min(n, 200)),  # few different words
        0 if n >= 20 and common < 0.03 else 1 if common >= 0.1 and triples_again < 0.1 and capitals < 0.3 else -1,  # common words
        1 if ends >= 0.7 and odd < 0.05 and len(set(lines)) == len(lines) and triples_again < 0.1 and shouts < 0.1 else -1,  # lines that end as sentences do
    ]


def em(patterns: list[tuple[list[int], int]], steps: int = 100, prior: float = 0.8) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each combination, the heuristics' accuracies, and the share of good documents.

    A heuristic that votes is right with its accuracy, whatever the label; when it abstains says nothing. It starts from accuracies of
    0.8 and adds ten imagined votes of that accuracy to each heuristic; none counts as worse than 0.6.
    """
    if not patterns:
        return np.zeros(0), np.zeros(0), prior
    v = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    accuracy, share = np.full(v.shape[1], 0.8), prior
    for _ in range(steps):
        odds = np.log(accuracy / (1 - accuracy))
        z = np.log(share / (1 - share)) + np.where(v == 1, odds, np.where(v == 0, -odds, 0.0)).sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        share = float(np.clip((good @ weight + 8) / (weight.sum() + 10), 0.01, 0.99))
        right = ((v == 1) * good[:, None] + (v == 0) * (1 - good[:, None])) * weight[:, None]
        accuracy = np.clip((right.sum(axis=0) + 8) / (((v >= 0) * weight[:, None]).sum(axis=0) + 10), 0.6, 0.99)
    return good, accuracy, share


def features(text: str | None, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and shapes with their square-rooted shares of all words. ``both``: the text's places, if they are known."""
    both = places(text) if both is None else both
    if not len(both):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found = np.sort(np.concatenate([both & DIMS - 1, both >> DIMS.bit_length() - 1 & DIMS - 1]).astype(np.int32))
    begins = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    counts = np.diff(begins, append=len(found))
    return found[begins], np.sqrt(counts.astype(np.float32) / len(both))


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, weight: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 200, rate: float = 20.0) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels, by gradients of the mean loss with momentum."""
    w, bias, v, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    share = np.full(len(y), 1 / max(1, len(y))) if weight is None else weight / max(1e-9, weight.sum())
    for _ in range(steps):
        z = np.bincount(rows, w[columns] * values, minlength=len(y)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        v = 0.9 * v - rate * 0.1 * (np.bincount(columns, gap[rows] * values, minlength=width) + penalty * w)
        vb = 0.9 * vb - 0.1 * gap.sum()
        w, bias = w + v, bias + vb
    return w, float(bias)


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, pattern (the votes as text, one character for each heuristic) and h, a hash of the text."""

    def run(batches):
        for batch in batches:
            out = ["".join("-01"[v + 1] for v in votes(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, "doc_id long, pattern string")


def posteriors(counts: DataFrame) -> dict[str, float]:
    """Posterior of good for every combination of votes. ``counts``: pattern, n; at most 3**10 rows."""
    rows = sorted((r["pattern"], r["n"]) for r in counts.collect())
    good, _, _ = em([(["-01".index(c) - 1 for c in p], n) for p, n in rows])
    return {p: float(g) for (p, _), g in zip(rows, good)}


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, pattern, posterior, score, keep (score of at least one half) for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = written(voted(docs).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "votes")
    by_pattern = posteriors(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    dropped(counts)
    shared = spark.sparkContext.broadcast(by_pattern)
    share = min(1.0, sample / total) if total else 1.0
    chosen = docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).where(F.trim("text") != "")
    chosen = chosen.groupBy("text").agg(F.count(F.lit(1)).alias("n"))  # copies of a text meet before they are moved

    def packed(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [features(t) for t in texts]
            y = [shared.value["".join("-01"[v + 1] for v in votes(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary()), pa.array(y, pa.float64()), batch.column("n")], names=["at", "value", "y", "n"])

    data = chosen.transform(in_arrow, packed, "at binary, value binary, y double, n long").collect()
    at = [np.frombuffer(r["at"], np.int32) for r in data]
    if data:
        flat, values = np.concatenate(at), np.concatenate([np.frombuffer(r["value"], np.float32) for r in data]).astype(float)
        w, bias = fit_linear(np.repeat(np.arange(len(data)), [len(a) for a in at]), flat, values, np.array([r["y"] for r in data]), DIMS, np.array([r["n"] for r in data], float))
    else:
        w, bias = np.zeros(DIMS), 0.0
    model = spark.sparkContext.broadcast((w, bias))

    def run(batches):
        w, bias = model.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                both = places(text)  # words are looked up once for votes and features
                pattern = "".join(["-01"[v + 1] for v in votes(text, both)])
                at, value = features(text, both)
                z = float(w[at] @ value) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if len(at) else 0.0
                for column, x in zip(out, (pattern, shared.value[pattern], float(score))):
                    column.append(x)
            types = [pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], names=["doc_id", "pattern", "posterior", "score"])

    return docs.transform(in_arrow, run, "doc_id long, pattern string, posterior double, score double").withColumn("keep", F.col("score") >= 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
