"""Toxicity by noisy-channel deobfuscation and a hashed linear scorer.

1. A character trigram model is counted over all documents (28 symbols, so at most 28**3 sums reach the driver).
2. Spans that look disguised - letters mixed with digits or signs, single letters (or signs among them) with gaps, letters repeated three
   times or more - become lattices: each character may stand for the letters that leetspeak writes with it, a
   run for one or two letters, a gap for nothing. Viterbi decoding under the language model picks the reading.
3. The words of the restored text, with their beginnings and ends, are hashed into buckets. A feature is a bucket
   that at least one, two or four different words of a text have. Features that
   speak for label 1 are selected from a sample of labelled documents, and logistic regression weighs them.

The sample is bounded (``sample``, half of it for each label; rows are chosen by a hash of their id and weigh what they stand
for), so the broadcast of its ids is bounded too. Nothing but the text enters a score.

Cases: null and empty texts get the score of a text without evidence; rows are scored one by one, so repeated rows
and null ids come back as they are; labels that are null are unused, of several labels for one id the greatest counts, of several texts the least;
without labels of both kinds every score is the share of label 1 (0 without any); empty tables give no rows;
other columns are ignored; texts are read whole, in time that grows
with their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import dropped, free_names, in_arrow, table, written

SYMBOLS = 28  # 0: no letter, 1 to 26: a to z, 27: any other letter
SAMPLE, BUCKETS, SELECTED = 20_000, 1 << 20, 2048
THRESHOLD = 0.7

#: The letters that a character of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

_LETTER = r"[^\W\d_]"
_MARK = rf"(?:{_LETTER}|[0-9@$!|+])"
_KNOT = re.compile(r"[^\W_]")
_GAPPED = re.compile(rf"(?<![^\W_]){_MARK}(?:[ .*_~-]{{1,2}}+{_MARK}){{2,}}+")  # single letters, or what may stand for them, with gaps; a run is read once
_PART = re.compile(r"[\w@$!|+]+")
_SIGN = re.compile(rf"[0-9@$|+]|!{_LETTER}")
_ANY_LETTER = re.compile(_LETTER)
_LETTER_RUN = re.compile(rf"({_LETTER})\1\1")
_WORD = re.compile(_LETTER + "+")
_GAP = " .*_~-"
_GAPS = str.maketrans("", "", _GAP)


def suspicious(part: str) -> bool:
    """Letters with digits or signs, or a letter three times in a row. Each test passes the text once."""
    return bool(_ANY_LETTER.search(part) and _SIGN.search(part) or _LETTER_RUN.search(part))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _symbol_table() -> np.ndarray:
    return np.array([symbol(chr(i).lower()[0]) for i in range(0x3000)] + [27], np.uint8)


def letter_counts(docs: DataFrame) -> DataFrame:
    """gram, n: how often each three symbols follow each other in the column text."""

    def run(batches):
        codes, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                chars = np.frombuffer(f"  {text.as_py() or ''} ".encode("utf-32-le", "replace"), "<u4")
                s = codes[np.minimum(chars, 0x3000)].astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).transform(in_arrow, run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log p(third | first, second), smoothed with the pair and single frequencies."""
    n = np.zeros(SYMBOLS**3)
    for row in counts.collect():
        n[row["gram"]] = row["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(axis=0) + 10 * one) / (n.sum(axis=(0, 2))[:, None] + 10)
    return np.log((n + 5 * two) / (n.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Replaces disguised spans by their likeliest readings."""

    #: Readings that are kept before they are forgotten, and the longest span that is.
    CACHE, SHORT = 100_000, 64

    def __init__(self, model: np.ndarray) -> None:
        #: For each pair of symbols the third one's log probabilities.
        self.model = model.reshape(-1, SYMBOLS).tolist()
        self.seen: dict[str, str] = {}
        self.runs: dict[tuple, list] = {}
        self.steps: dict[tuple, dict] = {}

    def __call__(self, text: str) -> str:
        """The lower-case text with its disguised spans restored."""
        return _TOKEN.sub(lambda m: self.token(m[0]), self._joined(text))

    def tokens(self, text: str | None) -> set[str]:
        """The different tokens of a text, after letters with gaps were joined; ``token`` restores them."""
        return set(self._joined(text or "").split())

    def token(self, token: str) -> str:
        """A restored token; it is looked at only when met for the first time."""
        return token if token.isalpha() and not _RUN3.search(token) else _PART.sub(self._part, token)

    def words(self, text: str | None) -> set[str]:
        """The different words of the restored text."""
        return {w for t in self.tokens(text) for w in _WORD.findall(self.token(t))}

    def _joined(self, text: str) -> str:
        return _GAPPED.sub(self._gapped, text.lower())

    def _gapped(self, match: re.Match) -> str:
        """Letters with gaps, and signs among them if most are letters. A last one that begins a longer word does not belong to them."""
        whole, rest = match[0], ""
        if _KNOT.match(match.string, match.end()):
            gap = len(whole) - 1 - len(whole[:-1].rstrip(_GAP))
            whole, rest = whole[: -1 - gap], whole[-1 - gap :]
        span = whole.translate(_GAPS)
        return self.read(span) + rest if len(span) > 2 and 2 * sum(map(str.isalpha, span)) > len(span) else match[0]

    def _part(self, match: re.Match) -> str:
        """Exclamation marks at the end are no letters."""
        part = match[0].rstrip("!")
        return self.read(part) + match[0][len(part) :] if suspicious(part) else match[0]

    def read(self, span: str) -> str:
        if len(span) > self.SHORT:
            return self.decode(span)
        if span not in self.seen:
            if len(self.seen) >= self.CACHE:
                self.seen.clear()
            self.seen[span] = self.decode(span)
        return self.seen[span]

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For every run of a character its readings with their channel costs."""
        return [[(letters, cost) for letters, _, cost in self._readings(m[1], min(3, m.end() - m.start()))] for m in _RUNS.finditer(span)]

    def _readings(self, c: str, n: int) -> list[tuple[str, list[int], float]]:
        """Letters, their symbols and the cost for a character that stands n times (3: or more)."""
        if (c, n) not in self.runs:
            letters = [(c, 0.0)] if c.isalpha() else [(x, -0.5) for x in LEET.get(c, "")] + [(c, -4.0)]
            if n > 1:
                letters = [(x * k, cost - (0.2 if n > 2 else abs(n - k) * 1.0)) for x, cost in letters for k in (1, 2)]
            self.runs[c, n] = [(x, [symbol(y) for y in x], cost) for x, cost in letters]
        return self.runs[c, n]

    def _steps(self, c: str, n: int, state: int) -> list[tuple[int, float, str]]:
        """From a state, the pair of the last two symbols: the states after a run's readings, with costs and letters."""
        out = []
        for letters, symbols, total in self._readings(c, n):
            at = state
            for s in symbols:
                total += self.model[at][s]
                at = at % SYMBOLS * SYMBOLS + s
            out.append((at, total, letters))
        return out

    def decode(self, span: str) -> str:
        """Viterbi: of the paths that end in the same state only the best goes on."""
        best: dict = {0: (0.0, "", None)}  # by state: score, letters, the path before them
        for m in _RUNS.finditer(span):
            run = m[1], min(3, m.end() - m.start())
            steps = self.steps.setdefault(run, {})
            after: dict = {}
            get = after.get
            for state, path in best.items():
                if state not in steps:
                    steps[state] = self._steps(*run, state)
                for at, cost, letters in steps[state]:
                    total, old = path[0] + cost, get(at)
                    if old is None or old[0] < total:
                        after[at] = total, letters, path
            best = after
        _, path = max(((path[0] + self.model[state][0], path) for state, path in best.items()), key=lambda p: p[0])
        out = []
        while path:
            out.append(path[1])
            path = path[2]
        return "".join(reversed(out))


_RUNS = re.compile(r"(.)\1*", re.S)
_RUN3 = re.compile(r"(.)\1\1")
_TOKEN = re.compile(r"\S+")


def buckets_of(word: str) -> list[int]:
    """The hashed features of a word: itself, its beginnings and its ends of 3 to 6 letters."""
    parts = ["w" + word] + [f"{side}{part}" for k in (3, 4, 5, 6) if len(word) > k for side, part in (("b", word[:k]), ("e", word[-k:]))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


#: How many different words of a text must have a bucket, for each level.
LEVELS = (1, 2, 4)


def features_of(counts: Counter) -> list[int]:
    """The features of a text: a number for each bucket and level, from how many different words have the bucket."""
    return [b * len(LEVELS) + i for b, n in counts.items() for i, least in enumerate(LEVELS) if n >= least]


class Scorer:
    """The selected features' weights; tokens are looked up once."""

    CACHE = 100_000

    def __init__(self, model: dict) -> None:
        self.restore = Restorer(model["letters"])
        self.weights, self.bias = model["weights"], model["bias"]
        self.buckets = {f // len(LEVELS) for f in self.weights}
        self.seen: dict[str, tuple] = {}

    def found(self, text: str | None) -> list[int]:
        """The selected features that a text has."""
        seen, words = self.seen, {}
        if len(seen) > self.CACHE:
            seen.clear()
        for token in self.restore.tokens(text):
            hit = seen.get(token)
            if hit is None:
                each = ((w, tuple(b for b in buckets_of(w) if b in self.buckets)) for w in _WORD.findall(self.restore.token(token)))
                hit = seen[token] = tuple(x for x in each if x[1])
            if hit:
                words.update(hit)
        return sorted(f for f in features_of(Counter(b for buckets in words.values() for b in buckets)) if f in self.weights)

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[f] for f in self.found(text))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


_last: list = []


def _scorer(model: dict) -> Scorer:
    """The worker's scorer, with the tokens that it has seen in earlier tasks."""
    if not _last or _last[0] is not model:
        _last[:] = [model, Scorer(model)]
    return _last[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int) -> tuple[DataFrame | None, float]:
    """text, y, weight of at most about ``sample`` labelled documents, half of each label, and the share of label 1."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(allowed).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(count.values())
    if not count.get(0) or not count.get(1):
        return None, count.get(1, 0) / total if total else 0.0
    part = {y: min(1.0, sample / 2 / n) for y, n in count.items()}
    share = F.when(F.col("y") == 1, F.lit(part[1])).otherwise(F.lit(part[0]))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 62)) < share * (1 << 62)).withColumn("weight", 1 / share)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text for each id, so the sample stays as large as it was meant to be.
    return found.groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text")).select("text", "y", "weight"), count[1] / total


def _feature_counts(rows: DataFrame, letters) -> DataFrame:
    """feature, with1, with0: how many documents of each label have the feature."""

    def run(batches):
        restore, counts = Restorer(letters.value), np.zeros((2, BUCKETS * len(LEVELS)), np.int32)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                counts[y, features_of(Counter(b for w in restore.words(text) for b in buckets_of(w)))] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[1, seen]), pa.array(counts[0, seen])], names=["feature", "with1", "with0"])

    return rows.select("text", "y").transform(in_arrow, run, "feature int, with1 int, with0 int").groupBy("feature").agg(F.sum("with1").alias("with1"), F.sum("with0").alias("with0"))


def logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, penalty: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features, by full gradients with momentum. ``penalty``: of squared weights."""
    w, bias, v, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    weight = weight / weight.sum() * len(y)
    rate = 1.0 / (1 + np.bincount(columns, minlength=width) / 4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], minlength=len(y)) + bias, -30, 30)))
        gap = (p - y) * weight
        v = 0.9 * v - 0.1 * rate * (np.bincount(columns, gap[rows], minlength=width) + penalty * w)
        vb = 0.9 * vb - 0.1 * gap.sum() / (1 + len(y) / 4)
        w, bias = w + v, bias + vb
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """The model: letters (language model), weights by feature, bias."""
    spark = docs.sparkSession
    letters = language_model(letter_counts(docs))
    rows, prior = labelled_sample(docs, labels, label, allowed, sample)
    if rows is None:
        p = min(max(prior, 1e-9), 1 - 1e-9)
        return {"letters": letters, "weights": {}, "bias": float(np.log(p / (1 - p)))}
    rows = written(rows.repartition(min(64, max(8, sample // 500))), "labelled")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(letters)
    ratio = F.log((F.col("with1") + 0.5) / (n.get(1, 0) + 1) / ((F.col("with0") + 0.5) / (n.get(0, 0) + 1)))
    speaking = _feature_counts(rows, shared).withColumn("ratio", ratio).where("with1 >= 3 and ratio > 2")
    chosen = [r["feature"] for r in speaking.orderBy(F.desc(F.col("ratio") * F.col("with1")), "feature").limit(SELECTED).collect()]
    place = {b: i for i, b in enumerate(chosen)}
    model = spark.sparkContext.broadcast({"letters": letters, "weights": dict.fromkeys(chosen, 1.0), "bias": 0.0})

    def features(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            found = [scorer.found(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("y"), batch.column("weight")], names=["found", "y", "weight"])

    data = rows.transform(in_arrow, features, "found array<int>, y int, weight double").collect()
    counts = [len(r["found"]) for r in data]
    flat = np.array([place[b] for r in data for b in r["found"]], np.int64)
    w, bias = logistic(np.repeat(np.arange(len(data)), counts), flat, np.array([r["y"] for r in data], float), np.array([r["weight"] for r in data]), len(chosen))
    dropped(rows)
    return {"letters": letters, "weights": {b: float(x) for b, x in zip(chosen, w)}, "bias": bias}


def scored(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and, as ``name``, the score."""
    spark, names = docs.sparkSession, [c for c in docs.columns if c != name]
    (text,) = free_names(docs.columns, "__text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer.score(t) for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], names=[*names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([docs.schema[n] for n in names] + [StructField(name, DoubleType())])
    return docs.select(*(F.col(f"`{n}`") for n in names), F.col("text").cast("string").alias(text)).transform(in_arrow, run, schema)


def third(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), third(F.col("doc_id")) != 1)
    keys = docs.select("doc_id", "text", F.coalesce(third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return scored(keys, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
