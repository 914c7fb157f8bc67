"""URL filters: host rules first, gradient-boosted trees on lexical features for all other URLs.

Rules name a host suffix and a path prefix; the longest rule that fits a URL decides. URLs without a rule are judged by
gradient-boosted trees whose features are lexical: lengths, depth, digit ratio, entropy, parameter counts, words of
the host and statistics of its suffix. The trees are trained on labelled URLs: those whose host has a word of a seed list
count as bad, those without one that no rule blocks as good. The words themselves are no features. ``held_out`` deals hosts into folds and
measures each fold with trees of the other folds, which never saw its hosts. At most ``SAMPLE`` URLs (chosen by a hash of the URL) are used for fitting, and they reach
the driver as counts of equal feature vectors; suffix statistics cover all labelled URLs and stay a table, for any number of
suffixes. The finished trees are one column expression of nested conditions, so judging is a projection of the scan, joined with the suffixes.

Cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by its features; repeated
rows are judged each; an empty table gives no rows; without labels of both kinds every verdict is allow, or block if
all labelled URLs are blocked; other columns are ignored, also one named like a result; very long URLs are read whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import LOWER, UPPER, table, written

#: Fixed values: (host suffix, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of hosts that label a URL as spam.
SPAM_WORDS = ("spam", "cheap", "pills", "casino", "viagra", "porn", "xxx", "bet", "loan", "warez")
SAMPLE = 20_000
#: Labelled URLs that a suffix needs for a statistic of its own, and folds of hosts.
SUFFIX_URLS, FOLDS = 10, 5
_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#&=%:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls without one."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        hit = fits(host, path, rule)
        name, verdict = F.when(hit, rule[0] + rule[1]).otherwise(name), F.when(hit, rule[2]).otherwise(verdict)
    return name, verdict


def features(url: Column, host: Column, path: Column, suffix_blocked: Column) -> dict[str, Column]:
    """Lexical features as whole numbers; ratios and entropies are in hundredths. ``suffix_blocked``: how often the host's suffix was blocked, in hundredths, or null."""
    url = F.coalesce(url, F.lit(""))
    low = F.lower(url)
    size = F.length(low)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    log2 = lambda x: F.log2(x.cast("double"))

    def entropy(text: Column) -> Column:
        n = F.length(text)
        return F.when(n > 0, 100 * sum((F.when(count(text, c) > 0, -count(text, c) / n * log2(count(text, c) / n)).otherwise(0.0) for c in _CHARS), F.lit(0.0))).otherwise(0.0)

    digits = size - F.length(F.translate(low, "0123456789", ""))
    labels = F.split(host, r"\.")
    # Without its last label: what a site can choose for itself.
    name = F.regexp_replace(host, r"\.[^.]*$", "")
    vowels = F.length(name) - F.length(F.translate(name, "aeiou", ""))
    out = {
        "length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digits": F.when(size > 0, 100 * digits / size).otherwise(0.0),
        "host_digits": F.length(host) - F.length(F.translate(host, "0123456789", "")),
        "entropy": entropy(low),
        "host_entropy": entropy(host),
        "parameters": count(low, "="),
        "separators": count(low, "&"),
        "hyphens": count(host, "-"),
        "labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "name_vowels": F.when(F.length(name) > 0, 100 * vowels / F.length(name)).otherwise(0.0),
        "https": F.startswith(low, F.lit("https://")).cast("int"),
        "fragment": (F.instr(low, "#") > 0).cast("int"),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        "suffix_length": F.length(F.element_at(labels, -1)),
        "suffix_blocked": F.coalesce(suffix_blocked, F.lit(50)),
    }
    return {k: v.cast("int") for k, v in out.items()}


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


def fold_of(host: Column) -> Column:
    return F.crc32(host) % FOLDS


@dataclass
class Trees:
    """Boosted trees: a tree is (feature, cut, left, right) with value <= cut to the left, or a number. ``suffixes``: a table suffix, blocked."""

    start: float
    trees: list
    suffixes: DataFrame | None = None

    def column(self, columns: dict[str, Column]) -> Column:
        def one(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, cut, left, right = tree
            return F.when(columns[feature] <= cut, one(left)).otherwise(one(right))

        return sum((one(t) for t in self.trees), F.lit(self.start))

    def value(self, row: dict) -> float:
        def one(tree) -> float:
            while not isinstance(tree, float):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return self.start + sum(map(one, self.trees))


def boost(rows: list[tuple[dict, int, int]], rounds: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss. ``rows``: features, how many have label 1, how many have label 0."""
    ones, zeros = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not ones or not zeros:
        return Trees(math.inf if ones else -math.inf, [])
    names = sorted(rows[0][0])
    start = math.log(ones / zeros)
    raw = [start] * len(rows)
    trees = []
    for _ in range(rounds):
        grads = []
        for (_, a, b), z in zip(rows, raw):
            p = 1 / (1 + math.exp(-z))
            grads.append((p * (a + b) - a, p * (1 - p) * (a + b)))

        def grow(members: list[int], left: int):
            g, h = sum(grads[i][0] for i in members), sum(grads[i][1] for i in members)
            best = (1e-6, None, None)
            if left:
                for name in names:
                    bins: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
                    for i in members:
                        b = bins[rows[i][0][name]]
                        b[0] += grads[i][0]
                        b[1] += grads[i][1]
                    gl = hl = 0.0
                    for cut in sorted(bins)[:-1]:
                        gl, hl = gl + bins[cut][0], hl + bins[cut][1]
                        if hl >= least and h - hl >= least:
                            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                            if gain > best[0] + 1e-12:
                                best = (gain, name, cut)
            if best[1] is None:
                return float(-rate * g / (h + ridge))
            _, name, cut = best
            return (name, cut, grow([i for i in members if rows[i][0][name] <= cut], left - 1), grow([i for i in members if rows[i][0][name] > cut], left - 1))

        tree = grow(list(range(len(rows))), depth)
        if isinstance(tree, float) and abs(tree) < 1e-9:
            break
        trees.append(tree)
        one = Trees(0.0, [tree])
        raw = [z + one.value(r[0]) for r, z in zip(rows, raw)]
    return Trees(start, trees)


def label_of(host: Column, verdict: Column, spam_words=SPAM_WORDS) -> Column:
    """1: a seed word in the host. 0: no seed word, and no rule that blocks. Null: blocked by a rule, which says nothing about the URL itself."""
    spam = sum((F.contains(host, F.lit(w)).cast("int") for w in spam_words), F.lit(0)) > 0
    return F.when(spam, 1).when(F.coalesce(verdict, F.lit("")) != "block", 0)


def labelled(pages: DataFrame, rules=RULES, spam_words=SPAM_WORDS) -> DataFrame:
    """url, host, path, suffix, y of the URLs that have a label."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col("url").cast("string").alias("url")).select("url", host.alias("host"), path.alias("path"))
    known = named.withColumns({"y": label_of(F.col("host"), rule_of(F.col("host"), F.col("path"), rules)[1], spam_words), "suffix": suffix_of(F.col("host"))})
    return known.where("y is not null")


def _with_features(rows: DataFrame, suffixes: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows url, host, path, suffix with their suffix's statistic, and the features. Spark knows the table's size and broadcasts it while it is small."""
    if suffixes is None:
        rows = rows.withColumn("blocked", F.lit(None).cast("int"))
    else:
        rows = rows.join(suffixes, "suffix", "left")
    return rows, features(F.col("url"), F.col("host"), F.col("path"), F.col("blocked"))


def train(pages: DataFrame, rules=RULES, spam_words=SPAM_WORDS, sample: int = SAMPLE, without: int | None = None) -> Trees:
    """Trees from the labelled URLs of ``pages``, but for the hosts of a fold; at most about ``sample`` URLs are used."""
    known = labelled(pages, rules, spam_words)
    if without is not None:
        known = known.where(fold_of(F.col("host")) != without)
    ends = known.groupBy("suffix").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUFFIX_URLS)
    suffixes = written(ends.select("suffix", F.round(100 * F.col("ones") / F.col("n")).cast("int").alias("blocked")), "suffixes")
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    chosen = known.where(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    chosen, columns = _with_features(chosen, suffixes)
    binned = chosen.select("y", *(v.alias(k) for k, v in columns.items())).groupBy(*columns).agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    rows = [({k: r[k] for k in columns}, r["ones"], r["zeros"]) for r in sorted(binned.collect())]
    trees = boost(rows)
    trees.suffixes = suffixes
    return trees


def _scored(rows: DataFrame, trees: Trees) -> DataFrame:
    """Rows url, host, path, suffix with a column score, the trees' probability of block."""
    if math.isinf(trees.start):
        return rows.withColumn("score", F.lit(1.0 if trees.start > 0 else 0.0))
    names = rows.columns
    rows, columns = _with_features(rows, trees.suffixes)
    used = sorted({f for t in trees.trees for f in _used(t)})
    rows = rows.withColumns({f"f_{k}": columns[k] for k in used})
    return rows.select(*names, (1 / (1 + F.exp(-trees.column({k: F.col(f"f_{k}") for k in used})))).alias("score"))


def judged(pages: DataFrame, trees: Trees, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("suffix", suffix_of(F.col("host")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = _scored(named, trees).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "score")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def held_out(pages: DataFrame, rules=RULES, spam_words=SPAM_WORDS) -> dict[str, float]:
    """How trees judge labelled URLs on hosts that they were not fitted on, over all folds: urls, bad, precision, recall."""
    sums = {"urls": 0, "bad": 0, "blocked": 0, "both": 0}
    for fold in range(FOLDS):
        trees = train(pages, rules, spam_words, without=fold)
        rows = _scored(labelled(pages, rules, spam_words).where(fold_of(F.col("host")) == fold), trees)
        hit = (F.col("score") >= 0.5).cast("int")
        found = rows.agg(F.count(F.lit(1)).alias("urls"), F.sum("y").alias("bad"), F.sum(hit).alias("blocked"), F.sum(hit * F.col("y")).alias("both")).first()
        sums = {k: n + (found[k] or 0) for k, n in sums.items()}
    part = lambda a, b: a / b if b else 0.0
    return {"urls": sums["urls"], "bad": sums["bad"], "precision": part(sums["both"], sums["blocked"]), "recall": part(sums["both"], sums["bad"])}


def _used(tree) -> set[str]:
    return set() if isinstance(tree, float) else {tree[0]} | _used(tree[2]) | _used(tree[3])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    return judged(pages, train(pages))
