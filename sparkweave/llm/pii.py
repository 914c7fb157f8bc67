"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Base spans are emails, IP addresses, card numbers and telephone numbers, found by pattern and check (parts of at most 255, the Luhn
sum, 8 to 15 digits). Then the corpus decides which terms reveal a protected value: for a value e and a term t
of the same documents, wherever in them, the disclosure of e by t is their pointwise
mutual information over all documents, as a share of the information of e itself:

    log2(N * n(t,e) / (n(t) * n(e))) / log2(N / n(e))

A share of one means that whoever reads t knows e. Terms that disclose at least ``DISCLOSURE`` of e become spans of the kind ``term`` wherever
they stand, in all documents, if they have support: ``SUPPORT`` documents that hold both, or as many places of e with t among the
``CONTEXT_WORDS`` words to either side. Documents or places count once if the ``REACH`` characters around e are the same, so
copies give no support. Sanitising replaces base spans by their kind and generalises terms: numbers to ``[NUMBER]``, other terms are removed.

All of it is DataFrame functions. Patterns are written without backtracking over runs, and what is gathered along a text is
gathered in blocks, so that no array or string is copied for each match; a text with 200,000 matches takes seconds.

Cases: null texts count as empty; empty texts have no spans; overlapping spans of different kinds all count, and sanitising
replaces their union once, by the first kind; repeated rows come back as often as they occur; null ids come back as null; an empty table gives
no rows; other columns are ignored (sanitising keeps them); texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.llm.common import BREAK, dropped, free_names, table, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, with possessive repeats, which match the same spans. Cards: whole runs of as many digits as can pass.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text without a span of the kind lacks: a quick test.
QUICK = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
REACH, CONTEXT_WORDS = 120, 5
#: Matches that are gathered at once.
BLOCK = 512
#: The first and the last part of a text up to a break.
FIRST, LAST = r"^[^\x20\x09-\x0D]*+", r"[^\x20\x09-\x0D]++$"
#: Stands for characters of base spans.
_COVER = "\x03"
SUPPORT, DISCLOSURE = 3, 0.9
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _once(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(items: Column) -> Column:
    """An array (a variable, not an expression) cut into arrays of BLOCK items, which are taken by place, as ``slice`` copies the whole array."""
    block = lambda i: F.transform(F.sequence(i, F.least(i + BLOCK, F.size(items)) - 1), lambda j: F.get(items, j))
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), block)).otherwise(F.array())


def find_all(text: Column, pattern: str | Column, kind: str, good=None) -> Column:
    """Array of (kind, start, end, value) for all matches that are ``good``, in code points. Matches are marked, and the text is cut at the marks."""
    pattern = F.lit(f"({pattern})") if isinstance(pattern, str) else F.concat(F.lit("("), pattern, F.lit(")"))
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, F.lit("\x01$1\x01"))
    none = F.array().cast(_SPAN)

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), end.alias("end"), part.alias("value"))
        taken = state["inside"] if good is None else F.when(state["inside"], good(span)).otherwise(F.lit(False))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), F.when(taken, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def block(state: Column, parts: Column) -> Column:
        first = F.struct(state["at"].alias("at"), state["inside"].alias("inside"), none.alias("out"))
        return F.aggregate(parts, first, step, lambda end: F.struct(end["at"].alias("at"), end["inside"].alias("inside"), F.concat(state["out"], F.array(end["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.flatten(_once(F.split(marked, "\x01", -1), lambda parts: F.aggregate(_blocks(parts), start, block, lambda state: state["out"])))


def replaced(text: Column, spans: Column, shown, rest=None) -> Column:
    """The text with ``shown(span)`` for each span, from left to right; of a span that an earlier one covers in part, ``rest(span, length)`` stays."""

    def step(state: Column, s: Column, piece: Column, base: Column) -> Column:
        between = F.substring(piece, state["at"] - base + 1, s["start"] - state["at"])
        tail = F.lit("") if rest is None else rest(s, F.greatest(s["end"] - state["at"], F.lit(0)))
        added = F.when(s["start"] >= state["at"], F.concat(between, shown(s))).otherwise(tail)
        return F.struct(F.concat(state["out"], added).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    def block(state: Column, part: Column, text: Column) -> Column:
        base = state["at"]
        to = F.greatest(F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), base), base)
        first = F.struct(F.lit("").alias("out"), base.alias("at"))
        done = lambda end: F.struct(end["at"].alias("at"), F.concat(state["out"], F.array(end["out"])).alias("out"))
        return _once(F.substring(text, base + 1, to - base), lambda piece: F.aggregate(part, first, lambda x, s: step(x, s, piece, base), done))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def run(x: Column) -> Column:
        last = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(x["text"], state["at"] + 1, F.length(x["text"])))
        return _once(x["spans"], lambda items: F.aggregate(_blocks(items), start, lambda state, part: block(state, part, x["text"]), last))

    return _once(F.struct(text.alias("text"), ordered.alias("spans")), run)


def _valid(span: Column) -> Column:
    value, digits = span["value"], F.regexp_replace(span["value"], "[^0-9]", "")
    card = F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    phone = F.length(digits).between(8, 15)
    return {"ip": F.rlike(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")), "card": card, "phone": phone}


def base_spans(text: Column) -> Column:
    """Array of all base spans, by kind as listed, then by start."""
    out = []
    for kind in KINDS:
        found = find_all(text, PATTERNS[kind], kind, None if kind == "email" else _check(kind))
        out.append(F.when(F.rlike(text, F.lit(QUICK[kind])), found).otherwise(F.array().cast(_SPAN)))
    return F.concat(*out)


def _check(kind: str):
    return lambda span: _valid(span)[kind]


def _plain(text: Column) -> Column:
    """The text without the characters that serve as marks."""
    return F.translate(text, "\x01" + _COVER, "\x02\x02")


def covered(text: Column, spans: Column) -> Column:
    """The text with a mark for each character of a span; all places stay."""
    fill = lambda n: F.repeat(F.lit(_COVER), n)
    return replaced(_plain(text), spans, lambda s: fill(s["end"] - s["start"]), lambda s, n: fill(n))


def _contexts(rows: DataFrame) -> DataFrame:
    """key, entity, context, terms: for every base span the words around it. Columns: key, text, covered, spans."""

    def one(s: Column, low: Column, piece: Column, plain: Column) -> Column:
        before = F.greatest(s["start"] - REACH, F.lit(0))
        left = lambda t: F.substring(t, before - low + 1, s["start"] - before)
        right = lambda t: F.substring(t, s["end"] - low + 1, F.lit(REACH))
        # What touches the end of the reach may be a part of a word.
        whole = F.when(before > 0, F.regexp_replace(left(plain), FIRST, "")).otherwise(left(plain))
        rest = F.when(F.length(right(plain)) == REACH, F.regexp_replace(right(plain), LAST, "")).otherwise(right(plain))
        words = lambda t: F.filter(F.split(F.lower(t), BREAK), lambda w: w != "")
        near = F.concat(F.slice(F.reverse(words(whole)), 1, CONTEXT_WORDS), F.slice(words(rest), 1, CONTEXT_WORDS))
        return F.struct(
            F.xxhash64(s["kind"], s["value"]).alias("entity"),
            F.xxhash64(left(piece), right(piece)).alias("context"),
            F.array_distinct(F.filter(near, lambda w: ~F.contains(w, F.lit(_COVER)))).alias("terms"),
        )

    def block(part: Column) -> Column:
        low = F.greatest(F.array_min(F.transform(part, lambda s: s["start"])) - REACH, F.lit(0))
        size = F.array_max(F.transform(part, lambda s: s["end"])) + REACH - low
        cut = lambda t: F.substring(t, low + 1, size)
        return _once(F.struct(low.alias("low"), cut(F.col("text")).alias("piece"), cut(F.col("covered")).alias("plain")), lambda c: F.transform(part, lambda s: one(s, c["low"], c["piece"], c["plain"])))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    found = F.flatten(_once(ordered, lambda items: F.transform(_blocks(items), block)))
    return rows.select("key", F.explode(found).alias("c")).select("key", "c.*")


def _terms(text: Column) -> Column:
    """The different lower-case words of a covered text that hold no part of a base span."""
    return F.array_distinct(F.filter(F.split(F.lower(text), BREAK), lambda w: (w != "") & ~F.contains(w, F.lit(_COVER))))


def _signed(rows: DataFrame, by: list[str], names: tuple[str, str]) -> DataFrame:
    """``by`` and two hashes of the set of documents (key) that the group's rows name; equal sets have equal hashes."""
    return rows.groupBy(*by).agg(*(F.bit_xor(F.xxhash64("key", F.lit(n))).alias(name) for n, name in enumerate(names)))


def disclosing_terms(docs: DataFrame, protected: DataFrame) -> DataFrame:
    """h: hashes of the terms with enough support and disclosure, a written table. ``docs``: text of all documents; ``protected``: key, text, covered, spans.

    Values that occur in the same documents are one class, and so are terms; only classes meet, so a directory that occurs several
    times costs one pair and not one for each value and term. For the share, n(t) must not exceed n(e) (N / n(e)) ** (1 - DISCLOSURE), so the
    classes of a document meet under this condition, and what is common beside a rare value is left out before any row is made.
    """
    n = docs.count()
    protected = protected.dropDuplicates(["key"])
    contexts = written(_contexts(protected).withColumn("terms", F.transform("terms", lambda w: F.xxhash64(w))), "contexts")
    places = contexts.select("entity", "key", "context")
    # An entity with fewer places that differ can have no term.
    entities = places.groupBy("entity").agg(F.count_distinct("context").alias("c"), F.count_distinct("key").alias("n_e")).where(F.col("c") >= SUPPORT)
    entities = written(entities.where(F.col("n_e") < n).select("entity", "n_e"), "entities")
    held = places.join(entities, "entity").groupBy("entity", "key", "n_e").agg(F.min("context").alias("context"))
    held = written(held, "held")
    signed = _signed(held, ["entity", "n_e"], ("e0", "e1"))
    classed = written(held.join(signed.drop("n_e"), "entity"), "classed")
    # The documents of a class are those of any of its values.
    chosen = signed.groupBy("e0", "e1").agg(F.min("entity").alias("entity"))
    values = classed.join(chosen.select("entity"), "entity", "left_semi").select("key", "e0", "e1", "n_e")
    values = values.withColumn("most", F.col("n_e") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - DISCLOSURE)) + 1e-6)
    words = protected.join(held.select("key").distinct(), "key").select("key", F.explode(F.transform(_terms(F.col("covered")), lambda w: F.xxhash64(w))).alias("h"))
    words = written(words, "words")
    found = docs.select(F.explode(F.transform(F.array_distinct(F.split(F.lower(_plain(F.col("text"))), BREAK)), lambda w: F.xxhash64(w))).alias("h"))
    terms = _signed(words, ["h"], ("t0", "t1")).join(found.groupBy("h").agg(F.count(F.lit(1)).alias("n_t")), "h")
    terms = written(terms, "vocabulary")
    some = terms.groupBy("t0", "t1", "n_t").agg(F.min("h").alias("h"))
    spoken = words.join(some, "h").select("key", "t0", "t1", "n_t")
    pairs = values.join(spoken, "key").where(F.col("n_t") <= F.col("most"))
    together = pairs.groupBy("e0", "e1", "n_e", "t0", "t1", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
    information = F.log2(F.lit(float(n)) / F.col("n_e"))
    share = F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / information
    known = written(together.where(share >= DISCLOSURE).select("e0", "e1", "t0", "t1", "n_t", "n_te"), "candidates")
    pair = ["e0", "e1", "t0", "t1", "n_t"]
    # Support by documents: places of one value that differ, over the documents that hold both.
    shared = known.where(F.col("n_te") >= SUPPORT).select(*pair).join(spoken, ["t0", "t1", "n_t"])
    in_docs = shared.join(classed, ["e0", "e1", "key"]).groupBy("entity", "t0", "t1", "n_t").agg(F.count_distinct("context").alias("c")).where(F.col("c") >= SUPPORT)
    by_docs = terms.join(in_docs.select("t0", "t1", "n_t").distinct(), ["t0", "t1", "n_t"]).select("h")
    # Support by places of one value with the term near them.
    near = contexts.join(signed, "entity").select("entity", "e0", "e1", "context", F.explode("terms").alias("h")).distinct()
    often = near.groupBy("entity", "e0", "e1", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= SUPPORT)
    by_places = often.join(terms, "h").join(known.select(*pair), pair, "left_semi").select("h")
    out = written(by_docs.unionByName(by_places).distinct(), "terms")
    dropped(contexts, entities, held, classed, words, terms, known)
    return out


def _marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, spans: where the terms stand in the texts that hold some, by start. ``docs``: key, text.

    Words are looked up by their hashes, so a text costs its words, however many terms it holds.
    """
    each = docs.select("key", F.explode(F.array_distinct(F.split(F.lower(_plain(F.col("text"))), BREAK))).alias("w")).select("key", F.xxhash64("w").alias("h"))
    # Few documents hold a term. As a table their size is known, so texts move only if it is too large to broadcast.
    holders = written(each.join(terms, "h").select("key").distinct(), "holders")
    texts = docs.join(holders, "key", "left_semi").dropDuplicates(["key"])
    # Places are sums of lengths, counted by a window along each text.
    pieces = texts.select("key", F.posexplode(F.split(covered(F.col("text"), base_spans(F.col("text"))), r"[\x20\x09-\x0D]", -1)).alias("pos", "w"))
    before = F.sum(F.length("w") + 1).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).where((F.col("w") != "") & ~F.contains("w", F.lit(_COVER)))
    rows = rows.withColumn("value", F.lower("w")).withColumn("h", F.xxhash64("value")).join(terms, "h")
    span = F.struct("start", (F.col("start") + F.length("w")).alias("end"), "value")
    found = rows.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = written(found.select("key", F.transform("spans", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("spans")), "marked")
    dropped(holders)
    return out


def with_spans(docs: DataFrame, name: str = "pii_spans") -> DataFrame:
    """All columns of ``docs`` and, as ``name``, base spans by kind and start, then the spans of disclosing terms by start."""
    names = [c for c in docs.columns if c != name]
    mine, holder, held = free_names(docs.columns, "__key", "__holds", "__spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id"), text)
    protected = docs.select(key.alias("key"), text.alias("text"), base_spans(text).alias("spans")).where(F.size("spans") > 0)
    protected = written(protected.withColumn("covered", covered(F.col("text"), F.col("spans"))), "protected")
    terms = disclosing_terms(docs.select(text.alias("text")), protected)
    dropped(protected)
    marked = _marked(docs.select(key.alias("key"), text.alias("text")), terms).select(F.col("key").alias(holder), F.col("spans").alias(held))
    dropped(terms)
    out = docs.withColumn(mine, key).join(marked, F.col(mine) == F.col(holder), "left")
    return out.select(*(F.col(f"`{c}`") for c in names), F.concat(base_spans(text), F.coalesce(F.col(held), F.array().cast(_SPAN))).alias(name))


def written_as(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced, from left to right; parts of a span that an earlier one covers are gone already."""
    general = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.rlike(s["value"], F.lit("[0-9]")), F.lit("[NUMBER]")).otherwise(F.lit(""))
    return replaced(text, spans, general)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["kind"] != "term")
    counts = [F.size(F.filter(spans, _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return docs.select("doc_id", *counts, F.sha2(written_as(base), 256).alias("base_sha256"), written_as(spans).alias("spans"))


def _of(kind: str):
    return lambda span: span["kind"] == kind
