"""Named queries over the driver's tables and their SQL oracles.

Literal fixtures are the same Python rows on both sides: a DataFrame here, VALUES in the SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.functions import text as T
from sparkweave.operators import chunk, evaluate, extract, graph, increment, retrieve, vector
from sparkweave.schema import DOMAIN, FORM_TITLES, OTHER_TITLE, REFERENCE
from sparkweave.sources import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Queries over one relation: its SQL with REL in its place, the relation, and the function of a DataFrame. Tests run them over fixed rows too.
OVER: dict[str, tuple] = {}


class Derived:
    """A relation made from a table by expressions that Spark and the oracle read alike: ``key`` as id, and one row for each of the expressions."""

    def __init__(self, table: str, key: str, name: str, expressions: list[str]) -> None:
        self.table, self.key, self.name, self.expressions = table, key, name, expressions
        self.sql = f"(SELECT {key} * {len(expressions)} + unnest({list(range(len(expressions)))}) AS id, unnest([{', '.join(expressions)}]) AS {name} FROM {table})"

    def frame(self, spark, d) -> DataFrame:
        rows = t(spark, d, self.table).select(self.key, F.posexplode(F.array(*map(F.expr, self.expressions))).alias("n", self.name))
        return rows.select((F.col(self.key) * len(self.expressions) + F.col("n")).alias("id"), self.name)


def query_over(relation, sql: str):
    """Registers a function of the relation's DataFrame under its name."""

    def add(f):
        OVER[f.__name__] = sql, relation, f
        QUERIES[f.__name__] = lambda spark, d: f(relation.frame(spark, d))
        ORACLE[f.__name__] = sql.replace("REL", relation.sql)
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(quoted, x)) + "]"
    return repr(x)


def values(rows: list[tuple], *columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({', '.join(columns)}))"


def picked(words, by: str = "doc_id") -> str:
    """One of the words for each row, in turn."""
    cases = " ".join(f"WHEN {i} THEN {quoted(w)}" for i, w in enumerate(words))
    return f"CASE {by} % {len(words)} {cases} END"


def digits(n: int, by: str = "doc_id") -> str:
    return f"CAST({by} % {n} AS STRING)"


FORM_LETTERS, FIRST_WORD = picked(("I", "N", "G", "DS", "ETA", "AR")), "split_part(text, ' ', 1)"
#: Names in all the ways in which documents write them, with numbers and words of their own.
NAMES = Derived("documents", "doc_id", "name", [
    f"{FORM_LETTERS} || '-' || {digits(10000)}", f"'Form ' || {FORM_LETTERS} || ' ' || {digits(1000)} || {picked(('', 'a', 'B'))}", f"'form i‑' || {digits(997)}", f"upper(left(source, 1)) || '-' || {digits(10)} || 'B'",
    f"{picked(('W-', '10', '9'))} || {digits(50)}", f"'section ' || {digits(300)} || ' of Form I-' || {digits(900)}", f"{FIRST_WORD} || ' ' || {picked([w for ws in DOMAIN.keywords.values() for w in ws])}",
    f"'  ' || upper(source) || '   ' || lang || '  '", "text",
])
#: Paths of files.
PATHS = Derived("documents", "doc_id", "path", [
    f"'/x/' || lower({FORM_LETTERS}) || '-' || {digits(1000)} || 'instr.pdf'", f"'C:' || chr(92) || 'docs' || chr(92) || {FORM_LETTERS} || '-' || {digits(900)} || 'A.pdf'", f"lower({FORM_LETTERS}) || {digits(10000)} || '.tar.pdf'", "source || '.txt'",
    f"'/a/b/' || lower({FORM_LETTERS}) || {digits(1000)}", f"{picked(('', '.pdf', '/x/i-485instr', '/y/'))}", f"'/data/' || lang || '/i-' || {digits(1000)} || {picked(('', 'a', 'ez'))} || '.html'",
])
#: What models answer.
SAID = Derived("documents", "doc_id", "said", [
    f"'File I-' || {digits(1000)} || ' with I‑' || {digits(997)} || ' and AB-1, or i-' || {digits(1000)} || '.'", f"{picked(('The sources do not cover this.', 'I could not find it', 'It does not include fees', 'Yes: file it.', 'No information is available', 'outside the scope'))} || ' ' || {FIRST_WORD}",
    f"'score: 0.' || {digits(100)}", "'{\"score\": ' || " + digits(12) + " || '}'", f"'I rate this ' || {digits(101)} || ' of 100'", f"'-' || {digits(7)}", f"'about 0.' || {digits(100)} || ' then 9'", f"{picked(('', 'none', 'Score = 1.5'))}", "source || ' ' || left(text, 400)",
])
_JSON = (
    "'{\"entities\": [\"Form I-' || " + digits(900) + " || '\", {\"name\": \"H-' || " + digits(10) + " || 'B\", \"entity_type\": \"form\"}, {\"value\": \"' || source || '\", \"category\": \"Agency\"}, {\"name\": \"  \"}, 5], "
    "\"relations\": [{\"subject\": \"Form I-' || " + digits(900) + " || '\", \"predicate\": \"Requires\", \"object\": \"' || lang || '\", \"evidence\": \"must\"}, {\"source\": \"' || source || '\", \"relation\": \"references\", \"target\": \"a\"}, "
    "{\"subject\": \"a\", \"predicate\": \"likes\", \"object\": \"b\"}, {\"subject\": \"x\", \"predicate\": \"requires\", \"object\": \"x\"}]}'"
)
#: Models' answers with JSON in them: alone, fenced, within words, cut off.
RESPONSES = Derived("documents", "doc_id", "text", [_JSON, f"'```json' || chr(10) || {_JSON} || chr(10) || '```'", f"'Here it is: ' || {_JSON} || ' done'", f"left({_JSON}, 60)", "lang", "''"])
PARAGRAPHS = Derived("documents", "doc_id", "text", [f"replace(text, '. ', '.' || chr(10) || chr(10))", f"lang || chr(10) || source || chr(10) || chr(10) || chr(10) || {FIRST_WORD} || '  ' || chr(10) || chr(10)"])


# ── texts and filters ──────────────────────────────────────────────────────────────────────────────────────────────

SUBSTANTIAL_SQL = r"""
  length(trim(text, E' \t\n\r')) >= 200
  AND NOT regexp_matches(text, '(?i)^\s*form\s+[a-z]+-\d+[a-z]?\s+.{0,40}?page\s+\d+\s+of\s+\d+')
  AND length(regexp_replace(trim(text, E' \t\n\r'), '[^\p{L}]', '', 'g')) * 1.0 / greatest(length(trim(text, E' \t\n\r')), 1) > 0.5"""


@query(f"SELECT doc_id, lang FROM documents WHERE {SUBSTANTIAL_SQL}")
def chunk_filter_substantial(spark, d):
    return t(spark, d, "documents").where(T.is_substantial(F.col("text"))).select("doc_id", "lang")


@query("SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY lang")
def doc_stats_by_lang(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.length("text")).cast("long").alias("longest")
    )


@query(r"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s[i] AS sentence FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents), range(1, 100000) r(i)
WHERE i <= len(s)""")
def sentence_split(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query_over(PARAGRAPHS, r"""
SELECT id, CAST(i - 1 AS BIGINT) AS pos, p[i] AS paragraph FROM (
  SELECT id, list_filter(list_transform(regexp_extract_all(text, '(?s).+?(?:\n{2,}|$)'), lambda x: trim(x, E' \t\n')), lambda x: x <> '') AS p
  FROM REL), range(1, 20000) r(i) WHERE i <= len(p)""")
def paragraph_split(rows):
    return rows.select("id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, CAST(i // 1400 AS BIGINT) AS pos, substr(text, CAST(i + 1 AS BIGINT), 1500) AS piece FROM documents, range(0, 1000000, 1400) r(i) WHERE i <= greatest(length(text) - 1, 0)")
def hard_split_windows(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM conversations""")
def section_offsets(spark, d):
    return chunk.section_offsets(t(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "offset")


def _sections(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    return docs.select(F.col("doc_id"), F.concat(F.lit("/data/"), F.col("source")).alias("filepath"), F.lit(0).alias("section_no"), F.col("lang").alias("heading_path"), "text", F.expr("cast(map() as map<string,string>)").alias("metadata"))


#: Units of long texts (paragraphs, sentences of long ones, windows of long sentences), then one unit a step: it goes into the open chunk, or opens the next one with the end of the last.
CHUNKS_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, '/data/' || source AS filepath, lang, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, unnest(range(len(x))) AS p, unnest(x) AS part FROM (SELECT doc_id, regexp_extract_all(text, '(?s).+?(?:\n{2,}|$)') AS x FROM docs WHERE length(text) > 1500)),
par AS (SELECT doc_id, p, trim(part, E' \t\n\r') AS para, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY p) - length(part) AS begins FROM parts QUALIFY para <> ''),
sen AS (SELECT doc_id, p, unnest(range(1, len(x) + 1)) AS s, unnest(x) AS sentence FROM (SELECT doc_id, p, string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM par WHERE length(para) > 1500)),
win AS (SELECT doc_id, p, s, unnest(range(1, (length(sentence) - 1) // 1400 + 2)) AS w, sentence FROM sen WHERE length(sentence) > 1500),
units AS (
  SELECT doc_id, p, 0 AS s, 0 AS w, CASE WHEN length(para) <= 1500 THEN para END AS text, length(para) AS size, 500 AS least FROM par
  UNION ALL SELECT doc_id, p, s, 0, CASE WHEN length(sentence) <= 1500 THEN sentence END, length(sentence), 1 FROM sen
  UNION ALL SELECT doc_id, p, s, w, substr(sentence, (w - 1) * 1400 + 1, 1500), length(substr(sentence, (w - 1) * 1400 + 1, 1500)), 1 FROM win),
u AS MATERIALIZED (SELECT doc_id, text, coalesce(text, '') AS shown, size, least, row_number() OVER (PARTITION BY doc_id ORDER BY p, s, w) AS n FROM units),
filled AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, 0 AS ordinal, CAST(min(begins) AS BIGINT) AS start, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS acc, 0 AS taken FROM par GROUP BY doc_id
  UNION ALL
  SELECT doc_id, n, CASE WHEN opens THEN ordinal + 1 ELSE ordinal END, CASE WHEN opens THEN greatest(0, start + length(coalesce(acc, '')) - length(tail)) ELSE start END, CASE WHEN opens THEN length(tail) ELSE size END + length(shown),
    CASE WHEN opens AND text IS NULL THEN tail WHEN opens THEN tail || E'\n\n' || text WHEN text IS NULL THEN acc WHEN acc IS NULL THEN text ELSE acc || E'\n\n' || text END, CASE WHEN opens THEN 1 ELSE taken + 1 END
  FROM (SELECT f.doc_id, u.n, f.ordinal, f.start, f.size, f.acc, f.taken, u.text, u.shown, right(coalesce(f.acc, ''), 100) AS tail, f.taken > 0 AND NOT (f.size + u.size <= 1500 OR f.size < u.least) AS opens
    FROM filled f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1)),
pieces AS (
  SELECT doc_id, ordinal, coalesce(arg_max(acc, n), '') AS content, min(start) AS start FROM filled WHERE n > 0 GROUP BY doc_id, ordinal
  UNION ALL SELECT doc_id, 0, text, 0 FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM par))
SELECT substr(sha256(doc_id || '|0|' || ordinal), 1, 16) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, filepath, lang AS heading_path, 0 AS section_no, CAST(ordinal AS INTEGER) AS ordinal, content, CAST(start AS BIGINT) AS char_start, CAST(start + length(content) AS BIGINT) AS char_end
FROM pieces JOIN docs USING (doc_id)"""


@query(CHUNKS_SQL)
def chunk_documents(spark, d):
    return chunk.sections_to_chunks(_sections(spark, d)).drop("metadata")


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s+', ' ', 'g')), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS title FROM pages WHERE html LIKE '%<h1>%'""")
def html_title_h1(spark, d):
    found = parse.pages_to_sections(t(spark, d, "pages"), "page_id", "html").where(F.col("heading_path") != "")
    return found.groupBy("doc_id").agg(F.min_by("heading_path", "section_no").alias("title")).select(F.col("doc_id").cast("long").alias("page_id"), F.regexp_replace("title", r"\s+", " ").alias("title"))


#: For pages as the tables have them: headings h1, no nesting of dropped tags. Without those, a page is comments, tags and texts in order.
HTML_SQL = r"""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head[^>]*>.*?</head>', '', 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<nav[^>]*>.*?(</nav>|$)', '<hr>', 'g'), '(?is)<(header|footer)[^>]*>.*?(</(header|footer)>|$)', '<hr>', 'g') AS html FROM pages),
e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+')) AS event, unnest(range(len(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+')))) AS n FROM c),
s AS (SELECT *, event LIKE '<!--%' AS comment, CASE WHEN event LIKE '<!--%' THEN substr(event, 5, length(event) - 7) WHEN event LIKE '<%' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(event, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') END AS data,
  count(CASE WHEN lower(event) LIKE '<h1%' THEN 1 END) OVER w AS opened, count(CASE WHEN lower(event) LIKE '</h1%' THEN 1 END) OVER w AS closed FROM e WINDOW w AS (PARTITION BY page_id ORDER BY n)),
d AS (SELECT page_id, n, opened, comment, opened > closed AS heading, trim(data, E' \t\n\r') AS data FROM s WHERE trim(data, E' \t\n\r') <> ''),
b AS (SELECT page_id, opened AS part, string_agg(data, chr(10) ORDER BY n) AS text FROM d WHERE NOT heading GROUP BY page_id, opened),
h AS (SELECT page_id, opened AS part, string_agg(data, ' ' ORDER BY n) AS title FROM d WHERE heading AND NOT comment GROUP BY page_id, opened)
SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS filepath, CAST(row_number() OVER (PARTITION BY b.page_id ORDER BY b.part) - 1 AS INTEGER) AS section_no, coalesce(title, '') AS heading_path,
  CAST(CASE WHEN title IS NULL THEN 0 ELSE 1 END AS INTEGER) AS level, text, CAST(NULL AS VARCHAR) AS error
FROM b LEFT JOIN h USING (page_id, part)"""


@query(HTML_SQL)
def html_sections(spark, d):
    return parse.pages_to_sections(t(spark, d, "pages"), "page_id", "html").drop("metadata")


#: Spans as a PDF reader gives them, from conversations: every turn has a block of one line, whose size and weight vary, and a block of two lines.
SPAN_PARTS = [
    ("turn % 3 * 2", "0", "0", "upper(role)", f"CAST({picked((20, 14, 10, 10, 13, 10, 10, 16), 'turn')} AS DOUBLE)", "CASE WHEN role = 'assistant' THEN 16 ELSE 0 END"),
    ("turn % 3 * 2", "0", "1", "'turn ' || CAST(turn AS STRING)", f"CAST({picked((20, 14, 10, 10, 13, 10, 10, 16), 'turn')} AS DOUBLE)", "0"),
    ("turn % 3 * 2 + 1", "0", "0", "split_part(text, chr(10), 1)", "CAST(10 AS DOUBLE)", "0"), ("turn % 3 * 2 + 1", "0", "1", "'  and so on '", "CAST(10 AS DOUBLE)", "0"),
    ("turn % 3 * 2 + 1", "1", "0", "CASE WHEN turn % 2 = 0 THEN split_part(text, ' ', 2) ELSE '   ' END", "CAST(10 AS DOUBLE)", "0"),
]
SPANS_SQL = "(" + " UNION ALL ".join(f"SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn // 3 + 1 AS INTEGER) AS page, CAST({b} AS INTEGER) AS block, {l} AS line, {k} AS span, {x} AS text, {size} AS size, {flags} AS flags FROM conversations" for b, l, k, x, size, flags in SPAN_PARTS) + ")"  # noqa: E741


class Spans:
    sql = SPANS_SQL

    def frame(self, spark, d) -> DataFrame:
        part = lambda b, l, k, x, size, flags: F.expr(f"struct(cast({b} as int) as block, {l} as line, {k} as span, {x} as text, {size} as size, {flags} as flags)")  # noqa: E731, E741
        rows = t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.expr("cast(turn div 3 + 1 as int)").alias("page"), F.explode(F.array(*(part(*p) for p in SPAN_PARTS))).alias("s"))
        return rows.select("doc_id", "page", "s.*")


LEVEL_SQL = "CAST(CASE WHEN size / median >= 1.6 THEN 1 WHEN size / median >= 1.3 THEN 2 WHEN (flags & 16) <> 0 AND size / median >= 1.0 THEN 3 END AS INTEGER)"


@query_over(Spans(), f"""
WITH s AS (SELECT * FROM REL WHERE trim(text) <> ''), m AS (SELECT doc_id, median(CAST(size AS DOUBLE)) AS median FROM s GROUP BY doc_id)
SELECT s.doc_id, CAST(page AS BIGINT) AS page, CAST(block AS BIGINT) AS block, text, {LEVEL_SQL} AS level FROM s JOIN m USING (doc_id)""")
def pdf_heading_levels(spans):
    spans = spans.where(F.trim("text") != "")
    medians = spans.groupBy("doc_id").agg(F.median("size").alias("median"))
    level = parse.pdf_heading_level(F.col("size"), F.col("flags").bitwiseAND(16) != 0, F.col("median"))
    return spans.join(medians, "doc_id").select("doc_id", F.col("page").cast("long").alias("page"), F.col("block").cast("long").alias("block"), "text", level.alias("level"))


def _open_title_sql(k: int) -> str:
    """The title of the last heading of level k, unless one of a lower level came after it."""
    return f"CASE WHEN coalesce(broken{k}, -1) < open{k} THEN (SELECT text FROM n h WHERE h.doc_id = o.doc_id AND h.place = open{k}) END"


@query_over(Spans(), f"""
WITH s AS (SELECT * FROM REL WHERE trim(text, E' \\t\\n\\r') <> ''), m AS (SELECT doc_id, median(CAST(size AS DOUBLE)) AS median FROM s GROUP BY doc_id),
l AS (SELECT s.doc_id, page, block, line, trim(string_agg(text, ' ' ORDER BY span), E' \\t\\n\\r') AS text, min({LEVEL_SQL}) AS level FROM s JOIN m USING (doc_id) GROUP BY s.doc_id, page, block, line),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, block, line) AS place FROM (SELECT * FROM l UNION ALL SELECT DISTINCT doc_id, page, 1000000000, 0, '', NULL::INTEGER FROM l)),
o AS (SELECT *, count(level) OVER w AS part, {', '.join(f"max(CASE WHEN level = {k} THEN place END) OVER w AS open{k}, max(CASE WHEN level < {k} THEN place END) OVER w AS broken{k}" for k in (1, 2, 3))}
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
p AS (SELECT doc_id, part, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN concat_ws(' > ', {', '.join(map(_open_title_sql, (1, 2, 3)))}) END) AS heading_path,
  trim(string_agg(CASE WHEN level IS NULL THEN text END, chr(10) ORDER BY place), E' \\t\\n\\r') AS text, min(CASE WHEN level IS NOT NULL OR text <> '' THEN page END) AS page FROM o GROUP BY doc_id, part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section_no, coalesce(heading_path, '') AS heading_path, coalesce(level, 0) AS level, text, CAST(page AS VARCHAR) AS page FROM p WHERE text <> ''""")
def pdf_sections(spans):
    return parse.pdf_sections(spans).select("doc_id", "section_no", "heading_path", "level", "text", F.col("metadata")["page_number"].alias("page"))


# ── names ──────────────────────────────────────────────────────────────────────────────────────────────────────────

def word_bounds(pattern: str) -> str:
    """The pattern for DuckDB, whose ``\\b`` knows ASCII letters only: no letter, digit or underscore of any script stands beside a match."""
    beside = r"[^\p{L}\p{N}_]"
    return re.sub(r"\\b$", lambda _: f"(?:$|{beside})", re.sub(r"^(\(\?i\))?\\b", lambda m: f"{m[1] or ''}(?:^|{beside})", pattern))


FORM_RE, VISA_RE, TAX_RE = map(word_bounds, (DOMAIN.form, DOMAIN.visa, DOMAIN.tax))


def folded_sql(x: str) -> str:
    return f"translate({x}, {quoted(T.DASHES)}, {quoted('-' * len(T.DASHES))})"


def squeezed_sql(x: str) -> str:
    return rf"trim(regexp_replace({folded_sql(x)}, '\s+', ' ', 'g'))"


def type_sql(x: str) -> str:
    section = f"regexp_matches({x}, '(?i)section|§')"
    cases = [f"WHEN regexp_matches({folded_sql(x)}, {quoted(FORM_RE)}) AND NOT {section} THEN 'form'"]
    cases += [f"WHEN regexp_matches({x}, {quoted(p)}) AND NOT {section} THEN '{k}'" for p, k in ((VISA_RE, "applicant_category"), (TAX_RE, "evidence_or_document"))]
    cases += [f"WHEN {' OR '.join(f'contains(lower({x}), {quoted(w)})' for w in ws)} THEN '{k}'" for k, ws in DOMAIN.keywords.items()]
    return f"CASE {' '.join(cases)} ELSE '{DOMAIN.fallback_type}' END"


def canonical_sql(x: str, kind: str) -> str:
    s = squeezed_sql(x)
    part = lambda g: f"upper(regexp_extract({s}, {quoted(FORM_RE)}, {g}))"
    return f"CASE WHEN {kind} = 'form' AND regexp_matches({s}, {quoted(FORM_RE)}) THEN 'Form ' || {part(1)} || '-' || {part(2)} || {part(3)} ELSE {s} END"


def id_sql(x: str, kind: str) -> str:
    return f"substr(sha256({kind} || '::' || trim(lower({canonical_sql(x, kind)}))), 1, 16)"


@query_over(NAMES, f"SELECT id, {canonical_sql('name', quoted('form'))} AS as_form, {canonical_sql('name', quoted('agency'))} AS as_agency FROM REL")
def canonicalize_names(rows):
    return rows.select("id", T.canonical_name(F.col("name"), F.lit("form")).alias("as_form"), T.canonical_name(F.col("name"), F.lit("agency")).alias("as_agency"))


@query_over(NAMES, f"SELECT id, {type_sql('name')} AS type FROM REL")
def infer_types(rows):
    return rows.select("id", T.infer_type(F.col("name")).alias("type"))


@query_over(NAMES, f"SELECT id, entity_id FROM (SELECT v.id, {id_sql('name', 'type')} AS entity_id FROM (SELECT id, name, {type_sql('name')} AS type FROM REL) v)")
def entity_ids(rows):
    return rows.withColumn("type", T.infer_type(F.col("name"))).select("id", T.entity_id(F.col("name"), F.col("type")).alias("entity_id"))


@query_over(PATHS, rf"""
WITH s AS (SELECT id, path, regexp_replace(lower(regexp_extract(path, '([^\\/]*)$', 1)), '\.[^.]*$', '') AS stem FROM REL),
g AS (SELECT *, regexp_replace(stem, 'instr$', '') AS slug FROM s)
SELECT id, CASE WHEN length(path) > 0 AND regexp_matches(slug, '^([a-z]+)-?(\d+)([a-z]?)$') THEN
  'Form ' || upper(regexp_extract(slug, '^([a-z]+)-?(\d+)([a-z]?)$', 1)) || '-' || regexp_extract(slug, '^([a-z]+)-?(\d+)([a-z]?)$', 2) || upper(regexp_extract(slug, '^([a-z]+)-?(\d+)([a-z]?)$', 3))
  || CASE WHEN ends_with(stem, 'instr') THEN ' (instructions)' ELSE '' END END AS label FROM g""")
def form_labels(rows):
    return rows.select("id", T.form_label(F.col("path")).alias("label"))


@query_over(PATHS, rf"""
WITH s AS (SELECT id, regexp_replace(regexp_replace(lower(regexp_extract(path, '([^\\/]*)$', 1)), '\.[^.]*$', ''), 'instr$', '') AS name FROM REL)
SELECT id, CASE WHEN regexp_matches(name, '^([a-z]{{1,3}})-?(\d{{2,4}})([a-z]?)') THEN upper(regexp_extract(name, '^([a-z]{{1,3}})-?(\d{{2,4}})([a-z]?)', 1)) || '-'
  || regexp_extract(name, '^([a-z]{{1,3}})-?(\d{{2,4}})([a-z]?)', 2) || upper(regexp_extract(name, '^([a-z]{{1,3}})-?(\d{{2,4}})([a-z]?)', 3)) END AS form FROM s""")
def form_of_path(rows):
    return rows.select("id", T.form_of_path(F.col("path")).alias("form"))


@query_over(SAID, rf"SELECT id, list_sort(list_distinct(regexp_extract_all({folded_sql('said')}, '\b([A-Z]{{1,3}}-\d{{2,4}}[A-Z]?)\b', 1))) AS forms FROM REL")
def forms_in_text(rows):
    return rows.select("id", F.array_sort(T.forms_in_text(F.col("said"))).alias("forms"))


@query_over(SAID, rf"""
WITH s AS (SELECT id, CAST(coalesce(nullif(regexp_extract(said, '(?i)"?score"?\s*[:=]\s*(-?\d+(?:\.\d+)?)', 1), ''), nullif(regexp_extract(said, '(?:score\D*)?(-?\d+(?:\.\d+)?)', 1), ''), '0') AS DOUBLE) AS v FROM REL)
SELECT id, coalesce(greatest(0.0, least(1.0, CASE WHEN v > 1 AND v <= 10 THEN v / 10 WHEN v > 10 THEN v / 100 ELSE v END)), CAST(0 AS DOUBLE)) AS score FROM s""")
def parse_score(rows):
    return rows.select("id", T.parse_score(F.col("said")).alias("score"))


@query_over(SAID, f"SELECT id, coalesce(regexp_matches(said, {quoted(DOMAIN.refusal)}), false) AS refusal FROM REL")
def refusal_flag(rows):
    return rows.select("id", T.is_refusal(F.col("said")).alias("refusal"))


@query_over(PATHS, rf"""
SELECT id, CASE WHEN length(path) = 0 OR stem = '' THEN '' ELSE {quoted(T.FORMS_URL)} || stem || '.pdf' END AS url,
  CASE WHEN length(path) > 0 AND stem <> '' THEN {quoted(T.FORMS_URL)} || stem || '.pdf#page=3' END AS page_url
FROM (SELECT id, path, regexp_replace(regexp_extract(path, '([^\\/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM REL)""")
def citation_urls(rows):
    return rows.select("id", T.source_url(F.col("path")).alias("url"), T.page_url(F.col("path"), F.lit(3)).alias("page_url"))


@query_over(PATHS, rf"""
WITH b AS (SELECT id, replace(lower(regexp_extract(path, '([^\\/]*)$', 1)), 'instr', '') AS base FROM REL),
f AS (SELECT id, CASE WHEN regexp_matches(base, '{T.IN_URL}') THEN upper(regexp_extract(base, '{T.IN_URL}', 1)) || '-' || regexp_extract(base, '{T.IN_URL}', 2) || upper(regexp_extract(base, '{T.IN_URL}', 3)) END AS form FROM b)
SELECT id, {quoted(REFERENCE[0])} || coalesce(title, {quoted(OTHER_TITLE)}) || coalesce(' (Form ' || form || ')', '') || {quoted(REFERENCE[1])} AS reference FROM f LEFT JOIN {values(list(FORM_TITLES.items()), 'k', 'title')} ON k = form""")
def form_references(rows):
    return rows.select("id", T.reference(F.col("path")).alias("reference"))


JSON_SQL = rf"""
WITH r AS (SELECT id, CASE WHEN starts_with(trim(text, E' \n'), '```') THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(trim(x), '```')), chr(10)) ELSE text END AS text FROM REL),
j AS (SELECT id, coalesce(TRY_CAST(nullif(text, '') AS JSON), TRY_CAST(nullif(regexp_extract(text, '(?s)\{{.*\}}'), '') AS JSON)) AS doc FROM r)"""


@query_over(RESPONSES, JSON_SQL + rf""",
e AS (SELECT id, unnest(CAST(doc -> '$.entities' AS JSON[])) AS raw FROM j WHERE doc IS NOT NULL),
n AS (SELECT id, json_type(raw) AS kind, raw, trim(CASE WHEN json_type(raw) = 'VARCHAR' THEN raw ->> '$' ELSE coalesce(nullif(raw ->> '$.name', ''), raw ->> '$.value', '') END) AS name FROM e WHERE json_type(raw) IN ('VARCHAR', 'OBJECT')),
k AS (SELECT *, replace(trim(lower(coalesce(nullif(raw ->> '$.entity_type', ''), nullif(raw ->> '$.category', ''), raw ->> '$.type', ''))), ' ', '_') AS declared FROM n WHERE name <> '')
SELECT id, name, CASE WHEN kind = 'VARCHAR' OR declared NOT IN ({', '.join(map(quoted, DOMAIN.entity_types))}) OR (declared = 'form' AND NOT regexp_matches(name, {quoted(FORM_RE)})) THEN {type_sql('name')} ELSE declared END AS type,
  CASE WHEN kind = 'VARCHAR' THEN '' ELSE coalesce(raw ->> '$.description', '') END AS description FROM k""")
def json_entities(rows):
    return rows.select("id", F.explode(T.json_entities(F.col("text"))).alias("e")).select("id", F.col("e.name").alias("name"), F.col("e.entity_type").alias("type"), F.col("e.description").alias("description"))


@query_over(RESPONSES, JSON_SQL + rf""",
x AS (SELECT id, unnest(CAST(doc -> '$.relations' AS JSON[])) AS raw FROM j WHERE doc IS NOT NULL),
f AS (SELECT id, trim(coalesce(nullif(raw ->> '$.subject', ''), raw ->> '$.source', '')) AS subject, trim(lower(coalesce(nullif(raw ->> '$.predicate', ''), raw ->> '$.relation', ''))) AS predicate,
  trim(coalesce(nullif(raw ->> '$.object', ''), raw ->> '$.target', '')) AS object, coalesce(raw ->> '$.evidence', '') AS evidence FROM x WHERE json_type(raw) = 'OBJECT')
SELECT * FROM f WHERE predicate IN ({', '.join(map(quoted, DOMAIN.predicates))}) AND subject <> '' AND object <> '' AND subject <> object""")
def json_relations(rows):
    return rows.select("id", F.explode(T.json_relations(F.col("text"))).alias("r")).select("id", "r.*")


@query("SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS INTEGER)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def event_props(spark, d):
    parsed = t(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("event_type").agg(F.sum("p.k").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""
WITH k AS (SELECT doc_id, md5(source || '::' || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
SELECT doc_id, k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c ON k.key = c.key""")
def cache_probe(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("context"), F.col("text").alias("content"))
    cache = docs.where("doc_id % 3 = 0").select(T.cache_key(F.col("context"), F.col("content")).alias("key"), F.lit("{}").alias("answer")).dropDuplicates(["key"])
    hits, misses = extract.cache_split(docs, cache)
    return hits.select("doc_id", "key", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "key", F.lit(False).alias("hit")))


# ── graph over the star schema ─────────────────────────────────────────────────────────────────────────────────────
# customer -placed-> order -contains-> part, customer -located_in-> nation -part_of-> region, supplier -supplies-> part.

ENTITIES_SQL = """
  SELECT 'customer:' || c_custkey AS id, c_name AS name, 'customer' AS type FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region"""
EDGES_SQL = """
  SELECT 'customer:' || o_custkey AS src, 'placed' AS predicate, 'order:' || o_orderkey AS dst, CAST(1 AS DOUBLE) AS weight FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 1 FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, 1 FROM nation"""
SUPPLIES_SQL = """SELECT 'supplier:' || l_suppkey AS src, 'supplies' AS predicate, 'part:' || l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey"""
MENTIONS_SQL = "SELECT DISTINCT l_orderkey AS chunk_id, 'part:' || l_partkey AS entity_id FROM lineitem UNION SELECT l_orderkey, 'supplier:' || l_suppkey FROM lineitem UNION SELECT o_orderkey, 'customer:' || o_custkey FROM orders"


def _id(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def star_entities(spark, d) -> DataFrame:
    parts = [("customer", "c_custkey", F.col("c_name"), "customer"), ("order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "orders"), ("part", "p_partkey", F.col("p_name"), "part"),
             ("nation", "n_nationkey", F.col("n_name"), "nation"), ("region", "r_regionkey", F.col("r_name"), "region")]
    out = None
    for kind, key, name, source in parts:
        one = t(spark, d, source).select(_id(kind, key).alias("id"), name.alias("name"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("aliases", F.array().cast("array<string>"))


def _edges(df: DataFrame, a: tuple, predicate: str, b: tuple) -> DataFrame:
    return df.select(_id(*a).alias("src"), F.lit(predicate).alias("predicate"), _id(*b).alias("dst"))


def star_relates(spark, d) -> DataFrame:
    lines = _edges(t(spark, d, "lineitem"), ("order", "l_orderkey"), "contains", ("part", "l_partkey")).groupBy("src", "predicate", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    single = [_edges(t(spark, d, "orders"), ("customer", "o_custkey"), "placed", ("order", "o_orderkey")), _edges(t(spark, d, "customer"), ("customer", "c_custkey"), "located_in", ("nation", "c_nationkey")), _edges(t(spark, d, "nation"), ("nation", "n_nationkey"), "part_of", ("region", "n_regionkey"))]
    for one in single:
        lines = lines.unionByName(one.withColumn("weight", F.lit(1.0)))
    return lines.withColumn("evidence", F.lit(""))


def star_supplies(spark, d) -> DataFrame:
    rows = t(spark, d, "lineitem").select(_id("supplier", "l_suppkey").alias("src"), F.lit("supplies").alias("predicate"), _id("part", "l_partkey").alias("dst"),
        F.col("l_shipdate").cast("string").alias("evidence"), F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"))
    return graph.relation_weights(rows)


def star_mentions(spark, d) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", F.explode(F.array(_id("part", "l_partkey"), _id("supplier", "l_suppkey"))).alias("id"))
    rows = lines.select(F.col("l_orderkey").alias("chunk_id"), "id").unionByName(t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), _id("customer", "o_custkey").alias("id")))
    return graph.mentions(rows)


def star(spark, d) -> graph.Graph:
    return graph.Graph(star_entities(spark, d), star_mentions(spark, d), star_relates(spark, d))


@query("""
WITH r AS (SELECT 'customer:' || o_custkey AS id, o_orderpriority AS description, o_orderkey AS seq FROM orders)
SELECT id, arg_max(description, length(description) * 1000000000 - seq) AS description, arg_min(description, seq) AS first_seen, count(*) AS mention_count,
  array_to_string(list_sort(list_distinct(list(description))), ',') AS aliases FROM r GROUP BY id""")
def entity_registry(spark, d):
    orders = t(spark, d, "orders").select(_id("customer", "o_custkey").alias("id"), F.col("o_orderpriority").alias("canon"), F.lit("customer").alias("type"), F.col("o_orderpriority").alias("description"), F.array("o_orderpriority").alias("aliases"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("pos"))
    return graph.entity_registry(orders).select("id", "description", F.col("name").alias("first_seen"), "mention_count", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query("""
SELECT 'supplier:' || l_suppkey AS src, 'supplies' AS predicate, 'part:' || l_partkey AS dst, strftime(arg_min(l_shipdate, l_orderkey * 100 + l_linenumber), '%Y-%m-%d %H:%M:%S') AS evidence,
  arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS source_chunk, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey""")
def relation_weights(spark, d):
    return star_supplies(spark, d)


@query(f"SELECT chunk_id, entity_id FROM ({MENTIONS_SQL})")
def mentions(spark, d):
    return star_mentions(spark, d)


@query(f"SELECT (SELECT count(*) FROM ({ENTITIES_SQL})) AS entities, (SELECT count(DISTINCT chunk_id) FROM ({MENTIONS_SQL})) AS chunks, (SELECT count(*) FROM ({MENTIONS_SQL})) AS mentions, (SELECT count(*) FROM ({EDGES_SQL})) AS relations")
def graph_stats(spark, d):
    return graph.stats(star(spark, d))


@query(f"SELECT predicate, count(*) AS relations FROM ({EDGES_SQL}) GROUP BY predicate")
def relations_by_predicate(spark, d):
    return graph.relations_by_predicate(star_relates(spark, d))


@query(f"SELECT src AS source, dst AS target, predicate, CASE WHEN weight IS NULL OR weight = 0 THEN 1.0 ELSE weight END AS weight FROM ({EDGES_SQL})")
def full_graph(spark, d):
    return graph.full_graph(star_relates(spark, d))


@query(f"SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ({EDGES_SQL}) UNION ALL SELECT dst FROM ({EDGES_SQL})) GROUP BY node HAVING count(*) > 40")
def node_degree_hubs(spark, d):
    return graph.degrees(star_relates(spark, d)).where("degree > 40")


@query(f"WITH e AS ({EDGES_SQL}) SELECT src AS node, dst AS other, predicate, src, dst, weight FROM e WHERE src IN ('customer:1', 'nation:3') UNION ALL SELECT dst, src, predicate, src, dst, weight FROM e WHERE dst IN ('customer:1', 'nation:3')")
def incident_relations(spark, d):
    ids = spark.createDataFrame([("customer:1",), ("nation:3",)], "id string")
    return graph.incident(star_relates(spark, d), ids).select("node", "other", "predicate", "src", "dst", "weight")


SEEDS = ["customer:7", "nobody", "customer:1", "customer:2", "customer:7"]


def khop_sql(what: str, hops: int, max_nodes: int, fanout: int, hub: int) -> str:
    """The hops one after the other as common table expressions."""
    order = list(dict.fromkeys(SEEDS))
    ctes = [f"e AS ({EDGES_SQL})", f"ent AS ({ENTITIES_SQL})", f"n0 AS (SELECT s.id, row_number() OVER (ORDER BY s.pos) - 1 AS pos FROM {values([(s, i) for i, s in enumerate(order)], 'id', 'pos')} s JOIN ent USING (id))", "f0 AS (SELECT id AS node, pos FROM n0)"]
    edges = []
    for h in range(hops):
        ctes += [
            f"t{h} AS (SELECT f.pos, e.src, e.predicate, e.dst, e.weight, e.dst AS other FROM f{h} f JOIN e ON e.src = f.node UNION ALL SELECT f.pos, e.src, e.predicate, e.dst, e.weight, e.src FROM f{h} f JOIN e ON e.dst = f.node)",
            f"r{h} AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY weight DESC, src, predicate, dst) AS rn, count(*) OVER (PARTITION BY pos) AS deg FROM t{h})",
            f"c{h} AS (SELECT other, min(pos * 1000000 + rn) AS k FROM r{h} WHERE deg <= {hub} AND rn <= {fanout} AND other NOT IN (SELECT id FROM n{h}) GROUP BY other)",
            f"a{h} AS (SELECT other, k, row_number() OVER (ORDER BY k) AS nth FROM c{h} QUALIFY nth <= {max_nodes} - (SELECT count(*) FROM n{h}))",
            f"x{h} AS (SELECT r.src, r.predicate, r.dst, r.weight FROM r{h} r LEFT JOIN a{h} a ON a.other = r.other WHERE (r.other IN (SELECT id FROM n{h}) OR a.k <= r.pos * 1000000 + r.rn) AND (SELECT count(*) FROM n{h}) < {max_nodes})",
            f"n{h + 1} AS (SELECT id, pos FROM n{h} UNION ALL SELECT other, (SELECT count(*) FROM n{h}) + nth - 1 FROM a{h})",
            f"f{h + 1} AS (SELECT other AS node, nth - 1 AS pos FROM a{h})",
        ]
        edges.append(f"SELECT * FROM x{h}")
    last = f"SELECT id, name, type, CAST(pos AS BIGINT) AS pos FROM n{hops} JOIN ent USING (id)" if what == "nodes" else f"SELECT DISTINCT src AS source, dst AS target, predicate, weight FROM ({' UNION ALL '.join(edges)})"
    return f"WITH {', '.join(ctes)} {last}"


def _around_seeds(spark, d, **limits) -> tuple[DataFrame, DataFrame]:
    """The traversal reads the edges several times, so they are kept for as long as it takes."""
    g = star(spark, d)
    g.relates.persist()
    try:
        return graph.k_hop(g, SEEDS, **limits)
    finally:
        g.relates.unpersist()


def _khop(what: str, **limits) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        nodes, edges = _around_seeds(spark, d, **limits)
        return nodes.withColumn("pos", F.col("pos").cast("long")) if what == "nodes" else edges.select("source", "target", "predicate", "weight")

    return run


for _name, _what, _limits in (
    ("khop_1", "nodes", (1, 60, 10, 40)), ("khop_2_nodes", "nodes", (2, 60, 10, 40)), ("khop_2_edges", "edges", (2, 60, 10, 40)), ("khop_capped", "nodes", (2, 12, 3, 15)), ("khop_capped_edges", "edges", (3, 25, 4, 15)),
):
    QUERIES[_name] = _khop(_what, **dict(zip(("hops", "max_nodes", "fanout", "hub_degree"), _limits)))
    ORACLE[_name] = khop_sql(_what, *_limits)


#: Questions for all at once: every customer whose key is divisible by 100, with seeds of its own.
QUESTION_SEEDS_SQL = """
  SELECT c_custkey AS question, 'customer:' || c_custkey AS id, 0 AS pos FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey, 'customer:' || (c_custkey - 93), 1 FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey, 'nobody', 2 FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey, 'nation:' || (c_custkey // 100 % 25), 3 FROM customer WHERE c_custkey % 200 = 0"""


def question_seeds(spark, d) -> DataFrame:
    key = F.col("question")
    seeds = F.array(
        F.struct(F.concat(F.lit("customer:"), key.cast("string")).alias("id"), F.lit(0).alias("pos")), F.struct(F.concat(F.lit("customer:"), (key - 93).cast("string")).alias("id"), F.lit(1).alias("pos")),
        F.struct(F.lit("nobody").alias("id"), F.lit(2).alias("pos")), F.struct(F.when(key % 200 == 0, F.concat(F.lit("nation:"), F.expr("question div 100 % 25").cast("string"))).alias("id"), F.lit(3).alias("pos")),
    )
    questions = t(spark, d, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("question"))
    return questions.select("question", F.explode(seeds).alias("s")).select("question", "s.id", "s.pos")


def khop_many_sql(what: str, seeds: str, hops: int = 2, max_nodes: int = 60, fanout: int = 10, hub: int = 40) -> str:
    """The hops of all questions; a recursive expression would not allow the budgets."""
    ctes = [f"e AS MATERIALIZED ({EDGES_SQL})", f"ent AS ({ENTITIES_SQL})", "ends AS (SELECT src AS node, dst AS other, * FROM e UNION ALL SELECT dst, src, * FROM e)",
            f"n0 AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY pos, id) - 1 AS pos, 0 AS hop FROM (SELECT question, id, min(pos) AS pos FROM ({seeds}) GROUP BY question, id) JOIN ent USING (id))"]
    edges = []
    for h in range(hops):
        ctes += [
            f"k{h} AS (SELECT question, count(*) AS known FROM n{h} GROUP BY question HAVING count(*) < {max_nodes})",
            f"t{h} AS (SELECT f.question, f.pos AS place, known, x.* FROM n{h} f JOIN k{h} USING (question) JOIN ends x ON x.node = f.id WHERE f.hop = {h})",
            f"r{h} AS (SELECT *, row_number() OVER (PARTITION BY question, place ORDER BY weight DESC, src, predicate, dst) AS rn, count(*) OVER (PARTITION BY question, place) AS deg FROM t{h})",
            f"c{h} AS (SELECT question, other, min(place * 1000000 + rn) AS k, any_value(known) AS known FROM r{h} WHERE deg <= {hub} AND rn <= {fanout} AND (question, other) NOT IN (SELECT (question, id) FROM n{h}) GROUP BY question, other)",
            f"a{h} AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY k) AS nth FROM c{h} QUALIFY nth <= {max_nodes} - known)",
            f"p{h} AS (SELECT question, id AS other, -1 AS k FROM n{h} UNION ALL SELECT question, other, k FROM a{h})",
            f"x{h} AS (SELECT question, src, predicate, dst, weight FROM r{h} JOIN p{h} USING (question, other) WHERE k <= place * 1000000 + CASE WHEN deg <= {hub} THEN rn ELSE 0 END)",
            f"n{h + 1} AS (SELECT * FROM n{h} UNION ALL SELECT question, other, known + nth - 1, {h + 1} FROM a{h})",
        ]
        edges.append(f"SELECT * FROM x{h}")
    last = f"SELECT question, id, name, type, CAST(pos AS BIGINT) AS pos FROM n{hops} JOIN ent USING (id)" if what == "nodes" else f"SELECT DISTINCT question, src AS source, dst AS target, predicate, weight FROM ({' UNION ALL '.join(edges)})"
    return f"WITH {', '.join(ctes)} {last}"


def _around_questions(spark, d, **limits) -> tuple[DataFrame, DataFrame]:
    return graph.k_hop_many(star(spark, d), question_seeds(spark, d), **limits)


@query(khop_many_sql("nodes", QUESTION_SEEDS_SQL))
def khop_many_nodes(spark, d):
    return _around_questions(spark, d)[0].withColumn("pos", F.col("pos").cast("long"))


@query(khop_many_sql("edges", QUESTION_SEEDS_SQL, 3, 30, 4, 15))
def khop_many_edges(spark, d):
    return _around_questions(spark, d, hops=3, max_nodes=30, fanout=4, hub_degree=15)[1].drop("evidence")


@query(f"SELECT id, name, type FROM ({ENTITIES_SQL}) WHERE id IN (SELECT min(id) FROM ({ENTITIES_SQL}) WHERE lower(name) IN ('asia', 'order 5') GROUP BY lower(name))")
def entity_lookup(spark, d):
    e = star_entities(spark, d)
    return graph.entity_by_name(e, "ASIA").unionByName(graph.entity_by_name(e, "order 5")).select("id", "name", "type")


@query(f"SELECT id, name FROM ({ENTITIES_SQL}) WHERE contains(lower(name), '00012') ORDER BY id LIMIT 10")
def entity_search(spark, d):
    return graph.search_entities(star_entities(spark, d), "00012").select("id", "name")


@query(f"""
WITH n AS ({ENTITIES_SQL}), e AS ({EDGES_SQL})
SELECT a.name AS src_name, b.name AS dst_name, weight FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE predicate = 'contains' AND a.type = 'order' AND b.type = 'part' ORDER BY weight DESC, src, dst LIMIT 15""")
def top_typed_edges(spark, d):
    return graph.top_typed_edges(star_relates(spark, d), star_entities(spark, d), "contains", "order", "part")


@query(f"""
WITH n AS (SELECT id FROM ({ENTITIES_SQL}) WHERE type IN ('nation', 'region', 'customer')), e AS ({EDGES_SQL})
SELECT src, predicate, dst, weight FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY weight DESC, src, predicate, dst LIMIT 80""")
def display_links(spark, d):
    nodes = star_entities(spark, d).where(F.col("type").isin("nation", "region", "customer"))
    return graph.display_links(star_relates(spark, d), nodes).select("src", "predicate", "dst", "weight")


#: What an extractor answers for every document: names as documents write them, shared by some; ends of relations that are known, made, empty and equal.
FORM_OF = f"'Form I-' || {digits(97)}"
EXTRACTED_ENTITIES = [(FORM_OF, "'form'", "source"), (f"'H-' || {digits(9)} || 'B'", "'form'", "''"), (f"'i ' || {digits(89)}", "'form'", "lang"), (f"upper(lang) || ' fee ' || {digits(11)}", "'agency'", "source")]
EXTRACTED_RELATIONS = [(FORM_OF, "'requires'", f"'form i-' || {digits(101)}", "lang"), (f"'I-' || {digits(97)}", "'references'", f"lang || ' fee ' || {digits(11)}", "source"), (f"'I ' || {digits(97)}", "'references'", FORM_OF, "''"), (f"'  '", "'requires'", FORM_OF, "''"), ("source || ' office'", "'filed_with'", FORM_OF, "''")]


def _extracted_sql(parts: list[tuple], *names: str) -> str:
    rows = " UNION ALL ".join(f"SELECT 'c' || doc_id AS chunk_id, doc_id AS seq, {p} AS pos, " + ", ".join(f"{x} AS {n}" for n, x in zip(names, part)) + " FROM documents" for p, part in enumerate(parts))
    return f"({rows})"


ENTITIES_OF_SQL, RELATIONS_OF_SQL = _extracted_sql(EXTRACTED_ENTITIES, "name", "declared", "description"), _extracted_sql(EXTRACTED_RELATIONS, "subject", "predicate", "object", "evidence")


def _extraction(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    entity = lambda n, k, x: F.expr(f"named_struct('name', {n}, 'entity_type', {k}, 'description', {x}, 'aliases', cast(array() as array<string>))")
    relation = lambda a, p, b, e: F.expr(f"named_struct('subject', {a}, 'predicate', {p}, 'object', {b}, 'evidence', {e})")
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("seq"), F.array(*(entity(*e) for e in EXTRACTED_ENTITIES)).alias("entities"), F.array(*(relation(*r) for r in EXTRACTED_RELATIONS)).alias("relations"))


CORRECTED_SQL = f"""
SELECT *, {canonical_sql('name', 'type')} AS canon, {id_sql('name', 'type')} AS id FROM (
  SELECT chunk_id, seq, pos, name, CASE WHEN declared = 'form' AND NOT regexp_matches({folded_sql('name')}, {quoted(FORM_RE)}) THEN {type_sql('name')} ELSE declared END AS type
  FROM {ENTITIES_OF_SQL})"""


@query(f"""
WITH r AS ({CORRECTED_SQL}), k AS (SELECT lower(canon) AS key, id, seq * 1000 + pos * 10 AS place FROM r UNION ALL SELECT lower(trim(name)), id, seq * 1000 + pos * 10 + 1 FROM r)
SELECT key, arg_max(id, place) AS id FROM k GROUP BY key""")
def name_index(spark, d):
    return graph.name_index(graph.typed_entities(_extraction(spark, d)))


@query(f"""
WITH r AS ({CORRECTED_SQL}), k AS (SELECT lower(canon) AS key, id, seq * 1000 + pos * 10 AS place FROM r UNION ALL SELECT lower(trim(name)), id, seq * 1000 + pos * 10 + 1 FROM r),
ix AS (SELECT key, arg_max(id, place) AS id FROM k GROUP BY key), rel AS (SELECT * FROM {RELATIONS_OF_SQL}),
ends AS (SELECT DISTINCT trim(subject) AS name FROM rel WHERE trim(subject) <> '' UNION SELECT object FROM rel), typed AS (SELECT name, {type_sql('name')} AS type FROM ends),
canon AS (SELECT name, type, {canonical_sql('name', 'type')} AS canon, {id_sql('name', 'type')} AS made FROM typed),
res AS (SELECT c.name, coalesce(a.id, b.id, c.made) AS id, c.canon FROM canon c LEFT JOIN ix a ON a.key = lower(c.name) LEFT JOIN ix b ON b.key = lower(c.canon)),
nm AS (SELECT id, arg_min(canon, seq * 1000 + pos) AS name FROM r GROUP BY id UNION SELECT id, canon FROM res WHERE id NOT IN (SELECT id FROM r))
SELECT s.name AS s, predicate, o.name AS o, CAST(count(*) AS DOUBLE) AS weight
FROM rel JOIN res x ON x.name = trim(subject) JOIN res y ON y.name = object JOIN nm s ON s.id = x.id JOIN nm o ON o.id = y.id WHERE x.id <> y.id GROUP BY ALL""")
def resolve_endpoints(spark, d):
    g = graph.build(_extraction(spark, d))
    names = g.entities.select("id", "name")
    return g.relates.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("o")), "dst").select("s", "predicate", "o", "weight")


# Two batches: the second replaces the documents of an older version (doc_id % 3 = 1) and brings new ones; what it brings comes later in the order.


def _in_batches(spark, d) -> graph.Graph:
    """The graph of all documents, ingested in two batches."""
    import uuid

    from sparkweave.tables import written

    tables: dict = {}
    every = _extraction(spark, d).withColumn("doc_id", F.col("seq"))
    older = every.withColumns({"entities": F.slice("entities", 2, 2), "relations": F.slice("relations", 1, 2)})
    parts = [every.where("doc_id % 3 = 0").unionByName(older.where("doc_id % 3 = 1")), every.where("doc_id % 3 > 0")]
    for batch, rows in enumerate(parts, 1):
        rows = rows.withColumn("seq", F.col("seq") + batch * 10**12)

        def write(df, name, batch=batch):
            tables[name, batch] = written(df, f"{name}-{uuid.uuid4().hex[:6]}")

        log = increment.GraphLog(lambda name, b: tables[name, b], write, list(range(1, batch)))
        log.add(rows, rows.select("doc_id").distinct(), rows.select("doc_id", F.col("chunk_id").alias("id"), F.lit("").alias("heading_path"), F.lit("").alias("filepath")))
    return increment.GraphLog(lambda name, b: tables[name, b], None, [1, 2]).graph()


BATCHED_SQL = f"""
WITH r AS (SELECT *, (seq + 1000000000 * CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END) * 1000 + pos * 10 AS place FROM ({CORRECTED_SQL})), k AS (SELECT lower(canon) AS key, id, place FROM r UNION ALL SELECT lower(trim(name)), id, place + 1 FROM r),
ix AS (SELECT key, arg_max(id, place) AS id FROM k GROUP BY key), rel AS (SELECT *, (seq + 1000000000 * CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END) * 1000 + pos * 10 AS place FROM {RELATIONS_OF_SQL}),
ends AS (SELECT DISTINCT trim(subject) AS name FROM rel WHERE trim(subject) <> '' UNION SELECT object FROM rel), typed AS (SELECT name, {type_sql('name')} AS type FROM ends),
canon AS (SELECT name, type, {canonical_sql('name', 'type')} AS canon, {id_sql('name', 'type')} AS made FROM typed),
res AS (SELECT c.name, coalesce(a.id, b.id, c.made) AS id FROM canon c LEFT JOIN ix a ON a.key = lower(c.name) LEFT JOIN ix b ON b.key = lower(c.canon))"""


@query(BATCHED_SQL + """
SELECT x.id AS src, predicate, y.id AS dst, arg_min(evidence, place) AS evidence, arg_min(chunk_id, place) AS source_chunk, CAST(count(*) AS DOUBLE) AS weight
FROM rel JOIN res x ON x.name = trim(subject) JOIN res y ON y.name = object WHERE x.id <> y.id GROUP BY x.id, predicate, y.id""")
def graph_by_batches(spark, d):
    """Edges after two batches: weights add up over batches, replaced documents count no more, ends follow the names that are known in the end."""
    return _in_batches(spark, d).relates


@query(BATCHED_SQL + """
SELECT id, arg_min(canon, place) AS name, arg_min(type, place) AS type, arg_max(description, length(description) * 10000000000000 - place) AS description, count(*) AS mention_count
FROM (SELECT r.*, e.description FROM r JOIN """ + ENTITIES_OF_SQL + """ e USING (seq, pos)) GROUP BY id""")
def entities_by_batches(spark, d):
    """Extracted entities after two batches: first names, longest texts, mentions."""
    return _in_batches(spark, d).entities.where("mention_count > 0").select("id", "name", "type", "description", "mention_count")


@query(f"""
SELECT count(*) AS entities, (SELECT count(*) FROM {RELATIONS_OF_SQL}) AS relations, count(DISTINCT lower(trim(name))) AS names
FROM {ENTITIES_OF_SQL}""")
def extraction_totals(spark, d):
    return extract.extraction_totals(_extraction(spark, d))


# ── retrieval and evaluation ───────────────────────────────────────────────────────────────────────────────────────

def _query_vector(spark, d, vec_id: int = 0) -> list[float]:
    row = t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"])


DISTANCE_SQL = "list_distance(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"
KNN_SQL = f"SELECT vec_id, {DISTANCE_SQL} AS distance FROM embeddings e ORDER BY distance, vec_id LIMIT 10"


@query(f"SELECT vec_id, round(distance, 6) AS distance, '[' || row_number() OVER (ORDER BY distance, vec_id) || ']' AS citation_id FROM ({KNN_SQL})")
def knn_topk(spark, d):
    near = vector.knn(t(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id")
    rank = F.row_number().over(Window.orderBy("distance", "vec_id"))
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.concat(F.lit("["), rank.cast("string"), F.lit("]")).alias("citation_id"))


@query(f"SELECT k.vec_id, label, round(distance, 6) AS distance FROM ({KNN_SQL}) k JOIN embeddings USING (vec_id)")
def knn_join_labels(spark, d):
    e = t(spark, d, "embeddings")
    return vector.knn_join(e, _query_vector(spark, d), e.select("vec_id", "label"), 10, "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""
WITH k AS (SELECT vec_id FROM ({KNN_SQL}) ORDER BY distance, vec_id LIMIT 5), c AS (SELECT lower(text) AS low FROM documents WHERE doc_id IN (SELECT vec_id FROM k)),
n AS (SELECT DISTINCT word AS name FROM (SELECT unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ')) AS word FROM documents) WHERE length(word) >= 5)
SELECT DISTINCT name FROM n JOIN c ON contains(low, name)""")
def content_mentions_name(spark, d):
    """The words of all documents that the documents of the five nearest vectors contain."""
    docs = t(spark, d, "documents")
    near = vector.knn(t(spark, d, "embeddings"), _query_vector(spark, d), retrieve.SCANNED, "vec_id").select(F.col("vec_id").alias("doc_id"))
    contents = docs.join(F.broadcast(near), "doc_id", "left_semi").select(F.col("text").alias("content"))
    found = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " "))).alias("name")).distinct()
    return retrieve.names_in_contents(contents, found.withColumn("type", F.lit("form")))


@query("""
WITH n AS (SELECT DISTINCT word AS name FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' ')) AS word FROM conversations) WHERE length(word) >= 9),
d AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT doc_id AS chunk_id, name FROM d JOIN n ON contains(low, lower(name))""")
def names_in_documents(spark, d):
    """The long words of all conversations that stand in a document, alone or within words, for all documents."""
    words = t(spark, d, "conversations").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " ")).alias("name")).where("length(name) >= 9")
    return retrieve.names_in_all(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), words)


GRAPH_CHUNKS_SQL = f"""
WITH m AS ({MENTIONS_SQL}), k AS ({KNN_SQL}), n AS (SELECT id FROM ({khop_sql('nodes', 2, 60, 10, 40)}))
SELECT chunk_id, count(DISTINCT CASE WHEN entity_id IN ('customer:7', 'customer:1', 'customer:2') THEN entity_id END) AS graph_score
FROM m WHERE entity_id IN (SELECT id FROM n) AND chunk_id NOT IN (SELECT vec_id FROM k) GROUP BY chunk_id ORDER BY graph_score DESC, chunk_id LIMIT 10"""


def _channels(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The nearest vectors as chunks (vec_id is the chunk id by convention), and the graph channel around the seeds."""
    near = vector.knn(t(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id").withColumnRenamed("vec_id", "chunk_id")
    g = star(spark, d)
    nodes, edges = _around_seeds(spark, d)
    seeds = nodes.where(F.col("id").isin(*SEEDS))
    return near, retrieve.graph_chunks(g.mentions, nodes, seeds, near), nodes, edges


@query(GRAPH_CHUNKS_SQL)
def graph_chunks_scored(spark, d):
    return _channels(spark, d)[1]


@query(f"""
WITH v AS (SELECT vec_id AS chunk_id, 'vector' AS retrieval_source, 0 AS channel, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({KNN_SQL})),
g AS (SELECT chunk_id, 'graph' AS retrieval_source, 1 AS channel, row_number() OVER (ORDER BY graph_score DESC, chunk_id) AS rank FROM ({GRAPH_CHUNKS_SQL})),
u AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY channel, rank) AS nth FROM (SELECT * FROM v UNION ALL SELECT * FROM g))
SELECT chunk_id, retrieval_source, '[' || row_number() OVER (ORDER BY channel, rank, chunk_id) || ']' AS citation_id FROM u WHERE nth = 1""")
def hybrid_merge(spark, d):
    near, found, _, _ = _channels(spark, d)
    v = near.select("chunk_id", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("rank"))
    g = found.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("graph_score"), "chunk_id")).alias("rank"))
    return retrieve.merged(v, g).select("chunk_id", "retrieval_source", "citation_id")


@query("""
SELECT doc_id AS chunk_id, '[' || doc_id || ']' AS citation_id, '/data/' || source || '.pdf' AS filepath, lang AS heading_path, 'unknown' AS retrieval_source,
  left(text, 200) || '...' AS preview, 'https://www.uscis.gov/sites/default/files/document/forms/' || source || '.pdf' AS source_url FROM documents""")
def citations(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")).alias("citation_id"), F.concat(F.lit("/data/"), "source", F.lit(".pdf")).alias("filepath"), F.col("lang").alias("heading_path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("retrieval_source"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    return retrieve.citations(rows).drop("page", "source_url_with_page")


@query(f"""
WITH n AS ({khop_sql('nodes', 2, 60, 10, 40)}), x AS ({khop_sql('edges', 2, 60, 10, 40)}),
o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, source, predicate, target) AS n FROM x)
SELECT o.n AS n, '  - ' || coalesce(a.name, source) || ' — ' || replace(predicate, '_', ' ') || ' → ' || coalesce(b.name, target) AS line FROM o LEFT JOIN n a ON a.id = source LEFT JOIN n b ON b.id = target WHERE o.n <= 20""")
def graph_context(spark, d):
    nodes, edges = _around_seeds(spark, d)
    return retrieve.edge_lines(edges, nodes).withColumn("n", F.col("n").cast("long"))


@query(f"WITH n AS ({khop_sql('nodes', 2, 60, 10, 40)}) SELECT type, string_agg(name, '|' ORDER BY pos) AS names FROM n GROUP BY type")
def graph_context_nodes(spark, d):
    nodes, _ = _around_seeds(spark, d)
    return retrieve.node_groups(nodes).select("type", F.array_join("names", "|").alias("names"))


EVAL_SQL = """
WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS question_id, q.label AS gold, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, CAST(e.embedding AS DOUBLE[])), 9), e.vec_id) AS rn FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
h AS (SELECT question_id, CASE WHEN rn <= 8 THEN 'naive' ELSE 'hybrid' END AS mode, gold, label FROM s WHERE rn <= 24)"""


def _eval_rows(spark, d) -> DataFrame:
    """question_id, mode, gold, label: the next neighbours of every vector whose id is divisible by 100; the first eight stand for one mode, later ones for the other."""
    e = t(spark, d, "embeddings")
    near = vector.knn_many(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), 24)
    labels = e.select("vec_id", "label")
    ranked = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("gold")), "query")
    return ranked.select(F.col("query").alias("question_id"), F.when(F.col("rank") <= 8, "naive").otherwise("hybrid").alias("mode"), "gold", "label")


@query(EVAL_SQL + " SELECT question_id, mode, CASE WHEN bool_or(label = gold) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recall FROM h GROUP BY question_id, mode")
def eval_recall(spark, d):
    rows = _eval_rows(spark, d).groupBy("question_id", "mode").agg(F.array(F.first("gold")).alias("gold"), F.collect_set("label").alias("found"))
    return rows.select("question_id", "mode", evaluate.recall(F.col("gold"), F.col("found")).alias("recall"))


@query(EVAL_SQL + " SELECT question_id, mode, avg(CASE WHEN label = gold THEN 1.0 ELSE 0.0 END) AS precision FROM h GROUP BY question_id, mode")
def eval_precision(spark, d):
    return _eval_rows(spark, d).groupBy("question_id", "mode").agg(F.avg((F.col("label") == F.col("gold")).cast("double")).alias("precision"))


@query(EVAL_SQL + """, p AS (SELECT question_id, mode, avg(CASE WHEN label = gold THEN 1.0 ELSE 0.0 END) AS v, CASE WHEN question_id % 2 = 0 THEN 'multi' ELSE 'single' END AS hops FROM h GROUP BY question_id, mode)
SELECT mode, 'citation_precision' AS metric, round(avg(v), 9) AS value, round(avg(CASE WHEN hops = 'multi' THEN v END), 9) AS multi FROM p GROUP BY mode""")
def eval_aggregate(spark, d):
    p = _eval_rows(spark, d).groupBy("question_id", "mode").agg(F.avg((F.col("label") == F.col("gold")).cast("double")).alias("citation_precision"))
    p = p.withColumn("hops", F.when(F.col("question_id") % 2 == 0, "multi").otherwise("single"))
    return evaluate.aggregated(p).select("mode", "metric", F.round("value", 9).alias("value"), F.round("multi", 9).alias("multi"))


@query_over(SAID, f"SELECT avg(CASE WHEN coalesce(regexp_matches(said, {quoted(DOMAIN.refusal)}), false) THEN 1.0 ELSE 0.0 END) AS rate FROM REL")
def refusal_rate(rows):
    return evaluate.refusal_rate(rows.withColumnRenamed("said", "answer"))


@query("SELECT doc_id AS chunk_id, text AS content FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def chunks_by_ids(spark, d):
    chunks = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return chunk.chunks_by_ids(chunks, t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))


@query("SELECT doc_id AS chunk_id, lang FROM documents WHERE doc_id = 7")
def chunk_by_id(spark, d):
    return chunk.chunk_by_id(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), 7)


@query(f"SELECT id, name, type FROM ({ENTITIES_SQL}) WHERE id = 'nation:3'")
def entity_by_id(spark, d):
    return graph.entity_by_id(star_entities(spark, d), "nation:3").select("id", "name", "type")


@query("SELECT source AS filepath, count(*) AS chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY source")
def chunk_stats_by_file(spark, d):
    return chunk.stats_by_file(t(spark, d, "documents").select(F.col("source").alias("filepath"), F.col("text").alias("content")))


@query("SELECT count(*) AS n FROM documents")
def chunk_count(spark, d):
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))


ASKED = [("ASIA", "agency", 0), ("customer#000000001", "form", 1), ("order 7", "form", 2), ("no such name", "form", 3), ("ord", "statute", 4), ("germany", "agency", 5)]
IN_CHUNKS = [("FRANCE",), ("Order 11",), ("nothing",)]


@query(f"""
WITH ent AS ({ENTITIES_SQL}), q AS (SELECT seq, type, lower(name) AS q FROM {values([(n, k, i) for n, k, i in ASKED], 'name', 'type', 'seq')}),
exact AS (SELECT seq, min(id) AS id, 0 AS n FROM ent JOIN q ON lower(ent.name) = q GROUP BY seq),
inside AS (SELECT seq, id, row_number() OVER (PARTITION BY seq ORDER BY id) AS n FROM ent JOIN q ON contains(lower(ent.name), q) WHERE q.type IN ('form', 'statute') AND length(q) >= 4 AND seq NOT IN (SELECT seq FROM exact)),
named AS (SELECT c, min(id) AS id FROM ent JOIN {values(IN_CHUNKS, 'c')} x ON lower(ent.name) = lower(c) GROUP BY c),
u AS (SELECT id, seq, n FROM exact UNION ALL SELECT id, seq, n FROM inside WHERE n <= 2 UNION ALL SELECT id, 1000000, row_number() OVER (ORDER BY c) FROM named),
f AS (SELECT id, min(seq * 1000 + n) AS k FROM u GROUP BY id)
SELECT id, CAST(row_number() OVER (ORDER BY k, id) - 1 AS BIGINT) AS pos FROM f""")
def matched_entities(spark, d):
    asked = spark.createDataFrame(ASKED, "name string, type string, seq int")
    found = retrieve.matched_entities(star_entities(spark, d), asked, spark.createDataFrame(IN_CHUNKS, "name string"))
    return found.select("id", F.col("pos").cast("long").alias("pos"))


class _Stored:
    """An embedder that knows one vector."""

    def __init__(self, v: list[float]) -> None:
        self.v = v

    def embed_one(self, text: str) -> list[float]:
        return self.v


@query(f"""
WITH v AS (SELECT vec_id AS chunk_id, 'vector' AS retrieval_source, 0 AS channel, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({KNN_SQL})),
g AS (SELECT chunk_id, 'graph' AS retrieval_source, 1 AS channel, row_number() OVER (ORDER BY graph_score DESC, chunk_id) AS rank FROM ({GRAPH_CHUNKS_SQL})),
u AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY channel, rank) AS nth FROM (SELECT * FROM v UNION ALL SELECT * FROM g)),
m AS (SELECT chunk_id, retrieval_source, '[' || row_number() OVER (ORDER BY channel, rank, chunk_id) || ']' AS citation_id FROM u WHERE nth = 1)
SELECT m.*, o_orderpriority AS content FROM m JOIN orders ON o_orderkey = chunk_id""")
def retrieve_hybrid(spark, d):
    """The retriever as a user calls it: embedding, matching, traversal, both channels and their fusion, with orders as chunks."""
    g = star(spark, d)
    chunks = t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.lit("/data/orders").alias("filepath"), F.lit("").alias("heading_path"), F.col("o_orderpriority").alias("content"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    names = dict(g.entities.where(F.col("id").isin(*SEEDS)).select("id", "name").collect())
    asked = [(names[s], "agency") for s in dict.fromkeys(SEEDS) if s in names]
    found = retrieve.Retriever(chunks, vectors, g, _Stored(_query_vector(spark, d)), lambda q: asked).retrieve("which orders?")
    return found.merged.select("chunk_id", "retrieval_source", "citation_id", "content")


METRIC_ROWS_SQL = """
WITH c AS (SELECT doc_id % 97 AS question_id, CASE WHEN doc_id % 2 = 0 THEN 'naive' ELSE 'hybrid' END AS mode, 'see I-' || (480 + doc_id % 7) || ' and N-' || (400 + doc_id % 5) AS content,
  'I-' || (480 + doc_id % 4) AS doc, CASE WHEN doc_id % 3 = 0 THEN 'graph' ELSE 'vector' END AS source FROM documents),
q AS (SELECT DISTINCT question_id, ['I-' || (480 + question_id % 9), 'N-401'] AS gold, CASE WHEN question_id % 2 = 0 THEN 'multi' ELSE 'single' END AS hops FROM c),
f AS (SELECT question_id, mode, unnest(regexp_extract_all(content, '[IN]-[0-9]+')) AS form FROM c)"""


@query(METRIC_ROWS_SQL + """,
r AS (SELECT f.question_id, mode, count(DISTINCT CASE WHEN list_contains(gold, form) THEN form END) / 2.0 AS retrieval_recall FROM f JOIN q USING (question_id) GROUP BY f.question_id, mode),
p AS (SELECT c.question_id, mode, any_value(hops) AS hops, count(DISTINCT CASE WHEN list_contains(gold, doc) THEN doc END) / 2.0 AS doc_recall, avg(CASE WHEN list_contains(gold, doc) THEN 1.0 ELSE 0.0 END) AS citation_precision,
  avg(CASE WHEN source = 'graph' THEN 1.0 ELSE 0.0 END) AS graph_share FROM c JOIN q USING (question_id) GROUP BY c.question_id, mode)
SELECT p.question_id, p.mode, hops, round(retrieval_recall, 9) AS retrieval_recall, round(doc_recall, 9) AS doc_recall, round(citation_precision, 9) AS citation_precision, round(graph_share, 9) AS graph_share FROM p JOIN r USING (question_id, mode)""")
def question_metrics(spark, d):
    """Retrieval metrics of rows made from all documents."""
    n = F.col("doc_id")
    number = lambda first, k: (F.lit(first) + n % k).cast("string")
    chunks = t(spark, d, "documents").select(
        (n % 97).alias("question_id"), F.when(n % 2 == 0, "naive").otherwise("hybrid").alias("mode"), F.concat(F.lit("see I-"), number(480, 7), F.lit(" and N-"), number(400, 5)).alias("content"),
        F.concat(F.lit("/x/i-"), number(480, 4), F.lit("instr.pdf")).alias("filepath"), F.when(n % 3 == 0, "graph").otherwise("vector").alias("retrieval_source"),
    )
    q = F.col("question_id")
    questions = chunks.select("question_id").distinct().select("question_id", F.array(F.concat(F.lit("I-"), (F.lit(480) + q % 9).cast("string")), F.lit("N-401")).alias("gold"), F.when(q % 2 == 0, "multi").otherwise("single").alias("hops"))
    out = evaluate.question_metrics(chunks, questions)
    return out.select("question_id", "mode", "hops", *(F.round(c, 9).alias(c) for c in ("retrieval_recall", "doc_recall", "citation_precision", "graph_share")))


# Questions are all vectors with an id divisible by 100; their gold are the nations of the customers that they name, as form numbers, and chunks are orders.
RETRIEVED_SQL = f"""
WITH seeds AS (SELECT vec_id AS question, 'customer:' || (vec_id % 997 + 1) AS id, 0 AS pos FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT vec_id, 'customer:' || (vec_id % 991 + 2), 1 FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT q.vec_id AS question, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9), e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 8),
nodes AS ({khop_many_sql("nodes", "SELECT * FROM seeds")}),
score AS (SELECT n.question, m.chunk_id, count(DISTINCT s.id) AS graph_score FROM nodes n JOIN ({MENTIONS_SQL}) m ON m.entity_id = n.id LEFT JOIN seeds s ON s.question = n.question AND s.id = n.id GROUP BY n.question, m.chunk_id),
g AS (SELECT question, chunk_id, row_number() OVER (PARTITION BY question ORDER BY graph_score DESC, chunk_id) AS rank FROM score WHERE (question, chunk_id) NOT IN (SELECT (question, chunk_id) FROM near) QUALIFY rank <= 8),
found AS (SELECT question, 'naive' AS mode, chunk_id, 'vector' AS retrieval_source, rank AS pos FROM near UNION ALL SELECT question, 'hybrid', chunk_id, 'vector', rank FROM near
  UNION ALL SELECT question, 'hybrid', chunk_id, 'graph', rank + (SELECT count(*) FROM near n WHERE n.question = g.question) FROM g)"""
ORDER_FORM_SQL = "'I-' || (480 + o_custkey % 9)"
EVALUATED_SQL = RETRIEVED_SQL + f""",
rows AS (SELECT question, mode, retrieval_source, {ORDER_FORM_SQL} AS doc, 'N-' || (400 + o_orderkey % 7) AS form, ['I-' || (480 + (question // 100) % 9), 'N-' || (400 + question % 7)] AS gold FROM found JOIN orders ON o_orderkey = chunk_id),
metrics AS (SELECT question, mode, CASE WHEN question % 200 = 0 THEN 'multi' ELSE 'single' END AS hops, count(DISTINCT CASE WHEN list_contains(gold, form) THEN form END) / 2.0 AS retrieval_recall,
  count(DISTINCT CASE WHEN list_contains(gold, doc) THEN doc END) / 2.0 AS doc_recall, avg(CASE WHEN list_contains(gold, doc) THEN 1.0 ELSE 0.0 END) AS citation_precision, avg(CASE WHEN retrieval_source = 'graph' THEN 1.0 ELSE 0.0 END) AS graph_share
  FROM rows GROUP BY question, mode),
long AS (UNPIVOT metrics ON retrieval_recall, doc_recall, citation_precision, graph_share INTO NAME metric VALUE v)"""


def _retrieved(spark, d) -> DataFrame:
    e = t(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "embedding")
    name = lambda k, n, pos: F.struct(F.concat(F.lit("customer:"), (F.col("question") % k + n).cast("string")).alias("id"), F.lit(pos).alias("pos"))
    seeds = asked.select("question", F.explode(F.array(name(997, 1, 0), name(991, 2, 1))).alias("s")).select("question", "s.*")
    return retrieve.retrieve_many(star(spark, d), e.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, seeds)


@query(RETRIEVED_SQL + " SELECT question, mode, chunk_id, retrieval_source, pos FROM found")
def retrieve_many(spark, d):
    """Both modes for all questions: nearest chunks, traversal, graph channel and fusion in one plan."""
    return _retrieved(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query(EVALUATED_SQL + " SELECT mode, metric, round(avg(v), 9) AS value, round(avg(CASE WHEN hops = 'multi' THEN v END), 9) AS multi FROM long GROUP BY mode, metric")
def evaluate_both_modes(spark, d):
    """The evaluation end to end: retrieval of both modes, metrics of each question, means over all and over those of several hops."""
    number = lambda first, n: (F.lit(first) + n).cast("string")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("see N-"), number(400, F.col("o_orderkey") % 7)).alias("content"), F.concat(F.lit("/x/i-"), number(480, F.col("o_custkey") % 9), F.lit("instr.pdf")).alias("filepath"))
    q = F.col("question_id")
    gold = F.array(F.concat(F.lit("i-"), number(480, F.expr("question_id div 100 % 9"))), F.concat(F.lit("N-"), number(400, q % 7)))
    questions = t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id")).select("question_id", gold.alias("gold"), F.when(q % 200 == 0, "multi").otherwise("single").alias("hops"))
    means = evaluate.aggregated(evaluate.evaluated(_retrieved(spark, d), orders, questions))
    return means.select("mode", "metric", F.round("value", 9).alias("value"), F.round("multi", 9).alias("multi"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: nearest vectors and graph neighbourhood, fused and cited."""
    return hybrid_merge(spark, sf_dir)
