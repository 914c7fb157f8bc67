"""Scalar functions as columns: names, types, ids, forms in texts, scores, refusals, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweave.schema import DOMAIN, FORM_TITLES, OTHER_TITLE, REFERENCE, DomainSchema

DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"
# The patterns by which forms are found in texts, paths and addresses.
IN_TEXT = r"\b([A-Z]{1,3}-\d{2,4}[A-Z]?)\b"
IN_FILE = r"^([a-z]{1,3})-?(\d{2,4})([a-z]?)"
FILE_SLUG = r"^([a-z]+)-?(\d+)([a-z]?)$"
IN_URL = r"([a-z]+)-?(\d+)([a-z]?)"
FORMS_URL = "https://www.uscis.gov/sites/default/files/document/forms/"


def fold_dashes(text: Column) -> Column:
    """Typographic dashes as ``-``."""
    return F.translate(text, DASHES, "-" * len(DASHES))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"^(?U:\s+)|(?U:\s+)$", "")


def squeeze(text: Column) -> Column:
    """Stripped, with runs of Unicode white space as one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def is_form(name: Column, domain: DomainSchema = DOMAIN) -> Column:
    return F.rlike(fold_dashes(name), F.lit(domain.form))


def is_visa_class(name: Column, domain: DomainSchema = DOMAIN) -> Column:
    return F.rlike(name, F.lit(domain.visa))


def is_tax_form(name: Column, domain: DomainSchema = DOMAIN) -> Column:
    return F.rlike(name, F.lit(domain.tax))


def canonical_name(name: Column, entity_type: Column, domain: DomainSchema = DOMAIN) -> Column:
    """Folded and squeezed; a form's number is written ``Form P-N[S]``."""
    plain = squeeze(fold_dashes(name))
    part = lambda g: F.upper(F.regexp_extract(plain, domain.form, g))
    form = F.concat(F.lit("Form "), part(1), F.lit("-"), part(2), part(3))
    return F.when((entity_type == "form") & F.rlike(plain, F.lit(domain.form)), form).otherwise(plain)


def infer_type(name: Column, domain: DomainSchema = DOMAIN) -> Column:
    """Form, visa class and tax form by pattern (unless a section is named), then the first keyword list that hits."""
    section = F.rlike(name, F.lit("(?i)section|§"))
    low = F.lower(name)
    out = F.when(is_form(name, domain) & ~section, "form").when(is_visa_class(name, domain) & ~section, "applicant_category").when(is_tax_form(name, domain) & ~section, "evidence_or_document")
    for kind, words in domain.keywords.items():
        out = out.when(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, kind)
    return out.otherwise(domain.fallback_type)


def corrected_type(name: Column, entity_type: Column, domain: DomainSchema = DOMAIN) -> Column:
    """An unknown type, or a form without a form number, is inferred anew."""
    wrong = entity_type.isNull() | ~entity_type.isin(*domain.entity_types) | ((entity_type == "form") & ~is_form(name, domain))
    return F.when(wrong, infer_type(name, domain)).otherwise(entity_type)


def entity_id(name: Column, entity_type: Column, domain: DomainSchema = DOMAIN) -> Column:
    """16 hex digits of the SHA-256 of type and canonical name."""
    key = F.concat(entity_type, F.lit("::"), strip(F.lower(canonical_name(name, entity_type, domain))))
    return F.substring(F.sha2(key, 256), 1, 16)


def _stem(path: Column) -> Column:
    """Basename after either slash, lower case, without its last extension."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1)), r"\.[^.]*$", "")


def form_label(path: Column) -> Column:
    """``Form P-N[S]`` for a file named by a form, with a mark for instructions; null for other names."""
    stem = _stem(path)
    slug = F.regexp_replace(stem, "instr$", "")
    part = lambda g: F.upper(F.regexp_extract(slug, FILE_SLUG, g))
    label = F.concat(F.lit("Form "), part(1), F.lit("-"), part(2), part(3), F.when(F.endswith(stem, F.lit("instr")), " (instructions)").otherwise(""))
    return F.when((F.length(path) > 0) & F.rlike(slug, F.lit(FILE_SLUG)), label)


def form_of_path(path: Column) -> Column:
    """``P-N[S]`` from the beginning of a file name; null without one."""
    name = F.regexp_replace(_stem(path), "instr$", "")
    part = lambda g: F.upper(F.regexp_extract(name, IN_FILE, g))
    return F.when(F.rlike(name, F.lit(IN_FILE)), F.concat(part(1), F.lit("-"), part(2), part(3)))


def forms_in_text(text: Column) -> Column:
    """Different form numbers in a text."""
    return F.array_distinct(F.regexp_extract_all(fold_dashes(text), F.lit(IN_TEXT), F.lit(1)))


def parse_score(text: Column) -> Column:
    """A score of 0 to 1 from a judge's answer: a score field or else the first number; scales of ten and a hundred are recognised."""
    named = F.regexp_extract(text, r'(?i)"?score"?\s*[:=]\s*(-?\d+(?:\.\d+)?)', 1)
    first = F.regexp_extract(text, r"(?:score\D*)?(-?\d+(?:\.\d+)?)", 1)
    value = F.coalesce(F.when(named != "", named.cast("double")), F.when(first != "", first.cast("double")), F.lit(0.0))
    scaled = F.when((value > 1) & (value <= 10), value / 10).when(value > 10, value / 100).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def is_refusal(text: Column, domain: DomainSchema = DOMAIN) -> Column:
    return F.coalesce(F.rlike(text, F.lit(domain.refusal)), F.lit(False))


def fraction(n: Column, d: Column) -> Column:
    """n / d, or 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def cache_key(context: Column, content: Column) -> Column:
    return F.md5(F.concat(context, F.lit("::"), content))


def source_url(path: Column) -> Column:
    """Online place of a form's file; empty for an empty path."""
    base = F.regexp_extract(path, r"([^\\/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.when(F.coalesce(F.length(path), F.lit(0)) == 0, "").when(stem == "", "").otherwise(F.concat(F.lit(FORMS_URL), stem, F.lit(".pdf")))


def page_url(path: Column, page: Column) -> Column:
    url = source_url(path)
    return F.when(page.isNotNull() & (url != ""), F.concat(url, F.lit("#page="), page.cast("string")))


def reference(path: Column, titles: dict[str, str] | None = None) -> Column:
    """A source's reference: the title of its form, or a general one, and the form's number if the path has one."""
    titles = FORM_TITLES if titles is None else titles
    base = F.replace(F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^\\/]*)$", 1)), F.lit("instr"), F.lit(""))
    part = lambda g: F.upper(F.regexp_extract(base, IN_URL, g))
    form = F.when(F.rlike(base, F.lit(IN_URL)), F.concat(part(1), F.lit("-"), part(2), part(3)))
    known = F.create_map(*(F.lit(x) for pair in titles.items() for x in pair))
    title = F.coalesce(F.try_element_at(known, form), F.lit(OTHER_TITLE))
    return F.concat(F.lit(REFERENCE[0]), title, F.coalesce(F.concat(F.lit(" (Form "), form, F.lit(")")), F.lit("")), F.lit(REFERENCE[1]))


def preview(content: Column) -> Column:
    return F.concat(F.left(F.coalesce(content, F.lit("")), F.lit(200)), F.lit("..."))


def evidence_stored(text: Column) -> Column:
    return F.left(text, F.lit(500))


def evidence_shown(text: Column) -> Column:
    return F.left(strip(F.coalesce(text, F.lit(""))), F.lit(160))


def predicate_shown(predicate: Column) -> Column:
    return F.replace(F.coalesce(predicate, F.lit("related to")), F.lit("_"), F.lit(" "))


def letters(text: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def is_substantial(content: Column, min_chars: int = 200, domain: DomainSchema = DOMAIN) -> Column:
    """Long enough, no page footer, and more than half letters."""
    text = strip(content)
    return (F.length(text) >= min_chars) & ~F.rlike(text, F.lit(domain.footer)) & (letters(text) / F.greatest(F.length(text), F.lit(1)) > 0.5)


def _paragraph_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s).+?(?:\n{2,}|$)"), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs that are not blank."""
    return F.filter(F.transform(_paragraph_parts(text), strip), lambda p: p != "")


def first_paragraph(text: Column) -> Column:
    """Where the part with the first paragraph begins: behind the blank parts before it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("found"))

    def step(state: Column, part: Column) -> Column:
        found = state["found"] | (strip(part) != "")
        return F.struct(F.when(found, state["at"]).otherwise(state["at"] + F.length(part)).alias("at"), found.alias("found"))

    return F.aggregate(_paragraph_parts(text), start, step, lambda state: F.when(state["found"], state["at"]).otherwise(F.lit(0)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def hard_split(text: Column, size: int = 1500, step: int = 1400) -> Column:
    """Windows of ``size`` characters every ``step`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def parsed_json(response: Column) -> Column:
    """A model's answer as a variant: without code fences; else what lies between the first and the last brace; else null."""
    text = strip(response)
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(strip(x), F.lit("```")))
    text = F.when(F.startswith(text, F.lit("```")), F.array_join(lines, "\n")).otherwise(text)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def _field(value: Column, *names: str) -> Column:
    """The first of the fields that is a non-empty string or a number."""
    found = [F.nullif(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")) for n in names]
    return F.coalesce(*found, F.lit(""))


def _items(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), F.expr("array()").cast("array<variant>"))


def json_entities(response: Column, domain: DomainSchema = DOMAIN) -> Column:
    """Entities of an answer: bare strings or objects under several names; types outside the vocabulary are inferred."""

    def entity(raw: Column) -> Column:
        bare = F.schema_of_variant(raw) == "STRING"
        name = strip(F.when(bare, F.try_variant_get(raw, "$", "string")).otherwise(_field(raw, "name", "value")))
        kind = F.replace(strip(F.lower(_field(raw, "entity_type", "category", "type"))), F.lit(" "), F.lit("_"))
        aliases = F.coalesce(F.try_variant_get(raw, "$.aliases", "array<string>"), F.array().cast("array<string>"))
        return F.struct(
            name.alias("name"),
            F.when(bare, infer_type(name, domain)).otherwise(corrected_type(name, kind, domain)).alias("entity_type"),
            F.when(bare, "").otherwise(_field(raw, "description")).alias("description"),
            F.when(bare, F.array().cast("array<string>")).otherwise(aliases).alias("aliases"),
        )

    raws = F.filter(_items(parsed_json(response), "entities"), lambda r: (F.schema_of_variant(r) == "STRING") | F.startswith(F.schema_of_variant(r), F.lit("OBJECT")))
    return F.filter(F.transform(raws, entity), lambda e: e["name"] != "")


def json_relations(response: Column, domain: DomainSchema = DOMAIN) -> Column:
    """Relations of an answer with a known predicate and two different ends."""

    def relation(raw: Column) -> Column:
        return F.struct(
            strip(_field(raw, "subject", "source")).alias("subject"),
            strip(F.lower(_field(raw, "predicate", "relation"))).alias("predicate"),
            strip(_field(raw, "object", "target")).alias("object"),
            _field(raw, "evidence").alias("evidence"),
        )

    raws = F.filter(_items(parsed_json(response), "relations"), lambda r: F.startswith(F.schema_of_variant(r), F.lit("OBJECT")))
    good = lambda r: r["predicate"].isin(*domain.predicates) & (r["subject"] != "") & (r["object"] != "") & (r["subject"] != r["object"])
    return F.filter(F.transform(raws, relation), good)
