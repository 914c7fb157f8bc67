"""Table schemas and the domain vocabulary.

The vocabulary is an object, so another domain needs other lists and patterns, not other code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

CHUNKS = "chunk_id string, doc_id string, filepath string, heading_path string, ordinal int, content string, char_start long, char_end long, metadata map<string,string>"
EMBEDDINGS = "chunk_id string, embedding array<float>"
ENTITY = "struct<name:string,entity_type:string,description:string,aliases:array<string>>"
RELATION = "struct<subject:string,predicate:string,object:string,evidence:string>"
EXTRACTION = f"chunk_id string, seq long, entities array<{ENTITY}>, relations array<{RELATION}>"
ENTITIES = "id string, name string, type string, description string, aliases array<string>, mention_count long"
MENTIONS = "chunk_id string, entity_id string"
RELATES = "src string, predicate string, dst string, evidence string, source_chunk string, weight double"


def _keywords() -> dict[str, tuple[str, ...]]:
    # Words that decide the type of a name, in the order in which the types are tried.
    return {
        "statute": ("ina ", "8 cfr", "cfr ", "u.s.c", "usc ", "§", "section ", "title 8"),
        "agency": ("uscis", "national visa center", "department of", "service center", "field office", "lockbox", "consulate", "embassy", "cbp", "social security", " nvc", "uscis.gov", "ombudsman"),
        "fee": ("fee",),
        "benefit_or_status": ("adjustment of status", "permanent resident", "green card", "employment authorization", "advance parole", "naturalization", "citizenship", "asylum", "refugee", " status", "travel document", "work permit", "immigrant visa", "lawful"),
        "applicant_category": ("immediate relative", "spouse", "preference", "eb-1", "eb-2", "eb-3", "derivative", "self-petition", "beneficiary", "petitioner", "applicant", "principal", "fiancé", "widow"),
        "eligibility_condition": ("eligible", "admissible", "inadmissib", "present in", "approved", "available", "priority date", "physically", "must be", "bona fide", "continuous"),
        "evidence_or_document": ("certificate", "photograph", "passport", "record", "letter", "affidavit", "translation", "evidence", "documentation", "transcript", "examination", "report", "receipt", "i-94", "identification", "decree", "statement"),
    }


#: Titles of forms in references.
FORM_TITLES = {
    "I-129": "Instructions for Petition for a Nonimmigrant Worker",
    "I-130": "Instructions for Petition for Alien Relative",
    "I-130A": "Supplemental Information for Spouse Beneficiary",
    "I-131": "Instructions for Application for Travel Document",
    "I-140": "Instructions for Immigrant Petition for Alien Worker",
    "I-485": "Instructions for Application to Register Permanent Residence or Adjust Status",
    "I-693": "Instructions for Report of Immigration Medical Examination and Vaccination Record",
    "I-765": "Instructions for Application for Employment Authorization",
    "I-864": "Instructions for Affidavit of Support Under Section 213A of the INA",
    "I-907": "Instructions for Request for Premium Processing Service",
}
OTHER_TITLE = "USCIS form instructions"
REFERENCE = ("U.S. Citizenship and Immigration Services. (n.d.). ", ". U.S. Department of Homeland Security.")


@dataclass(frozen=True)
class DomainSchema:
    """Types, predicates, patterns and keyword lists of a domain."""

    # The closed vocabularies and the token patterns.
    entity_types: tuple[str, ...] = ("form", "agency", "benefit_or_status", "eligibility_condition", "evidence_or_document", "statute", "applicant_category", "fee")
    predicates: tuple[str, ...] = ("requires", "filed_with", "evidence_for", "eligibility_for", "references", "supersedes", "applies_to")
    form: str = r"(?i)\b(I|N|G|DS|ETA|AR)[-\s]?(\d{1,4})([a-z]?)\b"
    visa: str = r"\b([A-Z]-\d[A-Z]?\d?|TN|TD)\b"
    tax: str = r"\b(W-\d[A-Z]?G?|10(?:40|99)[A-Z]*|9(?:41|43|40))\b"
    footer: str = r"(?i)^\s*form\s+[a-z]+-\d+[a-z]?\s+.{0,40}?page\s+\d+\s+of\s+\d+"
    refusal: str = (
        r"(?i)(could\s*n[o']?t find|cannot (?:find|answer)|do(?:es)? not (?:contain|cover|include|mention|have)"
        r"|not (?:enough|sufficient) (?:information|detail)|no (?:relevant )?information"
        r"|not (?:covered|addressed|present|available|found)|sources? (?:do|does) not"
        r"|unable to (?:find|answer)|do(?:es)?n'?t (?:contain|cover|have enough)"
        r"|outside (?:the|its|my) (?:scope|sources|knowledge))"
    )
    keywords: dict = field(default_factory=_keywords)
    fallback_type: str = "evidence_or_document"


DOMAIN = DomainSchema()
