"""Chunking: a text becomes units, chunks take as many units as fit, and know their places in the document.

Units are columns of ``sparkweave.functions.text``: paragraphs; of a paragraph that is too long its sentences; of a sentence that
is too long overlapping windows. A chunk then goes on from its first unit to the last one that still fits, and begins with the
end of the chunk before it. Separators between units belong to a chunk's text and places, but not to the size that
decides what fits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sparkweave.functions import text as T
from sparkweave.tables import in_arrow

MAX_CHARS, MIN_CHARS, OVERLAP = 1500, 500, 100
BETWEEN = "\n\n"
PIECE = "array<struct<text:string,start:long,end:long>>"


def units(text: Column, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of (text, size, least): a chunk of at least ``least`` characters ends before a unit whose size does not fit.

    A unit without text stands before the parts of what was too long: it may end a chunk, and adds nothing.
    """

    def unit(shown: Column, size: Column, least: int) -> Column:
        return F.struct(shown.alias("text"), size.alias("size"), F.lit(least).alias("least"))

    def cut(whole: Column, least: int, parts: Column) -> Column:
        too_long = F.concat(F.array(unit(F.lit(None).cast("string"), F.length(whole), least)), parts)
        return F.when(F.length(whole) <= max_chars, F.array(unit(whole, F.length(whole), least))).otherwise(too_long)

    windows = lambda s: F.transform(T.hard_split(s, max_chars, max_chars - overlap), lambda w: unit(w, F.length(w), 1))
    in_sentences = lambda p: F.flatten(F.transform(T.sentences(p), lambda s: cut(s, 1, windows(s))))
    return F.flatten(F.transform(T.paragraphs(text), lambda p: cut(p, min_chars, in_sentences(p))))


def _filled(found: list[dict], most: int, overlap: int, start: int):
    """(text, start, end) of the chunks of a text's units."""
    first, tail = 0, None
    while first < len(found):
        size, last = len(tail or ""), first
        while last == first or last < len(found) and (size + found[last]["size"] <= most or size < found[last]["least"]):
            size += len(found[last]["text"] or "")
            last += 1
        parts = [u["text"] for u in found[first:last] if u["text"] is not None]
        text = BETWEEN.join(parts if tail is None else [tail, *parts])
        yield text, start, start + len(text)
        first, tail = last, text[-overlap:]
        start = max(0, start + len(text) - len(tail))


def chunked(sections: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """All columns of ``sections`` (with a column text) and pieces: array of (text, start, end). A text within the limit, or a blank one, is one piece."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long = F.length(text) > max_chars
    none = F.array().cast("array<struct<text:string,size:int,least:int>>")
    rows = sections.withColumns({"__units": F.when(long, units(text, max_chars, min_chars, overlap)).otherwise(none), "__begin": F.when(long, T.first_paragraph(text)).otherwise(F.lit(0))})
    names = sections.columns

    def run(batches):
        kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            pieces = []
            for whole, found, begin in zip(*(batch.column(c).to_pylist() for c in ("text", "__units", "__begin"))):
                chunks = _filled(found, max_chars, overlap, begin) if found else [(whole or "", 0, len(whole or ""))]
                pieces.append([dict(zip(("text", "start", "end"), c)) for c in chunks])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pieces, kind)], names=[*names, "pieces"])

    return in_arrow(rows, run, StructType([*sections.schema.fields, *StructType.fromDDL(f"pieces {PIECE}").fields]))


def section_offsets(sections: DataFrame, by: list[str], order: list[str], text: str = "text", name: str = "offset") -> DataFrame:
    """Where a section begins in its document: every earlier section counts one character more than its text."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn(name, F.coalesce(F.sum(F.length(text) + F.lit(1)).over(earlier), F.lit(0)).cast("long"))


def sections_to_chunks(sections: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks from sections: doc_id, filepath, section_no, heading_path, text, metadata.

    A chunk's id is a hash of its document, section and ordinal, so a second run makes the same ids.
    """
    placed = section_offsets(sections, ["doc_id"], ["section_no"])
    each = chunked(placed, max_chars, min_chars, overlap).select("*", F.posexplode("pieces").alias("ordinal", "piece"))
    key = F.concat_ws("|", F.col("doc_id"), F.col("section_no").cast("string"), F.col("ordinal").cast("string"))
    return each.select(
        F.substring(F.sha2(key, 256), 1, 16).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        "filepath",
        "heading_path",
        "section_no",
        "ordinal",
        F.col("piece.text").alias("content"),
        (F.col("offset") + F.col("piece.start")).alias("char_start"),
        (F.col("offset") + F.col("piece.end")).alias("char_end"),
        "metadata",
    )


def chunk_by_id(chunks: DataFrame, chunk_id) -> DataFrame:
    """The chunk with the id, or no row."""
    return chunks.where(F.col("chunk_id") == F.lit(chunk_id))


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks whose ids a table lists, each once; no ids: no rows."""
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi")


def stats_by_file(chunks: DataFrame) -> DataFrame:
    """filepath, chunks, chars."""
    return chunks.groupBy("filepath").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"))


def first_chunks(chunks: DataFrame, limit: int = 0) -> DataFrame:
    """The first chunks in the order of files, sections and places; all of them for 0."""
    return chunks.orderBy("filepath", "doc_id", "section_no", "ordinal").limit(limit) if limit else chunks
