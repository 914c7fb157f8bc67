"""Chunking against an independent description, and page parsing on small pages."""

import random
import re

import pytest

from sparkweave.operators import chunk
from sparkweave.sources import parse


def by_the_rules(text, most, least, overlap):
    """The rules as a list of steps over units: ('p' paragraph | 's' sentence | 'h' hard piece, text)."""
    if len(text) <= most:
        return [(text, 0, len(text))]
    units, first = [], None
    for m in re.finditer(r"(?s).+?(?:\n{2,}|$)", text):
        p = m.group().strip()
        if not p:
            continue
        first = m.start() if first is None else first
        if len(p) <= most:
            units.append(("p", p))
            continue
        units.append(("long", p))
        for s in re.split(r"(?<=[.!?])\s+", p):
            if len(s) > most:
                units.append(("gate", s))
                units += [("s", s[i : i + most]) for i in range(0, len(s), most - overlap)]
            else:
                units.append(("s", s))
    if first is None:
        return [(text, 0, len(text))]
    out, buffer, start = [], [], first
    for kind, u in units:
        n = sum(map(len, buffer))
        over = n + len(u) > most
        if over and (buffer if kind in ("s", "gate") else n >= least):
            joined = "\n\n".join(buffer)
            out.append((joined, start, start + len(joined)))
            buffer, start = [joined[-overlap:]], max(0, start + len(joined) - min(overlap, len(joined)))
        if kind in ("p", "s"):
            buffer.append(u)
    if buffer:
        joined = "\n\n".join(buffer)
        out.append((joined, start, start + len(joined)))
    return out


def test_split_against_the_rules(spark):
    rng = random.Random(1)
    texts = ["", " ", "\n\n \n\n" * 30, "\n\n" + "x" * 100, None]
    texts += ["".join(rng.choice(["ab ", "c. ", "d! ", "\n", "\n\n", "xyzxyz", "? ", " "]) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for most in (20, 40, 60):
        for r in chunk.chunked(rows, most, most // 3, 7).collect():
            assert [tuple(p) for p in r["pieces"]] == by_the_rules(texts[r["id"]] or "", most, most // 3, 7), texts[r["id"]]


def test_lookups_and_counts(spark):
    chunks = spark.createDataFrame([("a", "f", "xy"), ("b", "f", None), ("c", "g", "z")], "chunk_id string, filepath string, content string")
    ids = spark.createDataFrame([("c",), ("a",), ("a",), ("no",)], "chunk_id string")
    assert [r["chunk_id"] for r in chunk.chunk_by_id(chunks, "b").collect()] == ["b"] and chunk.chunk_by_id(chunks, "no").count() == 0
    assert sorted(r["chunk_id"] for r in chunk.chunks_by_ids(chunks, ids).collect()) == ["a", "c"] and chunk.chunks_by_ids(chunks, ids.limit(0)).count() == 0
    assert {tuple(r) for r in chunk.stats_by_file(chunks).collect()} == {("f", 2, 2), ("g", 1, 1)}


def test_chunks_of_sections(spark):
    rows = [("d", "f.html", 0, "A", "x" * 10, {}), ("d", "f.html", 1, "B", "word. " * 600, {"page_number": "2"}), ("e", None, 0, None, None, None)]
    from sparkweave.streaming.ingest import SECTIONS

    got = chunk.sections_to_chunks(spark.createDataFrame(rows, SECTIONS)).collect()
    mine = sorted((r for r in got if r["doc_id"] == "d"), key=lambda r: (r["section_no"], r["ordinal"]))
    assert (mine[0]["char_start"], mine[0]["char_end"]) == (0, 10) and mine[1]["char_start"] == 11 and len(mine) > 3
    assert len({r["chunk_id"] for r in got}) == len(got) and all(len(r["chunk_id"]) == 16 for r in got)
    again = chunk.sections_to_chunks(spark.createDataFrame(rows, SECTIONS)).collect()
    assert {r["chunk_id"] for r in got} == {r["chunk_id"] for r in again}


@pytest.mark.parametrize(
    "html, want",
    [
        ("<body>plain", [("", 0, "plain")]),
        ("<html><head><title>T</title></head><body><h1>A</h1>one<h2>B</h2><p>two<p>three<h1>C</h1>four</body>", [("A", 1, "one"), ("A > B", 2, "two\nthree"), ("C", 1, "four")]),
        ("<body><script>var t='</p>';</script><nav>menu</nav><p>x &amp; y<br>z</p><footer>f</footer>", [("", 0, "x & y\nz")]),
        ("<body><!-- ad 3 --><p>text</p>", [("", 0, "ad 3\ntext")]),
        ("<body><h1><b>bold</b> title</h1>body", [("bold title", 1, "bold\nbody")]),
        ("<body>a<h2></h2>b<h2>T</h2>c", [("", 0, "a"), ("", 0, "b"), ("T", 2, "c")]),
        ("<body><h3>deep</h3>x<h1>top</h1>y", [("deep", 3, "x"), ("top", 1, "y")]),
        ("", []), (None, []),
    ],
)
def test_html_sections(html, want):
    assert parse.html_sections(html) == want


def test_pages_and_directories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.HTML").write_bytes("<body><h1>Über</h1>text".encode("latin-1"))
    (tmp_path / "sub" / "b.htm").write_text("<body>﻿plain")
    (tmp_path / "c.txt").write_text("no page")
    got = {r["filepath"].rsplit("/", 1)[1]: r for r in parse.ingest_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.HTML", "b.htm"} and got["a.HTML"]["heading_path"] == "Über" and got["b.htm"]["error"] is None
    with pytest.raises(ValueError):
        parse.ingest_file(spark, str(tmp_path / "c.txt"))
    with pytest.raises(FileNotFoundError):
        parse.ingest_file(spark, str(tmp_path / "none.html"))
    with pytest.raises(FileNotFoundError):
        parse.ingest_directory(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        parse.ingest_directory(spark, str(tmp_path / "a.HTML"))
    (tmp_path / "Z.pdf").write_bytes(b"%PDF")
    assert [r["path"].rsplit("/", 1)[1] for r in parse.list_files(spark, str(tmp_path)).collect()] == ["Z.pdf", "a.HTML", "b.htm"]
    # A PDF file has sections from spans that were given, or else a row that says so.
    rows = lambda spans: {r["filepath"].rsplit("/", 1)[1]: r for r in parse.ingest_directory(spark, str(tmp_path), spans=spans).collect()}
    assert "spans" in rows(None)["Z.pdf"]["error"] and set(rows(None)) == {"a.HTML", "b.htm", "Z.pdf"}
    place = rows(None)["Z.pdf"]["filepath"]
    found = rows(spark.createDataFrame([(place, 1, 0, 0, 0, "Title", 20.0, 0), (place, 1, 1, 0, 0, "Body", 10.0, 0), (place, 1, 1, 1, 0, "more", 10.0, 0), ("other", 1, 0, 0, 0, "x", 9.0, 0)], "doc_id string, page int, block int, line int, span int, text string, size double, flags int"))
    assert found["Z.pdf"]["heading_path"] == "Title" and found["Z.pdf"]["text"] == "Body\nmore" and found["Z.pdf"]["error"] is None and len(found) == 3
    chunks = spark.createDataFrame([("f", "d", 1, 0), ("f", "d", 0, 1), ("e", "d", 9, 9)], "filepath string, doc_id string, section_no int, ordinal int")
    assert [r["section_no"] for r in chunk.first_chunks(chunks, 2).collect()] == [9, 0] and chunk.first_chunks(chunks).count() == 3
