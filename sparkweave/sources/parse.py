"""Documents to sections: HTML by a streaming parser in Arrow batches, PDF from its text spans as DataFrame operations."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkweave.functions import text as T
from sparkweave.tables import in_arrow

HTML_EXTENSIONS, PDF_EXTENSIONS = (".html", ".htm", ".xhtml"), (".pdf",)
SEPARATOR = " > "
DROPPED = frozenset({"script", "style", "nav", "header", "footer"})
#: Tags without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What the start of a tag closes if it is open.
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure form h1 h2 h3 h4 h5 h6 hr main ol p pre section table ul".split())


def heading_level(tag: str) -> int:
    m = re.match(r"h(\d)", tag, re.IGNORECASE)
    return int(m[1]) if m else 0


class Sections(HTMLParser):
    """Collects (heading path, level, text) while the page streams by.

    Text in dropped tags is lost. Comments count as text. Text of a heading goes into its path; text of a tag inside a
    heading goes into both the path and the body.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.path: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.heading: list[str] | None = None
        self.pending: list[str] = []
        self.out: list[tuple[str, int, str]] = []
        self.in_body = False

    def flush(self) -> None:
        text = "\n".join(self.parts).strip()
        if text:
            self.out.append((SEPARATOR.join(t for _, t in self.path), self.path[-1][0] if self.path else 0, text))
        self.parts = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body":
            self.in_body = True
        if tag in BLOCKS and "p" in self.open and not (set(self.open) & DROPPED):
            self.close("p")
        for other in CLOSED_BY.get(tag, ()):
            if self.open and self.open[-1] == other:
                self.close(other)
        if tag not in VOID:
            self.open.append(tag)
            if heading_level(tag) in range(1, 7) and len(tag) == 2 and not self.hidden() and self.heading is None:
                self.flush()
                self.heading, self.pending = [], []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.close(tag)

    def close(self, tag: str) -> None:
        while self.open:
            last = self.open.pop()
            if self.heading is not None and heading_level(last) and len(last) == 2 and not any(heading_level(t) and len(t) == 2 for t in self.open):
                self.end_heading(heading_level(last))
            if last == tag:
                return

    def end_heading(self, level: int) -> None:
        title = " ".join(self.heading or [])
        if title:
            while self.path and self.path[-1][0] >= level:
                self.path.pop()
            self.path.append((level, title))
        self.heading = None
        self.parts.extend(self.pending)

    def hidden(self) -> bool:
        return not DROPPED.isdisjoint(self.open)

    def text(self, data: str, visible: bool) -> None:
        data = data.strip()
        if not data or self.hidden() or "head" in self.open and not self.in_body:
            return
        direct = bool(self.open) and heading_level(self.open[-1]) and len(self.open[-1]) == 2
        if self.heading is not None:
            if visible:
                self.heading.append(data)
            if not direct:
                self.pending.append(data)
        elif not direct:
            self.parts.append(data)

    def handle_data(self, data: str) -> None:
        self.text(data, True)

    def handle_comment(self, data: str) -> None:
        self.text(data, False)


def html_sections(html: str | None) -> list[tuple[str, int, str]]:
    """(heading path, level, text) of a page."""
    parser = Sections()
    parser.feed(html or "")
    HTMLParser.close(parser)
    if parser.heading is not None:
        parser.end_heading(next((heading_level(t) for t in parser.open if heading_level(t)), 1))
    parser.flush()
    return parser.out


def decode_html(content: bytes | None) -> str:
    """UTF-8, or else Latin-1, which reads any bytes. A byte order mark stays."""
    try:
        return (content or b"").decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def pages_to_sections(pages: DataFrame, key: str, html: str, path: str | None = None) -> DataFrame:
    """doc_id, filepath, section_no, heading_path, level, text, metadata, error. A page that cannot be read has a row with its error only.

    ``html`` is a string or binary column.
    """
    binary = dict(pages.dtypes)[html] == "binary"

    def run(batches):
        names = ["doc_id", "filepath", "section_no", "heading_path", "level", "text", "error"]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for key_, path_, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    found = html_sections(decode_html(page) if binary else page)
                    rows += [(key_, path_, n, *s, None) for n, s in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one bad page must not end the job; its error is a row
                    rows.append((key_, path_, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    where = F.col(path) if path else F.lit(None)
    rows = pages.select(F.col(key).cast("string").alias("doc_id"), where.cast("string").alias("filepath"), F.col(html))
    out = in_arrow(rows, run, "doc_id string, filepath string, section_no int, heading_path string, level int, text string, error string")
    return out.withColumn("metadata", F.expr("cast(map() as map<string,string>)"))


def pdf_heading_level(size: Column, bold: Column, median: Column) -> Column:
    """1 to 3 by size against the document's median, or null; bold text of at least normal size is 3."""
    r = size / median
    return F.when(median > 0, F.when(r >= 1.6, 1).when(r >= 1.3, 2).when(bold & (r >= 1.0), 3))


def pdf_lines(spans: DataFrame) -> DataFrame:
    """Lines from spans doc_id, page, block, line, span, text, size, flags: doc_id, page, block, line, text, level.

    Blank spans count for nothing; a line's level is the least of its spans, and a page's last line is followed by an empty one.
    """
    shown = spans.where(T.strip(F.col("text")) != "")
    medians = shown.groupBy("doc_id").agg(F.median("size").alias("median"))
    leveled = shown.join(medians, "doc_id").withColumn("level", pdf_heading_level(F.col("size"), F.col("flags").bitwiseAND(16) != 0, F.col("median")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"])
    lines = leveled.groupBy("doc_id", "page", "block", "line").agg(T.strip(F.array_join(ordered, " ")).alias("text"), F.min("level").alias("level"))
    ends = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(1 << 30).alias("block"), F.lit(0).alias("line"), F.lit("").alias("text"), F.lit(None).cast("int").alias("level"))
    return lines.unionByName(ends)


def heading_path(level: Column, title: Column, over, levels: int = 3) -> Column:
    """The titles open at a row, joined: for each level the last title since a heading of a lower level."""
    place = F.struct(F.col("page"), F.col("block"), F.col("line"))
    parts = []
    for k in range(1, levels + 1):
        mine = F.last(F.when(level == k, F.struct(place.alias("at"), title.alias("t"))), ignorenulls=True).over(over)
        broken = F.last(F.when(level < k, place), ignorenulls=True).over(over)
        parts.append(F.when(broken.isNull() | (mine["at"] > broken), mine["t"]))
    return F.concat_ws(SEPARATOR, *parts)


def pdf_sections(spans: DataFrame) -> DataFrame:
    """doc_id, section_no, heading_path, level, text, metadata (page_number: where the section starts)."""
    over = Window.partitionBy("doc_id").orderBy("page", "block", "line").rowsBetween(Window.unboundedPreceding, 0)
    lines = pdf_lines(spans)
    marked = lines.withColumns({
        "part": F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(over),
        "heading_path": heading_path(F.col("level"), F.col("text"), over),
        "open_level": F.last("level", ignorenulls=True).over(over),
    })
    head = F.col("level").isNotNull()
    body = F.array_sort(F.collect_list(F.when(~head, F.struct("page", "block", "line", "text"))))
    parts = marked.groupBy("doc_id", "part").agg(
        F.max("heading_path").alias("heading_path"),
        F.max("open_level").alias("level"),
        T.strip(F.array_join(F.transform(body, lambda x: x["text"]), "\n")).alias("text"),
        F.min(F.when(head | (F.col("text") != ""), F.col("page"))).alias("page"),
    )
    kept = parts.where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return kept.select("doc_id", number.alias("section_no"), "heading_path", F.coalesce("level", F.lit(0)).alias("level"), "text", F.create_map(F.lit("page_number"), F.col("page").cast("string")).alias("metadata"))


def read_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = HTML_EXTENSIONS, glob: str | None = None) -> DataFrame:
    """path, content of the files below a directory with one of the extensions (any case). A missing path and a file are errors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(f"no such directory: {path}")
    if not system.getFileStatus(place).isDirectory():
        raise NotADirectoryError(f"not a directory: {path}")
    files = reader.load(path)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions)).select("path", "content")


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = HTML_EXTENSIONS + PDF_EXTENSIONS, glob: str | None = None) -> DataFrame:
    """path of the supported files below a directory, in order; contents are not read."""
    return read_directory(spark, path, extensions, glob).select("path").orderBy("path")


def ingest_directory(spark: SparkSession, path: str, glob: str | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Sections of all files below a directory; files that cannot be parsed leave a row with their error.

    PDF files have sections if ``spans`` (as ``pdf_sections`` takes them, doc_id: the file's path) has some of theirs, else a row with an error.
    """
    out = pages_to_sections(read_directory(spark, path, glob=glob), "path", "content", "path")
    files = read_directory(spark, path, PDF_EXTENSIONS, glob).select(F.col("path").alias("doc_id"))
    missing = files
    if spans is not None:
        found = pdf_sections(spans.join(files, "doc_id", "left_semi"))
        out = out.unionByName(found.select("doc_id", F.col("doc_id").alias("filepath"), "section_no", "heading_path", "level", "text", F.lit(None).cast("string").alias("error"), "metadata"))
        missing = files.join(spans.select("doc_id"), "doc_id", "left_anti")
    return out.unionByName(missing.select("doc_id", F.col("doc_id").alias("filepath"), F.lit("no spans of this PDF file were given").alias("error")), allowMissingColumns=True)


def ingest_file(spark: SparkSession, path: str) -> DataFrame:
    """Sections of one file. PDF files need their spans extracted first; see ``pdf_sections``."""
    if not path.lower().endswith(HTML_EXTENSIONS):
        raise ValueError(f"unsupported file type: {path}")
    try:
        file = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        raise FileNotFoundError(f"no such file: {path}") from e
    return pages_to_sections(file, "path", "content", "path")
