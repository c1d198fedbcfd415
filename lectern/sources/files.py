"""A corpus of mixed files to text.

One scan opens every file, and its text is made within its row: zipped XML and CSV become nested arrays in Python, all other
bytes are read by built-in expressions. A file that cannot be read becomes a row with the message; the others go on. The
functions on parts (explode_container, docx_text and so on) do the same on tables of parts, for users who want the parts.
"""

from __future__ import annotations

import io
import posixpath
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

ACCEPTED = tuple(T.MIME)
PARTS = "path string, part string, kind string, ordinal int, sub_ordinal int, attr string, text string"
ROWS = "path string, row_no int, fields array<string>"
#: Messages for files that give no text.
MESSAGES = {
    "docx": "Invalid DOCX: missing word/document.xml",
    "odt": "Invalid ODT: missing content.xml",
    "pptx": "Invalid PPTX: no slides found",
    "pptx_empty": "PPTX file contains no text data.",
    "xlsx": "Invalid XLSX: no worksheets found",
    "xlsx_empty": "XLSX file contains no text data.",
    "csv": "CSV file is empty.",
    "rtf": "Could not extract text from RTF file (file may be empty or corrupted).",
    "html": "Could not extract text from HTML file (no body content).",
    "doc": "Could not extract text from .doc file. Try converting it to .docx or .pdf for better results.",
    "unsupported": "Supported: PDF, DOCX, DOC, ODT, RTF, EPUB, XLSX, PPTX, CSV, HTML, TXT, MD.",
}


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, name, ext, mime) of accepted files below path, to any depth."""
    return routed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)).filter(F.col("ext").isin(*ACCEPTED))


def routed(files: DataFrame) -> DataFrame:
    rows = files.withColumn("name", F.substring_index("path", "/", -1)).withColumn("ext", T.file_extension(F.col("name")))
    return rows.withColumn("mime", T.mime_type(F.col("ext"), F.lit("")))


def text_from_plain(files: DataFrame) -> DataFrame:
    return files.select("path", T.utf8_text(F.col("content")).alias("text"))


_OUTSIDE, _INSIDE = re.compile(r'"|,|\r\n|\r|\n|[^",\r\n]+'), re.compile(r'""|"|[^"]+')


def csv_fields(text: str) -> list[list[str]]:
    """Rows of fields. Quotes toggle anywhere in a field and are doubled inside; carriage returns, newlines or both end rows."""
    rows, row, field, quoted, at = [], [], [], False, 0
    while at < len(text):
        token = (_INSIDE if quoted else _OUTSIDE).match(text, at)[0]
        at += len(token)
        if token == '"':
            quoted = not quoted
        elif quoted:
            field.append('"' if token == '""' else token)
        elif token == ",":
            row.append("".join(field))
            field = []
        elif token[0] in "\r\n":
            rows.append([*row, "".join(field)])
            row, field = [], []
        else:
            field.append(token)
    if row or field:
        rows.append([*row, "".join(field)])
    return rows


def csv_rows(files: DataFrame) -> DataFrame:
    """(path, row_no, fields) of CSV files; a blank line is a row with one empty field, and there is no header."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(p, i, r) for p, t in zip(batch["path"], batch["text"]) for i, r in enumerate(csv_fields(t))], columns=["path", "row_no", "fields"])

    return text_from_plain(files).mapInPandas(run, ROWS)


def csv_text(rows: DataFrame) -> DataFrame:
    """(path, text): fields joined by a comma and a space, rows by newlines."""
    line = F.array_join("fields", ", ")
    return rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line"))))["line"], "\n").alias("text"))


def csv_rows_fast(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own reader for well-formed files: blank lines are dropped, and quotes inside a field are kept as they are."""
    return spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node, name: str):
    return [x for x in node.iter() if isinstance(x.tag, str) and _local(x.tag) == name]


def _content(node) -> str:
    return "".join(node.itertext())


def _html_body(raw: bytes) -> str:
    """Text of a book's chapter, tags and markup aside; a chapter that is no XML is read by its tags."""
    try:
        root = ElementTree.fromstring(raw)
        body = _all(root, "body")
        return _content(body[0]) if body else ""
    except ElementTree.ParseError:
        import html

        return html.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?is)<head\b.*?</head>", "", raw.decode("utf-8", "replace"))))


def _explode(path: str, raw: bytes, ext: str):
    """Rows of one container: (part, kind, ordinal, sub_ordinal, attr, text)."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    names = archive.namelist()
    xml = lambda name: ElementTree.fromstring(archive.read(name))
    if ext == "docx" and "word/document.xml" in names:
        for i, p in enumerate(_all(xml("word/document.xml"), "p")):
            yield "word/document.xml", "paragraph", i, -1, None, None
            for k, t in enumerate(_all(p, "t")):
                yield "word/document.xml", "run", i, k, None, _content(t)
    elif ext == "odt" and "content.xml" in names:
        space = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}p"
        for i, p in enumerate(xml("content.xml").iter(space)):
            yield "content.xml", "paragraph", i, 0, None, _content(p)
    elif ext == "pptx":
        for name in names:
            if re.fullmatch(r"ppt/slides/slide\d+\.xml", name):
                yield name, "slide", 0, -1, None, None
                for k, t in enumerate(x for x in xml(name).iter() if _local(str(x.tag)) == "t" and "drawingml" in str(x.tag)):
                    yield name, "run", 0, k, None, _content(t)
    elif ext == "xlsx":
        if "xl/sharedStrings.xml" in names:
            for i, s in enumerate(_all(xml("xl/sharedStrings.xml"), "si")):
                yield "xl/sharedStrings.xml", "string", i, 0, None, "".join(map(_content, _all(s, "t")))
        for name in names:
            if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", name):
                yield name, "sheet", -1, -1, None, None
                for i, row in enumerate(_all(xml(name), "row")):
                    for k, c in enumerate(_all(row, "c")):
                        kind = c.get("t") or ""
                        held = _all(c, "t" if kind == "inlineStr" else "v")[:1]
                        yield name, "cell", i, k, kind, _content(held[0]) if held else ""
    elif ext == "epub":
        package = next(x.get("full-path") for x in _all(xml("META-INF/container.xml"), "rootfile"))
        root = xml(package)
        items = {x.get("id"): x.get("href") for x in _all(root, "item")}
        for i, ref in enumerate(_all(root, "itemref")):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(items.get(ref.get("idref")) or "").split("#")[0]))
            yield name, "chapter", i, 0, None, _html_body(archive.read(name)) if name in names else ""


def explode_container(files: DataFrame) -> DataFrame:
    """(path, part, kind, ordinal, sub_ordinal, attr, text) of zipped XML files; a file that cannot be opened gives one row of kind error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw, ext in zip(batch["path"], batch["content"], batch["ext"]):
                try:
                    rows += [(path, *r) for r in _explode(path, raw, ext)]
                except Exception as wrong:  # noqa: BLE001  any broken file is quarantined
                    rows = [r for r in rows if r[0] != path] + [(path, "", "error", 0, 0, None, f"{type(wrong).__name__}: {wrong}")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return files.select("path", "content", "ext").mapInPandas(run, PARTS)


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _paragraphs(lines: DataFrame) -> DataFrame:
    """(path, text) of lines (path, ordinal, line); blank ones dropped, a blank line between the others."""
    return lines.filter(T.trim_ws(F.col("line")) != "").groupBy("path").agg(F.array_join(_ordered("ordinal", "line")["line"], "\n\n").alias("text"))


def docx_text(parts: DataFrame) -> DataFrame:
    runs = parts.filter("kind = 'run' and part = 'word/document.xml'").groupBy("path", "ordinal").agg(F.array_join(_ordered("sub_ordinal", "text")["text"], "").alias("line"))
    return _paragraphs(runs)


def odt_text(parts: DataFrame) -> DataFrame:
    return _paragraphs(parts.filter("kind = 'paragraph' and part = 'content.xml'").select("path", "ordinal", F.col("text").alias("line")))


def pptx_text(parts: DataFrame) -> DataFrame:
    """Slides by number, their runs joined by spaces."""
    number = F.regexp_extract("part", r"slide(\d+)\.xml", 1).cast("int").alias("ordinal")
    slides = parts.filter("kind = 'run' and part like 'ppt/slides/%'").groupBy("path", number).agg(
        T.trim_ws(F.array_join(_ordered("sub_ordinal", "text")["text"], " ")).alias("line")
    )
    return _paragraphs(slides).withColumn("text", T.trim_ws(F.col("text")))


def xlsx_text(parts: DataFrame) -> DataFrame:
    """Cells of a row joined by commas, rows by newlines, sheets in order of their names with a blank line between them."""
    shared = parts.filter("kind = 'string'").select("path", F.col("ordinal").alias("_i"), F.col("text").alias("_shared"))
    cells = parts.filter("kind = 'cell'").withColumn("_i", F.when(F.col("attr") == "s", F.regexp_extract("text", r"^\s*([+-]?\d+)", 1).try_cast("int")))
    value = F.when(F.col("attr") == "s", F.coalesce("_shared", F.lit(""))).otherwise(F.col("text"))
    rows = cells.join(shared, ["path", "_i"], "left").withColumn("value", value).groupBy("path", "part", "ordinal").agg(_ordered("sub_ordinal", "value")["value"].alias("values"))
    rows = rows.filter(F.exists("values", lambda v: T.trim_ws(v) != "")).withColumn("line", F.array_join("values", ", "))
    sheets = rows.groupBy("path", "part").agg(F.array_join(_ordered("ordinal", "line")["line"], "\n").alias("sheet"))
    return sheets.groupBy("path").agg(T.trim_ws(F.array_join(_ordered("part", "sheet")["sheet"], "\n\n")).alias("text"))


def epub_text(parts: DataFrame) -> DataFrame:
    chapters = parts.filter("kind = 'chapter'").select("path", "ordinal", T.collapse_ws(F.col("text")).alias("line"))
    return _paragraphs(chapters)


CONTAINERS = {"docx": docx_text, "odt": odt_text, "pptx": pptx_text, "xlsx": xlsx_text, "epub": epub_text}


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir.

    Without that setting a local session takes a temporary folder of this machine; a cluster is refused, as its executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """df as a table, so that what follows does not read and unzip every file again; options are the writer's."""
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files that are opened at a time in a worker of Python.
FILES_AT_ONCE = 64
HEAD = ["path", "name", "ext", "mime"]
#: What is found in one file: paragraphs, slides, rows or chapters in order, each with its cells, and the shared strings of a workbook.
OPENED = (
    "struct<units:array<struct<part:string,ordinal:int,cells:array<struct<attr:string,text:string>>>>,"
    "shared:array<string>,found:boolean,body:boolean,broken:string>"
)


def _opened(raw: bytes, ext: str) -> dict:
    """One container or CSV file as OPENED has it."""
    out = {"units": [], "shared": [], "found": False, "body": False, "broken": None}
    try:
        if ext == "csv":
            lines = csv_fields(raw.decode("utf-8", "replace").removeprefix("\ufeff"))
            return out | {"units": [{"part": "", "ordinal": i, "cells": [{"attr": None, "text": t} for t in row]} for i, row in enumerate(lines)]}
        units: dict = {}
        for part, kind, ordinal, _, attr, text in _explode("", raw, ext):
            out["found"] = True
            if kind == "string":
                out["shared"].append(text)
                continue
            out["body"] |= kind in ("sheet", "slide", "paragraph", "chapter")
            if kind == "sheet":
                continue
            if ext == "pptx":  # slides are in order of their number
                ordinal = int(re.search(r"(\d+)\.xml$", part)[1])
            unit = units.setdefault((part, ordinal), {"part": part, "ordinal": ordinal, "cells": []})
            if text is not None:
                unit["cells"].append({"attr": attr, "text": text})
        return out | {"units": list(units.values())}
    except Exception as wrong:  # noqa: BLE001  any broken file is quarantined
        return {"units": [], "shared": [], "found": False, "body": False, "broken": f"{type(wrong).__name__}: {wrong}"}


def _open(content: Column, ext: Column) -> Column:
    """OPENED of each container or CSV file; null where the content is null, which then is all that goes to Python."""
    kind = pa.struct(
        [
            ("units", pa.list_(pa.struct([("part", pa.string()), ("ordinal", pa.int32()), ("cells", pa.list_(pa.struct([("attr", pa.string()), ("text", pa.string())])))]))),
            ("shared", pa.list_(pa.string())),
            ("found", pa.bool_()),
            ("body", pa.bool_()),
            ("broken", pa.string()),
        ]
    )

    @F.arrow_udf(OPENED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # Arrow's batches have thousands of files, whose cells take far more room than their bytes: what is opened goes back in smaller parts.
        for content, ext in batches:
            for at in range(0, len(content), FILES_AT_ONCE):
                part = zip(content.slice(at, FILES_AT_ONCE).to_pylist(), ext.slice(at, FILES_AT_ONCE).to_pylist())
                yield pa.array([None if raw is None else _opened(raw, e) for raw, e in part], kind)

    return run(content, ext)


def _join(lines: Column, between: str) -> Column:
    """Lines that are not blank, with a string between them."""
    return F.array_join(F.filter(lines, lambda x: T.trim_ws(x) != ""), between)


def _cells(unit: Column) -> Column:
    return unit["cells"]["text"]


def _sheets(opened: Column) -> Column:
    """A workbook's text: shared strings by number, rows that are not blank, sheets in order of their names."""
    shared = opened["shared"]

    def value(cell: Column) -> Column:
        number = F.regexp_extract(cell["text"], r"^\s*([+-]?\d+)", 1).try_cast("int")
        held = F.when(number >= 0, F.get(shared, number))
        return F.when(cell["attr"] == "s", F.coalesce(held, F.lit(""))).otherwise(cell["text"])

    rows = F.transform(opened["units"], lambda u: F.struct(u["part"].alias("part"), F.transform(u["cells"], value).alias("values")))
    full = F.filter(rows, lambda r: F.exists(r["values"], lambda v: T.trim_ws(v) != ""))
    lines = F.transform(full, lambda r: F.struct(r["part"].alias("part"), F.array_join(r["values"], ", ").alias("line")))

    def by_sheet(all_lines: Column) -> Column:
        names = F.array_sort(F.array_distinct(all_lines["part"]))
        return F.array_join(F.transform(names, lambda n: F.array_join(F.filter(all_lines, lambda x: x["part"] == n)["line"], "\n")), "\n\n")

    return T.trim_ws(_once(lines, by_sheet))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _container_text(opened: Column, mime: Column) -> Column:
    """The text of an opened file by its format, from its own row."""
    units = opened["units"]
    by_number = F.array_sort(F.transform(units, lambda u: F.struct(u["ordinal"].alias("ordinal"), T.trim_ws(F.array_join(_cells(u), " ")).alias("line"))))
    return (
        F.when(mime == T.MIME["csv"], F.array_join(F.transform(units, lambda u: F.array_join(_cells(u), ", ")), "\n"))
        .when(mime.isin(T.MIME["docx"], T.MIME["odt"]), _join(F.transform(units, lambda u: F.array_join(_cells(u), "")), "\n\n"))
        .when(mime == T.MIME["pptx"], T.trim_ws(_join(by_number["line"], "\n\n")))
        .when(mime == T.MIME["xlsx"], _sheets(opened))
        .when(mime == T.MIME["epub"], _join(F.transform(units, lambda u: T.collapse_ws(F.array_join(_cells(u), ""))), "\n\n"))
    )


def extract_corpus(files: DataFrame, use_ocr: bool = False) -> DataFrame:
    """(path, name, mime, text, n_chars, error) of each file of scan_corpus, or of routed() where other types may occur.

    One scan and no shuffle: a file's text is made in its own row. Text, Markdown, HTML, RTF and legacy documents are read by built-in expressions,
    and Python gets the bytes of zipped XML and of CSV only. A file that cannot be read has the message as its error. PDF pages
    and OCR words come from outside; see operators.layout.
    """
    mime = F.col("mime")
    by_python = mime.isin(*[T.MIME[e] for e in (*CONTAINERS, "csv")])
    ext = F.try_element_at(F.create_map(*[F.lit(x) for e in (*CONTAINERS, "csv") for x in (T.MIME[e], e)]), mime)
    rows = files.select(*HEAD, F.when(~by_python, F.col("content")).alias("content"), _open(F.when(by_python, F.col("content")), ext).alias("opened"))
    words = T.utf8_text(F.col("content"))
    text = (
        F.when(by_python, _container_text(F.col("opened"), mime))
        .when(mime.isin(T.MIME["txt"], T.MIME["md"]), words)
        .when(mime == T.MIME["html"], T.html_text(words))
        .when(mime == T.MIME["rtf"], T.rtf_text(words))
        .when(mime == T.MIME["doc"], T.doc_text(F.col("content")))
    )
    # A generator of one row stands between: the text is computed once, however often it is named below.
    found = rows.select(*HEAD, F.col("opened.found"), F.col("opened.body"), F.col("opened.broken"), F.explode(F.array(text)).alias("text"))
    empty = T.trim_ws(F.coalesce("text", F.lit(""))) == ""
    named = F.coalesce(F.nullif("mime", F.lit("")), F.nullif("ext", F.lit("")), F.lit("unknown"))
    error = (
        F.when(F.lit(use_ocr) & (mime != T.MIME["pdf"]), F.concat(F.lit("OCR is only supported for PDFs; got "), named, F.lit(". Disable the OCR toggle for this document.")))
        .when(~mime.isin(*set(T.MIME.values())), F.concat(F.lit("Unsupported file type: "), F.col("ext"), F.lit(". " + MESSAGES["unsupported"])))
        .when(F.col("broken").isNotNull(), F.col("broken"))
    )
    for kind in ("docx", "odt", "pptx", "xlsx"):
        there = F.col("found" if kind in ("docx", "odt") else "body")
        error = error.when(~F.coalesce(there, F.lit(False)) & (mime == T.MIME[kind]), MESSAGES[kind])
    for kind, message in (("pptx", "pptx_empty"), ("xlsx", "xlsx_empty"), ("csv", "csv"), ("rtf", "rtf"), ("html", "html"), ("doc", "doc")):
        error = error.when((mime == T.MIME[kind]) & empty, MESSAGES[message])
    text = F.when(F.col("error").isNull(), F.when(mime == T.MIME["pdf"], F.col("text")).otherwise(F.coalesce("text", F.lit(""))))
    done = found.withColumn("error", error).withColumn("text", text)
    return done.select("path", "name", "mime", "text", F.length("text").cast("long").alias("n_chars"), "error")


def split_outcome(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error, the first without that column."""
    return df.filter("error is null").drop("error"), df.filter("error is not null")


def wav_bytes(jobs: DataFrame) -> DataFrame:
    """(job_id, wav) of jobs (job_id, audio, sample_rate): a 44-byte header and 16-bit little-endian samples."""
    import struct

    from lectern.functions.audio import pcm16

    def run(batches):
        for batch in batches:
            out = []
            for job_id, pcm, rate in zip(*(batch[c] for c in ("job_id", "pcm", "sample_rate"))):
                n = 2 * len(pcm)
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, int(rate), 2 * int(rate), 2, 16, b"data", n)
                out.append((job_id, head + pd.Series(pcm, dtype="int16").to_numpy().astype("<i2").tobytes()))
            yield pd.DataFrame(out, columns=["job_id", "wav"])

    return jobs.select("job_id", pcm16(F.col("audio")).alias("pcm"), "sample_rate").mapInPandas(run, "job_id string, wav binary")


def wav_export(jobs: DataFrame, out_dir: str) -> None:
    """Written as Parquet (job_id, wav): one object store write a task and not a file a job."""
    wav_bytes(jobs).write.mode("append").parquet(out_dir)
