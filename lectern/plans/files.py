"""Queries that run file extraction, export and synthesis over the given tables as files and jobs."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audio as O
from lectern.plans.common import TURNS_SQL, as_files, table, turns
from lectern.plans.text import _HTML, WS
from lectern.sources import files as S


def extracted_corpus(spark, sf_dir):
    """Pages as HTML files, documents as text and Markdown files, and conversations as CSV files, through the router of formats."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    texts = table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("/d/"),
            "doc_id",
            F.when(F.col("doc_id") % 10 == 0, ".bin").when(F.col("doc_id") % 2 == 1, ".TXT").otherwise(".md")
        ).alias("path"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "role", quoted)
    sheets = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))["line"], "\r\n").alias("csv")
    )
    sheets = sheets.select(F.concat(F.lit("/c/"), "conv_id", F.lit(".csv")).alias("path"), F.col("csv").cast("binary").alias("content"))
    out = S.extract_corpus(S.routed(pages.unionByName(texts).unionByName(sheets)))
    return out.select("path", "mime", F.sha2("text", 256).alias("sha"), F.col("error").isNotNull().alias("failed"))


def rtf_documents(spark, sf_dir):
    """Documents as RTF files, without the signs that RTF itself uses."""
    body = F.translate(F.coalesce("text", F.lit("")), "\\{}", "")
    rtf = F.concat(F.lit("{\\rtf1\\ansi "), F.replace(body, F.lit("\n"), F.lit("\\par ")), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.rtf_text(rtf), 256).alias("sha"))


def wav_files(spark, sf_dir):
    """Embeddings as mono audio files."""
    jobs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("job_id"), F.col("embedding").alias("audio"), F.lit(24000).alias("sample_rate"))
    sample = lambda at: F.expr(f"substring(wav, {at}, 2)")
    number = lambda b: F.conv(F.concat(F.hex(F.substring(b, 2, 1)), F.hex(F.substring(b, 1, 1))), 16, 10).cast("int")
    signed = lambda n: F.when(n >= 32768, n - 65536).otherwise(n)
    rows = S.wav_bytes(jobs)
    return rows.select(
        "job_id",
        F.length("wav").cast("long").alias("n_bytes"),
        F.hex(F.substring("wav", 1, 44)).alias("head"),
        signed(number(sample(45))).alias("first"),
        signed(number(sample("length(wav) - 1"))).alias("last")
    )


_PACKAGE = '<p><manifest>{0}</manifest><spine>{1}</spine></p>'
_OFFICE = ("docx", "odt", "pptx", "xlsx", "epub")


def _made(rows, make):
    """(path, content) that make gives for frames of rows; Arrow's batches have thousands of rows and become Python objects in smaller parts."""
    kind = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        small = (b.slice(at, S.FILES_AT_ONCE).to_pandas() for b in batches for at in range(0, b.num_rows, S.FILES_AT_ONCE))
        yield from (pa.RecordBatch.from_pandas(files, kind, preserve_index=False) for files in make(small))

    return rows.mapInArrow(run, "path string, content binary")


def _containers(batches):
    """Zipped XML files of lines, in the format that ext names."""
    import io
    import zipfile

    for rows in batches:
        out = []
        for ext, lines in zip(rows["ext"], rows["lines"]):
            n = range(len(lines))
            if ext == "docx":
                parts = {"word/document.xml": '<w:d xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>{x[:3]}</w:t></w:r><w:r><w:t>{x[3:]}</w:t></w:r></w:p>" for x in lines) + "</w:d>"}
            elif ext == "odt":
                parts = {
                    "content.xml": '<d xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h>no</text:h>' + "".join(
                        f"<text:p>{x[:2]}<text:span>{x[2:]}</text:span></text:p>" for x in lines
                    ) + "</d>"
                }
            elif ext == "pptx":
                parts = {f"ppt/slides/slide{k + 1}.xml": f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:t>{lines[k]}</a:t></p>' for k in reversed(n)}
            elif ext == "xlsx":
                cells = "".join(
                    f'<row><c t="s"><v>{k}</v></c><c t="inlineStr"><is><t>{lines[k]}</t></is></c><c><v>{k}</v></c><c t="s"><v>{k + len(lines)}</v></c></row>' for k in n
                )
                parts = {"xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{x}</t></si>" for x in lines) + "</sst>", "xl/worksheets/sheet1.xml": f"<s>{cells}</s>"}
            else:
                parts = {
                    "META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>',
                    "O/p.opf": _PACKAGE.format(
                        "".join(f'<item id="i{k}" href="c{k}.xhtml"/>' for k in n),
                        "".join(f'<itemref idref="i{k}"/>' for k in n)
                    )
                }
                parts |= {f"O/c{k}.xhtml": f"<html><head><title>no</title></head><body><p>{lines[k]}</p></body></html>" for k in n}
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for name, body in parts.items():
                    z.writestr(name, body)
            out.append(raw.getvalue())
        yield pd.DataFrame({"path": rows["path"], "content": out})


def _clean_lines():
    """Lines of letters, digits, dots and spaces, which need no escapes in XML."""
    return F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9. \n]", ""), "\n", -1)


def office_texts(spark, sf_dir):
    """Documents as files of the five zipped formats, a fifth each."""
    ext = F.element_at(F.array(*map(F.lit, _OFFICE)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("/o/"), "doc_id", F.lit("."), ext).alias("path"), ext.alias("ext"), _clean_lines().alias("lines"))
    out = S.extract_corpus(S.routed(_made(rows, _containers)))
    return out.select("path", F.sha2("text", 256).alias("sha"), "error")


def _workbooks(batches):
    """Workbooks of lines over the sheets 1, 10 and 2 in turn, with shared strings, strings in their cells, a number and a string that is missing."""
    import io
    import zipfile

    for rows in batches:
        out = []
        for lines in rows["lines"]:
            sheets: dict[int, str] = {2: "", 10: "", 1: ""}
            for k, x in enumerate(lines):
                cells = f'<c t="s"><v>{k}</v></c><c t="inlineStr"><is><t>{x}</t></is></c><c><v>{k}</v></c><c t="s"><v>{len(lines)}</v></c>'
                sheets[(1, 10, 2)[k % 3]] += f"<row>{cells}</row><row><c t='s'><v>-1</v></c></row>"
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for number, body in sheets.items():
                    z.writestr(f"xl/worksheets/sheet{number}.xml", f"<s>{body}</s>")
                z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><r><t>{x[:4]}</t></r><r><t>{x[4:]}</t></r></si>" for x in lines) + "</sst>")
            out.append(raw.getvalue())
        yield pd.DataFrame({"path": rows["path"], "content": out})


def workbook_texts(spark, sf_dir):
    """Documents as workbooks of three sheets, which are read in order of their names: 1, 10, 2."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("/w/"), "doc_id", F.lit(".xlsx")).alias("path"), _clean_lines().alias("lines"))
    out = S.extract_corpus(S.routed(_made(rows, _workbooks)))
    return out.select("path", F.sha2("text", 256).alias("sha"), "error")


def csv_documents(spark, sf_dir):
    """Lines of documents as CSV rows with commas and quotes in quotes, quotes amid a field, all three line ends, and a blank line after the first row."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    first = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit(', ""q"""'))
    end = lambda i: F.when(i == 0, "\n\n").when(i % 3 == 0, "\n").when(i % 3 == 1, "\r").otherwise("\r\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(first(x), F.lit(',a"b,c"d,'), i.cast("string"), end(i))), "")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("/c/"), "doc_id", F.lit(".csv")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return S.extract_corpus(S.routed(rows)).select("path", F.sha2("text", 256).alias("sha"), "error")


def rtf_escapes(spark, sf_dir):
    """Documents as RTF files whose characters beyond ASCII are escapes: those of Latin-1 as bytes, all others as UTF-16 units."""
    unit = lambda c, at: F.concat(F.lit("\\u"), F.conv(F.substring(F.hex(F.encode(c, "UTF-16BE")), at, 4), 16, 10), F.lit("?"))

    def escaped(c):
        two = F.length(F.hex(F.encode(c, "UTF-16BE"))) == 8
        wide = F.when(two, F.concat(unit(c, 1), unit(c, 5))).otherwise(unit(c, 1))
        latin = F.concat(F.lit("\\'"), F.hex(F.encode(c, "ISO-8859-1")))
        plain = F.when(c == "\n", F.lit("\\par ")).when(c == "\t", F.lit("\\tab ")).otherwise(c)
        return F.when(F.octet_length(c) == 1, plain).when(F.ascii(c).between(160, 255), latin).otherwise(wide)

    body = F.translate(F.coalesce("text", F.lit("")), "\\{}", "")
    rtf = F.concat(F.lit("{\\rtf1\\ansi{\\b "), F.array_join(F.transform(F.split(body, ""), escaped), ""), F.lit("}}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.rtf_text(rtf), 256).alias("sha"))


def legacy_texts(spark, sf_dir):
    """Documents as UTF-16 bytes between control bytes, as legacy files hold them."""
    lines = F.array_join(_clean_lines(), "\n")
    content = F.concat(F.unhex(F.lit("D0CF11E001010000")), F.encode(F.concat(lines, F.lit("\n")), "UTF-16LE"), F.unhex(F.lit("01000200")))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("/l/"), "doc_id", F.lit(".doc")).alias("path"), content.alias("content"))
    return S.extract_corpus(S.routed(rows)).select("path", F.sha2("text", 256).alias("sha"), F.col("error").isNotNull().alias("failed"))


def corpus_scan(spark, sf_dir):
    """Documents written as text files in a folder for each language, and read back as a corpus to any depth."""
    path = S.scratch(spark)
    as_files(spark, sf_dir, path)
    texts, _ = S.split_outcome(S.extract_corpus(S.scan_corpus(spark, path)))
    lang = F.regexp_extract("path", r"lang=([^/]*)/", 1)
    return texts.groupBy(lang.alias("lang"), "mime").agg(F.sum("n_chars").alias("chars"))


def _tone(batches):
    """A backend for tests and queries: 24 samples a character, all of one value; it cannot speak empty texts."""
    for rows in batches:
        if (rows["text"] == "").any():
            raise ValueError("nothing to speak")
        yield pd.DataFrame({"job_id": rows["job_id"], "audio": [[0.25] * (24 * len(t)) for t in rows["text"]], "sample_rate": 24000, "word_timings": None})


def synthesised(spark, sf_dir):
    """Turns spoken by two registered backends and one that is missing."""
    backends = O.Backends()
    backends.register("even", _tone)
    backends.register("odd", _tone)
    model = F.when(F.col("session_id") % 5 == 0, "none").when(F.col("session_id") % 2 == 0, "even").otherwise("odd")
    jobs = turns(spark, sf_dir).select(F.concat_ws("-", "session_id", "chunk_index").alias("job_id"), model.alias("model_id"), "text")
    out = O.synthesize(jobs, backends)
    return out.groupBy("model_id", "error").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("audio").isNotNull(), F.size("audio"))), F.lit(0)).cast("long").alias("samples")
    )


QUERIES = {
    f.__name__: f
    for f in (extracted_corpus, office_texts, workbook_texts, csv_documents, legacy_texts, corpus_scan, rtf_documents, rtf_escapes, wav_files, synthesised)
}
ORACLES = {
    "extracted_corpus": f"""WITH {_HTML}
SELECT '/p/' || page_id || '.html' AS path, 'text/html' AS mime, CASE WHEN text <> '' THEN sha256(text) END AS sha, coalesce(text, '') = '' AS failed FROM ht
UNION ALL SELECT '/d/' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.bin' WHEN doc_id % 2 = 1 THEN '.TXT' ELSE '.md' END, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 2 = 1 THEN 'text/plain' ELSE 'text/markdown' END, CASE WHEN doc_id % 10 <> 0 THEN sha256(coalesce(text, '')) END, doc_id % 10 = 0 FROM documents
UNION ALL SELECT '/c/' || conv_id || '.csv', 'text/csv', sha256(string_agg(role || ', ' || coalesce(text, ''), chr(10) ORDER BY turn)), false FROM conversations GROUP BY conv_id""",
    "office_texts": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9. \n]', '', 'g'), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, list_filter(ls, lambda x: trim(x) <> '') AS full_lines, list_transform(list_zip(ls, range(len(ls))), lambda z: z[1] || ', ' || z[1] || ', ' || z[2] || ', ') AS sheet FROM l),
t AS (SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN trim(array_to_string(list_transform(full_lines, lambda x: trim(x)), chr(10) || chr(10)))
  WHEN 3 THEN rtrim(ltrim(array_to_string(sheet, chr(10)), ' ' || chr(10)), ' ' || chr(10)) WHEN 4 THEN array_to_string(list_transform(full_lines, lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), chr(10) || chr(10))
  ELSE array_to_string(full_lines, chr(10) || chr(10)) END AS x FROM n)
SELECT '/o/' || doc_id || '.' || ['docx', 'odt', 'pptx', 'xlsx', 'epub'][doc_id % 5 + 1] AS path, CASE WHEN doc_id % 5 <> 2 OR x <> '' THEN sha256(x) END AS sha, CASE WHEN doc_id % 5 = 2 AND x = '' THEN 'PPTX file contains no text data.' END AS error FROM t""",
    "legacy_texts": r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9. \n]', '', 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9. \n]', '', 'g'), chr(10)), 1) AS k FROM documents),
t AS (SELECT doc_id, string_agg(trim(x), chr(10) ORDER BY k) FILTER (trim(x) <> '') AS x FROM l GROUP BY doc_id)
SELECT '/l/' || doc_id || '.doc' AS path, sha256(x) AS sha, x IS NULL AS failed FROM t""",
    "corpus_scan": "SELECT coalesce(lang, 'none') AS lang, 'text/plain' AS mime, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars FROM documents GROUP BY ALL",
    "wav_files": """WITH q AS (SELECT vec_id, len(embedding) AS n, list_transform([embedding[1], embedding[len(embedding)]], lambda x: CAST(floor(least(1, greatest(-1, CAST(x AS DOUBLE))) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END + 0.5) AS INTEGER)) AS s FROM embeddings),
h AS (SELECT *, printf('%08X', 36 + 2 * n) AS r, printf('%08X', 2 * n) AS d FROM q)
SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(44 + 2 * n AS BIGINT) AS n_bytes, '52494646' || r[7:8] || r[5:6] || r[3:4] || r[1:2] || '57415645666D74201000000001000100C05D000080BB00000200100064617461' || d[7:8] || d[5:6] || d[3:4] || d[1:2] AS head, s[1] AS first, s[2] AS last FROM h""",
    "rtf_documents": rf"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '\{{}}', '') AS x FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), '\t +', chr(9), 'g'), ' +\t', chr(9), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM t)
SELECT doc_id, sha256(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')) AS sha FROM c""",
    "rtf_escapes": rf"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '\{{}}', '') AS x FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), '\t +', chr(9), 'g'), ' +\t', chr(9), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM t)
SELECT doc_id, sha256(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')) AS sha FROM c""",
    "workbook_texts": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9. \n]', '', 'g'), chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, k, ls[k + 1] || ', ' || ls[k + 1] || ', ' || k || ', ' AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM l)),
t AS (SELECT doc_id, k % 3 AS sheet, string_agg(line, chr(10) ORDER BY k) AS x FROM r GROUP BY ALL),
d AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY sheet) AS x FROM t GROUP BY doc_id)
SELECT '/w/' || doc_id || '.xlsx' AS path, sha256(rtrim(ltrim(x, ' ' || chr(10)), ' ' || chr(10))) AS sha, CAST(NULL AS VARCHAR) AS error FROM d""",
    "csv_documents": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, list_transform(ls, lambda x, i: x || ', "q", ab,cd, ' || (i - 1) || CASE WHEN i = 1 THEN chr(10) ELSE '' END) AS rows FROM l)
SELECT '/c/' || doc_id || '.csv' AS path, sha256(array_to_string(rows, chr(10))) AS sha, CAST(NULL AS VARCHAR) AS error FROM r""",
    "synthesised": f"WITH {TURNS_SQL}, j AS (SELECT CASE WHEN session_id % 5 = 0 THEN 'none' WHEN session_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model_id, text FROM tu), r AS (SELECT model_id, CASE WHEN model_id = 'none' THEN 'Custom engine for none not registered' WHEN text = '' THEN 'nothing to speak' END AS error, text FROM j) SELECT model_id, error, count(*) AS n, CAST(coalesce(sum(CASE WHEN error IS NULL THEN 24 * length(text) END), 0) AS BIGINT) AS samples FROM r GROUP BY model_id, error",
}
