import io
import zipfile

import pytest

from lectern.sources import files as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
O = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:office="o"'


def container(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return raw.getvalue()


FILES = {
    "a.docx": container(
        **{
            "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"
        }
    ),
    "b.odt": container(**{"content.xml": f"<office:d {O}><text:h>No</text:h><text:p>One <text:span>x</text:span></text:p><text:p> </text:p><text:p>Two</text:p></office:d>"}),
    "c.pptx": container(**{f"ppt/slides/slide{n}.xml": f"<p {A}><a:t>s{n}</a:t><a:t>t</a:t></p>" for n in (10, 2)}),
    "d.xlsx": container(
        **{
            "xl/sharedStrings.xml": f"<sst {X}><si><t>na</t><t>me</t></si></sst>",
            "xl/worksheets/sheet10.xml": f'<s {X}><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c><v> </v></c></row></s>',
            "xl/worksheets/sheet2.xml": f'<s {X}><row><c t="inlineStr"><is><t>in</t></is></c><c t="s"><v>9</v></c></row></s>'
        }
    ),
    "e.epub": container(
        **{
            "META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>',
            "O/p.opf": '<p><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></p>',
            "O/a.xhtml": "<html><head><title>t</title></head><body><p>A  a</p></body></html>",
            "O/b.xhtml": "<html><body>B</body></html>"
        }
    ),
    "f.csv": 'a,"b ""q"", c"\r\n\r\nx,y'.encode(),
    "g.html": b"<html><body><p>Hi &amp; ho</p></body></html>",
    "h.rtf": rb"{\rtf1 Fox\par Two}",
    "i.txt": b"plain\n text",
    "j.MD": b"# head",
    "k.doc": "words here\n".encode("utf-16le"),
    "sub/l.htm": b"<p>deep",
    "m.docx": b"not a zip",
    "n.docx": container(other="x"),
    "o.pptx": container(other="x"),
    "p.csv": b"  ",
    "q.rtf": b"{}",
    "r.doc": b"\x01",
    "z.bin": b"no",
}
EXPECTED = {
    "a.docx": "Hello\n\nTwo",
    "b.odt": "One x\n\nTwo",
    "c.pptx": "s2 t\n\ns10 t",
    "d.xlsx": "name, 5\n\nin,",
    "e.epub": "B\n\nA a",
    "f.csv": 'a, b "q", c\n\nx, y',
    "g.html": "Hi & ho",
    "h.rtf": "Fox\nTwo",
    "i.txt": "plain\n text",
    "j.MD": "# head",
    "k.doc": "words here",
    "l.htm": "deep"
}
ERRORS = {"n.docx": S.MESSAGES["docx"], "o.pptx": S.MESSAGES["pptx"], "p.csv": S.MESSAGES["csv"], "q.rtf": S.MESSAGES["rtf"], "r.doc": S.MESSAGES["doc"]}


@pytest.fixture
def corpus(tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_extract(spark, corpus):
    out = S.extract_corpus(S.scan_corpus(spark, corpus)).cache()
    good, bad = S.split_outcome(out)
    assert {r.name: r.text for r in good.collect()} == EXPECTED
    errors = {r.name: r.error for r in bad.collect()}
    assert {k: errors[k] for k in ERRORS} == ERRORS and "BadZipFile" in errors["m.docx"] and len(errors) == 6
    everything = S.routed(spark.read.format("binaryFile").load(corpus + "/z.bin"))
    assert S.extract_corpus(everything).first().error.startswith("Unsupported file type: bin.")
    assert all("OCR is only supported" in r.error for r in S.extract_corpus(S.scan_corpus(spark, corpus + "/i.txt"), use_ocr=True).collect())


@pytest.mark.parametrize(
    "text,rows",
    [
        ("", []),
        ("a,b\n", [["a", "b"]]),
        ("a\r\rb", [["a"], [""], ["b"]]),
        ('x"y,z"w', [["xy,zw"]]),
        ('"a""b"', [['a"b']]),
        ('""', []),
        ('"",', [["", ""]]),
        ('"a\nb",c', [["a\nb", "c"]]),
        ("a,", [["a", ""]]),
        ('""""', [['"']]),
        ('a""b', [["ab"]]),
        ('"open', [["open"]])
    ],
)
def test_csv(text, rows):
    assert S.csv_fields(text) == rows


def test_wav(spark, tmp_path):
    df = spark.createDataFrame([("a", [2.5, -3.0, float("nan"), 1.0], 24000), ("b", [], 8000)], "job_id string, audio array<float>, sample_rate int")
    rows = {r.job_id: bytes(r.wav) for r in S.wav_bytes(df).collect()}
    assert rows["a"][:4] == b"RIFF" and len(rows["a"]) == 52 and rows["a"][44:] == b"\xff\x7f\x00\x80\x00\x00\xff\x7f" and len(rows["b"]) == 44
    S.wav_export(df, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def test_stream(spark, corpus, tmp_path_factory):
    from lectern.streaming import flows

    out = str(tmp_path_factory.mktemp("out"))
    for _ in range(2):  # the second run finds nothing new
        flows.stream_corpus(spark, corpus, out + "/good", out + "/bad", out + "/check").awaitTermination()
    assert spark.read.parquet(out + "/good").count() == len(EXPECTED)
    assert spark.read.parquet(out + "/bad").count() == 6


def test_extraction_is_one_scan_without_a_shuffle(spark, corpus):
    """Bytes of plain formats do not go to Python, no part is joined or shuffled, and nothing is written on the way."""
    plan = S.extract_corpus(S.scan_corpus(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and plan.count("ArrowEvalPython") == 1
    assert not any(node in plan for node in ("Exchange", "Join", "Aggregate", "MapInPandas"))


@pytest.mark.parametrize("ext", ["docx", "odt", "pptx", "xlsx", "epub"])
def test_rows_of_parts_give_the_same_text(spark, ext):
    """The functions on tables of parts and the text made within a row agree."""
    from lectern.plans.files import _containers

    lines = [["one two", "", " ", "three. four"], ["x"], [f"line {k}" for k in range(12)], ["", "a  b"]]
    made = spark.createDataFrame([(f"/o/{k}.{ext}", ext, x) for k, x in enumerate(lines)], "path string, ext string, lines array<string>")
    files = S.routed(made.mapInPandas(_containers, "path string, content binary"))
    whole = {r.path: r.text for r in S.extract_corpus(files).collect() if r.error is None}
    parts = {r.path: r.text for r in S.CONTAINERS[ext](S.explode_container(files)).collect()}
    assert whole == parts and len(parts) == len(lines)


def test_odd_containers(spark):
    """Cells without a value, shared strings by odd numbers, chapters that are missing, nulls and empty files."""
    sheet = f'<s {X}><row><c t="s"><v>-1</v></c><c t="s"><v> 1x</v></c><c t="s"><v>9</v></c><c/></row></s>'
    files = {
        "a.xlsx": container(**{"xl/sharedStrings.xml": f"<sst {X}><si><t>zero</t></si><si><t>one</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}),
        "b.xlsx": container(**{"xl/worksheets/sheet1.xml": f"<s {X}/>"}),
        "c.pptx": container(**{"ppt/slides/slide1.xml": f"<p {A}/>"}),
        "d.epub": container(
            **{
                "META-INF/container.xml": '<c><rootfile full-path="p.opf"/></c>',
                "p.opf": '<p><manifest><item id="a" href="no.xhtml"/></manifest><spine><itemref idref="a"/></spine></p>'
            }
        ),
        "e.docx": b"",
        "f.csv": b"",
        "g.txt": b"",
        "h.docx": None,
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r.path: (r.text, r.error) for r in S.extract_corpus(S.routed(df)).collect()}
    assert got["a.xlsx"] == (", one, ,", None)
    assert got["b.xlsx"] == (None, S.MESSAGES["xlsx_empty"]) and got["c.pptx"] == (None, S.MESSAGES["pptx_empty"])
    assert got["d.epub"] == ("", None) and got["g.txt"] == ("", None)
    assert "BadZipFile" in got["e.docx"][1] and got["f.csv"] == (None, S.MESSAGES["csv"]) and got["h.docx"] == (None, S.MESSAGES["docx"])


def test_byte_order_marks(spark):
    """One mark at the start of a text goes, whether or not the rest is valid UTF-8; others stay."""
    df = spark.createDataFrame([("a.txt", b"\xef\xbb\xbfx\xff"), ("b.md", b"\xef\xbb\xbf\xef\xbb\xbf"), ("c.txt", b"\xef\xbb"), ("d.txt", b"x\xef\xbb\xbf")], "path string, content binary")
    assert {r.path: r.text for r in S.extract_corpus(S.routed(df)).collect()} == {"a.txt": "x�", "b.md": "﻿", "c.txt": "�", "d.txt": "x﻿"}


@pytest.fixture
def one_file(spark, tmp_path):
    """A table of 1000 documents in one file, as a task of a larger table has them."""
    rows = spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 9 = 0, null, 'en') as lang")
    rows.coalesce(1).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    return str(tmp_path / "t")


def written_files(spark, monkeypatch, query, sf_dir, tmp_path):
    """The documents in each of the files that a query writes, and the query's rows."""
    numbers = iter(range(99))
    monkeypatch.setattr(S, "scratch", lambda _: str(tmp_path / f"s{next(numbers)}"))
    rows = query(spark, sf_dir).collect()
    return [len(p.read_bytes().splitlines()) for p in (tmp_path / "s0").rglob("*.txt")], {r.lang: r.chars for r in rows}


CHARS = {"none": sum(len(f"text {k}\n") for k in range(0, 1000, 9)), "en": sum(len(f"text {k}\n") for k in range(1000) if k % 9)}


def test_a_scanned_corpus_has_small_files(spark, monkeypatch, one_file, tmp_path):
    from lectern.plans import files

    sizes, chars = written_files(spark, monkeypatch, files.corpus_scan, one_file, tmp_path)
    assert sum(sizes) == 1000 and max(sizes) <= 100 and chars == CHARS


def test_a_streamed_corpus_has_small_files_and_reads_few_rows_at_once(spark, monkeypatch, one_file, tmp_path):
    from lectern.plans import streams
    from lectern.streaming import flows

    seen, extract = [], S.extract_corpus

    def noted(files):
        seen.append(files.sparkSession)
        return extract(files)

    monkeypatch.setattr(S, "extract_corpus", noted)
    sizes, chars = written_files(spark, monkeypatch, streams.streamed_corpus, one_file, tmp_path)
    assert sum(sizes) == 1000 and max(sizes) <= 100 and chars == CHARS
    assert seen and all(s.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(flows.ROWS_AT_ONCE) for s in seen)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"


def test_python_holds_few_opened_files(spark, monkeypatch):
    """What is opened goes back in parts of 64 files, however many rows a batch has."""
    seen, udf = [], S.F.arrow_udf
    monkeypatch.setattr(S.F, "arrow_udf", lambda kind: lambda f: seen.append(f) or udf(kind)(f))
    rows = spark.range(1000).selectExpr("concat(id, '.csv') as path", "cast(concat('a,', id) as binary) as content").coalesce(1)
    got = {r.path: r.text for r in S.extract_corpus(S.routed(rows)).collect()}
    assert got == {f"{k}.csv": f"a, {k}" for k in range(1000)}
    raw, ext = S.pa.array([b"a,b"] * 1000), S.pa.array(["csv"] * 1000)
    assert [len(x) for x in seen[0](iter([(raw, ext)]))] == [64] * 15 + [40]
