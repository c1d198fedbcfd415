import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import text as O


def one(spark, column, **values):
    names = list(values)
    ddl = ", ".join(f"{n} {'int' if isinstance(v, int) else 'binary' if isinstance(v, bytes) else 'array<double>' if isinstance(v, list) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first().x


SENTENCES = [
    ("Hello. World! How are you?", ["Hello.", "World!", "How are you?"]),
    ("Mr. Smith went to Washington. He arrived at noon.", ["Mr. Smith went to Washington.", "He arrived at noon."]),
    ("On Jan. 5, 2024, the meeting was held.", ["On Jan. 5, 2024, the meeting was held."]),
    ("你好。世界！你好吗？", ["你好。", "世界！", "你好吗？"]),
    ("", []),
    ("  \n \n ", []),
    ('"Stop!" she shouted. He ran.', ['"Stop!', '"', "she shouted.", "He ran."]),
    ("3.14", ["3.", "14"]),
    ("Wait...", ["Wait.", ".", "."]),
    ("no end", ["no end"]),
    (None, []),
]


@pytest.mark.parametrize("text,expected", SENTENCES)
def test_sentences(spark, text, expected):
    rows = one(spark, T.sentence_array(F.col("t")), t=text)
    assert [r.text for r in rows] == expected
    assert [r.global_index for r in rows] == list(range(len(expected)))


def test_paragraph_index_counts_blank_pieces(spark):
    rows = one(spark, T.sentence_array(F.col("t")), t="\n\nOne. Two.\n \nThree.")
    assert [(r.text, r.paragraph_index) for r in rows] == [("One.", 1), ("Two.", 1), ("Three.", 2)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 500 + ". short."), (2, "One. Two. Three."), (3, None), (4, "x" * 90 + ". " + "y" * 90 + ".")], "doc_id int, text string")
    rows = O.chunks(df, 100).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.text[:3], r.first_sentence, r.last_sentence, r.n_words) for r in rows] == [
        (1, 0, "aaa", 0, 0, 1),
        (1, 1, "sho", 1, 1, 1),
        (2, 0, "One", 0, 2, 3),
        (4, 0, "xxx", 0, 0, 1),
        (4, 1, "yyy", 1, 1, 1)
    ]
    assert rows[2].text == "One. Two. Three."


@pytest.mark.parametrize(
    "name,ext,mime",
    [
        ("a.PDF", "pdf", "application/pdf"),
        ("x", "", "f"),
        (".hidden", "hidden", "f"),
        ("a.", "", "f"),
        ("a.tar.htm", "htm", "text/html"),
        ("n.Markdown", "markdown", "text/markdown")
    ]
)
def test_types(spark, name, ext, mime):
    assert one(spark, T.file_extension(F.col("n")), n=name) == ext
    assert one(spark, T.mime_type(T.file_extension(F.col("n")), F.lit("f")), n=name) == mime


U = chr(92) + "u"  # the control word for a character
RTF = [
    (r"{\rtf1 Hello\par World}", "Hello\nWorld"),
    (f"{U}20320?{U}22909?", chr(20320) + chr(22909)),
    (r"caf\'e9", "caf" + chr(0xE9)),
    (f"{U}-32768?x", chr(0x8000) + "x"),
    (r"a\tab  b", "a\tb"),
    (r"{\b bold} {\i  it}", "bold it"),
    (f"{U}55357?{U}56832?!", chr(0x1F600) + "!"),
    (f"{U}55357?!", chr(0xFFFD) + "!"),
    (f"{U}-x", "x"),
    ("", ""),
    (r"a\{b\}c\\d", "abc"),
]


@pytest.mark.parametrize("rtf,expected", RTF)
def test_rtf(spark, rtf, expected):
    assert one(spark, T.rtf_text(F.col("r")), r=rtf) == expected


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><p>A&nbsp;&lt;b&gt;</p><script>x</p></script><p>B &amp;lt;</p><!-- c -->"
    assert one(spark, T.html_text(F.col("h")), h=page) == "A <b>B &lt;"


def test_doc(spark):
    raw = b"\xd0\xcf" + "ok\n".encode("utf-16le") + b"\x01" + "ab".encode("utf-16le") + b"\x02\x03" + "long é run".encode("utf-16le")
    assert one(spark, T.doc_text(F.col("c")), c=raw) == "ok\nlong é run"


def test_space_and_markup(spark):
    assert one(spark, T.collapse_ws(F.col("t")), t="﻿ a  b\n") == "a b"
    assert one(spark, T.escape_html(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, T.utf8_text(F.col("c")), c=b"\xef\xbb\xbfa\xff") == "a�"


@pytest.mark.parametrize("quad,box", [([0.0, 0, 4, 0, 4, 2, 0, 2], (0, 0, 4, 2)), ([5.0, 1, 9, 5, 5, 9, 1, 5], (1, 1, 9, 9)), ([-3.0, -4, 1, -4, 1, 2, -3, 2], (-3, -4, 1, 2))])
def test_quads(spark, quad, box):
    assert tuple(one(spark, T.quad_to_bbox(F.col("q")), q=[float(x) for x in quad])) == box


def test_symbols(spark, tmp_path):
    from lectern.operators.catalog import vocab_df

    assert one(spark, T.symbol_ids(F.col("t"), {"$": 1, "a": 7}), t="ab") == [1, 7, 0, 1]
    (tmp_path / "v.json").write_text('{"model": {"vocab": {"a": 3, "$": 0}}}')
    vocabulary = vocab_df(spark, str(tmp_path / "v.json"))
    assert {tuple(r) for r in vocabulary.collect()} == {("a", 3), ("$", 0)}
    df = spark.createDataFrame([("aab",), ("",)], "phonemes string")
    assert [tuple(r) for r in O.oov_report(df, vocabulary).collect()] == [("b", 1)]


def test_progress_and_pairs(spark):
    df = spark.createDataFrame([("page 3/0",), ("Page 7 / 3",), ("OCR page 2: 45%",), ("x",), (None,)], "message string")
    assert [(r.kind, r.percent) for r in O.parse_progress(df).collect()] == [("pages", 100), ("pages", 100), ("ocr", 45), ("indeterminate", None), ("none", None)]
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], [[1.0] * 8]), (2, [], [])], "page int, labels array<string>, quad_boxes array<array<double>>")
    assert [(r.page, r.text, len(r.words)) for r in O.pair_words(pairs).collect()] == [(1, "a b c", 1), (2, "", 0)]


def test_sentence_patterns_split_as_the_plain_ones(spark):
    """Dots are looked at before abbreviations, and end signs are marked in one pass; ASCII comes first in the class of ink."""
    from pyspark.sql import functions as F
    from lectern.functions import text as T

    texts = ["Dr. No. Smith vs. 5 etc. x", 'a."b".\'c\'. no.no. X mr.', "xno. A 1st. B (al. C)...?!\" Ü.’", "。」一！ ﻿é. NO. Z", ".", "'", " . ' .", "e.g. A. eds.  “Q”"]
    assert T._pieces.__doc__ and T.INK.startswith("[!-~")

    def plain(p):
        guard = rf"(?<![A-Za-z0-9_])((?i:{'|'.join(T.ABBREVIATIONS)}))\.(?={T.SPACE}+[{T.FOLLOWS}])"
        text = F.regexp_replace(F.regexp_replace(T.trim_ws(p), guard, "$1\u0001"), f"([{T.ENDS}])", "$1\u0002")
        parts = F.split(F.regexp_replace(text, f"\u0002([{T.CLOSES}])", "\u0002$1\u0002"), "\u0002")
        return F.filter(F.transform(parts, lambda s: T.trim_ws(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")

    p = F.col("p")
    slow = F.regexp_extract_all(p, F.lit(f"[^{T._SPACES}]+"), F.lit(0))
    for r in spark.createDataFrame([(t,) for t in texts], "p string").select("p", T._pieces(p).alias("a"), plain(p).alias("b"), T.words(p).alias("c"), slow.alias("d")).collect():
        assert r.a == r.b and r.c == r.d
