"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import text as O
from lectern.operators.catalog import vocab_df
from lectern.plans.common import documents, table
from lectern.sources import files as S

#: White space in the other engine's notation.
WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_ABBR = "|".join(T.ABBREVIATIONS)
_FOLLOWS = T.FOLLOWS.replace("'", "''")
_GUARD = rf"'(^|[^A-Za-z0-9_])((?i:{_ABBR}))\.({WS}+[{_FOLLOWS}])', '\1\2' || chr(1) || '\3', 'g'"
_CLOSES = T.CLOSES.replace("'", "''")
DOCS_SQL = rf"docs AS (SELECT doc_id, lang, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents)"
PARAGRAPHS_SQL = rf"""{DOCS_SQL},
split AS (SELECT doc_id, lang, regexp_split_to_array(translate(text, chr(1) || chr(2), ''), '\n{WS}*\n') AS ps FROM docs),
pieces AS (SELECT doc_id, lang, unnest(range(len(ps))) AS paragraph_index, unnest(ps) AS raw FROM split),
paras AS (SELECT doc_id, lang, paragraph_index, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS text FROM pieces)"""
SENTENCES_SQL = rf"""{PARAGRAPHS_SQL},
kept AS (SELECT doc_id, lang, paragraph_index, regexp_replace(regexp_replace(text, {_GUARD}), {_GUARD}) AS text FROM paras WHERE text <> ''),
marked AS (SELECT doc_id, lang, paragraph_index, string_split(regexp_replace(regexp_replace(text, '([.!?。！？…])', '\1' || chr(2), 'g'), chr(2) || '([{_CLOSES}])', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS parts FROM kept),
parted AS (SELECT doc_id, lang, paragraph_index, unnest(range(len(parts))) AS k, unnest(parts) AS part FROM marked),
trimmed AS (SELECT doc_id, lang, paragraph_index, k, regexp_replace(replace(part, chr(1), '.'), '^{WS}+|{WS}+$', '', 'g') AS text FROM parted),
sents AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, k) - 1 AS INTEGER) AS global_index, CAST(paragraph_index AS INTEGER) AS paragraph_index, text,
  len(regexp_extract_all(text, '[^{WS[1:]}+')) AS n_words FROM trimmed WHERE text <> '')"""
CHUNKS_SQL = rf"""WITH RECURSIVE {SENTENCES_SQL},
sized AS (SELECT doc_id, lang, global_index, text, n_words, length(text) AS n FROM sents),
walk AS (
  SELECT doc_id, lang, global_index, n, text, n_words, 0 AS chunk_index, n AS used FROM sized WHERE global_index = 0
  UNION ALL
  SELECT s.doc_id, s.lang, s.global_index, s.n, s.text, s.n_words,
    CASE WHEN w.used + 1 + s.n <= 300 THEN w.chunk_index ELSE w.chunk_index + 1 END,
    CASE WHEN w.used + 1 + s.n <= 300 THEN w.used + 1 + s.n ELSE s.n END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.global_index = w.global_index + 1),
ch AS (SELECT doc_id, lang, chunk_index, string_agg(text, ' ' ORDER BY global_index) AS text, min(global_index) AS first_sentence, max(global_index) AS last_sentence, sum(n_words) AS n_words FROM walk GROUP BY doc_id, lang, chunk_index)"""


def prepare_by_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = O.prepare_reader_data(docs, id_col="lang").select(
        "lang",
        F.size("sentences").alias("s"),
        F.size("chunks").alias("k"),
        F.aggregate("sentences", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"])).alias("c")
    )
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("s").alias("sentences"), F.sum("k").alias("chunks"), F.sum("c").alias("characters"))


def sentences(spark, sf_dir):
    rows = O.sentences(documents(spark, sf_dir))
    return rows.select("doc_id", "global_index", "paragraph_index", "text", F.size("words").cast("long").alias("n_words"))


def paragraphs(spark, sf_dir):
    return O.paragraphs(documents(spark, sf_dir)).select("doc_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), "text")


def chunks(spark, sf_dir):
    return O.chunks(documents(spark, sf_dir)).withColumn("n_words", F.col("n_words").cast("long"))


def reading_view(spark, sf_dir):
    return O.reading_view(O.sentences(documents(spark, sf_dir)))


def text_gates(spark, sf_dir):
    return O.text_gates(table(spark, sf_dir, "documents")).withColumn("n", F.col("n").cast("long"))


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


def html_references(spark, sf_dir):
    """Pages put into markup with quoted attributes, and with references by number and by name whose characters their ids choose."""
    n = (F.col("page_id") * 37 % 20000 + 161).cast("int")
    high = (F.col("page_id") % 60 + 128512).cast("int")
    head = F.concat(
        F.lit("<p title='a > b' data-x=\"it's > c\">"),
        F.lit("&#"),
        n,
        F.lit(";&#x"),
        F.hex(high),
        F.lit("; &amp;lt;&lt;&copy 5 &eacute;&notit;&#150;&bogus; a < b<!-- > --></p>")
    )
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.concat(head, F.coalesce("html", F.lit("")))).alias("text"))


def html_quarantine(spark, sf_dir):
    """Pages as extracted, by whether they gave text."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    marked = rows.withColumn("error", F.when(F.coalesce("text", F.lit("")) == "", S.MESSAGES["html"]))
    good, bad = S.split_outcome(marked)
    return good.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("outcome", F.lit("good")).unionByName(
        bad.groupBy().agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("chars")).withColumn("outcome", F.lit("quarantine"))
    )


def escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("sha"), F.length(T.escape_html(F.col("html"))).cast("long").alias("n"))


def collapsed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse_ws(F.coalesce("text", F.lit(""))), 256).alias("sha"))


def file_types(spark, sf_dir):
    """Extensions and media types of names made of page addresses."""
    last = F.substring_index(F.regexp_replace("url", r"[?#].*$", ""), "/", -1)
    ext = F.element_at(F.array(*[F.lit(e) for e in ("", ".pdf", ".DOCX", ".tar.Html", ".", ".md", ".xyz")]), (F.col("page_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(last, ext).alias("name"))
    return rows.withColumn("ext", T.file_extension(F.col("name"))).withColumn("mime", T.mime_type(F.col("ext"), F.lit("application/octet-stream")))


def admitted(spark, sf_dir):
    """Files as large as 100 bytes for each character of a document, and those that are let in."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.length("text"), F.lit(0)).cast("long") * 5000).alias("length"))
    return O.admit_files(rows)


def progress(spark, sf_dir):
    i = F.col("doc_id")
    message = F.when(
        i % 4 == 0,
        F.concat(F.lit("Processing PDF PAGE "), i % 90, F.lit(" / "), i % 70 + 1)
    ).when(i % 4 == 1, F.concat(F.lit("ocr page "), i, F.lit(": "), i % 101, F.lit("%"))).when(i % 4 == 2, "Extracting text").otherwise("")
    return O.parse_progress(table(spark, sf_dir, "documents").select("doc_id", message.alias("message"))).select("doc_id", "kind", "percent")


def loads(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.col("n_chars"), F.lit(0)).alias("loaded"),
        F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.coalesce(F.col("n_chars"), F.lit(0)) * 3 + 1000).cast("long").alias("total")
    )
    return O.load_progress(rows).select("doc_id", "percent", "size_mb")


def ocr_requests(spark, sf_dir):
    rows = file_types(spark, sf_dir).withColumn("use_ocr", F.col("page_id") % 2 == 0)
    return O.ocr_request(rows).select("page_id", F.col("error").isNotNull().alias("rejected"), "ui_ocr")


#: Signs of the documents as a vocabulary: letters by their place in the alphabet and some others, as fixed ids.
VOCABULARY = {c: i for i, c in enumerate("$;:,.!?-'() abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def symbols(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("phonemes"))
    ids = O.encode_symbols(rows, VOCABULARY)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1000003).alias("digest"))


def unknown_symbols(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("phonemes"))
    vocabulary = spark.createDataFrame(list(VOCABULARY.items()), "symbol string, id int")
    return O.oov_report(rows, vocabulary)


def vocabulary_symbols(spark, sf_dir):
    """Characters of English documents as a tokenizer's JSON file, with ids by code point; how often each occurs in all documents, with its id where the file has one."""
    rows = table(spark, sf_dir, "documents").select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("symbol")
    ).filter("symbol <> ''")
    counted = S.written(rows.groupBy("lang", "symbol").agg(F.count("*").alias("n")))
    symbols = counted.filter("lang = 'en'").agg(F.array_sort(F.collect_set("symbol")).alias("s"))  # as many as there are characters at most
    entries = F.map_from_arrays("s", F.transform("s", lambda _, i: i))
    path = S.scratch(spark)
    symbols.select(F.to_json(F.struct(F.struct(entries.alias("vocab")).alias("model")))).coalesce(1).write.text(path)
    known = vocab_df(spark, path)
    return counted.groupBy("symbol").agg(F.sum("n").alias("n")).join(known, "symbol", "left").select(F.hex("symbol").alias("symbol"), "n", F.col("id").cast("long").alias("id"))


def paired_words(spark, sf_dir):
    """Words of turns as labels, and a box for each of the first ones."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), F.split(F.coalesce("text", F.lit("")), " ").alias("labels"))
    boxes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("labels") - F.lit(2))), lambda i: F.array(*[i.cast("double") + k for k in range(8)]))
    out = O.pair_words(rows.withColumn("quad_boxes", boxes))
    return out.select("page", F.length("text").cast("long").alias("n_text"), F.size("words").cast("long").alias("n_pairs"), F.element_at("words", -1)["text"].alias("last_label"))


def quads(spark, sf_dir):
    box = T.quad_to_bbox(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", box.alias("b")).select("vec_id", "b.*")


QUERIES = {
    f.__name__: f for f in (
        prepare_by_language,
        sentences,
        paragraphs,
        chunks,
        reading_view,
        text_gates,
        html_text,
        html_references,
        html_quarantine,
        escaped,
        collapsed,
        file_types,
        admitted,
        progress,
        loads,
        ocr_requests,
        symbols,
        unknown_symbols,
        vocabulary_symbols,
        paired_words,
        quads
    )
}

_TYPES = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in T.MIME.items())
_NAMES = rf"""nm AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') || ['', '.pdf', '.DOCX', '.tar.Html', '.', '.md', '.xyz'][page_id % 7 + 1] AS name FROM pages),
ty AS (SELECT page_id, name, CASE WHEN instr(name, '.') = 0 THEN '' ELSE lower(regexp_extract(name, '([^.]*)$', 1)) END AS ext FROM nm),
ft AS (SELECT page_id, name, ext, CASE ext {_TYPES} ELSE 'application/octet-stream' END AS mime FROM ty)"""
#: Attributes of a tag, and what html_text takes out, in the other engine's notation.
_ATTR = r"""(?:[\s\x0B/]+|=?[^\s\x0B/>=]+(?:[\s\x0B]*=[\s\x0B]*(?:"[^"]*"|''[^'']*''|[^\s\x0B>"''][^\s\x0B>]*)?)?)*"""
_SILENT = "|".join(rf"<{e}(?:[\s\x0B/]{_ATTR})?>.*?(?:</{e}(?:[\s\x0B/][^>]*)?>|\z)" for e in ("script", "style", "noscript", "template", "title"))
_TAGS = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|{_SILENT}|</?[a-z][^\s\x0B/>]*{_ATTR}(?:>|\z)|</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|</[^a-z][^>]*(?:>|\z)"
_SQL = lambda x: "'" + x.replace("'", "''") + "'"
_NAMED = ", ".join(f"{_SQL(k)}: {_SQL(v)}" for k, v in T.REFERENCES.items())
_WINDOWS = " ".join(f"WHEN {k} THEN {_SQL(v)}" for k, v in T.WINDOWS.items() if v != chr(k))
#: References by the rule of html_text: all names, those without a semicolon by their longest beginning, and numbers.
_HTML = rf"""bare AS (SELECT page_id, regexp_replace(html, '{_TAGS}', '', 'g') AS h FROM pages),
cut AS (SELECT page_id, h, regexp_split_to_array(h, '&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)') AS p,
  regexp_extract_all(h, '&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)') AS r FROM bare),
known AS MATERIALIZED (SELECT MAP {{{_NAMED}}} AS named),
refs AS (SELECT r, regexp_extract(r, '^&({'|'.join(T.BARE)})', 1) AS b, regexp_extract(r, '^&#0*([0-9]*);?$', 1) AS ten, regexp_extract(r, '^&#[xX]0*([0-9A-Fa-f]*);?$', 1) AS hexa
  FROM (SELECT DISTINCT unnest(r) AS r FROM cut)),
numbers AS (SELECT *, CASE WHEN r[2] <> '#' THEN NULL WHEN r[3] IN ('x', 'X') THEN CASE WHEN length(hexa) > 6 THEN 1114112 WHEN hexa = '' THEN 0 ELSE CAST('0x' || hexa AS BIGINT) END
  WHEN length(ten) > 7 THEN 1114112 WHEN ten = '' THEN 0 ELSE CAST(ten AS BIGINT) END AS n FROM refs),
signs AS (SELECT r, CASE WHEN n IS NOT NULL THEN CASE n {_WINDOWS} ELSE chr(CAST(CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN 65533 ELSE n END AS INTEGER)) END
  ELSE coalesce(named[r[2:]], CASE WHEN b <> '' THEN named[b] || r[length(b) + 2:] END, r) END AS c FROM numbers, known),
told AS MATERIALIZED (SELECT map_from_entries(list((r, c))) AS told FROM signs),
open AS (SELECT page_id, regexp_replace(CASE WHEN len(r) = 0 THEN h ELSE array_to_string(list_transform(range(len(p)), lambda i: p[i + 1] || coalesce(told[r[i + 1]], '')), '') END, '{WS}+', ' ', 'g') AS text FROM cut, told),
ht AS (SELECT page_id, trim(text) AS text FROM open)"""
_LEN = "length(text)"
_SYMBOLS = " ".join(f"WHEN '{c.replace(chr(39), chr(39) * 2)}' THEN {i}" for c, i in VOCABULARY.items())

ORACLES = {
    "prepare_by_language": f"{CHUNKS_SQL}, per AS (SELECT doc_id, count(*) AS s, sum(length(text)) AS c FROM sents GROUP BY doc_id), pc AS (SELECT doc_id, count(*) AS k FROM ch GROUP BY doc_id) SELECT d.lang, count(*) AS documents, CAST(sum(coalesce(s, 0)) AS BIGINT) AS sentences, CAST(sum(coalesce(k, 0)) AS BIGINT) AS chunks, CAST(sum(coalesce(c, 0)) AS BIGINT) AS characters FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN pc USING (doc_id) GROUP BY d.lang",
    "sentences": f"WITH {SENTENCES_SQL} SELECT doc_id, global_index, paragraph_index, text, n_words FROM sents",
    "paragraphs": f"WITH {PARAGRAPHS_SQL} SELECT doc_id, paragraph_index, text FROM paras WHERE text <> ''",
    "chunks": f"{CHUNKS_SQL} SELECT doc_id, chunk_index, text, first_sentence, last_sentence, CAST(n_words AS BIGINT) AS n_words FROM ch",
    "reading_view": f"WITH {SENTENCES_SQL} SELECT doc_id, paragraph_index, min(global_index) AS first_sentence, string_agg(text, ' ' ORDER BY global_index) AS text FROM sents GROUP BY doc_id, paragraph_index",
    "text_gates": f"WITH t AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')) AS n FROM documents) SELECT doc_id, n, CASE WHEN n = 0 THEN 'blank' WHEN n > 20000 THEN 'too_long' ELSE 'ok' END AS session_gate, CASE WHEN n = 0 THEN 'blank' WHEN n > 2000 THEN 'too_long' WHEN n > 1800 THEN 'warn' ELSE 'ok' END AS request_gate FROM t",
    "html_text": f"WITH {_HTML} SELECT page_id, text FROM ht",
    "html_references": f"WITH {_HTML} SELECT page_id, trim(chr(CAST(page_id * 37 % 20000 + 161 AS INTEGER)) || chr(CAST(page_id % 60 + 128512 AS INTEGER)) || ' ' || chr(38) || 'lt;' || chr(60) || chr(169) || ' 5 ' || chr(233) || chr(172) || 'it;' || chr(8211) || chr(38) || 'bogus; a < b' || coalesce(text, '')) AS text FROM open",
    "html_quarantine": f"WITH {_HTML} SELECT count(*) AS n, CAST(coalesce(sum({_LEN}), 0) AS BIGINT) AS chars, 'good' AS outcome FROM ht WHERE coalesce(text, '') <> '' UNION ALL SELECT count(*), CAST(0 AS BIGINT), 'quarantine' FROM ht WHERE coalesce(text, '') = ''",
    "escaped": "WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS h FROM pages) SELECT page_id, sha256(h) AS sha, length(h) AS n FROM e",
    "collapsed": f"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))) AS sha FROM documents",
    "file_types": f"WITH {_NAMES} SELECT * FROM ft",
    "admitted": "SELECT doc_id, coalesce(length(text), 0) * 5000 AS length FROM documents WHERE coalesce(length(text), 0) * 5000 <= 26214400",
    "progress": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pages' WHEN 1 THEN 'ocr' WHEN 2 THEN 'indeterminate' ELSE 'none' END AS kind, CAST(CASE doc_id % 4 WHEN 0 THEN least(100, floor((doc_id % 90)::DOUBLE / (doc_id % 70 + 1) * 100 + 0.5)) WHEN 1 THEN doc_id % 101 END AS INTEGER) AS percent FROM documents",
    "loads": "WITH l AS (SELECT doc_id, coalesce(n_chars, 0) AS loaded, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE coalesce(n_chars, 0) * 3 + 1000 END AS total FROM documents) SELECT doc_id, CAST(CASE WHEN total > 0 THEN floor(loaded / total * 100 + 0.5) ELSE 0 END AS INTEGER) AS percent, CASE WHEN total > 0 THEN printf('%.1f', total / 1024 / 1024) ELSE '?' END AS size_mb FROM l",
    "ocr_requests": f"WITH {_NAMES} SELECT page_id, page_id % 2 = 0 AND mime <> 'application/pdf' AS rejected, page_id % 2 = 0 AND lower(name) LIKE '%.pdf' AS ui_ocr FROM ft",
    "symbols": f"WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, string_split('$' || coalesce(text, '') || '$', '') AS cs FROM conversations), m AS (SELECT doc_id, list_transform(cs, lambda c: CAST(CASE c {_SYMBOLS} ELSE 0 END AS BIGINT)) AS ids FROM c) SELECT doc_id, len(ids) AS n, list_reduce(ids, lambda a, x: (a * 31 + x) % 1000003, CAST(0 AS BIGINT)) AS digest FROM m",
    "vocabulary_symbols": """WITH c AS (SELECT lang, unnest(string_split(coalesce(text, ''), '')) AS symbol FROM documents), n AS (SELECT symbol, count(*) AS n FROM c WHERE symbol <> '' GROUP BY symbol),
k AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT symbol FROM c WHERE lang = 'en' AND symbol <> ''))
SELECT hex(symbol) AS symbol, n, id FROM n LEFT JOIN k USING (symbol)""",
    "unknown_symbols": f"WITH c AS (SELECT unnest(string_split(coalesce(text, ''), '')) AS symbol FROM conversations) SELECT symbol, count(*) AS n FROM c WHERE symbol <> '' AND CASE symbol {_SYMBOLS} ELSE -1 END = -1 GROUP BY symbol",
    "paired_words": "WITH w AS (SELECT conv_id * 1000 + turn AS page, string_split(coalesce(text, ''), ' ') AS labels FROM conversations) SELECT page, length(array_to_string(labels, ' ')) AS n_text, CAST(greatest(1, len(labels) - 2) AS BIGINT) AS n_pairs, labels[CAST(greatest(1, len(labels) - 2) AS INTEGER)] AS last_label FROM w",
    "quads": "WITH q AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, least(e[1], e[3], e[5], e[7]) AS x0, least(e[2], e[4], e[6], e[8]) AS y0, greatest(e[1], e[3], e[5], e[7]) AS x1, greatest(e[2], e[4], e[6], e[8]) AS y1 FROM q",
}
