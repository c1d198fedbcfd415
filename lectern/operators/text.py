"""From documents to paragraphs, sentences, chunks and symbol ids. One scan, no shuffle, unless a table is regrouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Limits of a reading session and of a direct request, in characters, and of a file in bytes.
SESSION_MAX, REQUEST_WARN, REQUEST_MAX, FILE_MAX = 20_000, 1_800, 2_000, 25 * 1024 * 1024


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by hash of key where it has fewer partitions than the cluster has cores: one file gives one task, and text functions cost CPU."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def held(df: DataFrame, name: str) -> DataFrame:
    """df with a column that is computed once a row, however often later columns name it: a generator of one row stands between them."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(name)).alias(name))


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph_index, text): pieces between blank lines, trimmed. A blank piece gives no row but takes an index."""
    rows = df.select(F.col(id_col), F.posexplode(T.paragraph_array(F.col(text_col))).alias("paragraph_index", "text"))
    return rows.withColumn("text", T.trim_ws(F.col("text"))).filter("text <> ''")


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, global_index, paragraph_index, text, words) of each sentence; texts that are blank or null give no row."""
    rows = held(df.select(F.col(id_col), T.sentence_array(F.col(text_col)).alias("all")), "all")
    return rows.select(F.col(id_col), F.explode("all").alias("s")).select(id_col, "s.global_index", "s.paragraph_index", "s.text", "s.words")


def prepare_reader_data(df: DataFrame, max_chars: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, chunks) in one pass; chunks are array<struct<chunk_index, text, first_sentence, last_sentence, n_words>>."""
    rows = held(df.select(F.col(id_col), T.sentence_array(F.col(text_col)).alias("sentences")), "sentences")
    rows = held(rows.withColumn("lengths", F.transform("sentences", lambda s: F.length(s["text"]))), "lengths")
    rows = held(rows.withColumn("ranges", T.chunk_ranges("lengths", max_chars)), "ranges")

    def chunk(r, i):
        held = F.slice("sentences", r["first"] + 1, r["last"] - r["first"] + 1)
        return F.struct(
            i.cast("int").alias("chunk_index"),
            F.array_join(held["text"], " ").alias("text"),
            r["first"].alias("first_sentence"),
            r["last"].alias("last_sentence"),
            F.aggregate(held, F.lit(0), lambda a, s: a + F.size(s["words"])).alias("n_words")
        )

    return rows.select(id_col, "sentences", F.transform("ranges", chunk).alias("chunks"))


def chunks(df: DataFrame, max_chars: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, text, first_sentence, last_sentence, n_words)."""
    return held(prepare_reader_data(df, max_chars, id_col, text_col), "chunks").select(id_col, F.inline("chunks"))


def reading_view(sentence_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, paragraph_index, first_sentence, text): sentences of each paragraph in order, with one space between them."""
    grouped = sentence_rows.groupBy(id_col, "paragraph_index").agg(F.array_sort(F.collect_list(F.struct("global_index", "text"))).alias("s"))
    return grouped.select(id_col, "paragraph_index", F.col("s")[0]["global_index"].alias("first_sentence"), F.array_join("s.text", " ").alias("text"))


def encode_symbols(df: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "phonemes") -> DataFrame:
    """(doc_id, ids) of each text between boundary signs. The vocabulary is a few hundred signs, sent as a literal map."""
    return df.select(id_col, T.symbol_ids(F.col(text_col), vocabulary).alias("ids"))


def oov_report(df: DataFrame, vocabulary: DataFrame, text_col: str = "phonemes") -> DataFrame:
    """(symbol, n): characters that the vocabulary (symbol, id) lacks; counted before the join, so the join has a row a character."""
    counted = df.select(F.explode(F.split(text_col, "")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    return counted.filter("symbol <> ''").join(vocabulary, "symbol", "left_anti")


def text_gates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, session_gate, request_gate) by trimmed length: blank and too long texts are rejected, nearly full requests warned."""
    n = F.length(T.trim_ws(F.coalesce(F.col(text_col), F.lit(""))))
    rows = df.select(id_col, n.alias("n"))
    session = F.when(F.col("n") == 0, "blank").when(F.col("n") > SESSION_MAX, "too_long").otherwise("ok")
    request = F.when(F.col("n") == 0, "blank").when(F.col("n") > REQUEST_MAX, "too_long").when(F.col("n") > REQUEST_WARN, "warn").otherwise("ok")
    return rows.select(id_col, "n", session.alias("session_gate"), request.alias("request_gate"))


def parse_progress(df: DataFrame, message_col: str = "message") -> DataFrame:
    """df with percent and kind (pages, ocr, indeterminate, none) of a progress message."""
    m = F.col(message_col)
    page, of = (F.regexp_extract(m, r"(?i)page\s+(\d+)\s*/\s*(\d+)", i).try_cast("double") for i in (1, 2))
    ocr = F.regexp_extract(m, r"(?i)OCR page\s+\d+:\s*(\d+)%", 1).try_cast("int")
    pages = F.least(F.lit(100), T.half_up(page / F.nullif(of, F.lit(0.0)) * 100)).cast("int")
    kind = F.when(page.isNotNull(), "pages").when(ocr.isNotNull(), "ocr").when(F.coalesce(m, F.lit("")) != "", "indeterminate").otherwise("none")
    return df.withColumn("kind", kind).withColumn("percent", F.when(F.col("kind") == "pages", F.coalesce(pages, F.lit(100))).when(F.col("kind") == "ocr", ocr))


def load_progress(df: DataFrame) -> DataFrame:
    """df (loaded, total) with percent (0 without a total) and size_mb ('?' without)."""
    known = F.col("total") > 0
    return df.withColumn(
        "percent",
        F.when(known, T.half_up(F.col("loaded") / F.col("total") * 100)).otherwise(0).cast("int")
    ).withColumn("size_mb", F.when(known, F.format_string("%.1f", F.col("total") / 1024 / 1024)).otherwise("?"))


def ocr_request(df: DataFrame) -> DataFrame:
    """df (name, mime, use_ocr) with error, for a wish that the type cannot meet, and ui_ocr, the wish as an interface narrows it."""
    error = F.when(
        F.col("use_ocr") & (F.col("mime") != T.MIME["pdf"]),
        F.concat(
            F.lit("OCR is only supported for PDFs; got "),
            F.coalesce(F.nullif("mime", F.lit("")), F.nullif(T.file_extension(F.col("name")), F.lit("")), F.lit("unknown")),
            F.lit(". Disable the OCR toggle for this document.")
        )
    )
    return df.withColumn("error", error).withColumn("ui_ocr", F.col("use_ocr") & F.lower("name").endswith(".pdf"))


def admit_files(df: DataFrame, size_col: str = "length") -> DataFrame:
    """Files of at most 25 MB. On a binaryFile scan the filter is pushed to the source, and larger files are not read."""
    return df.filter(F.col(size_col) <= FILE_MAX)


def engine_kind(model_id):
    """Which of the two custom backends serves a model id."""
    return F.when(F.lower(model_id).contains("kokoro"), "kokoro").otherwise("kitten")


def pair_words(df: DataFrame, id_col: str = "page") -> DataFrame:
    """(page, text, words): labels and boxes paired up to the shorter list; the text has all labels."""
    n = F.least(F.size("labels"), F.size("quad_boxes"))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("labels", i).alias("text"), F.element_at("quad_boxes", i).alias("quad")))
    empty = "cast(array() as array<struct<text:string,quad:array<double>>>)"
    return df.select(id_col, F.array_join("labels", " ").alias("text"), F.when(n > 0, pairs).otherwise(F.expr(empty)).alias("words"))
