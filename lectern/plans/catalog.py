"""Queries over the languages of documents, and the catalogue against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalog as O
from lectern.operators.text import engine_kind
from lectern.plans.common import table


def document_languages(spark, sf_dir):
    return O.supported_languages(table(spark, sf_dir, "documents"), "lang").select(F.col("position").cast("int").alias("position"), "language")


def named_languages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.select("lang", O.language_name(F.concat(F.col("lang"), F.when(F.col("n") % 2 == 0, "").otherwise("-x"))).alias("name"), "n")


def english_documents(spark, sf_dir):
    return O.filter_language(table(spark, sf_dir, "documents"), "en", "lang").select("doc_id")


def language_coverage(spark, sf_dir):
    """Documents by language, with the models that read it and their download sizes."""
    models = O.models_df(spark)
    per = models.groupBy(F.col("language").alias("lang")).agg(F.count("*").alias("models"))
    size = O.distinct_artifacts(models).agg(F.sum("size_mb").alias("all_mb"))
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"))
    return docs.join(per, "lang", "left").join(F.broadcast(size)).select("lang", "documents", F.coalesce("models", F.lit(0)).alias("models"), "all_mb")


def assets_for_documents(spark, sf_dir):
    """What has to be downloaded to read the documents' languages."""
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("language")).distinct()
    return O.asset_manifest(O.models_df(spark).join(langs, "language", "left_semi"))


def kinds_for_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("documents"))
    models = O.models_df(spark)
    chosen = O.default_voice(models)
    return docs.join(models, "language").join(chosen, "id").select("id", engine_kind(F.col("model_id")).alias("kind"), "voice_id", "documents")


def statuses(spark, sf_dir):
    """The catalogue's status for the language that most documents have."""
    top = table(spark, sf_dir, "documents").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1)
    session = top.select(
        F.concat(F.lit("mms-tts-"), F.when(F.col("lang") == "en", "eng").otherwise("deu")).alias("loaded_id"),
        F.lit("speecht5").alias("selected_id"),
        (F.col("count") > 0).alias("ready")
    )
    return O.catalogue_status(O.models_df(spark), session)


def violations(spark, sf_dir):
    """Checks of a catalogue that has an entry for each language of the documents, some of them wrong."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    extra = langs.select(
        F.concat(F.lit("speecht5"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))).alias("id"),
        F.lit("").alias("name"),
        F.lit("x/y").alias("model_id"),
        F.lit("fast").alias("category"),
        F.lit(None).cast("string").alias("dtype"),
        F.lit(1).alias("sample_rate"),
        F.lit(None).cast("boolean").alias("custom"),
        F.concat("lang", F.lit("-q")).alias("language"),
        F.lit(1).alias("size_mb"),
        F.lit(None).cast("string").alias("model_file"),
        F.lit("nobody").alias("default_voice_id"),
        F.lit(None).cast(O.models_df(spark).schema["voices"].dataType).alias("voices")
    )
    return O.catalogue_checks(O.models_df(spark).unionByName(extra))


QUERIES = {f.__name__: f for f in (document_languages, named_languages, english_documents, language_coverage, assets_for_documents, kinds_for_documents, statuses, violations)}

_q = lambda x: "NULL" if x is None else ("true" if x is True else str(x) if isinstance(x, int) else "'" + x + "'")
_MODELS = "(VALUES " + ", ".join(
    f"({', '.join(map(_q, m))}, {_q(O.VOICES[m[0]][0][0]) if m[0] in O.VOICES else 'NULL'})" for m in O.MODELS
) + ") AS m(id, name, model_id, category, dtype, sample_rate, custom, language, size_mb, model_file, default_voice_id, first_voice)"
_NAMES = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in O.LANGUAGES.items())
_REPO = "'https://huggingface.co/' || model_id"
_SMALL = "(coalesce(custom, false) AND NOT contains(lower(model_id), 'kokoro'))"
ORACLES = {
    "document_languages": "SELECT CAST(row_number() OVER (ORDER BY lang <> 'en', lang) - 1 AS INTEGER) AS position, lang AS language FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('', 'multi'))",
    "named_languages": f"WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), c AS (SELECT *, lang || CASE WHEN n % 2 = 0 THEN '' ELSE '-x' END AS code FROM n) SELECT lang, CASE code {_NAMES} ELSE upper(code) END AS name, n FROM c",
    "english_documents": "SELECT doc_id FROM documents WHERE coalesce(lang, 'en') = 'en'",
    "language_coverage": f"WITH m AS (SELECT * FROM {_MODELS}), s AS (SELECT model_id, coalesce(model_file, '') AS f, coalesce(dtype, 'q8') AS d, max(size_mb) AS mb FROM m GROUP BY ALL) SELECT d.lang, count(*) AS documents, (SELECT count(*) FROM m WHERE m.language = d.lang) AS models, CAST((SELECT sum(mb) FROM s) AS BIGINT) AS all_mb FROM documents d GROUP BY d.lang",
    "assets_for_documents": f"WITH m AS (SELECT * FROM {_MODELS} WHERE language IN (SELECT lang FROM documents)) SELECT id, 'repository' AS kind, {_REPO} AS url FROM m UNION ALL SELECT id, 'model', {_REPO} || '/resolve/main/' || CASE WHEN {_SMALL} THEN coalesce(model_file, 'kitten_tts_nano_v0_8.onnx') ELSE model_file END FROM m WHERE {_SMALL} OR model_file IS NOT NULL UNION ALL SELECT id, 'voices', {_REPO} || '/resolve/main/voices.npz' FROM m WHERE {_SMALL}",
    "kinds_for_documents": f"WITH m AS (SELECT * FROM {_MODELS}), d AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT id, CASE WHEN contains(lower(model_id), 'kokoro') THEN 'kokoro' ELSE 'kitten' END AS kind, coalesce(default_voice_id, first_voice) AS voice_id, n AS documents FROM d JOIN m ON m.language = d.lang",
    "statuses": f"WITH m AS (SELECT * FROM {_MODELS}), t AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) SELECT id, CASE WHEN id = 'mms-tts-' || CASE WHEN lang = 'en' THEN 'eng' ELSE 'deu' END THEN 'Loaded' WHEN id = 'speecht5' THEN 'Selected' ELSE 'Click to select' END AS status FROM m, t",
    "violations": "WITH l AS (SELECT DISTINCT lang FROM documents), e AS (SELECT 'speecht5' || CASE WHEN lang = 'en' THEN '' ELSE lang END AS id, lang FROM l) SELECT 'model id repeats' AS \"check\", id AS key FROM e WHERE id = 'speecht5' UNION ALL SELECT c, id FROM e, (VALUES ('name or repository missing'), ('default voice missing'), ('language without a name')) AS v(c)",
}
