"""The model and voice catalogue as dimension tables, its lookups and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language names by code.
LANGUAGES = {"en": "English", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese", "ru": "Russian", "ko": "Korean", "hi": "Hindi", "ar": "Arabic"}

#: Where the default speaker vector is.
XVECTORS = "https://huggingface.co/datasets/Xenova/transformers.js-docs/resolve/main/speaker_embeddings.bin"

#: Voices of the large model. (id, name, description, speaker vector)
LARGE_VOICES = [
    ("af_heart", "Heart (en-us, Female)", None, None),
    ("af_bella", "Bella (en-us, Female)", None, None),
    ("af_nicole", "Nicole (en-us, Female)", None, None),
    ("af_aoede", "Aoede (en-us, Female)", None, None),
    ("af_kore", "Kore (en-us, Female)", None, None),
    ("af_sarah", "Sarah (en-us, Female)", None, None),
    ("af_nova", "Nova (en-us, Female)", None, None),
    ("af_sky", "Sky (en-us, Female)", None, None),
    ("af_alloy", "Alloy (en-us, Female)", None, None),
    ("af_jessica", "Jessica (en-us, Female)", None, None),
    ("af_river", "River (en-us, Female)", None, None),
    ("am_adam", "Adam (en-us, Male)", None, None),
    ("am_michael", "Michael (en-us, Male)", None, None),
    ("am_eric", "Eric (en-us, Male)", None, None),
    ("am_liam", "Liam (en-us, Male)", None, None),
    ("am_onyx", "Onyx (en-us, Male)", None, None),
    ("am_echo", "Echo (en-us, Male)", None, None),
    ("am_fenrir", "Fenrir (en-us, Male)", None, None),
    ("am_puck", "Puck (en-us, Male)", None, None),
    ("am_santa", "Santa (en-us, Male)", None, None),
    ("bf_emma", "Emma (en-gb, Female)", None, None),
    ("bf_isabella", "Isabella (en-gb, Female)", None, None),
    ("bf_alice", "Alice (en-gb, Female)", None, None),
    ("bf_lily", "Lily (en-gb, Female)", None, None),
    ("bm_george", "George (en-gb, Male)", None, None),
    ("bm_lewis", "Lewis (en-gb, Male)", None, None),
    ("bm_daniel", "Daniel (en-gb, Male)", None, None),
    ("bm_fable", "Fable (en-gb, Male)", None, None),
]
#: Voices of the two small models, likewise.
SMALL_VOICES = [
    ("expr-voice-2-m", "Voice 2 (Male)", "Male voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-2-f", "Voice 2 (Female)", "Female voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-3-m", "Voice 3 (Male)", "Male voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-3-f", "Voice 3 (Female)", "Female voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-4-m", "Voice 4 (Male)", "Male voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-4-f", "Voice 4 (Female)", "Female voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-5-m", "Voice 5 (Male)", "Male voice (Kitten TTS Nano v0.8)", None),
    ("expr-voice-5-f", "Voice 5 (Female)", "Female voice (Kitten TTS Nano v0.8)", None),
]
#: Voices of the vector model, likewise.
VECTOR_VOICES = [
    ("cmarctic", "CMU Arctic (default)", "Neutral US English, male. Public xvector from transformers.js docs.", XVECTORS),
    ("custom", "Custom (paste URL)", "Provide your own 512-dim xvector .bin file URL.", ""),
]

#: Models. (id, name, repository, category, dtype, sample rate, custom, language, MB, file, default voice)
MODELS = [
    ("kokoro-82m", "Kokoro-82M (q8f16)", "onnx-community/Kokoro-82M-v1.0-ONNX", "premium", "q8", 24000, True, "en", 86, "onnx/model_q8f16.onnx", "af_heart"),
    ("kokoro-82m-fp16", "Kokoro-82M (fp16)", "onnx-community/Kokoro-82M-v1.0-ONNX", "premium", "fp16", 24000, True, "en", 163, "onnx/model_fp16.onnx", "af_heart"),
    ("speecht5", "SpeechT5", "Xenova/speecht5_tts", "balanced", "fp32", 16000, None, "en", 330, None, "cmarctic"),
    ("kitten-mini", "Kitten TTS Mini (~78MB)", "KittenML/kitten-tts-mini-0.8", "balanced", None, 24000, True, "en", 78, "kitten_tts_mini_v0_8.onnx", "expr-voice-2-m"),
    ("kitten-nano", "Kitten TTS Nano (~24MB)", "KittenML/kitten-tts-nano-0.8-int8", "fast", None, 24000, True, "en", 24, None, "expr-voice-2-m"),
    ("mms-tts-eng", "MMS-TTS (English)", "Xenova/mms-tts-eng", "multilingual", "q8", 16000, None, "en", 50, None, ""),
    ("mms-tts-spa", "MMS-TTS (Spanish)", "Xenova/mms-tts-spa", "multilingual", "q8", 16000, None, "es", 50, None, ""),
    ("mms-tts-fra", "MMS-TTS (French)", "Xenova/mms-tts-fra", "multilingual", "q8", 16000, None, "fr", 50, None, ""),
    ("mms-tts-deu", "MMS-TTS (German)", "Xenova/mms-tts-deu", "multilingual", "q8", 16000, None, "de", 50, None, ""),
    ("mms-tts-por", "MMS-TTS (Portuguese)", "Xenova/mms-tts-por", "multilingual", "q8", 16000, None, "pt", 50, None, ""),
    ("mms-tts-rus", "MMS-TTS (Russian)", "Xenova/mms-tts-rus", "multilingual", "q8", 16000, None, "ru", 50, None, ""),
    ("mms-tts-kor", "MMS-TTS (Korean)", "Xenova/mms-tts-kor", "multilingual", "q8", 16000, None, "ko", 50, None, ""),
    ("mms-tts-hin", "MMS-TTS (Hindi)", "Xenova/mms-tts-hin", "multilingual", "q8", 16000, None, "hi", 50, None, ""),
    ("mms-tts-ara", "MMS-TTS (Arabic)", "Xenova/mms-tts-ara", "multilingual", "q8", 16000, None, "ar", 50, None, ""),
]
VOICES = {"kokoro-82m": LARGE_VOICES, "kokoro-82m-fp16": LARGE_VOICES, "speecht5": VECTOR_VOICES, "kitten-mini": SMALL_VOICES, "kitten-nano": SMALL_VOICES}
MODEL_DDL = "id string, name string, model_id string, category string, dtype string, sample_rate int, custom boolean, language string, size_mb int, model_file string, default_voice_id string, voices array<struct<id:string,name:string,description:string,speaker_embeddings:string>>"


def models_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m, VOICES.get(m[0], [])) for m in MODELS], MODEL_DDL)


def voices_df(models: DataFrame) -> DataFrame:
    """(model_id, position, voice_id, name, description, speaker_embeddings) of a models table."""
    rows = models.select(F.col("id").alias("model_id"), F.posexplode("voices").alias("position", "v"))
    return rows.select("model_id", "position", F.col("v.id").alias("voice_id"), "v.name", "v.description", "v.speaker_embeddings")


def vocab_df(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, id) of a tokenizer's JSON file."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return whole.select(F.explode(entries).alias("symbol", "id"))


def supported_languages(models: DataFrame, col: str = "language") -> DataFrame:
    """(language, position): the languages that occur, English first, then by code. There are a few dozen codes at most."""
    found = models.select(F.col(col).alias("language")).filter(f"{col} is not null and {col} <> '' and {col} <> 'multi'").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("language") == "en", 0).otherwise(1).alias("k"), "language")))
    return found.agg(ordered.alias("l")).select(F.posexplode("l.language").alias("position", "language"))


def filter_language(models: DataFrame, language: str, col: str = "language") -> DataFrame:
    return models if language == "all" else models.filter(F.coalesce(col, F.lit("en")) == language)


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.upper(code))


def distinct_artifacts(models: DataFrame) -> DataFrame:
    """(model_id, model_file, dtype, entries, size_mb): one row for each download."""
    key = ["model_id", F.coalesce("model_file", F.lit("")).alias("model_file"), F.coalesce("dtype", F.lit("q8")).alias("dtype")]
    return models.groupBy(*key).agg(F.count("*").alias("entries"), F.max("size_mb").alias("size_mb"))


def default_voice(models: DataFrame) -> DataFrame:
    """(id, voice_id): the default voice, else the first one."""
    return models.select("id", F.coalesce("default_voice_id", F.get("voices", F.lit(0))["id"]).alias("voice_id"))


def catalogue_checks(models: DataFrame) -> DataFrame:
    """(check, key) of every violation: unique ids, names, voices unique in a model, default voices that exist, languages with a name."""
    voices = voices_df(models)
    named = lambda check, df, key: df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    wrong = [
        named("model id repeats", models.groupBy("id").count().filter("count > 1"), "id"),
        named("name or repository missing", models.filter("coalesce(name, '') = '' or coalesce(model_id, '') = ''"), "id"),
        named("voice id repeats", voices.groupBy("model_id", "voice_id").count().filter("count > 1").select(F.concat_ws("/", "model_id", "voice_id").alias("key")), "key"),
        named(
            "default voice missing",
            models.filter("coalesce(default_voice_id, '') <> ''").join(
                voices.select(F.col("model_id").alias("id"), F.col("voice_id").alias("default_voice_id")),
                ["id", "default_voice_id"],
                "left_anti"
            ),
            "id"
        ),
        named("language without a name", models.filter("language is not null and language not in ('', 'multi')").filter(F.try_element_at(known, "language").isNull()), "id"),
    ]
    return reduce(DataFrame.unionByName, wrong)


def asset_manifest(models: DataFrame, host: str = "https://huggingface.co/") -> DataFrame:
    """(id, kind, url): the repository of every model, its model file where it names one, and what the small custom models load."""
    base = F.concat(F.lit(host), F.col("model_id"))
    small = F.coalesce("custom", F.lit(False)) & ~F.lower("model_id").contains("kokoro")
    file = F.when(small, F.coalesce("model_file", F.lit("kitten_tts_nano_v0_8.onnx"))).otherwise(F.col("model_file"))
    entries = F.array(
        F.struct(F.lit("repository").alias("kind"), base.alias("url")),
        F.struct(F.lit("model").alias("kind"), F.concat(base, F.lit("/resolve/main/"), file).alias("url")),
        F.struct(F.lit("voices").alias("kind"), F.when(small, F.concat(base, F.lit("/resolve/main/voices.npz"))).alias("url"))
    )
    return models.select("id", F.inline(entries)).filter("url is not null")


def catalogue_status(models: DataFrame, session: DataFrame) -> DataFrame:
    """(id, status) against a session's one row (loaded_id, selected_id, ready)."""
    one = session.limit(1)
    status = F.when(
        F.coalesce(F.col("ready") & (F.col("id") == F.col("loaded_id")), F.lit(False)),
        "Loaded"
    ).when(F.col("id").eqNullSafe(F.col("selected_id")), "Selected").otherwise("Click to select")
    return models.join(F.broadcast(one)).select("id", status.alias("status"))
