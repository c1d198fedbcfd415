"""Queries over embeddings as audio, and conversations as segments of speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.operators import audio as O
from lectern.operators import catalog
from lectern.plans.common import TURNS_SQL, table, turns

_TOTAL = "CAST(floor({0} * 10000 + 0.5) AS BIGINT)"


def _waves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("audio"))


def _sum(col):
    """Total of an array's samples, in ten-thousandths."""
    return F.floor(F.aggregate(F.transform(col, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x) * 10000 + 0.5).cast("long")


def speeds(spark, sf_dir):
    """Resampled at speeds from 0.5 to 2.0."""
    rows = _waves(spark, sf_dir).withColumn("speed", 0.5 + (F.col("vec_id") % 7) * 0.25)
    rows = rows.withColumn("out", A.change_speed(F.col("audio"), F.col("speed")))
    return rows.select("vec_id", F.size("out").cast("long").alias("n"), (F.floor(F.element_at("out", -1).cast("double") * 100000 + 0.5) / 100000).alias("last"))


def pcm(spark, sf_dir):
    rows = _waves(spark, sf_dir).withColumn("pcm", A.pcm16(F.transform("audio", lambda x: (x * 3).cast("float"))))
    return rows.select(
        "vec_id",
        F.aggregate("pcm", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array_max("pcm").cast("int").alias("high"),
        F.array_min("pcm").cast("int").alias("low")
    )


def wav_headers(spark, sf_dir):
    return _waves(spark, sf_dir).select("vec_id", A.wav_header(F.col("audio"), F.lit(16000) + F.col("label")).alias("h")).select("vec_id", "h.*")


def cleaned(spark, sf_dir):
    """Every fifth sample a NaN, then NaN as silence."""
    holed = F.transform("audio", lambda x, i: F.when(i % 5 == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    return _waves(spark, sf_dir).select("vec_id", _sum(A.clean_audio(holed)).alias("total"))


def quiet(spark, sf_dir):
    soft = F.transform("audio", lambda x: (x.cast("double") * F.when(F.col("vec_id") % 2 == 0, 0.125).otherwise(1.0)).cast("float"))
    return _waves(spark, sf_dir).select("vec_id", A.normalize_quiet(soft).alias("out")).select(
        "vec_id",
        F.floor(F.array_max(F.transform("out", lambda x: F.abs(x.cast("double")))) * 100000 + 0.5).cast("long").alias("peak")
    )


def stitched(spark, sf_dir):
    """Vectors of a label and block of 16 ids as one job's segments."""
    rows = _waves(spark, sf_dir).select((F.col("label").cast("long") * 100000 + F.floor(F.col("vec_id") / 16)).alias("job_id"), F.col("vec_id").alias("seq"), "audio")
    out = O.stitch_segments(rows)
    return out.select("job_id", F.size("audio").cast("long").alias("n"), F.get("audio", F.lit(64)).cast("double").alias("second_first"))


def timings(spark, sf_dir):
    """Turns as segments of 240 samples a character."""
    rows = turns(spark, sf_dir)
    segments = rows.select(F.col("session_id").alias("job_id"), F.col("chunk_index").alias("seq"), F.col("text").alias("phonemes"), (240 * F.length("text")).alias("n_samples"))
    counts = rows.groupBy(F.col("session_id").alias("job_id")).agg(F.sum("n_words").alias("n_words"))
    out = O.word_timings(segments, counts)
    return out.select("job_id", F.size("word_timings").cast("long").alias("n"), F.floor(F.element_at("word_timings", -1) * 10000 + 0.5).cast("long").alias("last"))


def styles(spark, sf_dir):
    """Vectors as a bank of voices, asked for by turns of which some name no voice."""
    bank = _waves(spark, sf_dir).select(F.concat(F.lit("voice-"), "vec_id").alias("voice_id"), F.col("audio").alias("values"))
    jobs = turns(spark, sf_dir).select("session_id", "chunk_index", F.concat(F.lit("voice-"), F.length("text") % 600).alias("voice_id"))
    out = O.style_vector(jobs, bank)
    return out.groupBy(F.col("error").isNull().alias("found")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("style").isNotNull(), F.size("style"))), F.lit(0)).cast("long").alias("values")
    )


def speed_rule(spark, sf_dir):
    """Resampling where the model is not a custom one."""
    models = catalog.models_df(spark)
    ids = F.array(*[F.lit(m[0]) for m in catalog.MODELS])
    jobs = _waves(spark, sf_dir).select("vec_id", "audio", F.get(ids, (F.col("vec_id") % 14).cast("int")).alias("model_id"), F.lit(2.0).alias("speed"))
    return O.apply_speed(jobs, models).groupBy("model_id").agg(F.count("*").alias("n"), F.sum(F.size("audio")).alias("samples"))


QUERIES = {f.__name__: f for f in (speeds, pcm, wav_headers, cleaned, quiet, stitched, timings, styles, speed_rule)}

_MODELS = "(VALUES " + ", ".join(f"({i}, '{m[0]}', {'true' if m[6] else 'false'})" for i, m in enumerate(catalog.MODELS)) + ") AS m(k, id, custom)"
ORACLES = {
    "speeds": """WITH w AS (SELECT vec_id, embedding AS a, len(embedding) AS len, 0.5::DOUBLE + (vec_id % 7) * 0.25::DOUBLE AS s FROM embeddings),
n AS (SELECT *, CASE WHEN s = 1.0 THEN len ELSE greatest(1, CAST(floor(len / s) AS BIGINT)) END AS n FROM w),
l AS (SELECT *, (n - 1) * s AS pos, floor((n - 1) * s) AS low FROM n)
SELECT vec_id, n, floor(CAST(CASE WHEN s = 1.0 THEN a[len] ELSE CAST(a[CAST(low AS INTEGER) + 1] AS DOUBLE) * (1 - (pos - low)) + CAST(a[CAST(least(low + 1, len - 1) AS INTEGER) + 1] AS DOUBLE) * (pos - low) END AS FLOAT)::DOUBLE * 100000 + 0.5) / 100000 AS last FROM l""",
    "pcm": """WITH p AS (SELECT vec_id, list_transform(list_transform(embedding, lambda x: CAST(CAST(x * 3::FLOAT AS FLOAT) AS DOUBLE)), lambda v: CAST(floor(CASE WHEN v < 0 THEN greatest(v, -1.0) * 32768 ELSE least(v, 1.0) * 32767 END + 0.5) AS INTEGER)) AS q FROM embeddings)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, list_max(q) AS high, list_min(q) AS low FROM p""",
    "wav_headers": "SELECT vec_id, CAST(16000 + label AS INTEGER) AS rate, 2 AS block_align, CAST(2 * (16000 + label) AS INTEGER) AS byte_rate, len(embedding) * 2 AS data_length, len(embedding) * 2 + 44 AS total_length FROM embeddings",
    "cleaned": "SELECT vec_id, CAST(floor(list_reduce(list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN 0.0::DOUBLE ELSE x::DOUBLE END), lambda a, x: a + x, 0.0::DOUBLE) * 10000 + 0.5) AS BIGINT) AS total FROM embeddings",
    "quiet": "WITH p AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(CAST(x::DOUBLE * CASE WHEN vec_id % 2 = 0 THEN 0.125 ELSE 1.0 END AS FLOAT)::DOUBLE))) AS peak FROM embeddings) SELECT vec_id, CAST(floor(CASE WHEN peak > 0 AND peak < 0.1 THEN 0.5 ELSE peak END * 100000 + 0.5) AS BIGINT) AS peak FROM p",
    "stitched": "WITH s AS (SELECT CAST(label AS BIGINT) * 100000 + vec_id // 16 AS job_id, vec_id AS seq, embedding FROM embeddings), f AS (SELECT job_id, flatten(list(embedding ORDER BY seq)) AS a FROM s GROUP BY job_id) SELECT job_id, len(a) AS n, CAST(a[65] AS DOUBLE) AS second_first FROM f",
    "timings": rf"""WITH {TURNS_SQL}, seg AS (SELECT session_id, chunk_index, length(regexp_replace(text, '[\t\n\x0B\f\r ]+', '', 'g')) AS m, 240 * length(text) AS n FROM tu),
pre AS (SELECT *, coalesce(sum(n) OVER w, 0) / 24000.0::DOUBLE AS off, coalesce(sum(m) OVER w, 0) AS taken FROM seg WHERE m > 0 WINDOW w AS (PARTITION BY session_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cnt AS (SELECT session_id, sum(n_words) AS words FROM tu GROUP BY session_id),
used AS (SELECT p.*, least(m, words - taken) AS k FROM pre p JOIN cnt USING (session_id) WHERE taken < words)
SELECT session_id AS job_id, CAST(sum(k) AS BIGINT) AS n, CAST(floor(arg_max(off + (k - 1) * (n / 24000.0::DOUBLE / m), chunk_index) * 10000 + 0.5) AS BIGINT) AS last FROM used GROUP BY session_id""",
    "styles": f"WITH {TURNS_SQL}, j AS (SELECT length(text) % 600 AS v FROM tu) SELECT e.vec_id IS NOT NULL AS found, count(*) AS n, CAST(coalesce(sum(CASE WHEN e.vec_id IS NOT NULL THEN least(256, len(embedding)) END), 0) AS BIGINT) AS values FROM j LEFT JOIN embeddings e ON e.vec_id = j.v GROUP BY 1",
    "speed_rule": f"SELECT m.id AS model_id, count(*) AS n, CAST(sum(CASE WHEN custom THEN len(embedding) ELSE len(embedding) // 2 END) AS BIGINT) AS samples FROM embeddings e JOIN {_MODELS} ON m.k = e.vec_id % 14 GROUP BY m.id",
}
