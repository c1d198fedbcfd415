"""Queries over conversations as sessions that are read aloud."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import reading as O
from lectern.plans.common import TURNS_SQL, turns


def _timings(spark, sf_dir):
    """A start for each word of each turn, four tenths of a second apart."""
    return turns(spark, sf_dir).filter("n_words > 0").withColumn("word_timings", F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: i.cast("double") * 0.4))


def _positions(spark, sf_dir):
    """Three playback positions in each turn."""
    at = F.explode(F.array(F.lit(0.0), F.lit(1.7), F.lit(1000.0))).alias("time")
    return turns(spark, sf_dir).select(
        F.col("session_id").alias("doc_id"),
        "chunk_index",
        F.lit(0.5) * F.length("text") + 1.0,
        at
    ).toDF("doc_id", "chunk_index", "duration", "time").withColumn("ts", F.col("chunk_index") * 2000 + F.col("time"))


def words_at_times(spark, sf_dir):
    rows = _timings(spark, sf_dir).select(
        "session_id",
        "chunk_index",
        "n_words",
        "word_timings",
        F.explode(F.array(F.lit(-1.0), F.lit(0.4), F.lit(1.7), F.lit(float("nan")), F.lit(500.0))).alias("time")
    )
    rows = rows.withColumn("t", F.when(F.isnan("time"), -2).otherwise(F.floor(F.col("time") * 10 + 0.5)).cast("long"))
    return rows.select(
        "session_id",
        "chunk_index",
        "t",
        O.word_at_time(F.col("n_words"), F.col("time"), F.lit(10.0), F.col("word_timings")).alias("by_time"),
        O.word_at_ratio(F.col("n_words"), F.col("time"), F.lit(10.0)).alias("by_ratio")
    )


def asof_words(spark, sf_dir):
    rows = turns(spark, sf_dir)
    timings = rows.select("session_id", F.col("chunk_index").alias("word"), (F.col("chunk_index") * 3).cast("double").alias("start"))
    positions = rows.select("session_id", F.col("chunk_index").alias("n"), (F.col("chunk_index") * 2.5 + 0.5).alias("time"))
    return O.asof_word(positions, timings).select("session_id", "n", F.col("word").cast("long").alias("word"))


def _sentences(spark, sf_dir):
    """Lines of a turn as its sentences."""
    from lectern.functions import text as T

    rows = turns(spark, sf_dir).select(F.col("session_id").alias("doc_id"), "chunk_index", F.posexplode(F.split("text", r"\n")).alias("global_index", "line"))
    return rows.select("doc_id", "chunk_index", "global_index", F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).alias("n_words"))


def highlighted(spark, sf_dir):
    chunks = _timings(spark, sf_dir).withColumnRenamed("session_id", "doc_id")
    rows = O.highlights(_positions(spark, sf_dir), chunks, _sentences(spark, sf_dir))
    return rows.select(
        "doc_id",
        "chunk_index",
        F.floor(F.col("time") * 10 + 0.5).alias("t"),
        F.col("sentence_index").cast("long").alias("sentence_index"),
        F.col("word_index").cast("long").alias("word_index")
    )


def highlight_changes(spark, sf_dir):
    chunks = _timings(spark, sf_dir).withColumnRenamed("session_id", "doc_id")
    rows = O.highlights(_positions(spark, sf_dir), chunks, _sentences(spark, sf_dir))
    out = O.highlight_changes(rows, "doc_id", "ts")
    return out.select(
        "doc_id",
        F.floor(F.col("ts") * 10 + 0.5).alias("t"),
        F.col("sentence_index").cast("long").alias("sentence_index"),
        F.col("past_sentence").cast("long").alias("past_sentence")
    )


def timeline(spark, sf_dir):
    jobs = turns(spark, sf_dir).select("session_id", "chunk_index", (F.length("text") * 0.25).alias("duration"))
    return O.chunk_timeline(jobs)


QUERIES = {f.__name__: f for f in (words_at_times, asof_words, highlighted, highlight_changes, timeline)}

_HIGH = rf"""{TURNS_SQL}, ps AS (SELECT session_id AS doc_id, chunk_index, n_words AS n, unnest([0.0::DOUBLE, 1.7::DOUBLE, 1000.0::DOUBLE]) AS time FROM tu WHERE n_words > 0),
tg AS (SELECT *, chunk_index * 2000 + time AS ts, greatest(0, (SELECT count(*) FROM range(0, n) r(i) WHERE i::DOUBLE * 0.4::DOUBLE <= time) - 1) AS word FROM ps),
ls AS (SELECT session_id AS doc_id, chunk_index, unnest(range(len(string_split(text, chr(10))))) AS global_index, unnest(string_split(text, chr(10))) AS line FROM tu),
sw AS (SELECT *, len(regexp_extract_all(line, '[^\t\n\x0B\f\r ]+')) AS k FROM ls),
sr AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id, chunk_index ORDER BY global_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sw),
hi AS (SELECT tg.doc_id, tg.chunk_index, time, ts, sr.global_index AS sentence_index, CAST(word - s AS BIGINT) AS word_index FROM tg JOIN sr ON sr.doc_id = tg.doc_id AND sr.chunk_index = tg.chunk_index AND word >= s AND word < s + k)"""
ORACLES = {
    "words_at_times": f"WITH {TURNS_SQL}, x AS (SELECT session_id, chunk_index, n_words AS n, unnest([-10, 4, 17, -2, 5000]) AS t FROM tu WHERE n_words > 0), y AS (SELECT *, CASE WHEN t > 0 THEN t / 10.0::DOUBLE ELSE 0.0 END AS time FROM x) SELECT session_id, chunk_index, CAST(t AS BIGINT) AS t, CAST(greatest(0, (SELECT count(*) FROM range(0, n) r(i) WHERE i::DOUBLE * 0.4::DOUBLE <= time) - 1) AS INTEGER) AS by_time, CAST(least(floor(least(1.0, time / 10.0::DOUBLE) * n), n - 1) AS INTEGER) AS by_ratio FROM y",
    "asof_words": f"WITH {TURNS_SQL}, p AS (SELECT session_id, chunk_index AS n, chunk_index * 2.5::DOUBLE + 0.5::DOUBLE AS time FROM tu), w AS (SELECT session_id, chunk_index AS word, chunk_index * 3::DOUBLE AS start FROM tu) SELECT p.session_id, p.n, coalesce(w.word, 0) AS word FROM p ASOF LEFT JOIN w ON p.session_id = w.session_id AND p.time >= w.start",
    "highlighted": f"WITH {_HIGH} SELECT doc_id, chunk_index, CAST(floor(time * 10 + 0.5) AS BIGINT) AS t, sentence_index, word_index FROM hi",
    "highlight_changes": f"WITH {_HIGH}, lg AS (SELECT *, lag(sentence_index) OVER w AS s, lag(word_index) OVER w AS k FROM hi WINDOW w AS (PARTITION BY doc_id ORDER BY ts)) SELECT doc_id, CAST(floor(ts * 10 + 0.5) AS BIGINT) AS t, sentence_index, CASE WHEN s <> sentence_index THEN s END AS past_sentence FROM lg WHERE s IS DISTINCT FROM sentence_index OR k IS DISTINCT FROM word_index",
    "timeline": f"WITH {TURNS_SQL}, j AS (SELECT session_id, chunk_index, length(text) * 0.25::DOUBLE AS duration FROM tu) SELECT session_id, chunk_index, duration, coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS starts_at, coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + duration AS ends_at, lead(chunk_index) OVER w IS NULL AS finishes FROM j WINDOW w AS (PARTITION BY session_id ORDER BY chunk_index)",
}
