"""Queries over events as a log of jobs, and conversations as sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import catalog
from lectern.operators import jobs as O
from lectern.plans.common import EVENTS_SQL, TURNS_SQL, job_events, table, turns

_IDS = [m[0] for m in catalog.MODELS]


def _now():
    return F.timestamp_micros(F.lit(1_700_000_000_000_000))

_MODELS = "(VALUES " + ", ".join(f"({i}, '{m[0]}', '{m[1]}', '{m[10]}')" for i, m in enumerate(catalog.MODELS)) + ") AS m(k, id, name, dv)"
_VOICES = "(VALUES " + ", ".join(
    f"('{m}', {i}, '{v[0]}', '{v[1]}', {'NULL' if v[3] is None else repr(v[3])})" for m, vs in catalog.VOICES.items() for i, v in enumerate(vs)
) + ") AS v(model_id, position, voice_id, name, emb)"


def latest_states(spark, sf_dir):
    return O.latest_job_state(job_events(spark, sf_dir)).select("job_id", "seq", "status", "value")


def _jobs(spark, sf_dir):
    """A job for each user, from its last event: number, model, text and times."""
    last = O.latest_job_state(job_events(spark, sf_dir))
    first = job_events(spark, sf_dir).groupBy("job_id").agg(F.min("ts").alias("created_at"), F.min(F.when(F.col("status") == "generating", F.col("ts"))).alias("started_at"))
    rows = last.join(first, "job_id").withColumn("model_id", F.get(F.array(*[F.lit(i) for i in _IDS]), (F.col("job_id") % 14).cast("int")))
    done = F.when(F.col("status").isin(*O.TERMINAL), F.col("ts"))
    return rows.select(
        "job_id",
        F.col("job_id").alias("job_no"),
        "model_id",
        "status",
        "created_at",
        "started_at",
        done.alias("completed_at"),
        F.lit(None).cast("string").alias("error")
    )


_JOBS = f"""{EVENTS_SQL}, la AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1),
fi AS (SELECT job_id, min(ts) AS created_at, min(ts) FILTER (status = 'generating') AS started_at FROM ev GROUP BY job_id),
jo AS (SELECT job_id, m.id AS model_id, status, created_at, started_at, CASE WHEN status IN ('done', 'error', 'cancelled') THEN ts END AS completed_at FROM la JOIN fi USING (job_id) JOIN {_MODELS} ON m.k = job_id % 14)"""


def queue_counts(spark, sf_dir):
    return O.queue_counts(_jobs(spark, sf_dir), "model_id")


def newest_jobs(spark, sf_dir):
    return O.job_list(_jobs(spark, sf_dir)).select("job_id", "model_id", "status")


def next_jobs(spark, sf_dir):
    """The next job for each model that may be loaded; for one at most there is one."""
    models = spark.createDataFrame([(m,) for m in _IDS], "model_id string")
    return O.next_jobs(_jobs(spark, sf_dir), models).select("job_id", "model_id")


def drain(spark, sf_dir):
    return O.drain_order(_jobs(spark, sf_dir)).select("job_id", "model_id", "run_order")


def switched(spark, sf_dir):
    return O.cancel_on_switch(_jobs(spark, sf_dir), "speecht5", _now()).select("job_id", "status", "error", F.unix_millis("completed_at").alias("completed_ms"))


def cancelled(spark, sf_dir):
    ids = job_events(spark, sf_dir).filter("value > 50").select("job_id")
    return O.cancel_jobs(_jobs(spark, sf_dir), ids, _now()).select("job_id", "status", F.unix_millis("completed_at").alias("completed_ms"))


def unfinished(spark, sf_dir):
    return O.clear_finished(_jobs(spark, sf_dir)).select("job_id", "status")


def results_applied(spark, sf_dir):
    results = _jobs(spark, sf_dir).select("job_id", (F.col("job_id") % 3 != 0).alias("ok"), F.concat(F.lit("failed "), "job_id").alias("message"), _now().alias("at"))
    return O.apply_results(_jobs(spark, sf_dir), results).select("job_id", "status", "error", F.unix_millis("completed_at").alias("completed_ms"))


def completion(spark, sf_dir):
    rows = O.completion_stats(_jobs(spark, sf_dir), "model_id", "status")
    return rows.select("model_id", "status", "jobs", F.floor(F.col("mean_ms") + 0.5).alias("mean_ms"), "max_ms")


def built_jobs(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_no"),
        F.coalesce("props", F.lit("")).alias("text"),
        F.when(F.col("event_id") % 5 == 0, "gone").otherwise(
            F.get(F.array(*[F.lit(i) for i in _IDS]), (F.col("event_id") % 14).cast("int"))
        ).alias("model_id"),
        F.when(F.col("event_id") % 3 == 0, "custom").when(F.col("event_id") % 3 == 1, "").alias("voice_id"),
        F.when(F.col("event_id") % 2 == 0, 1.5).alias("speed"),
        F.col("ts").cast("timestamp").alias("created_at")
    )
    models = catalog.models_df(spark)
    return O.build_jobs(requests, models, catalog.voices_df(models), "kitten-nano").select("job_id", "model_id", "voice_id", "voice_name", "speed", "status")


def enriched(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("gone-"), F.col("event_id") % 2)).otherwise(
            F.get(F.array(*[F.lit(i) for i in _IDS]), (F.col("event_id") % 14).cast("int"))
        ).alias("model_id")
    )
    out = O.enrich_model(requests, catalog.models_df(spark))
    return out.groupBy("model_id", "model_name", "error").agg(F.count("*").alias("n"))


def embeddings_chosen(spark, sf_dir):
    models = catalog.models_df(spark)
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.get(F.array(*[F.lit(i) for i in _IDS]), (F.col("event_id") % 14).cast("int")).alias("model_id"),
        F.when(F.col("event_id") % 3 == 0, "custom").when(F.col("event_id") % 3 == 1, "none").alias("voice_id"),
        F.when(F.col("event_id") % 7 == 0, "https://x.example/e.bin").when(F.col("event_id") % 7 == 1, "").alias("custom_embedding")
    )
    rows = rows.join(models.select(F.col("id").alias("model_id"), "default_voice_id"), "model_id")
    return O.resolve_embedding(rows, catalog.voices_df(models)).groupBy("model_id", "embedding").agg(F.count("*").alias("n"))


def voices_checked(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, "speecht5").otherwise("kitten-nano").alias("model_id"),
        F.when(F.col("event_id") % 3 == 0, "custom").otherwise("cmarctic").alias("voice_id"),
        F.when(F.col("event_id") % 5 == 0, "https://x.example/e.bin").alias("custom_embedding")
    )
    return O.validate_voice(rows).select("event_id", F.col("error").isNotNull().alias("rejected"), "custom_embedding")


def reports(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.lit(0.5) + (F.col("doc_id") % 4) * 0.5).alias("speed"),
        F.timestamp_micros(F.lit(1_699_999_000_000_000) + F.col("doc_id") * 12345).alias("started_at"),
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 400).alias("duration_ms"),
        F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") * 1000).alias("n_samples"),
        F.when(F.col("doc_id") % 7 > 0, 24000).alias("sample_rate")
    )
    return O.job_report(rows, _now())


def buffered(spark, sf_dir):
    return O.buffered_index(turns(spark, sf_dir))


def to_enqueue(spark, sf_dir):
    rows = turns(spark, sf_dir)
    positions = rows.groupBy("session_id").agg(F.floor(F.max("chunk_index") / 2).alias("current_index"))
    return O.chunks_to_enqueue(rows, rows.filter("ready"), positions).select("session_id", "chunk_index")


def jobs_of_sessions(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return O.session_jobs(rows, rows.filter("chunk_index = 0 and ready").select("session_id")).select("session_id", "chunk_index")


def stopped(spark, sf_dir):
    jobs = turns(spark, sf_dir).select(
        "session_id",
        "chunk_index",
        F.when(F.col("ready"), "done").otherwise("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("completed_at")
    )
    return O.stop_session(jobs, 7, _now()).select("session_id", "chunk_index", "status", F.unix_millis("completed_at").alias("completed_ms"))


def session_lines(spark, sf_dir):
    rows = turns(spark, sf_dir)
    sessions = O.buffered_index(rows).join(rows.groupBy("session_id").agg(F.count("*").alias("total_chunks"), F.count_if("ready").alias("current_index")), "session_id")
    return O.session_progress(sessions.withColumn("current_index", F.least("current_index", F.col("total_chunks") - 1))).select("session_id", "progress")


def changed_jobs(spark, sf_dir):
    """Jobs after half of the events' time against jobs after all of it."""
    log = job_events(spark, sf_dir)
    half = log.agg(F.floor((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).alias("half"))
    old = O.latest_job_state(log.join(F.broadcast(half), F.unix_micros("ts") <= F.col("half")).drop("half")).select("job_id", "status")
    new = O.latest_job_state(log).select("job_id", "status")
    return O.snapshot_diff(old, new, "job_id")


def correlated(spark, sf_dir):
    log = job_events(spark, sf_dir)
    requests = log.select(F.col("seq").alias("id"))
    responses = log.select(
        (F.col("seq") - F.col("seq") % 4).alias("id"),
        "seq",
        F.when(F.col("status") == "error", "error").when(F.col("status") == "generating", "progress").otherwise("result").alias("type"),
        F.concat(F.lit("m"), "seq").alias("message")
    )
    return O.correlate(requests, responses)


QUERIES = {
    f.__name__: f for f in (
        latest_states,
        queue_counts,
        newest_jobs,
        next_jobs,
        drain,
        switched,
        cancelled,
        unfinished,
        results_applied,
        completion,
        built_jobs,
        enriched,
        embeddings_chosen,
        voices_checked,
        reports,
        buffered,
        to_enqueue,
        jobs_of_sessions,
        stopped,
        session_lines,
        changed_jobs,
        correlated
    )
}

_MS = "(epoch_us(completed_at) // 1000)"
_NOW_MS = "1700000000000"
ORACLES = {
    "latest_states": f"WITH {_JOBS} SELECT job_id, seq, status, value FROM la",
    "queue_counts": f"WITH {_JOBS}, c AS (SELECT model_id, count(*) FILTER (status IN ('pending', 'generating')) AS active, count(*) FILTER (status = 'generating') AS running, count(*) FILTER (status IN ('done', 'error', 'cancelled')) AS finished FROM jo GROUP BY model_id) SELECT *, CASE WHEN active = 0 THEN '' WHEN running > 0 THEN running || ' running · ' || active || ' in queue' ELSE active || ' in queue' END AS label FROM c",
    "newest_jobs": f"WITH {_JOBS} SELECT job_id, model_id, status FROM jo",
    "next_jobs": f"WITH {_JOBS}, p AS (SELECT * FROM jo WHERE status = 'pending' ORDER BY created_at DESC, job_id DESC LIMIT 1) SELECT job_id, model_id FROM p",
    "drain": f"WITH {_JOBS} SELECT job_id, model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, job_id DESC) AS INTEGER) AS run_order FROM jo WHERE status = 'pending'",
    "switched": f"WITH {_JOBS}, s AS (SELECT *, status = 'pending' AND model_id <> 'speecht5' AS hit FROM jo) SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN 'Model changed before generation started' END AS error, CASE WHEN hit THEN {_NOW_MS} ELSE {_MS} END AS completed_ms FROM s",
    "cancelled": f"WITH {_JOBS}, s AS (SELECT *, status IN ('pending', 'generating') AND job_id IN (SELECT job_id FROM ev WHERE value > 50) AS hit FROM jo) SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN {_NOW_MS} ELSE {_MS} END AS completed_ms FROM s",
    "unfinished": f"WITH {_JOBS} SELECT job_id, status FROM jo WHERE status IN ('pending', 'generating')",
    "results_applied": f"WITH {_JOBS}, s AS (SELECT *, status = 'generating' AS hit, job_id % 3 <> 0 AS ok FROM jo) SELECT job_id, CASE WHEN hit THEN CASE WHEN ok THEN 'done' ELSE 'error' END ELSE status END AS status, CASE WHEN hit AND NOT ok THEN 'failed ' || job_id END AS error, CASE WHEN hit THEN {_NOW_MS} ELSE {_MS} END AS completed_ms FROM s",
    "completion": f"WITH {_JOBS}, d AS (SELECT model_id, status, epoch_us(completed_at) // 1000 - epoch_us(coalesce(started_at, completed_at)) // 1000 AS ms FROM jo WHERE completed_at IS NOT NULL) SELECT model_id, status, count(*) AS jobs, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS mean_ms, max(ms) AS max_ms FROM d GROUP BY model_id, status",
    "built_jobs": f"WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'kitten-nano' ELSE m.id END AS model_id, CASE event_id % 3 WHEN 0 THEN 'custom' WHEN 1 THEN '' END AS asked, CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 1.0 END AS speed FROM events JOIN {_MODELS} ON m.k = event_id % 14), w AS (SELECT r.*, CASE WHEN coalesce(asked, '') = '' THEN d.dv ELSE asked END AS want, row_number() OVER (ORDER BY event_id) AS k FROM r JOIN {_MODELS.replace('AS m(', 'AS d(')} ON d.id = r.model_id) SELECT 'job-' || w.k AS job_id, w.model_id, v.voice_id, v.name AS voice_name, CAST(speed AS DOUBLE) AS speed, 'pending' AS status FROM w LEFT JOIN {_VOICES} ON v.model_id = w.model_id AND v.voice_id = w.want",
    "enriched": f"WITH r AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'gone-' || event_id % 2 ELSE m.id END AS asked FROM events JOIN {_MODELS} ON m.k = event_id % 14) SELECT d.id AS model_id, d.name AS model_name, CASE WHEN d.id IS NULL THEN 'Unknown model: ' || asked END AS error, count(*) AS n FROM r LEFT JOIN {_MODELS.replace('AS m(', 'AS d(')} ON d.id = r.asked GROUP BY ALL",
    "embeddings_chosen": f"WITH r AS (SELECT m.id AS model_id, m.dv, CASE event_id % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'none' END AS voice_id, CASE event_id % 7 WHEN 0 THEN 'https://x.example/e.bin' WHEN 1 THEN '' END AS own FROM events JOIN {_MODELS} ON m.k = event_id % 14), vo AS (SELECT * FROM {_VOICES}) SELECT r.model_id, nullif(coalesce(own, a.emb, b.emb, c.emb), '') AS embedding, count(*) AS n FROM r LEFT JOIN vo a ON a.model_id = r.model_id AND a.voice_id = r.voice_id LEFT JOIN vo b ON b.model_id = r.model_id AND b.voice_id = r.dv LEFT JOIN vo c ON c.model_id = r.model_id AND c.position = 0 GROUP BY ALL",
    "voices_checked": "WITH r AS (SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AS custom, CASE WHEN event_id % 5 = 0 THEN 'https://x.example/e.bin' END AS e FROM events) SELECT event_id, custom AND e IS NULL AS rejected, CASE WHEN custom THEN e END AS custom_embedding FROM r",
    "reports": "SELECT doc_id AS job_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE coalesce(text, '') END AS preview, CASE doc_id % 4 WHEN 0 THEN '0.50x' WHEN 1 THEN '' WHEN 2 THEN '1.50x' ELSE '2.00x' END AS speed_label, floor((1700000000000 - (1699999000000000 + doc_id * 12345) // 1000) / 100 + 0.5) / 10 AS elapsed_s, printf('%.1f', CASE WHEN doc_id % 3 > 0 THEN doc_id * 400 ELSE 0 END / 1000.0) AS wall_s, CAST(CASE WHEN doc_id % 5 > 0 AND doc_id % 7 > 0 THEN doc_id * 1000 // 24000 ELSE 0 END AS BIGINT) AS audio_s FROM documents",
    "buffered": f"WITH {TURNS_SQL} SELECT session_id, coalesce(min(chunk_index) FILTER (NOT ready), max(chunk_index) + 1) - 1 AS buffered_index FROM tu GROUP BY session_id",
    "to_enqueue": f"WITH {TURNS_SQL}, p AS (SELECT session_id, max(chunk_index) // 2 AS cur FROM tu GROUP BY session_id) SELECT session_id, chunk_index FROM tu JOIN p USING (session_id) WHERE chunk_index <= cur + 1 AND NOT EXISTS (SELECT 1 FROM tu j WHERE j.ready AND j.session_id = tu.session_id AND j.chunk_index = tu.chunk_index)",
    "jobs_of_sessions": f"WITH {TURNS_SQL} SELECT session_id, chunk_index FROM tu WHERE session_id IN (SELECT session_id FROM tu WHERE chunk_index = 0 AND ready)",
    "stopped": f"WITH {TURNS_SQL} SELECT session_id, chunk_index, CASE WHEN ready THEN 'done' WHEN session_id = 7 THEN 'cancelled' ELSE 'pending' END AS status, CASE WHEN NOT ready AND session_id = 7 THEN {_NOW_MS} END AS completed_ms FROM tu",
    "session_lines": f"WITH {TURNS_SQL}, s AS (SELECT session_id, count(*) AS total, least(count(*) FILTER (ready), count(*) - 1) AS cur, coalesce(min(chunk_index) FILTER (NOT ready), max(chunk_index) + 1) - 1 AS b FROM tu GROUP BY session_id) SELECT session_id, (cur + 1) || '/' || total || CASE WHEN total > 1 AND b >= 0 THEN ' · buffered ' || (b + 1) || '/' || total ELSE '' END AS progress FROM s",
    "changed_jobs": f"WITH {EVENTS_SQL}, h AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS half FROM ev), a AS (SELECT job_id, status FROM ev WHERE epoch_us(ts) <= (SELECT half FROM h) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1), b AS (SELECT job_id, status FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1) SELECT coalesce(a.job_id, b.job_id) AS job_id, CASE WHEN a.job_id IS NULL THEN 'added' WHEN b.job_id IS NULL THEN 'removed' WHEN a.status = b.status THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.job_id = b.job_id",
    "correlated": f"WITH {EVENTS_SQL}, rs AS (SELECT seq - seq % 4 AS id, seq, CASE status WHEN 'error' THEN 'error' WHEN 'generating' THEN 'progress' ELSE 'result' END AS type FROM ev), f AS (SELECT id, arg_min(type, seq) AS type, min(seq) AS seq FROM rs WHERE type <> 'progress' GROUP BY id) SELECT e.seq AS id, CASE WHEN f.type = 'result' THEN 'resolved' ELSE 'rejected' END AS outcome, CASE WHEN f.type IS NULL THEN 'Inference worker error' WHEN f.type = 'error' THEN 'm' || f.seq END AS message FROM ev e LEFT JOIN f ON f.id = e.seq",
}
