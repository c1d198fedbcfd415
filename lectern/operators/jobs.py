"""Generation jobs and reading sessions as tables: enrichment, states, queues and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import half_up
from lectern.operators.order import dense_number, ranked

STATUSES = ("pending", "generating", "done", "error", "cancelled")
ACTIVE, TERMINAL = ("pending", "generating"), ("done", "error", "cancelled")


def enrich_model(requests: DataFrame, models: DataFrame, session_model: str | None = None) -> DataFrame:
    """requests with model (id, name, default voice) of their own id, else of the session's model, else with an error."""
    dim = models.select("id", F.col("name").alias("model_name"), "default_voice_id")
    found = requests.withColumnRenamed("model_id", "asked").join(dim, F.col("asked") == F.col("id"), "left")
    current = dim.filter(F.col("id") == F.lit(session_model)).select(*[F.col(c).alias(f"_{c}") for c in dim.columns])
    both = found.join(
        current,
        F.col("id").isNull() & F.col("_id").isNotNull(),
        "left"
    ) if session_model else found.withColumns({f"_{c}": F.lit(None).cast("string") for c in dim.columns})
    chosen = both.withColumns({c: F.coalesce(c, f"_{c}") for c in dim.columns}).drop(*[f"_{c}" for c in dim.columns])
    return chosen.withColumnRenamed("id", "model_id").withColumn(
        "error",
        F.when(F.col("model_id").isNull(), F.concat(F.lit("Unknown model: "), F.coalesce("asked", F.lit(""))))
    ).drop("asked")


def resolve_voice(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Enriched requests with voice_id and voice_name: the voice asked for, or the default where none is; an unknown one stays null."""
    dim = voices.select("model_id", F.col("voice_id").alias("_want"), F.col("name").alias("voice_name"), F.col("voice_id").alias("_found"))
    want = F.when(F.coalesce("voice_id", F.lit("")) == "", F.col("default_voice_id")).otherwise(F.col("voice_id"))
    return requests.withColumn("_want", want).join(dim, ["model_id", "_want"], "left").drop("voice_id", "_want").withColumnRenamed("_found", "voice_id")


def resolve_embedding(jobs: DataFrame, voices: DataFrame) -> DataFrame:
    """jobs with embedding: the job's own, its voice's, the default voice's, the first voice's; only null falls through, and an empty one is not passed on."""
    v = voices.select("model_id", "position", F.col("voice_id").alias("_v"), "speaker_embeddings")
    own = v.select("model_id", F.col("_v").alias("voice_id"), F.col("speaker_embeddings").alias("_own"))
    default = v.select("model_id", F.col("_v").alias("default_voice_id"), F.col("speaker_embeddings").alias("_default"))
    first = v.filter("position = 0").select("model_id", F.col("speaker_embeddings").alias("_first"))
    joined = jobs.join(own, ["model_id", "voice_id"], "left").join(default, ["model_id", "default_voice_id"], "left").join(first, "model_id", "left")
    return joined.withColumn("embedding", F.nullif(F.coalesce("custom_embedding", "_own", "_default", "_first"), F.lit(""))).drop("_own", "_default", "_first")


def validate_voice(requests: DataFrame) -> DataFrame:
    """requests with error for a custom voice without an address, and the address only where it is used."""
    custom = F.coalesce((F.col("model_id") == "speecht5") & (F.col("voice_id") == "custom"), F.lit(False))
    missing = custom & (F.coalesce("custom_embedding", F.lit("")) == "")
    return requests.withColumn(
        "error",
        F.when(missing, "Custom voice: paste a speaker embedding URL first.")
    ).withColumn("custom_embedding", F.when(custom, F.col("custom_embedding")))


def build_jobs(requests: DataFrame, models: DataFrame, voices: DataFrame, session_model: str | None = None) -> DataFrame:
    """New jobs from requests (request_no, text, model_id, voice_id, speed, created_at ...) with ids job-1, job-2, ... in request order.

    Requests whose model is unknown are left out; enrich_model has them with the error. Dense numbers need one order over all
    requests, so they come from a range sort and the sizes of the ranges before. The sorted requests are written as a table when this is called.
    """
    good = resolve_voice(enrich_model(requests, models, session_model).filter("error is null"), voices)
    numbered = dense_number(good, "request_no")
    return numbered.select(
        F.concat(F.lit("job-"), F.col("_n")).alias("job_id"),
        F.col("_n").alias("job_no"),
        "text",
        "voice_id",
        "voice_name",
        "model_id",
        "model_name",
        F.coalesce("speed", F.lit(1.0)).alias("speed"),
        F.lit("pending").alias("status"),
        "created_at"
    )


def latest_job_state(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The last event of each job, by time and then sequence; a maximum, so it is combined in the tasks before it shuffles."""
    others = [c for c in events.columns if c not in (key, "ts", "seq")]
    return events.groupBy(key).agg(F.max(F.struct("ts", "seq", *others)).alias("e")).select(key, "e.*")


def queue_counts(jobs: DataFrame, *by: str) -> DataFrame:
    """active, running and finished jobs, and the label of a queue."""
    status = F.col("status")
    counts = jobs.groupBy(*by).agg(
        F.count_if(status.isin(*ACTIVE)).alias("active"),
        F.count_if(status == "generating").alias("running"),
        F.count_if(status.isin(*TERMINAL)).alias("finished")
    )
    label = F.when(F.col("active") == 0, "").when(
        F.col("running") > 0,
        F.concat(F.col("running"), F.lit(" running · "), F.col("active"), F.lit(" in queue"))
    ).otherwise(F.concat(F.col("active"), F.lit(" in queue")))
    return counts.withColumn("label", label)


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_no"))


def next_job(jobs: DataFrame, loaded_model: str) -> DataFrame:
    """The newest pending job, if it is for the loaded model; else no row."""
    pending = jobs.filter("status = 'pending'").orderBy(F.desc("created_at"), F.desc("job_no")).limit(1)
    return pending.filter(F.col("model_id") == loaded_model)


def next_jobs(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """For each loaded model of models (model_id) what next_job gives: the newest pending job is found once and then matched."""
    newest = jobs.filter("status = 'pending'").orderBy(F.desc("created_at"), F.desc("job_no")).limit(1)
    return newest.join(models.select("model_id").distinct(), "model_id")


def drain_order(jobs: DataFrame) -> DataFrame:
    """Pending jobs with run_order within their model: the newest first. No task holds a model: jobs are numbered range by range.

    The sorted jobs are written as a table when this is called.
    """
    pending = jobs.filter("status = 'pending'")
    return ranked(pending, ["model_id"], [F.desc("created_at"), F.desc("job_no")], "run_order").withColumn("run_order", F.col("run_order").cast("int"))


def cancel_on_switch(jobs: DataFrame, model_id: str, now) -> DataFrame:
    """jobs after a change to model_id: pending jobs of other models are cancelled with the reason and the time."""
    hit = (F.col("status") == "pending") & (F.col("model_id") != model_id)
    return jobs.withColumns(
        {
            "status": F.when(hit, "cancelled").otherwise(F.col("status")),
            "error": F.when(hit, "Model changed before generation started").otherwise(F.col("error")),
            "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))
        }
    )


def cancel_jobs(jobs: DataFrame, ids: DataFrame, now) -> DataFrame:
    """jobs with those of ids (job_id) cancelled, if they were pending or generating."""
    marked = jobs.join(ids.select("job_id").distinct().withColumn("_hit", F.lit(True)), "job_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(*ACTIVE)
    return marked.withColumns({"status": F.when(hit, "cancelled").otherwise(F.col("status")), "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))}).drop("_hit")


def clear_finished(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*ACTIVE))


def apply_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs after results (job_id, ok, message, at): done or error, but a cancelled job stays as it is. Results for unknown jobs are ignored."""
    r = results.select("job_id", F.col("ok").alias("_ok"), F.col("message").alias("_message"), F.col("at").alias("_at"))
    live = F.col("_ok").isNotNull() & (F.col("status") == "generating")
    return (
        jobs.join(r, "job_id", "left")
        .withColumn("_live", live)
        .withColumns(
            {
                "status": F.when(F.col("_live"), F.when(F.col("_ok"), "done").otherwise("error")).otherwise(F.col("status")),
                "error": F.when(F.col("_live") & ~F.col("_ok"), F.col("_message")).otherwise(F.col("error")),
                "completed_at": F.when(F.col("_live"), F.col("_at")).otherwise(F.col("completed_at"))
            }
        )
        .drop("_ok", "_message", "_at", "_live")
    )


def completion_stats(jobs: DataFrame, *by: str) -> DataFrame:
    """Jobs, and mean and greatest duration in ms, of the completed ones."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    duration = ms(F.col("completed_at")) - ms(F.coalesce("started_at", "completed_at"))
    return jobs.filter("completed_at is not null").withColumn("duration_ms", duration).groupBy(*by).agg(
        F.count("*").alias("jobs"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms")
    )


def buffered_index(chunks: DataFrame, key: str = "session_id") -> DataFrame:
    """(session_id, buffered_index): the last chunk of the unbroken run of ready ones from 0; -1 without. chunks have chunk_index and ready."""
    first_gap = F.min(F.when(~F.coalesce("ready", F.lit(False)), F.col("chunk_index")))
    return chunks.groupBy(key).agg((F.coalesce(first_gap, F.max("chunk_index") + 1) - 1).alias("buffered_index"))


def chunks_to_enqueue(chunks: DataFrame, jobs: DataFrame, positions: DataFrame, lookahead: int = 2, key: str = "session_id") -> DataFrame:
    """Chunks up to the lookahead from each session's current chunk that have no job yet."""
    near = chunks.join(positions.select(key, "current_index"), key).filter(F.col("chunk_index") <= F.col("current_index") + lookahead - 1)
    return near.drop("current_index").join(jobs.select(key, "chunk_index"), [key, "chunk_index"], "left_anti")


def session_jobs(jobs: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    return jobs.join(sessions.select(key), key, "left_semi")


def stop_session(jobs: DataFrame, session_id: str, now) -> DataFrame:
    """jobs with the unfinished ones of a session cancelled."""
    hit = F.col("session_id").eqNullSafe(F.lit(session_id)) & F.col("status").isin(*ACTIVE)
    return jobs.withColumns({"status": F.when(hit, "cancelled").otherwise(F.col("status")), "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))})


def session_progress(sessions: DataFrame) -> DataFrame:
    """sessions (current_index, total_chunks, buffered_index) with progress as it is shown."""
    total = F.col("total_chunks")
    buffered = F.when((total > 1) & (F.col("buffered_index") >= 0), F.concat(F.lit(" · buffered "), F.col("buffered_index") + 1, F.lit("/"), total)).otherwise("")
    return sessions.withColumn("progress", F.concat(F.col("current_index") + 1, F.lit("/"), total, buffered))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by the columns that both have."""
    common = [c for c in old.columns if c in new.columns and c != key]
    a = old.select(F.col(key), F.struct(*common).alias("_a"))
    b = new.select(F.col(key), F.struct(*common).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def correlate(requests: DataFrame, responses: DataFrame, reason: str = "Inference worker error") -> DataFrame:
    """(id, outcome, message) of each request: resolved, rejected with the response's message, or rejected for want of one. Progress and unknown ids are ignored."""
    final = responses.filter("type <> 'progress'").groupBy("id").agg(F.min(F.struct("seq", "type", "message")).alias("r"))
    outcome = F.when(F.col("r.type").isNull() | (F.col("r.type") == "error"), "rejected").otherwise("resolved")
    message = F.when(F.col("r").isNull(), reason).when(F.col("r.type") == "error", F.col("r.message"))
    return requests.join(final, "id", "left").select("id", outcome.alias("outcome"), message.alias("message"))


def job_report(jobs: DataFrame, now=None) -> DataFrame:
    """(job_id, preview, speed_label, elapsed_s, wall_s, audio_s) as a list of jobs shows them; jobs have n_samples and sample_rate."""
    text = F.col("text")
    preview = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("…"))).otherwise(text)
    elapsed = F.coalesce(half_up((F.unix_millis(now) - F.unix_millis("started_at")) / 100) / 10, F.lit(0.0)) if now is not None else F.lit(None).cast("double")
    audio = F.coalesce(F.floor(F.col("n_samples") / F.nullif("sample_rate", F.lit(0))), F.lit(0))
    return jobs.select(
        "job_id",
        preview.alias("preview"),
        F.when(F.col("speed") != 1.0, F.concat(F.format_string("%.2f", "speed"), F.lit("x"))).otherwise("").alias("speed_label"),
        elapsed.alias("elapsed_s"),
        F.format_string("%.1f", F.coalesce("duration_ms", F.lit(0)) / 1000.0).alias("wall_s"),
        audio.alias("audio_s")
    )
