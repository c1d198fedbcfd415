"""Queries that run the streams over the given tables as they would arrive, until nothing is left, and read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.common import EVENTS_SQL, TURNS_SQL, as_files, job_events, table, turns
from lectern.sources import files as S
from lectern.streaming import flows


BATCHES, ROWS_A_FILE = 6, 1_000_000


def _arriving(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as a stream of several micro-batches, from a table of its own; with a time, rows arrive in its order."""
    spark, path, held = df.sparkSession, S.scratch(df.sparkSession), S.written(df)
    if at:
        place = F.unix_micros(at).cast("double")
        edges = held.select(place.alias("t")).approxQuantile("t", [k / BATCHES for k in range(1, BATCHES)], 0.01)
        part = F.lit(0)
        for edge in sorted(edges):
            part = part + F.when(place > edge, 1).otherwise(0)
    else:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(BATCHES))
    files = max(1, held.count() // BATCHES // ROWS_A_FILE)
    for k in range(BATCHES):  # one after the other: a stream takes files by the time they were written
        held.filter(part == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives until its source is empty, with the number of their batch.

    A stateful stream keeps the number of state partitions that it starts with: twice the cluster's cores at most, as every batch has a task for each.
    """
    spark, path = stream.sparkSession, S.scratch(stream.sparkSession)
    spark.conf.set(*flows.STATE_STORE)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), 2 * spark.sparkContext.defaultParallelism)))
        started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", S.scratch(spark))
        started.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.parquet(path)


def streamed_jobs(spark, sf_dir):
    """The last state of every job whose first event makes it pending, from the stream of events; finished jobs are kept longer than the events last."""
    log = job_events(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), "ts", F.col("seq").cast("int").alias("seq"), F.col("status").alias("event"), F.concat(F.lit("m"), "seq").alias("message")
    )
    out = _drained(flows.job_state_stream(_arriving(log, "ts"), keep="1000 days"), "update")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "error", "started_at", "completed_at"), "batch").alias("s"))
    return last.select("job_id", "s.status", "s.error", F.unix_millis("s.started_at").alias("started_ms"), F.unix_millis("s.completed_at").alias("completed_ms"))


def streamed_sessions(spark, sf_dir):
    """Conversations as reading sessions: started, ready chunks announced, the first third of the chunks played, and then what their size tells.

    Sessions of 4n + 1 chunks are paused, those of 8n + 2 fail, those of 8n + 6 are blocked for want of a gesture, those of 4n + 3 are stopped while a
    chunk still gets ready, and the others are paused and resumed.
    """
    rows = turns(spark, sf_dir)
    sizes = rows.groupBy("session_id").agg(F.count("*").alias("total"))
    each = rows.join(sizes, "session_id")
    none = F.lit(None).cast("string")

    def event(df, name, n, seconds, message=none):
        at = F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
        return df.select(
            F.col("session_id").cast("string").alias("session_id"),
            at.alias("ts"),
            F.lit(0).alias("seq"),
            F.lit(name).alias("event"),
            n.cast("int").alias("n"),
            message.alias("message")
        )

    zero, of = F.lit(0), lambda k, n: sizes.filter(F.col("total") % k == n)
    log = event(sizes, "start", F.col("total"), zero)
    for more in (
        event(each.filter("ready"), "chunk_ready", F.col("chunk_index"), F.col("chunk_index") + 1),
        event(of(4, 2), "blocked", zero, F.lit(900)),
        event(of(4, 2), "gesture", zero, F.lit(901)),
        event(each.filter("chunk_index < total / 3"), "chunk_ended", F.col("chunk_index"), F.col("chunk_index") + 1000),
        event(of(4, 1), "pause", zero, F.lit(2000)),
        event(of(8, 2), "failed", zero, F.lit(2000), F.lit("no sound")),
        event(of(8, 6), "blocked", zero, F.lit(2000)),
        event(of(4, 3), "stop", zero, F.lit(2000)),
        event(of(4, 3), "chunk_ready", zero, F.lit(2001)),
        event(of(4, 0), "pause", zero, F.lit(2000)),
        event(of(4, 0), "resume", zero, F.lit(2001)),
    ):
        log = log.unionByName(more)
    out = _drained(flows.session_state_stream(_arriving(log, "ts")), "update")
    names = ["status", "current_index", "buffered_index", "total_chunks", "needs_gesture", "error"]
    return out.groupBy("session_id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("session_id", "s.*")


#: Workers fail at events of type error above the first value; answers come in time above the second one and too late above the third.
FAILS, ANSWERS, LATE = 150, 50, 40


def _messages(spark, sf_dir):
    """Events as requests of ten workers, with a progress message each, some answers and a few failures, as one log by time."""
    log = job_events(spark, sf_dir).withColumn("worker", F.pmod("job_id", F.lit(10)).cast("string"))
    none = F.lit(None).cast("string")
    text = F.concat(F.lit("m"), "seq")
    after = lambda minutes: F.col("ts") + F.expr(f"interval {minutes} minutes")
    answer = F.when(F.col("status") == "error", "error").otherwise("result")
    row = lambda df, kind, at, type_, message: df.select(
        "worker",
        F.col("seq").alias("id"),
        at.alias("at"),
        F.lit(kind).alias("kind"),
        type_.alias("type"),
        message.alias("message")
    )
    requests = row(log, "request", F.col("ts"), none, none)
    soon = row(log.filter(F.col("value") > ANSWERS), "response", after(1), answer, text)
    late = row(log.filter((F.col("value") > LATE) & (F.col("value") <= ANSWERS)), "response", after(20), answer, text)
    progress = row(log, "response", F.col("ts"), F.lit("progress"), none)
    failed = row(log.filter((F.col("status") == "error") & (F.col("value") > FAILS)), "failure", F.col("ts"), none, F.lit("worker failed"))
    return requests.unionByName(soon).unionByName(late).unionByName(progress).unionByName(failed)


def streamed_answers(spark, sf_dir):
    """How the requests of all workers ended: answered, rejected by an error or by their worker's failure, or timed out after ten minutes."""
    log = _arriving(_messages(spark, sf_dir), "at")
    requests = log.filter("kind = 'request'").select("worker", "id", F.col("at").alias("requested_at"))
    responses = log.filter("kind = 'response'").select("worker", "id", F.col("at").alias("responded_at"), "type", "message")
    failures = log.filter("kind = 'failure'").select("worker", F.col("at").alias("failed_at"), "message")
    out = _drained(flows.correlate_stream(requests, responses, failures, timeout="10 minutes", delay="1 minute"), "append")
    return out.select("worker", "id", F.unix_micros("requested_at").alias("requested_us"), "outcome", "message")


def streamed_progress(spark, sf_dir):
    log = job_events(spark, sf_dir).select(F.col("seq").alias("id"), F.when(F.col("status") == "generating", "progress").otherwise("result").alias("type"))
    return _drained(flows.progress_stream(_arriving(log)), "append").select("id")


def streamed_highlights(spark, sf_dir):
    """Three positions in each turn, whose sentences end at full stops and line ends; every other turn has word timings."""
    rows = turns(spark, sf_dir).withColumnRenamed("session_id", "doc_id")
    pieces = rows.select("doc_id", "chunk_index", F.posexplode(F.split("text", r"[.\n]")).alias("global_index", "line"))
    sentences = pieces.select("doc_id", "chunk_index", "global_index", F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).alias("n_words"))
    totals = sentences.groupBy("doc_id", "chunk_index").agg(F.sum("n_words").cast("int").alias("n")).filter("n > 0 and chunk_index % 2 = 0")
    timings = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i.cast("double") * 0.4)
    chunks = totals.select("doc_id", "chunk_index", timings.alias("word_timings"))
    at = F.explode(F.array(F.lit(0.0), F.lit(1.7), F.lit(6.0))).alias("time")
    positions = rows.select("doc_id", "chunk_index", at, F.when(F.col("chunk_index") % 4 == 3, 0.0).otherwise(10.0).alias("duration"))
    out = _drained(flows.highlight_stream(_arriving(positions), chunks, sentences), "append")
    return out.select(
        "doc_id",
        "chunk_index",
        F.floor(F.col("time") * 10 + 0.5).alias("t"),
        F.col("sentence_index").cast("long").alias("sentence_index"),
        F.col("word_index").cast("long").alias("word_index")
    )


def fanned_out(spark, sf_dir):
    """One stream of events to a consumer that is steady and to one that is down after its first batch, until it is served again after a restart."""
    out, log, check = S.scratch(spark), S.scratch(spark), S.scratch(spark)
    down = [False]

    def counting(name):
        def sink(batch, number):
            if name == "flaky":
                if down[0]:
                    raise RuntimeError("down")
                down[0] = True
            batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/sink={name}/batch={number}")

        return sink

    sinks, failures = {n: counting(n) for n in ("flaky", "steady")}, []
    stream = _arriving(table(spark, sf_dir, "events").select("event_id", "event_type"))
    for _ in range(2):  # the second run is a restart, which finds no new rows
        flows.fan_out(stream, sinks, check, log, failures).awaitTermination()
    while flows.redeliver(spark, sinks, log, failures)["flaky"]:
        down[0] = False
    return spark.read.parquet(out).groupBy("sink", "event_type").agg(F.sum("n").alias("n"))


def streamed_corpus(spark, sf_dir):
    """Documents as text files that arrive once; a second run of the stream finds nothing new."""
    source, good, bad, check = (S.scratch(spark) for _ in range(4))
    as_files(spark, sf_dir, source)
    for _ in range(2):
        flows.stream_corpus(spark, source, good, bad, check).awaitTermination()
    lang = F.regexp_extract("path", r"lang=([^/]*)/", 1)
    return spark.read.parquet(good).groupBy(lang.alias("lang")).agg(F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (streamed_jobs, streamed_sessions, streamed_answers, streamed_progress, streamed_highlights, fanned_out, streamed_corpus)}
_MS = "CAST(epoch_us({}) // 1000 AS BIGINT)"
_SPACE = r"[^\t\n\x0B\f\r ]+"
ORACLES = {
    "streamed_jobs": f"""WITH {EVENTS_SQL}, p AS (SELECT job_id, min((ts, seq)) AS p FROM ev WHERE status = 'pending' GROUP BY job_id),
t AS (SELECT job_id, arg_min(struct_pack(status := status, ts := ts, seq := seq), (ts, seq)) AS t FROM ev JOIN p USING (job_id) WHERE status IN ('done', 'error', 'cancelled') AND (ts, seq) > p GROUP BY job_id),
g AS (SELECT job_id, max(ts) AS g FROM ev JOIN p USING (job_id) LEFT JOIN t USING (job_id) WHERE status = 'generating' AND (ev.ts, ev.seq) > p AND (t IS NULL OR (ev.ts, ev.seq) < (t.ts, t.seq)) GROUP BY job_id)
SELECT CAST(job_id AS VARCHAR) AS job_id, CASE WHEN t IS NOT NULL THEN t.status WHEN g IS NOT NULL THEN 'generating' ELSE 'pending' END AS status, CASE WHEN t.status = 'error' THEN 'm' || t.seq END AS error, {_MS.format('g')} AS started_ms, {_MS.format('t.ts')} AS completed_ms
FROM p LEFT JOIN t USING (job_id) LEFT JOIN g USING (job_id)""",
    "streamed_sessions": f"""WITH {TURNS_SQL}, z AS (SELECT session_id, count(*) AS total, coalesce(min(chunk_index) FILTER (NOT ready), count(*)) - 1 AS b FROM tu GROUP BY session_id),
e AS (SELECT session_id, count(*) FILTER (chunk_index < total / 3.0) AS ended FROM tu JOIN z USING (session_id) GROUP BY session_id)
SELECT CAST(session_id AS VARCHAR) AS session_id,
CASE total % 4 WHEN 1 THEN 'paused' WHEN 2 THEN 'paused' WHEN 3 THEN 'idle' ELSE CASE WHEN ended >= total THEN 'finished' ELSE 'playing' END END AS status,
CAST(CASE WHEN total % 4 = 3 THEN 0 ELSE ended END AS INTEGER) AS current_index, CAST(CASE WHEN total % 4 = 3 THEN -1 ELSE b END AS INTEGER) AS buffered_index,
CAST(total AS INTEGER) AS total_chunks, total % 8 = 6 AS needs_gesture,
CASE total % 8 WHEN 2 THEN 'Playback failed: no sound' WHEN 6 THEN 'Browser blocked autoplay. Click play to continue.' END AS error FROM z JOIN e USING (session_id)""",
    "streamed_answers": f"""WITH {EVENTS_SQL}, m AS (SELECT job_id % 10 AS worker, seq AS id, ts, value, status FROM ev),
f AS (SELECT worker, ts AS f FROM m WHERE status = 'error' AND value > {FAILS}),
r AS (SELECT m.*, (SELECT min(f) FROM f WHERE f.worker = m.worker AND f >= m.ts AND f <= m.ts + INTERVAL 10 MINUTE) AS f FROM m),
w AS (SELECT max(u) - INTERVAL 1 MINUTE AS passed FROM (SELECT ts AS u FROM m UNION ALL SELECT ts + INTERVAL 1 MINUTE FROM m WHERE value > {ANSWERS}
UNION ALL SELECT ts + INTERVAL 20 MINUTE FROM m WHERE value > {LATE} AND value <= {ANSWERS})),
o AS (SELECT *, CASE WHEN value > {ANSWERS} AND (f IS NULL OR ts + INTERVAL 1 MINUTE <= f) THEN 'answer' WHEN f IS NOT NULL THEN 'failure'
WHEN ts + INTERVAL 10 MINUTE < passed THEN 'time' END AS why FROM r, w)
SELECT CAST(worker AS VARCHAR) AS worker, id, epoch_us(ts) AS requested_us, CASE WHEN why = 'answer' AND status <> 'error' THEN 'resolved' ELSE 'rejected' END AS outcome,
CASE why WHEN 'answer' THEN 'm' || id WHEN 'failure' THEN 'worker failed' ELSE 'timed out' END AS message FROM o WHERE why IS NOT NULL""",
    "streamed_progress": f"WITH {EVENTS_SQL} SELECT seq AS id FROM ev WHERE status = 'generating'",
    "streamed_highlights": rf"""WITH {TURNS_SQL}, l AS (SELECT session_id, chunk_index, regexp_split_to_array(text, '[.\n]') AS l FROM tu),
p AS (SELECT session_id, chunk_index, unnest(range(len(l))) AS g, unnest(l) AS line FROM l), k AS (SELECT *, len(regexp_extract_all(line, '{_SPACE}')) AS k FROM p),
s AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY session_id, chunk_index ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k),
n AS (SELECT session_id, chunk_index, sum(k) AS n, unnest([0.0::DOUBLE, 1.7::DOUBLE, 6.0::DOUBLE]) AS time FROM k WHERE chunk_index % 4 <> 3 GROUP BY session_id, chunk_index HAVING sum(k) > 0),
w AS (SELECT *, CASE WHEN chunk_index % 2 = 0 THEN greatest(0, (SELECT count(*) FROM range(0, CAST(n AS BIGINT)) r(i) WHERE i::DOUBLE * 0.4::DOUBLE <= time) - 1)
ELSE least(floor(time / 10.0::DOUBLE * n), n - 1) END AS word FROM n)
SELECT session_id AS doc_id, chunk_index, CAST(floor(time * 10 + 0.5) AS BIGINT) AS t, g AS sentence_index, CAST(word - s AS BIGINT) AS word_index
FROM w JOIN s USING (session_id, chunk_index) WHERE word >= s AND word < s + k""",
    "fanned_out": "SELECT sink, event_type, count(*) AS n FROM events, (SELECT unnest(['flaky', 'steady']) AS sink) GROUP BY sink, event_type",
    "streamed_corpus": "SELECT coalesce(lang, 'none') AS lang, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars FROM documents GROUP BY ALL",
}
