"""Streams: files as they arrive, job and session states, correlated messages, highlights and fan-out.

Stateful flows need the RocksDB state store (``STATE_STORE``), whose state spills to disk and not to executor memory.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import reading
from lectern.sources import files as sources
from lectern.streaming import state
from lectern.streaming.delivery import DeliveryLog, Sink

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Rows of whole files that are read at once, and how a table of them is written.
ROWS_AT_ONCE = 16
BY_ROW = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 16 << 20}
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New accepted files below path, each once."""
    read = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
    return sources.routed(read.load(path)).filter(F.col("ext").isin(*sources.ACCEPTED))


def stream_corpus(spark: SparkSession, path: str, good: str, quarantine: str, checkpoint: str, max_files: int = 1000):
    """Extracts every new file once; texts and failures go to two tables with a partition for each batch. Returns the query; it stops when nothing is left.

    A batch that is tried again after a failure overwrites its own partitions, so no row is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        # A row is a whole file: by default Parquet reads 4096 of them at once, and counts their size after a hundred. The session is the stream's own.
        batch.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", ROWS_AT_ONCE)
        texts, failed = sources.split_outcome(sources.written(sources.extract_corpus(batch), **BY_ROW))
        texts.write.mode("overwrite").options(**BY_ROW).parquet(f"{good.rstrip('/')}/batch={number}")
        failed.write.mode("overwrite").parquet(f"{quarantine.rstrip('/')}/batch={number}")

    return stream_files(spark, path, max_files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _micros(interval: str) -> int:
    """An interval such as 10 minutes in microseconds."""
    return int(pd.Timedelta(interval).value // 1000)


def _timed(events: DataFrame, at: str, delay: str) -> DataFrame:
    """events with their time in microseconds as us, and a watermark on it."""
    return events.withColumn("us", F.unix_micros(at)).withWatermark(at, delay)


#: Jobs and sessions are dealt by their ids to so many keys of state: enough to keep a key's row small, and few beside the events of a large batch.
STATE_SHARDS = 1024


def _sharded(events: DataFrame, id_col: str, delay: str, shards: int):
    """events with a watermark, their ids as strings, grouped by a shard of these."""
    rows = _timed(events, "ts", delay).withColumn(id_col, F.col(id_col).cast("string"))
    return rows.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")).groupBy("shard")


def job_state_stream(events: DataFrame, keep: str = "1 day", delay: str = "10 minutes", shards: int = STATE_SHARDS) -> DataFrame:
    """Updates (job_id, status, error, started_at, completed_at) from events (job_id, ts, seq, event, message).

    Events may be late by ``delay``. A finished job stays finished for ``keep`` after it ended; then its state goes.
    """
    schema = "job_id string, status string, error string, started_us long, completed_us long"
    rows = _sharded(events, "job_id", delay, shards)
    found = rows.transformWithStateInPandas(state.JobStates(_micros(keep)), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    at = lambda c: F.timestamp_micros(c).alias(c.replace("_us", "_at"))
    return found.select("job_id", "status", "error", at("started_us"), at("completed_us"))


def session_state_stream(events: DataFrame, keep: str = "1 day", delay: str = "10 minutes", shards: int = STATE_SHARDS) -> DataFrame:
    """Updates of each session (state.SessionStates.NAMES) from events (session_id, ts, seq, event, n, message); states go ``keep`` after the last event."""
    schema = "session_id string, status string, current_index int, buffered_index int, total_chunks int, needs_gesture boolean, error string"
    rows = _sharded(events, "session_id", delay, shards)
    return rows.transformWithStateInPandas(state.SessionStates(_micros(keep)), outputStructType=schema, outputMode="Update", timeMode="EventTime")


#: A worker's requests are dealt by id to so many keys; its failures go to all of them.
SHARDS = 16


def correlate_stream(
    requests: DataFrame, responses: DataFrame, failures: DataFrame | None = None, timeout: str = "10 minutes", delay: str = "1 minute", shards: int = SHARDS
) -> DataFrame:
    """(worker, id, requested_at, outcome, message) of each request, once: resolved, or rejected by an error answer, by a failure of its worker, or timed out.

    requests (id, requested_at), responses (id, responded_at, type, message) and failures (failed_at, message) have a column worker where there are
    several. Ids are whole numbers or strings; rows without one are left out. Progress messages end no request. A request is timed out when the watermark has passed its deadline, which later rows of any of
    the streams bring about; until then it waits. Answers and requests may be late by ``delay``, and an answer may come in before its request.
    """
    kind = requests.schema["id"].dataType.simpleString()
    worker = lambda df: F.col("worker").cast("string") if "worker" in df.columns else F.lit("")
    none = F.lit(None).cast("string")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    # An id that is null would turn long ids into doubles on their way to Python; a failure's id is not read.
    requests, responses = (df.filter("id is not null") for df in (requests, responses))
    asked = requests.select(
        worker(requests).alias("worker"),
        shard.alias("shard"),
        F.col("requested_at").alias("at"),
        "id",
        F.lit(state.REQUEST).alias("kind"),
        none.alias("type"),
        none.alias("message")
    )
    final = responses.filter("type <> 'progress'")
    answered = final.select(worker(final).alias("worker"), shard.alias("shard"), F.col("responded_at").alias("at"), "id", F.lit(state.RESPONSE).alias("kind"), "type", "message")
    all_rows = asked.unionByName(answered)
    if failures is not None:
        each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        failed = failures.select(
            worker(failures).alias("worker"),
            each,
            F.col("failed_at").alias("at"),
            F.lit("0").cast(kind).alias("id"),
            F.lit(state.FAILURE).alias("kind"),
            none.alias("type"),
            "message"
        )
        all_rows = all_rows.unionByName(failed)
    schema = f"worker string, id {kind}, requested_us long, outcome string, message string"
    rows = _timed(all_rows, "at", delay).groupBy("worker", "shard")
    found = rows.transformWithStateInPandas(state.PendingRequests(_micros(timeout), kind), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.select("worker", "id", F.timestamp_micros("requested_us").alias("requested_at"), "outcome", "message")


def progress_stream(responses: DataFrame) -> DataFrame:
    """Progress messages, which are passed on and end no request."""
    return responses.filter("type = 'progress'")


def highlight_stream(positions: DataFrame, chunks: DataFrame, sentences: DataFrame, keys: tuple = ("doc_id", "chunk_index")) -> DataFrame:
    """Highlights (position's columns, sentence_index, word_index) of a stream of positions (keys, time, duration) in static chunks.

    chunks (keys, word_timings) may lack timings, sentences are (keys, global_index, n_words). Each chunk's sentences are one row with the
    words before each of them, so a position finds its word and sentence in one join, by higher-order functions and without a window.
    """
    timings = F.col("word_timings") if "word_timings" in chunks.columns else F.lit(None).cast("array<double>")
    timed = chunks.select(*keys, timings.alias("_timings"))
    static = reading.chunk_words(sentences, keys).withColumnsRenamed({"n_words": "_n", "ranges": "_ranges"}).join(timed, list(keys), "left")
    usable = positions.filter("duration > 0 and not isnan(duration) and duration < double('infinity')")
    target = usable.join(static, list(keys)).filter("_n > 0")
    word = reading.word_at_time(F.col("_n"), F.col("time"), F.col("duration"), F.col("_timings"))
    hit = target.withColumn("_word", word).withColumn("_hit", reading.word_range(F.col("_ranges"), F.col("_word"))).filter("_hit is not null")
    return hit.select(*positions.columns, F.col("_hit.global_index").alias("sentence_index"), (F.col("_word") - F.col("_hit.first_word")).alias("word_index"))


def fan_out(stream: DataFrame, sinks: dict[str, Sink], checkpoint: str, log: str, failures: list | None = None):
    """One stream to several consumers, by a durable log (delivery.DeliveryLog): a batch is written once and then given to each of them.

    A consumer that fails is noted in failures and keeps its place: the next batch, a restart or redeliver() serves it again, while the others
    go on. ``sinks`` may change while the query runs: a new consumer gets the batches from then on, one that is removed gets none.
    Returns the query, which stops when nothing is left.
    """
    kept = DeliveryLog(stream.sparkSession, log)

    def deliver(batch: DataFrame, number: int) -> None:
        for name in list(sinks):
            kept.subscribe(name, number - 1)
        kept.write(batch, number)
        kept.serve(sinks, failures)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redeliver(spark: SparkSession, sinks: dict[str, Sink], log: str, failures: list | None = None) -> dict[str, int]:
    """Serves consumers of a log what they have not had yet, without a new batch; returns how many batches each still waits for."""
    return DeliveryLog(spark, log).serve(sinks, failures)
