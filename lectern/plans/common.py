"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.text import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line between their lines, so that each is a paragraph."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


#: Documents in a file of a corpus that a query writes: files stay small, whatever the table's size, as a file is one row when it is read.
DOCUMENTS_A_FILE = 100


def as_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Documents as text files below path, in a folder for each language."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("lang").option("maxRecordsPerFile", DOCUMENTS_A_FILE).text(path)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of jobs: (job_id, ts, seq, status, value)."""
    status = F.create_map(*[F.lit(x) for pair in JOB_STATUS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.coalesce(F.try_element_at(status, "event_type"), F.lit("pending")).alias("status"),
        "value"
    )


JOB_STATUS = {"signup": "pending", "view": "generating", "purchase": "done", "error": "error", "click": "cancelled"}
#: The same in SQL.
EVENTS_SQL = "ev AS (SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'generating' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'cancelled' ELSE 'pending' END AS status, value FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions of chunks: (session_id, chunk_index from 0, text, ready, n_words)."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("ready", F.length("text") % 5 != 0).withColumn("n_words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))


TURNS_SQL = r"tu AS (SELECT conv_id AS session_id, turn AS chunk_index, coalesce(text, '') AS text, length(coalesce(text, '')) % 5 <> 0 AS ready, len(regexp_extract_all(coalesce(text, ''), '[^\t\n\x0B\f\r ]+')) AS n_words FROM conversations)"
