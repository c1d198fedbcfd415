"""Exact deduplication by skew-safe combining, in DataFrame operations only.

A text whose digest no other row has needs no comparison. The others go through three stages, and each groups by the digest
*and the whole text*, so that two texts with one digest never meet:

1. local: Spark's map-side partial aggregate leaves one row a text and salt in every task;
2. salted: those rows meet by (digest, salt, text), so that a hot text is spread over ``salts`` reducers;
3. global: at most ``salts`` winners of each text meet and give the final one.

Whole texts are shuffled only where they may have a copy. Rows then find their group by its digest, as narrow rows of a join
that adaptive execution may split where a group is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import folded, saved, small, without

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when identical after lower-casing A-Z. Null counts as the empty text.
    The row with the largest id stays. A null id never beats another; rows that repeat an id and its
    text get the same answer. An empty table gives an empty result, and columns other than the two named are not read.
    """
    if salts < 1:
        raise ValueError("there must be a salt at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("body")).withColumn("digest", F.sha2("body", 256))
    narrow = saved(rows.select("doc_id", "digest"))
    again = saved(narrow.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    suspect = saved(narrow.join(small(again), "digest", "left_semi").select(F.xxhash64("doc_id").alias("mark")).distinct())
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("mark")).join(small(suspect), "mark", "left_semi")
    texts = held.select("doc_id", folded(F.col("text")).alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    by_salt = texts.groupBy("digest", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = by_salt.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups, key = saved(winners.drop("body")), ["digest"]
    if not groups.groupBy("digest").count().filter("count > 1").isEmpty():
        # Two texts share a digest: then the text itself takes part in the last join as well.
        groups, key, narrow = winners, ["digest", "body"], rows
    found = narrow.join(small(groups) if len(key) == 1 else groups, key, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id; all columns stay.

    Rows are told apart by id and text together, so a repeated id loses no other text. Of rows that repeat both, one stays.
    What is joined to docs are narrow rows of what goes, not texts.
    """
    found = saved(exact_groups(docs, id_col, text_col))
    key = [F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_digest")]
    gone = saved(found.filter("not kept").select(*key).distinct())
    twice = saved(found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").select(*key))
    return without(docs, id_col, F.sha2(folded(F.col(text_col)), 256), gone, twice)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
