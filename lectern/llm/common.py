"""Helpers that the operators share: shared scratch tables, and Arrow batches from rows."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.text import spread
from lectern.sources.files import written

#: df as a written table: lineage ends here, and any executor can read it again.
saved = written

#: The only letters that the contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A given table; with a key, one of fewer partitions than the cluster has cores is dealt out by it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, key) if key else df


def folded(text: Column) -> Column:
    """Null as empty, A-Z in lower case and nothing else changed. Texts of ASCII alone take the faster way."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def wrapped() -> Column:
    """A whole row as one column named row, so that none of its names can clash."""
    return F.struct("*").alias("row")


def unwrapped(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that a row was wrapped from, some of them changed."""
    return df.select(*[changed.get(n, F.col("row")[n]).alias(n) for n in names])


def without(docs: DataFrame, id_col: str, digest: Column, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """docs without the rows of gone, and with one row of each of twice; both are written tables of (gone_id, gone_digest).

    A row is told by its id and the digest of its text together, so that a repeated id loses no other text.
    """
    rows = docs.select(wrapped(), F.col(id_col).alias("id"), digest.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & F.col("digest").eqNullSafe(F.col("gone_digest"))
    stays = rows.join(small(gone), same, "left_anti")
    if not twice.isEmpty():
        once = stays.join(small(twice), same, "left_semi").dropDuplicates(["id", "digest"])
        stays = stays.join(small(twice), same, "left_anti").unionByName(once)
    return unwrapped(stays, docs.columns)


def small(df: DataFrame, rows: int = 200_000, most: int = 16 << 20) -> DataFrame:
    """A written table, marked for broadcast if it has few rows and these have few bytes, however wide one is; else joins shuffle it.

    Bytes are measured as JSON, which numbers and strings exceed by little in memory; a table of too many rows is only counted.
    """
    if df.count() > rows:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


_kept: dict = {"key": None, "value": None}


def kept(key, make=None):
    """What a Python worker keeps from task to task for one operator; that of another operator is let go first."""
    if _kept["key"] != key:
        _kept.update(key=key, value=None)
        trim()
        _kept["value"] = make() if make else None
    return _kept["value"]


def trim() -> None:
    """Gives memory that is free in this process back to the machine: workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, key: str):
    """run for mapInArrow, in a worker that keeps nothing of other operators and gives free memory back when the task ends."""

    def task(batches):
        kept(key)
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def chunks(rows, schema: pa.Schema, size: int = 2048):
    """Record batches of at most size rows from an iterator of tuples."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
