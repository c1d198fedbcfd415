"""Lines and pages from positioned text."""

from __future__ import annotations

import itertools
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGES = 500
#: Pages are drawn at this scale, and a line may sit so much of a page's height off.
RENDER, LINE_SHARE = 2.0, 0.025
#: Partitions of sorted words for each split of the table they are read from.
SPLIT = 8


def items_to_lines(items: DataFrame, gap: float = 3.0, keys: tuple = ("path", "page"), order: tuple = ("seq",)) -> DataFrame:
    """(keys, line_no, text): non-empty items in order, a new line where y moves by more than gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = items.filter("str <> ''").withColumn("_seq", F.row_number().over(w))
    rows = rows.withColumn("_new", F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "line_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_seq", "str")))["str"], " ").alias("text"))


def cap_pages(items: DataFrame, max_pages: int = MAX_PAGES, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Items of the first pages, and (path, num_pages, truncated)."""
    report = items.groupBy(key).agg(F.max("page").alias("num_pages")).withColumn("truncated", F.col("num_pages") > max_pages)
    return items.filter(F.col("page") <= max_pages), report


def page_line_ids(y0: list, x0: list, y1: list, limit: float) -> list[int]:
    """The line of each of a page's words, which come in (y0, x0, seq) order.

    Reading order is by top where two words are farther apart than the limit, else by left edge; that order is not transitive, so it is applied by
    one fixed sort. A word joins the first line that is near its centre; a line is where its first word's centre is, and rises to the top of what joins it.
    """
    order = sorted(range(len(y0)), key=cmp_to_key(lambda a, b: y0[a] - y0[b] if abs(y0[a] - y0[b]) > limit else x0[a] - x0[b]))
    tops: list[float] = []
    out = [0] * len(y0)
    for i in order:
        centre = (y0[i] + y1[i]) / 2
        for k, top in enumerate(tops):
            if abs(top - centre) <= limit:
                tops[k] = min(top, y0[i])
                break
        else:
            k = len(tops)
            tops.append(centre)
        out[i] = k
    return out


def _numbered(batches):
    """Line ids for rows that are sorted by page, many pages a batch; the last page of a batch waits for its rest."""
    names = ["doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1"]
    held = None
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        changed = (rows["doc_id"].ne(rows["doc_id"].shift()) | rows["page"].ne(rows["page"].shift())).to_numpy()
        starts = np.flatnonzero(changed).tolist()
        end = len(rows) if batch is None else starts[-1]
        held = rows.iloc[end:].reset_index(drop=True)
        y0, x0, y1, limit = (rows[c].to_numpy() for c in ("y0", "x0", "y1", "page_height"))
        ids: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            if a < end:
                ids += page_line_ids(y0[a:b].tolist(), x0[a:b].tolist(), y1[a:b].tolist(), float(limit[a]) * LINE_SHARE)
        yield rows.iloc[:end][names].assign(line_id=np.array(ids, np.int32))


def words_to_lines(words: DataFrame) -> DataFrame:
    """words (doc_id, page, page_height, seq, text, bbox) with a line_id: each word joins the first line that is near its centre.

    The fold depends on order, so a page, which is small, is one group; pages are sorted by Spark and folded many at a time.
    """
    flat = words.select("doc_id", "page", "page_height", "seq", "text", *[F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    # A task's rows do not grow with the table: each of its splits is dealt to SPLIT partitions, and none less than the session's.
    parts = max(SPLIT * flat.rdd.getNumPartitions(), int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = flat.repartition(parts, "doc_id", "page").sortWithinPartitions("doc_id", "page", "y0", "x0", "seq")
    return dealt.mapInPandas(_numbered, "doc_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, line_id int")


def line_blocks(grouped: DataFrame, scale: float = RENDER) -> DataFrame:
    """(doc_id, page, line_no, text, x, y, width, height): a box around each line's words, from left to right; lines from the top; blank ones dropped."""
    boxes = grouped.groupBy("doc_id", "page", "line_id").agg(
        *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1")],
        F.array_join(F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))["text"], " ").alias("text")
    )
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "line_id")) - 1
    return boxes.filter(F.trim("text") != "").select(
        "doc_id",
        "page",
        order.alias("line_no"),
        "text",
        (F.col("x0") / scale).alias("x"),
        (F.col("y0") / scale).alias("y"),
        ((F.col("x1") - F.col("x0")) / scale).alias("width"),
        ((F.col("y1") - F.col("y0")) / scale).alias("height")
    )


def page_fallback(pages: DataFrame, blocks: DataFrame, scale: float = RENDER) -> DataFrame:
    """blocks, and one block over the whole page for each page (doc_id, page, text, width, height) that has text but no block."""
    bare = pages.filter(F.trim("text") != "").join(blocks, ["doc_id", "page"], "left_anti")
    whole = bare.select(
        "doc_id",
        "page",
        F.lit(0).alias("line_no"),
        F.trim("text").alias("text"),
        F.lit(0.0).alias("x"),
        F.lit(0.0).alias("y"),
        (F.col("width") / scale).alias("width"),
        (F.col("height") / scale).alias("height")
    )
    return blocks.unionByName(whole)


def assemble_document(lines: DataFrame, key: str = "path") -> DataFrame:
    """(path, text): lines by page and number, a blank line between them."""
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))["text"], "\n\n").alias("text"))


def layout_preview(blocks: DataFrame, n: int = 50, key: str = "path", order: tuple = ("page", "line_no")) -> DataFrame:
    """(path, blocks, truncated): the first n blocks of each document as JSON."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = blocks.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n + 1)
    others = [c for c in blocks.columns if c != key]
    kept = F.filter(F.array_sort(F.collect_list(F.struct("_n", F.struct(*others).alias("b")))), lambda x: x["_n"] <= n)
    return rows.groupBy(key).agg(F.to_json(kept["b"]).alias("blocks"), (F.max("_n") > n).alias("truncated"))
