"""Queries over order lines as positioned items: a page for each order, items in line order, y the quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import layout as O
from lectern.plans.common import table

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).alias("path"),
        F.col("l_orderkey").alias("page"),
        *_ORDER,
        F.col("l_quantity").alias("y"),
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("str")
    )


def _lines(spark, sf_dir):
    return O.items_to_lines(_items(spark, sf_dir), keys=("path", "page"), order=_ORDER)


def item_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def capped_pages(spark, sf_dir):
    kept, report = O.cap_pages(_items(spark, sf_dir), 5000)
    return report.join(kept.groupBy("path").agg(F.count("*").alias("items")), "path", "left").select("path", "num_pages", "truncated", F.coalesce("items", F.lit(0)).alias("items"))


def assembled(spark, sf_dir):
    return O.assemble_document(_lines(spark, sf_dir)).select("path", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


def _boxes(spark, sf_dir):
    """Items with boxes, in lines by their ship mode's place in a page."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).cast("string").alias("doc_id"),
        F.col("l_orderkey").alias("page"),
        (F.col("l_linenumber") % 3).alias("line_id"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("l_partkey").cast("string").alias("text"),
        F.col("l_extendedprice").alias("x0"),
        (F.col("l_quantity") * 10).alias("y0"),
        (F.col("l_extendedprice") + 8).alias("x1"),
        (F.col("l_quantity") * 10 + 6).alias("y1")
    )


def boxed_lines(spark, sf_dir):
    rows = O.line_blocks(_boxes(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("y").alias("top"), F.max("width").alias("widest"), F.max("height").alias("tallest"))


def word_lines(spark, sf_dir):
    """Boxes grouped to lines by their places, and how many lines a page has: lines are numbered from 0 without a gap."""
    words = _boxes(spark, sf_dir).select(
        "doc_id",
        F.col("page").cast("int").alias("page"),
        F.lit(600.0).alias("page_height"),
        F.col("seq").cast("int").alias("seq"),
        "text",
        F.struct("x0", "y0", "x1", "y1").alias("bbox")
    )
    return O.words_to_lines(words).groupBy("doc_id", "page").agg((F.max("line_id") + 1).cast("long").alias("lines"), F.count("*").alias("words"))


def ruled_lines(spark, sf_dir):
    """Words whose tops lie on rules farther apart than a line may be off, so that reading order is a total order; tall words reach into lines above and below."""
    tall = (F.col("l_partkey") % 5) * 16
    top = F.col("l_quantity") * 40
    box = F.struct(F.col("l_extendedprice").alias("x0"), top.alias("y0"), (F.col("l_extendedprice") + 8).alias("x1"), (top + tall).alias("y1"))
    words = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).cast("string").alias("doc_id"),
        F.col("l_orderkey").cast("int").alias("page"),
        F.lit(600.0).alias("page_height"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("seq"),
        F.col("l_partkey").cast("string").alias("text"),
        box.alias("bbox"),
    )
    return O.words_to_lines(words).select("doc_id", "page", "seq", "line_id")


def bare_pages(spark, sf_dir):
    """Orders as pages, of which those without lines get one block."""
    orders = table(spark, sf_dir, "orders")
    pages = orders.select(
        F.floor(F.col("o_orderkey") / 1000).cast("string").alias("doc_id"),
        F.col("o_orderkey").alias("page"),
        F.concat(F.lit(" order "), "o_orderkey").alias("text"),
        F.lit(612.0).alias("width"),
        F.lit(792.0).alias("height")
    )
    blocks = O.line_blocks(_boxes(spark, sf_dir))
    return O.page_fallback(pages, blocks).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("width") == 306).alias("whole"))


def previews(spark, sf_dir):
    blocks = _lines(spark, sf_dir)
    return O.layout_preview(blocks, 50).select(
        "path",
        "truncated",
        F.size(F.from_json("blocks", "array<struct<text:string>>")).cast("long").alias("n"),
        F.sha2(F.array_join(F.from_json("blocks", "array<struct<text:string>>")["text"], "|"), 256).alias("sha")
    )


QUERIES = {f.__name__: f for f in (item_lines, capped_pages, assembled, boxed_lines, word_lines, ruled_lines, bare_pages, previews)}

_ITEMS = "it AS (SELECT l_orderkey // 1000 AS path, l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_quantity AS y, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE l_partkey::VARCHAR END AS str FROM lineitem)"
_LINES = f"{_ITEMS}, br AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY path, page ORDER BY seq)) > 3 THEN 1 ELSE 0 END AS b FROM it WHERE str <> ''), ln AS (SELECT *, sum(b) OVER (PARTITION BY path, page ORDER BY seq) AS line_no FROM br), li AS (SELECT path, page, CAST(line_no AS BIGINT) AS line_no, string_agg(str, ' ' ORDER BY seq) AS text FROM ln GROUP BY path, page, line_no)"
_BOXES = "bx AS (SELECT (l_orderkey // 1000)::VARCHAR AS doc_id, l_orderkey AS page, l_linenumber % 3 AS line_id, min(l_extendedprice) AS x0, min(l_quantity * 10) AS y0, max(l_extendedprice + 8) AS x1, max(l_quantity * 10 + 6) AS y1 FROM lineitem GROUP BY ALL)"
ORACLES = {
    "item_lines": f"WITH {_LINES} SELECT path, page, line_no, text FROM li",
    "capped_pages": f"WITH {_ITEMS} SELECT path, max(page) AS num_pages, max(page) > 5000 AS truncated, count(*) FILTER (page <= 5000) AS items FROM it GROUP BY path",
    "assembled": f"WITH {_LINES}, d AS (SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY page, line_no) AS text FROM li GROUP BY path) SELECT path, sha256(text) AS sha, length(text) AS n FROM d",
    "boxed_lines": f"WITH {_BOXES} SELECT doc_id, count(*) AS lines, min(y0 / 2.0) AS top, max((x1 - x0) / 2.0) AS widest, max((y1 - y0) / 2.0) AS tallest FROM bx GROUP BY doc_id",
    "ruled_lines": """WITH RECURSIVE w AS (SELECT (l_orderkey // 1000)::VARCHAR AS doc_id, l_orderkey AS page, l_partkey * 10 + l_linenumber AS seq, l_quantity * 40 AS y0,
l_quantity * 40 + (l_partkey % 5) * 8 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_partkey * 10 + l_linenumber) AS n FROM lineitem),
f AS (SELECT doc_id, page, seq, n, [c] AS tops, 1 AS k FROM w WHERE n = 1
UNION ALL SELECT w.doc_id, w.page, w.seq, w.n,
CASE WHEN near.k IS NULL THEN list_append(f.tops, w.c) ELSE list_transform(f.tops, lambda t, i: CASE WHEN i = near.k THEN least(t, w.y0) ELSE t END) END,
coalesce(near.k, len(f.tops) + 1) FROM f JOIN w ON w.page = f.page AND w.n = f.n + 1,
LATERAL (SELECT nullif(list_position(list_transform(f.tops, lambda t: abs(t - w.c) <= 15), true), 0) AS k) near)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(seq AS INTEGER) AS seq, CAST(k - 1 AS INTEGER) AS line_id FROM f""",
    "bare_pages": f"WITH {_BOXES}, b AS (SELECT doc_id, page, (x1 - x0) / 2.0 AS width FROM bx), p AS (SELECT (o_orderkey // 1000)::VARCHAR AS doc_id, o_orderkey AS page FROM orders), u AS (SELECT doc_id, width FROM b UNION ALL SELECT doc_id, 306.0 FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.page = p.page)) SELECT doc_id, count(*) AS blocks, count(*) FILTER (width = 306) AS whole FROM u GROUP BY doc_id",
    "previews": f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page, line_no) AS k FROM li) SELECT path, max(k) > 50 AS truncated, count(*) FILTER (k <= 50) AS n, sha256(string_agg(text, '|' ORDER BY k) FILTER (k <= 50)) AS sha FROM r GROUP BY path",
}
