"""Hard negatives by best-first search in a packed R-tree.

The tree is packed by sort-tile-recursive: rows are dealt to slabs by quantiles of the coordinate of largest spread, a range sort
by (slab, next coordinate, id) cuts them to pages of ``PAGE`` rows, and inside a page two further coordinates tile ``FAN`` inner
boxes of ``FAN`` leaves each. A box has its least and greatest value in every coordinate, so a query's inner product with any row of
it lies in the sum of the per-coordinate intervals. A queue takes boxes by their upper bound, and a box is left out if its
interval lies outside all score windows, or strictly below the kth score so far (a tie may still win by its smaller id).

Pages are rows of a written table. Queries are packed in blocks and first meet their home page, which gives each a kth score to prune
with, then all pages, in a Cartesian product of the partitions of both tables. A task goes through its pages block by block and gives at
most k rows a window for all of them. No join is a broadcast: packed vectors fill many times the bytes that Spark expects from their files.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import saved, trim
from lectern.llm.vectors import exact_in_double, grid, matrix, packed, unpacked, usable, width

PAGE, FAN, BLOCK = 4096, 8, 512
#: Into how many partitions blocks are put at most, so that there are no more tasks than so many for each partition of pages.
LANES = 8
#: A page a task up to so many tasks, beyond them so many pages a task: a range sort sends the driver 300 keys for each task.
TASKS, PAGES_A_TASK = 512, 16
#: How many positives and negatives, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SCALE, EVERY = 256, 100
#: Inner products of such components fit 64 bits up to 128 dimensions.
LARGEST = 1 << 28

#: Pages fill their files as they fill memory, so that partitions of files hold no more of them where vectors are equal.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
PAGES = "page long, ids array<long>, labels array<long>, rows binary, leaves array<int>, inner array<int>, low binary, high binary"


def integer_points(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, q): the rows that take part, with their vectors on the integer grid; a written table.

    Rows with a null id, label or vector or with a component that is null, not finite or beyond 2^28 on the grid take no part. Of rows
    with one id the least by label and vector stays, so repeated rows count once. Vectors of different lengths are filled with zeros.
    """
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    kept = kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    points = kept.select("id", "label", grid(F.col("v"), scale).alias("q")).filter(F.forall("q", lambda x: F.abs(x) <= F.lit(LARGEST)))
    one = points.groupBy("id").agg(F.min(F.struct("label", "q")).alias("p"))
    return saved(one.select("id", "p.label", "p.q"))


def _spread(points: DataFrame) -> list[int]:
    """Coordinates by falling variance; a row a coordinate comes to the driver."""
    each = points.select(F.posexplode("q").alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("v"))
    return [r.k for r in each.orderBy(F.desc("v"), "k").collect()]


def _tiles(m: np.ndarray, ids: np.ndarray, dims: list[int], fan: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Order of a page's rows, first rows of its leaves, and first leaves of its inner boxes: slabs by one coordinate, runs by the next."""
    n = len(m)
    order = np.lexsort((ids, m[:, dims[0]]))
    leaves, inner = [], []
    for slab in np.array_split(np.arange(n), min(fan, n)):
        part = order[slab]
        order[slab] = part[np.lexsort((ids[part], m[part, dims[1]]))]
        inner.append(len(leaves))
        leaves += [int(x[0]) for x in np.array_split(slab, min(fan, len(slab)))]
    return order, leaves, inner


def tree_pages(points: DataFrame, page: int = PAGE, fan: int = FAN) -> tuple[DataFrame, int]:
    """The packed tree of points as a written table of PAGES, and the width of its vectors. An empty table gives no page.

    Equal vectors are parted by id, so copies fill several pages and not one.
    """
    columns = max(1, width(points, "q"))
    dims = _spread(points) or [0]
    dims = [dims[k % len(dims)] for k in range(4)]
    n = points.count()
    slabs = max(1, math.isqrt(-(-n // page)))
    at = [F.coalesce(F.get("q", F.lit(d)), F.lit(0)) for d in dims[:2]]
    bounds = points.select(at[0].cast("double").alias("x")).approxQuantile("x", [k / slabs for k in range(1, slabs)], 0.1 / slabs) if slabs > 1 else []
    slab = F.lit(0) if not bounds else F.size(F.filter(F.array(*[F.lit(b) for b in sorted(bounds)]), lambda b: b < at[0]))
    parts = max(1, min(-(-n // page), max(TASKS, -(-n // (page * PAGES_A_TASK)))))
    ranged = points.withColumns({"slab": slab, "next": at[1]}).repartitionByRange(parts, "slab", "next", "id").sortWithinPartitions("slab", "next", "id")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = made = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, page - size)
                held.append(part)
                size, batch = size + part.num_rows, batch.slice(part.num_rows)
                if size == page:
                    yield built(held, made)
                    held, size, made = [], 0, made + 1
        if held:
            yield built(held, made)
        trim()

    def built(held: list, made: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        m, ids, labels = matrix(table["q"], columns), table["id"].to_numpy(), table["label"].to_numpy()
        order, leaves, inner = _tiles(m, ids, dims[2:], fan)
        m, ids, labels = m[order], ids[order], labels[order]
        low, high = np.minimum.reduceat(m, leaves), np.maximum.reduceat(m, leaves)
        number = (int(table["part"][0].as_py()) << 32) + made
        row = [number, ids.tolist(), labels.tolist(), packed(m), leaves, inner, packed(low), packed(high)]
        return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row))], schema=SCHEMA)

    pages = ranged.select("id", "label", "q", F.spark_partition_id().alias("part")).mapInArrow(run, PAGES)
    return saved(pages, **PLAIN), columns


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
SCHEMA = pa.schema(
    [
        ("page", pa.int64()),
        ("ids", _LONGS),
        ("labels", _LONGS),
        ("rows", pa.binary()),
        ("leaves", _INTS),
        ("inner", _INTS),
        ("low", pa.binary()),
        ("high", pa.binary()),
    ]
)


@dataclass
class Page:
    """A page in memory: its rows in leaf order, the first row of each leaf, the first leaf of each inner box, and the boxes of both."""

    ids: np.ndarray
    labels: np.ndarray
    m: np.ndarray
    leaves: list[int]
    inner: list[int]
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any row of each leaf, and of each inner box."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        low, high = np.minimum.reduceat(self.low, self.inner), np.maximum.reduceat(self.high, self.inner)
        return (
            plus @ self.low.T + minus @ self.high.T,
            plus @ self.high.T + minus @ self.low.T,
            plus @ low.T + minus @ high.T,
            plus @ high.T + minus @ low.T,
        )


class Windows:
    """What one query looks for: in each window [low, high] the k best scores, not below the floor that is known already."""

    def __init__(self, low: list, high: list, floor: list, k: int):
        self.low, self.high, self.k = low, high, k
        self.kth = [max(a, f) for a, f in zip(low, floor)]
        self.found: list[list[tuple[int, int]]] = [[] for _ in low]  # heaps of (score, -id)
        self._edge()

    def _edge(self) -> None:
        self.least, self.most = min(self.kth), max(self.high)

    def wants(self, least, most) -> bool:
        """Whether a box with scores from least to most may hold a row for some window."""
        return any(most >= kth and least <= high for kth, high in zip(self.kth, self.high))

    def take(self, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        near = np.flatnonzero((scores >= self.least) & (scores <= self.most) & fits)
        if not len(near):
            return
        for score, row in zip(scores[near].tolist(), ids[near].tolist()):
            for w, heap in enumerate(self.found):
                if self.kth[w] <= score <= self.high[w]:
                    if len(heap) < self.k:
                        heapq.heappush(heap, (score, -row))
                    elif heap[0] < (score, -row):
                        heapq.heapreplace(heap, (score, -row))
                    if len(heap) == self.k:
                        self.kth[w] = max(self.kth[w], heap[0][0])
        self._edge()


def best_first(page: Page, query: np.ndarray, bounds: tuple, windows: Windows, fits: np.ndarray) -> int:
    """Searches one page for one query: the box of greatest upper bound first. Returns how many leaves were opened."""
    leaf_low, leaf_high, box_low, box_high = (b.tolist() for b in bounds)
    ends, rows = [*page.inner[1:], len(page.leaves)], [*page.leaves[1:], len(page.ids)]
    queue = [(-high, 0, i) for i, high in enumerate(box_high) if windows.wants(box_low[i], high)]
    heapq.heapify(queue)
    opened = 0
    while queue:
        high, leaf, i = heapq.heappop(queue)
        if -high < windows.least:
            break  # strictly below the kth score of every window, as is all that waits
        if not leaf:
            for j in range(page.inner[i], ends[i]):
                if windows.wants(leaf_low[j], leaf_high[j]):
                    heapq.heappush(queue, (-leaf_high[j], 1, j))
        elif windows.wants(leaf_low[i], -high):
            opened += 1
            part = slice(page.leaves[i], rows[i])
            windows.take(page.m[part] @ query, page.ids[part], fits[part])
    return opened


ASK = "id long, label long, q array<long>, low array<long>, high array<long>, floor array<long>"
HITS = "anchor long, slot int, id long, score long"


class Asks:
    """A block of queries, and what each has found in the pages that it has met."""

    def __init__(self, asks: pa.RecordBatch, columns: int, k: int):
        names = ("id", "label", "low", "high", "floor")
        self.ids, self.labels, *windows = (asks.column(c).to_pylist() for c in names)
        self.windows = [Windows(low, high, floor, k) for low, high, floor in zip(*windows)]
        self.queries = matrix(asks.column("q"), columns)

    def search(self, page: Page, same: bool) -> None:
        queries = self.queries
        if exact_in_double(queries, page.m):
            queries = queries.astype(np.float64)
            page.m, page.low, page.high = (x.astype(np.float64) for x in (page.m, page.low, page.high))
        bounds = page.bounds(queries)
        for i, (anchor, label, windows) in enumerate(zip(self.ids, self.labels, self.windows)):
            fits = (page.labels == label) if same else (page.labels != label)
            best_first(page, queries[i], tuple(b[i] for b in bounds), windows, fits & (page.ids != anchor))

    def hits(self) -> pa.RecordBatch:
        out = [(a, w, -row, int(score)) for a, x in zip(self.ids, self.windows) for w, heap in enumerate(x.found) for score, row in heap]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "id", "score"])


def _searched(columns: int, k: int, same: bool):
    """best_first of each query of a block in each page that it meets, as a function of joined rows; same tells which labels fit.

    The rows of a block that follow one another are searched as one, so that they give k rows a window and the kth score of one prunes the next.
    """

    def run(batches):
        block = asks = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                get = lambda name: row.column(name)[0]  # noqa: B023,E731
                if asks is None or get("block").as_py() != block:
                    if asks:
                        yield asks.hits()
                    block, asks = get("block").as_py(), Asks(pa.RecordBatch.from_struct_array(get("asks").values), columns, k)
                asks.search(paged(get), same)
        if asks:
            yield asks.hits()
        trim()

    def paged(get) -> Page:
        return Page(
            *(get(c).values.to_numpy(zero_copy_only=False) for c in ("ids", "labels")),
            unpacked(get("rows").as_py(), columns),
            *(get(c).as_py() for c in ("leaves", "inner")),
            *(unpacked(get(c).as_py(), columns) for c in ("low", "high")),
        )

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """hits with their rank, up to k of each anchor and slot: higher scores first, ties by smaller id."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join of two tables that both grow with the input, however small Spark takes one for."""
    return left.join(right.hint("merge"), on, how)


def _search(pages: DataFrame, asks: DataFrame, columns: int, k: int, same: bool, block: int) -> DataFrame:
    """The k best rows of each window of asks (page, ASK columns), as (anchor, slot, id, score, rank); a written table.

    The home page is searched first; its kth score is the floor with which all other pages are searched.
    """
    ask = F.struct("id", "label", "q", "low", "high", "floor").alias("ask")
    home = asks.select("page", ask).groupBy("page").agg(F.collect_list("ask").alias("asks"))  # no more than the page has rows
    found = saved(_merged(pages, home, "page").withColumnRenamed("page", "block").mapInArrow(_searched(columns, k, same), HITS))
    # A window whose home page has k rows takes the least of them for its floor.
    kth = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    floors = kth.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("known"))
    better = F.transform("floor", lambda f, w: F.greatest(f, F.coalesce(F.try_element_at("known", w), f)))
    raised = _merged(asks, floors, "id", "left").withColumn("floor", F.when(F.col("known").isNull(), F.col("floor")).otherwise(better)).drop("known")
    blocks = max(1, -(-asks.count() // block))
    deal = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packs = saved(raised.select(deal.alias("block"), ask).groupBy("block").agg(F.collect_list("ask").alias("asks")))
    # Blocks are the outer rows: a task holds its pages, and goes through all of them with one block after the other.
    met = packs.coalesce(LANES).crossJoin(pages.drop("page").hint("shuffle_replicate_nl"))
    hits = met.mapInArrow(_searched(columns, k, same), HITS)
    return saved(_best(hits, k))


def hard_negatives(
    points: DataFrame,
    anchors: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    page: int = PAGE,
    fan: int = FAN,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from points (id, label, q) as integer_points gives them.

    Anchors are the points for which ``anchors`` holds, those whose id is divisible by 100 by default. An anchor's positives are its first
    ``positives`` other points of the same label; for each of them the first ``negatives`` points of other labels are returned whose score is from
    ``low`` to ``high`` hundredths of the positive's. Fewer rows come where there are fewer; a positive of a score below 0 has an
    empty window. An empty table, one of a single label or one without anchors gives no rows. Results are exact.
    """
    pages, columns = tree_pages(points, page, fan)
    marked = (F.col("id") % EVERY == 0) if anchors is None else anchors
    places = pages.select("page", F.explode("ids").alias("id"))
    asked = saved(_merged(points.filter(marked), places, "id"))
    lowest, highest = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    open_asks = asked.withColumns({"low": F.array(lowest), "high": F.array(highest), "floor": F.array(lowest)})
    best = _search(pages, open_asks, columns, positives, True, block)
    chosen = best.select("anchor", F.col("id").alias("positive"), "score")
    # ceil and floor of the bounds in integers; positives of one score share a window.
    least = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100L)) div 100)")
    most = F.expr(f"({high} * score - pmod({high} * score, 100L)) div 100")
    window = F.struct("score", least.cast("long").alias("low"), most.cast("long").alias("high"))
    wanted = chosen.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_set(window)).alias("w"))
    wanted = wanted.withColumn("w", F.filter("w", lambda x: x["low"] <= x["high"])).filter(F.size("w") > 0)
    windows = saved(_merged(asked, wanted, "id").withColumns({"low": F.col("w.low"), "high": F.col("w.high"), "floor": F.col("w.low")}))
    hits = _search(pages, windows.drop("w"), columns, negatives, False, block)
    slots = windows.select(F.col("id").alias("anchor"), F.posexplode("w.score").alias("slot", "score"))
    pairs = _merged(chosen, slots, ["anchor", "score"]).select("anchor", "slot", "positive", F.col("score").alias("positive_score"))
    chosen_hits = hits.select("anchor", "slot", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    found = _merged(pairs, chosen_hits, ["anchor", "slot"])
    return found.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"),
        "positive_score",
        "negative_score",
    )


ORACLE = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
