"""Vector codes by product quantisation, trained by Lloyd rounds on cover trees.

Rows are cut to chunks of ``CHUNK`` rows where they lie, without a shuffle, and each chunk gets a cover tree for every part of the
vectors: a node holds a centre, the greatest distance of its rows from it, and its rows as one range of the tree's order, so that
cumulative sums give the sum of any node. Children are centres whose balls of half the radius cover the node. Chunks and trees are a
written table, built once and read by every round.

A round walks all trees level by level. Where a node's nearest entry is nearer to the centre than any other by more than twice the
node's radius, the triangle inequality gives the whole node to it, by its sum and count alone; entries that are too far for any row
of a node are left out below it. What stays ambiguous goes down, to exact integer comparisons of rows. A task gives a row for each
entry, and the driver sees the entries' sums and no more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved, trim
from lectern.llm.vectors import grid, matrix, packed, unpacked, usable, width

#: The integer grid, how many parts and entries, and how many rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CHUNK, LEAF = 4096, 8
#: Squared distances of such components, summed over a vector of up to 512 components, fit 64 bits.
LARGEST = 1 << 26
#: Distances in double precision are compared with this relative margin; what is nearer than that goes to integers.
MARGIN = 1e-9


@dataclass
class Tree:
    """A cover tree over points in the tree's order. nodes has a row each: centre (an index of points), begin, end, first child, children, squared radius."""

    order: np.ndarray
    nodes: np.ndarray
    points: np.ndarray

    @property
    def sums(self) -> np.ndarray:
        """Sums of all points before each place of the order."""
        return np.vstack([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of the rows of an integer matrix. Equal rows end in one node of radius 0, however many they are."""
    order = np.arange(len(points))
    nodes: list[list[int]] = []
    waits = [(0, len(points), 0)]  # begin, end, centre
    at = 0
    nodes.append([0, 0, len(points), 0, 0, 0])
    while at < len(waits):
        begin, end, centre = waits[at]
        rows = order[begin:end].copy()
        away = points[rows] - points[centre]
        far = np.einsum("ij,ij->i", away, away)
        radius = int(far.max())
        nodes[at][5] = radius
        if radius and end - begin > leaf:
            nodes[at][3] = len(nodes)
            place = begin
            while len(rows):
                near = 4 * far <= radius
                group = rows[near]
                order[place : place + len(group)] = group
                nodes.append([centre, place, place + len(group), 0, 0, 0])
                waits.append((place, place + len(group), centre))
                nodes[at][4] += 1
                place += len(group)
                rows = rows[~near]
                if len(rows):
                    centre = rows[0]
                    away = points[rows] - points[centre]
                    far = np.einsum("ij,ij->i", away, away)
        at += 1
    table = np.array(nodes, dtype=np.int64)
    back = np.empty(len(points), np.int64)
    back[order] = np.arange(len(points))
    table[:, 0] = back[table[:, 0]]  # centres as places of the order
    return Tree(order, table, points[order])


def assigned(tree: Tree, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nearest entries of a codebook: whole nodes as (begins, ends, entries) by level, then single places and their entries. Ties go to the lower entry."""
    whole, places, codes = [], [], []
    front, open_ = np.array([0]), np.ones((1, len(book)), bool)
    while len(front):
        centre, begin, end, first, children, radius2 = tree.nodes[front].T
        away = tree.points[centre][:, None, :] - book
        square = np.einsum("ijk,ijk->ij", away, away)
        far = np.where(open_, np.sqrt(square), np.inf)
        radius = np.sqrt(radius2)
        best = far.argmin(1)
        row = np.arange(len(front))
        nearest = far[row, best]
        others = far.copy()
        others[row, best] = np.inf
        second = others.min(1)
        slack = MARGIN * (1 + nearest + radius)
        clear = nearest + 2 * radius + slack < second
        one = radius2 == 0  # all rows lie on the centre: integers decide
        best = np.where(one, np.where(open_, square, np.iinfo(np.int64).max).argmin(1), best)
        done = clear | one
        whole.append((begin[done], end[done], best[done]))
        split = ~done & (children > 0)
        rest = ~done & (children == 0)
        if rest.any():
            at = _ranges(begin[rest], end[rest])
            away = tree.points[at][:, None, :] - book
            places.append(at)
            codes.append(np.einsum("ijk,ijk->ij", away, away).argmin(1))
        stays = open_ & (far <= (nearest + 2 * radius + slack)[:, None])
        front = _ranges(first[split], first[split] + children[split])
        open_ = np.repeat(stays[split], children[split], axis=0)
    none = np.zeros(0, np.int64)
    return whole, np.concatenate(places) if places else none, np.concatenate(codes) if codes else none


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    length = end - begin
    if not length.sum():
        return np.zeros(0, np.int64)
    return np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())


def summed(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each entry is nearest to, and the sums of their components."""
    count, total, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64), tree.sums
    whole, places, codes = assigned(tree, book)
    for begin, end, entry in whole:
        np.add.at(count, entry, end - begin)
        np.add.at(total, entry, sums[end] - sums[begin])
    np.add.at(count, codes, 1)
    np.add.at(total, codes, tree.points[places])
    return count, total


def codes_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and its squared distance, for each row in the order that the tree was built from."""
    code = np.zeros(len(tree.points), np.int64)
    whole, places, codes = assigned(tree, book)
    for begin, end, entry in whole:
        code[_ranges(begin, end)] = np.repeat(entry, end - begin)
    code[places] = codes
    away = tree.points - book[code]
    out, error = np.empty_like(code), np.empty_like(code)
    out[tree.order], error[tree.order] = code, np.einsum("ij,ij->i", away, away)
    return out, error


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, q): the rows with usable vectors on the integer grid, each as often as it comes; ids and labels may be null.

    Rows whose vector is null, or has a component that is null, not finite or beyond 2^26 on the grid (a distance would not fit
    64 bits), are dropped.
    """
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    return kept.select("id", "label", grid(F.col("v"), scale).alias("q")).filter(F.forall("q", lambda x: F.abs(x) <= F.lit(LARGEST)))


def forest(points: DataFrame, columns: int, parts: int = PARTS, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """The chunks of points (id, label, q) with their cover trees, as a written table (ids, labels, points, orders, nodes)."""
    kinds = dict(points.dtypes)
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, points binary, orders array<binary>, nodes array<binary>"

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, chunk - size))
                size, batch = size + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if size == chunk:
                    yield built(held)
                    held, size = [], 0
        if held:
            yield built(held)
        trim()

    def built(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        m = matrix(table["q"], columns)
        trees = [cover_tree(p, leaf) for p in np.split(m, parts, axis=1)]
        whole = lambda name: pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), table[name].combine_chunks())
        binaries = lambda each: pa.array([[packed(x) for x in each]], pa.list_(pa.binary()))
        arrays = [
            whole("id"),
            whole("label"),
            pa.array([packed(m)], pa.binary()),
            binaries(t.order for t in trees),
            binaries(t.nodes for t in trees),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "points", "orders", "nodes"])

    return saved(points.select("id", "label", "q").mapInArrow(run, schema))


def _trees(batch: pa.RecordBatch, row: int, columns: int, parts: int) -> list[Tree]:
    m = unpacked(batch.column("points")[row].as_py(), columns)
    orders, nodes = (batch.column(c)[row].as_py() for c in ("orders", "nodes"))
    pieces = np.split(m, parts, axis=1)
    return [Tree(o := unpacked(a), unpacked(b, 6), p[o]) for a, b, p in zip(orders, nodes, pieces)]


def lloyd(trees: DataFrame, books: np.ndarray, columns: int) -> np.ndarray:
    """The codebooks after one round over all trees: each entry the floor of the mean of its rows; an entry without rows stays."""
    parts, entries, wide = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part, tree in enumerate(_trees(batch, row, columns, parts)):
                    n, s = summed(tree, books[part])
                    count[part] += n
                    total[part] += s
        part, entry = np.nonzero(count)
        arrays = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*arrays, sums], names=["part", "entry", "n", "sums"])
        trim()

    each = trees.select("points", "orders", "nodes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    wider = lambda c: F.sum(c.cast("decimal(38,0)"))
    all_sums = F.array(*[wider(F.col("sums")[k]) for k in range(wide)]).alias("sums")
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), all_sums).collect():  # parts x entries rows
        out[r.part, r.entry] = [int(s) // r.n for s in r["sums"]]
    return out


def train(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, leaf: int = LEAF) -> tuple[np.ndarray | None, DataFrame | None]:
    """Codebooks (parts, entries, components) of points (id, label, q), and the table of trees; none of both for an empty table.

    Codebooks begin as the parts of the vectors with the least ids, null ids last and ties by vector; there are fewer entries where there are
    fewer rows. Vectors of different lengths are filled with zeros, and all of them to a multiple of ``parts``.
    """
    longest = max(1, width(points, "q"))
    columns = -(-longest // parts) * parts
    first = [r.q for r in points.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    if not first:
        return None, None
    books = np.zeros((len(first), columns), np.int64)
    for row, q in zip(books, first):
        row[: len(q)] = q
    books = np.stack(np.split(books, parts, axis=1))
    trees = forest(points, columns, parts, chunk, leaf)
    for _ in range(rounds):
        books = lloyd(trees, books, columns)
    return books, trees


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every row of the trees: two hex digits a part, and the squared distances summed over the parts."""
    parts, columns = books.shape[0], books.shape[0] * books.shape[2]
    kinds = dict(trees.dtypes)
    schema = f"id {kinds['ids'][6:-1]}, label {kinds['labels'][6:-1]}, code string, error long"

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = [codes_of(tree, books[part]) for part, tree in enumerate(_trees(batch, row, columns, parts))]
                digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                code = [d.tobytes().hex() for d in digits]
                arrays = [batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array(code, pa.string()), pa.array(sum(e for _, e in found))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "code", "error"])
        trim()

    return trees.mapInArrow(run, schema)


def decoded(books: np.ndarray, scale: int = SCALE):
    """A column function: the vector, on the original scale, that a code stands for, in the middle of its grid cell."""
    tables = [F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in books]
    at = lambda code, part: (F.conv(F.substring(code, 2 * part + 1, 2), 16, 10).cast("int") + 1).cast("int")
    return lambda code: F.flatten(F.array(*[F.element_at(t, at(code, part)) for part, t in enumerate(tables)]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between them."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row with a usable vector; label_error sums error over equal labels, nulls together.

    A repeated row comes as often as it is there. An empty table gives an empty result. Columns other than the three named are not read.
    """
    points = integer_vectors(rows, id_col, label_col, vector_col, scale)
    books, trees = train(points, **options)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    if books is None:
        empty = points.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in names[2:4]], F.lit("").alias(names[4]))
        return empty.filter(F.lit(False))
    codes = saved(encode(trees, books))
    labels = saved(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).withColumn("codebooks_sha256", F.lit(digest(books)))
    return joined.withColumnRenamed("id", "vec_id").select(*names)


def _oracle() -> str:
    """The rounds unrolled: every round assigns all parts and replaces the entries, by part (p), entry (c) and component (k)."""
    rounds = [
        f"""a{r} AS MATERIALIZED (SELECT n, v.p, arg_min(b.c, (list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.c)) AS c
FROM v JOIN b{r} b USING (p) GROUP BY n, v.p),
m{r} AS (SELECT p, c, list(f ORDER BY k) AS x FROM (SELECT a.p, a.c, k, CAST(floor(sum(v.x[k])::DECIMAL(38, 0) / count(*)) AS BIGINT) AS f
FROM a{r} a JOIN v USING (n, p), (SELECT unnest(range(1, 9)) AS k) GROUP BY ALL) GROUP BY p, c),
b{r + 1} AS MATERIALIZED (SELECT p, c, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, c))"""
        for r in range(ROUNDS)
    ]
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT n, p, q[8 * p + 1 : 8 * p + 8] AS x FROM w, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS c, x FROM v WHERE n <= 16),
{",".join(chr(10) + x for x in rounds)},
e AS MATERIALIZED (SELECT n, v.p, min((list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.c)) AS e FROM v JOIN b{ROUNDS} b USING (p) GROUP BY n, v.p),
r AS (SELECT n, string_agg(printf('%02x', e[2]), '' ORDER BY p) AS code, CAST(sum(e[1]) AS BIGINT) AS error FROM e GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, c)) FROM b{ROUNDS}) AS codebooks_sha256 FROM r JOIN w USING (n)"""


ORACLE = _oracle()
