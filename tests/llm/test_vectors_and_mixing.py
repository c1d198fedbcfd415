"""Mixing, hard negatives and vector codes against plain versions."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import codes, mixing, negatives, queries
from tests.llm.conftest import frame

VECTORS = "vec_id long, embedding array<float>, label int, q string, part int, slot int, `row` string"


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Targets of sources {source: size}, by sharing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    held = {}
    while True:
        free = [s for s in order if s not in held]
        left = sum(sizes.values()) - sum(held.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return held | share
        held |= {s: limit * sizes[s] for s in over}


def mixed(df, **options):
    return mixing.mixed_sizes(df, **options).collect()


def check_mix(rows, docs, near=None):
    """docs is a list of (id, source, words)."""
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter(docs)
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    wanted, taken = targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], rel_tol=1e-12)
        assert r.taken == r.size * r.copies and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    if near is not None:
        for s, t in wanted.items():
            assert abs(taken[s] - t) <= near, (s, taken[s], t)
    return taken


def test_flight_keeps_totals_and_means():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 300):
        size = np.sort(rng.integers(0, 900, n))[::-1].astype(float)
        chance = rng.random(n)
        p = mixing.flight(chance, size, rng)
        assert abs(p.sum() - chance.sum()) < 1e-6 and abs((p * size).sum() - (chance * size).sum()) < 1e-4
        assert ((p > 0) & (p < 1)).sum() <= 2 and p.min() >= 0 and p.max() <= 1
        assert set(mixing.landing(p, size)) <= {0.0, 1.0}
    size, chance = np.array([9.0, 7, 5, 5, 4, 3, 2, 2, 1, 1]), np.array([0.3, 0.8, 0.5, 0.1, 0.6, 0.4, 0.7, 0.2, 0.9, 0.5])
    mean = np.mean([mixing.flight(chance, size, np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - chance).max() < 0.04


def test_flight_of_equal_and_odd_sizes():
    p = mixing.flight(np.full(9, 0.5), np.full(9, 4.0), np.random.default_rng(1))
    assert sorted(p)[:4] == [0] * 4 and sorted(p)[5:] == [1] * 4
    p = mixing.flight(np.full(5, 0.5), np.array([90.0, 4, 4, 4, 4]), np.random.default_rng(1))
    assert p[0] == 0.5 and sorted(p[1:]) == [0, 0, 1, 1]


@pytest.mark.parametrize("block,merge", [(1024, 512), (8, 4)])
def test_mix_of_uneven_sources(spark, block, merge):
    r = random.Random(3)
    docs = [(i, "hot" if r.random() < 0.4 else r.choice(["a", "b", "é", "z", "Z", None]), int(r.expovariate(0.02)) + 1) for i in range(600)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, s, n in docs], "doc_id long, text string, source string")
    rows = mixed(df, block=block, merge=merge)
    check_mix(rows, docs, near=40 if block > 8 else 150)
    again = mixed(df.repartition(7), block=block, merge=merge)
    assert sorted((x.doc_id, x.copies) for x in rows) == sorted((x.doc_id, x.copies) for x in again)


def test_mix_of_odd_rows(spark):
    texts = ["", None, "a\tb\x0bc  d", " x ", "one two", "é ß ü"]
    df = frame(spark, texts, source=["s", None])
    rows = mixed(df)
    assert {r.doc_id: r.size for r in rows} == {0: 0, 1: 0, 2: 4, 3: 1, 4: 2, 5: 2}
    check_mix(rows, [(r.doc_id, r.source, r.size) for r in rows])
    assert mixed(df.limit(0)) == []
    blank = mixed(frame(spark, ["", None, " "]))
    assert {(r.size, r.target, r.taken) for r in blank} == {(0, 0.0, 0)}


def test_mix_of_repeated_rows_and_ids(spark, monkeypatch):
    docs = [(7, "a", 3)] * 500 + [(None, "a", 3)] * 40 + [(i, "b", 5) for i in range(100)]
    df = spark.createDataFrame([(i, " ".join("w" * n), s) for i, s, n in docs], "doc_id long, text string, source string")
    whole = mixed(df)
    check_mix(whole, docs, near=5)
    monkeypatch.setattr(mixing, "REPEATS", 64)
    key = lambda x: (x.doc_id is None, x.doc_id, x.source, x.copies)
    assert sorted(map(key, mixed(df)), key=str) == sorted(map(key, whole), key=str)


def test_mix_gives_the_rows(spark):
    r = random.Random(4)
    texts = [" ".join(["w"] * r.randint(1, 30)) for _ in range(80)] + ["w w w"] * 10
    df = frame(spark, texts, source=["a", "b", "c"]).unionByName(frame(spark, {3: texts[3], 4: "other"}, source=["a"]))
    out = mixing.mix(df)
    assert out.columns == df.columns
    plan = Counter()
    for x in mixed(df):
        plan[x.doc_id, x.source, x.size] += x.copies
    got = Counter((x.doc_id, x.source, len(x.text.split())) for x in out.collect())
    assert got == +plan
    assert mixing.mix(df.limit(0)).collect() == []


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "q", 1, 2, "row") for i, v, y in rows], VECTORS).repartition(parts)


def hard(rows):
    """The contract of hard negatives over (id, vector, label), by all products."""
    ok, seen = {}, {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (y, [math.floor(256 * x) for x in v])
        ok[i] = min(ok.get(i, q), q)
    out = []
    for a, (y, q) in ok.items():
        if a % 100:
            continue
        scored = [(-sum(s * t for s, t in zip(q, w)), b, z) for b, (z, w) in ok.items() if b != a]
        for ps, p, _ in sorted(x for x in scored if x[2] == y)[:5]:
            fits = sorted(x for x in scored if x[2] != y and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def found(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def float32(x):
    return float(np.float32(x))


def clouds(n, dims, seed, copies=0, step=1):
    """Points around few centres, some of them equal, with ties by construction."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.4) for _ in range(dims)] for _ in range(5)]
    rows = [(i * step, [float32(round(c + r.gauss(0, 0.2), 1)) for c in centres[i % 5]], r.randint(0, 3)) for i in range(n)]
    return rows + [((n + k) * step, rows[0][1], k % 4) for k in range(copies)]


@pytest.mark.parametrize("page,fan,block", [(4096, 8, 512), (16, 2, 3), (7, 3, 1)])
def test_hard_negatives(spark, page, fan, block):
    rows = clouds(160, 6, 2, copies=60, step=20)
    got = negatives.hard_negatives(negatives.integer_points(vectors(spark, rows)), page=page, fan=fan, block=block)
    want = hard(rows)
    assert len(want) > 300 and found(got) == want


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clouds(30, 4, 6, step=50) + [(None, [1.0] * 4, 1), (1600, None, 1), (1700, [1.0, nan, 0.0, 0.0], 1), (1800, [inf, 0.0, 0.0, 0.0], 1)]
    rows += [(1900, [1.0, None, 0.0, 0.0], 1), (2000, [1.0] * 4, None), (2100, [0.0] * 4, 2), (0, [0.5, 0.5, 0.5, 0.5], 0), rows[2], rows[2]]
    assert found(negatives.hard_negatives(negatives.integer_points(vectors(spark, rows)), page=8, fan=2, block=4)) == hard(rows)
    points = negatives.integer_points(vectors(spark, rows[:12]))
    assert found(negatives.hard_negatives(points.limit(0))) == []
    assert found(negatives.hard_negatives(points.filter("label = 1"))) == []
    assert found(negatives.hard_negatives(points.filter("id % 100 <> 0"))) == []


def test_ragged_vectors_count_as_filled_with_zeros(spark):
    rows = clouds(40, 4, 8, step=25)
    ragged = [(i, v[: 2 + i // 25 % 3], y) for i, v, y in rows]
    filled = [(i, v + [0.0] * (4 - len(v)), y) for i, v, y in ragged]
    assert found(negatives.hard_negatives(negatives.integer_points(vectors(spark, ragged)), page=8)) == hard(filled)


def test_no_join_of_a_search_goes_through_the_driver(spark, monkeypatch):
    """Tables of queries and rows grow with the input, and packed ones fill far more memory than their files."""
    plans, write = [], negatives.saved

    def noted(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, **options)

    monkeypatch.setattr(negatives, "saved", noted)
    rows = clouds(160, 6, 2, copies=60, step=20)
    out = negatives.hard_negatives(negatives.integer_points(vectors(spark, rows)), page=16, fan=2, block=3)
    assert found(out) == hard(rows)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and sum("CartesianProduct" in p for p in plans) == 2
    assert not [p for p in plans if "Broadcast" in p]


def test_pages_that_follow_one_another_are_searched_as_one(spark):
    """They give at most k rows a window together, not each of them; the next block begins anew."""
    rows = clouds(160, 6, 2, copies=60, step=20)
    points = negatives.integer_points(vectors(spark, rows))
    pages, columns = negatives.tree_pages(points, 16, 2)
    lowest, highest = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    asks = points.filter("id % 100 = 0").withColumns({"low": F.array(lowest), "high": F.array(highest), "floor": F.array(lowest)})
    packs = asks.select((F.col("id") % 3).alias("block"), F.struct("id", "label", "q", "low", "high", "floor").alias("ask"))
    packs = packs.groupBy("block").agg(F.collect_list("ask").alias("asks")).coalesce(1)
    met = packs.crossJoin(pages.drop("page").coalesce(1).hint("shuffle_replicate_nl"))
    hits = met.mapInArrow(negatives._searched(columns, 5, True), negatives.HITS).collect()
    ok = {i: (y, [math.floor(256 * x) for x in v]) for i, v, y in rows}
    want = []
    for a, (y, q) in ok.items():
        if a % 100 == 0:
            scored = sorted((-sum(s * t for s, t in zip(q, w)), b) for b, (z, w) in ok.items() if b != a and z == y)
            want += [(a, 0, b, -s) for s, b in scored[:5]]
    assert pages.count() > 5 and sorted(tuple(h) for h in hits) == sorted(want)


def test_pages_of_large_tables_are_made_by_few_tasks(spark, monkeypatch):
    """Each partition of a range sort sends keys to the driver, so they grow slower than pages; equal vectors fill files as others do."""
    rows = [(i, [1.0] * 6, i % 3) for i in range(300)]
    monkeypatch.setattr(negatives, "TASKS", 3)
    pages = negatives.tree_pages(negatives.integer_points(vectors(spark, rows)), page=2, fan=2)[0]
    numbers = [r.page for r in pages.select("page").collect()]
    assert len(set(numbers)) == len(numbers) >= 150 and len({n >> 32 for n in numbers}) <= 10
    assert sorted(i for r in pages.select("ids").collect() for i in r.ids) == list(range(300))
    large = negatives.tree_pages(negatives.integer_points(vectors(spark, rows)), page=300, fan=2)[0]
    files = [p[len("file:") :].lstrip("/") for p in large.inputFiles()]
    assert sum(os.path.getsize(f"/{p}") for p in files) > 300 * 6 * 4


def test_a_search_opens_few_leaves_of_well_parted_rows(spark):
    """The queue prunes: rows far from a query's cloud are not looked at."""
    r = np.random.default_rng(1)
    m = np.repeat(r.integers(-3000, 3000, (64, 8)), 64, axis=0) + r.integers(-20, 20, (4096, 8))
    ids = np.arange(4096)
    order, leaves, inner = negatives._tiles(m, ids, [0, 1], 8)
    m = m[order]
    low, high = np.minimum.reduceat(m, leaves), np.maximum.reduceat(m, leaves)
    page = negatives.Page(ids[order], np.zeros(4096, np.int64), m, leaves, inner, low, high)
    bounds = page.bounds(m[:1])
    windows = negatives.Windows([-(1 << 63)], [(1 << 63) - 1], [-(1 << 63)], 5)
    opened = negatives.best_first(page, m[0], tuple(b[0] for b in bounds), windows, np.ones(4096, bool))
    best = sorted(((-int(s), int(i)) for s, i in zip(m @ m[0], page.ids)))[:5]
    assert sorted((-s, -i) for s, i in windows.found[0]) == best and opened < len(leaves) / 2


def quantised(rows, parts=8, entries=16, rounds=6):
    """The contract of codes over (id, vector, label), row by row."""
    ok = [(i, y, [math.floor(4096 * x) for x in v]) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max(len(q) for _, _, q in ok) // parts)
    ok = [(i, y, q + [0] * (wide * parts - len(q))) for i, y, q in ok]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    cut = lambda q, p: q[p * wide : (p + 1) * wide]
    books = [[cut(q, p) for _, _, q in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), c) for c, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, _, q in ok:
                groups[nearest(p, cut(q, p))[1]].append(cut(q, p))
            for c, xs in groups.items():
                books[p][c] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], Counter()
    for i, y, q in ok:
        near = [nearest(p, cut(q, p)) for p in range(parts)]
        out.append((i, y, "".join(f"{c:02x}" for _, c in near), sum(d for d, _ in near)))
        by[y] += out[-1][3]
    return sorted(((i, c, e, by[y], sha) for i, y, c, e in out), key=str)


def coded(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk,leaf", [(4096, 8), (50, 1), (33, 4)])
def test_codes(spark, chunk, leaf):
    rows = [(i, v, None if y == 3 else y) for i, v, y in clouds(200, 16, 9, copies=80)]
    assert coded(codes.vector_codes(vectors(spark, rows), chunk=chunk, leaf=leaf)) == quantised(rows)


def test_codes_of_odd_rows(spark):
    nan = float("nan")
    rows = clouds(20, 12, 4) + [(None, [0.25] * 12, 1), (3, None, 1), (4, [nan] * 12, 1), (5, [None] * 12, 2), (6, [0.5] * 5, None), (7, [], 2), (7, [], 2)]
    assert coded(codes.vector_codes(vectors(spark, rows))) == quantised(rows)
    few = rows[:5]
    assert coded(codes.vector_codes(vectors(spark, few))) == quantised(few)
    empty = codes.vector_codes(vectors(spark, few).limit(0))
    assert empty.collect() == [] and empty.columns == codes.vector_codes(vectors(spark, few)).columns
    assert codes.vector_codes(vectors(spark, [(1, None, 1)])).collect() == []


def test_cover_tree_assigns_like_all_distances():
    r = np.random.default_rng(3)
    shapes = [r.integers(-900, 900, (400, 8)), np.repeat(r.integers(-9, 9, (30, 8)), 20, axis=0), np.zeros((50, 8), np.int64), r.integers(0, 2, (300, 8))]
    for points in shapes:
        tree = codes.cover_tree(points, leaf=3)
        assert sorted(tree.order) == list(range(len(points))) and (tree.points == points[tree.order]).all()
        for _, begin, end, first, n, radius2 in tree.nodes:
            if n:
                kids = tree.nodes[first : first + n]
                assert (kids[1:, 1] == kids[:-1, 2]).all() and (kids[0, 1], kids[-1, 2]) == (begin, end) and (4 * kids[:, 5] <= radius2).all()
        book = points[r.integers(0, len(points), 16)]
        square = ((points[:, None] - book) ** 2).sum(-1)
        code, error = codes.codes_of(tree, book)
        assert (code == square.argmin(1)).all() and (error == square.min(1)).all()
        count, total = codes.summed(tree, book)
        assert (count == np.bincount(code, minlength=16)).all() and (total.sum(0) == points.sum(0)).all()


def test_whole_nodes_are_assigned():
    """Where points lie in tight groups, far fewer comparisons are made than there are points."""
    r = np.random.default_rng(8)
    points = np.repeat(r.integers(-40000, 40000, (16, 8)), 250, axis=0) + r.integers(-30, 30, (4000, 8))
    tree = codes.cover_tree(points)
    whole, places, _ = codes.assigned(tree, points[::250].copy())
    assert sum(len(b) for b, _, _ in whole) < 200 and len(places) == 0


def test_decoded_vectors_are_near(spark):
    rows = clouds(100, 16, 12)
    points = codes.integer_vectors(vectors(spark, rows))
    books, trees = codes.train(points)
    back = codes.encode(trees, books).select("id", codes.decoded(books)(codes.F.col("code")).alias("v")).collect()
    given = {i: v for i, v, _ in rows}
    errors = [sum((a - b) ** 2 for a, b in zip(r.v, given[r.id])) for r in back]
    assert len(errors) == 100 and sum(errors) / len(errors) < 0.5 * np.mean([sum(x * x for x in v) for v in given.values()])


@pytest.mark.parametrize("name", ["op12_tree_negatives", "op13_cover_tree_codes"])
def test_whole_queries_equal_their_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = c.execute(queries.ORACLES[name])
    order = [[d[0] for d in cursor.description].index(x) for x in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_the_whole_mix_query(spark, sf_dir):
    rows = queries.QUERIES["op11_cube_mixing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    import re

    sizes = [(d.doc_id, d.source, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))) for d in docs]
    taken, totals = check_mix(rows, sizes), defaultdict(int)
    for _, s, n in sizes:
        totals[s] += n
    wanted = targets(totals)
    assert sum(abs(taken[s] - wanted[s]) for s in wanted) < 0.2 * sum(wanted.values())  # ten documents a source here
