import hashlib
import os
import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from lectern.llm import exact_dedup, graph, line_dedup, neardup
from tests.llm.conftest import edited, frame, prose

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(words):
    texts = {}
    for k in range(40):
        texts[k] = prose(words, k, 60)
    for k in range(40, 90):  # a large group of near copies, of differing distance
        texts[k] = edited(texts[0], words, k, (k % 6) * 0.012)
    for k in range(90, 120):  # exact copies, but for case
        texts[k] = texts[1].upper() if k % 2 else texts[1]
    texts |= {
        200: None,
        201: "",
        202: " \n\t",
        203: "one two",
        204: "One  two",
        205: "a b c d e",
        206: "É b c d e",
        207: "é b c d e",
        208: prose(words, 9, 4000),
        209: edited(prose(words, 9, 4000), words, 3, 0.01),
        210: "x" * 50_000,
        211: "x" * 50_000
    }
    return texts


def test_exact(spark, words):
    texts = corpus(words)
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[(t or "").translate(UP)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for body, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(body.encode()).hexdigest()
    kept = exact_dedup.drop_exact(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {max(ids) for ids in groups.values()}


def test_exact_edges(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    rows = exact_dedup.exact_groups(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(frame(spark, []), salts=0)


def test_exact_repeats(spark):
    """A repeated id loses no other text, of rows that repeat id and text one stays, and a null id is a row like any other."""
    rows = [(5, "a", 1), (9, "A", 2), (5, "b", 3), (7, "c", 4), (7, "c", 5), (None, "d", 6), (None, None, 7), (3, "", 8), (None, "e", 9), (None, "E", 10)]
    kept = exact_dedup.drop_exact(spark.createDataFrame(rows, "doc_id long, text string, row long"))
    assert kept.columns == ["doc_id", "text", "row"]
    got = sorted((r.doc_id or 0, (r.text or "").lower(), r.row) for r in kept.collect())
    assert [g[:2] for g in got] == [(0, "d"), (0, "e"), (3, ""), (5, "b"), (7, "c"), (9, "a")]
    assert set(dict((g[:2], g[2]) for g in got).items()) >= {((9, "a"), 2), ((5, "b"), 3), ((3, ""), 8)}
    assert exact_dedup.drop_exact(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(30)],
        [(9, i) for i in range(20)] + [(None, 3), (4, 4)],
        [],
        [(random.Random(i).randint(0, 60), random.Random(-i - 1).randint(0, 60)) for i in range(50)]
    ]
)
def test_components(spark, edges):
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in list(up)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_oracle(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("leaf,block", [(4096, 256), (12, 5), (2, 2)])
def test_near(spark, words, leaf, block):
    texts = corpus(words)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(frame(spark, texts), leaf=leaf, block=block).collect()}
    assert got == near_oracle(texts)


def test_near_hub(spark, words):
    """Variants that are similar to a hub alone stay linked to it, though every node that holds them is large."""
    hub = prose(words, 5, 400).split(" ")
    texts = {0: " ".join(hub)}
    for k in range(1001, 2001):
        r, text = random.Random(k), list(hub)
        for at in r.sample(range(80), 11):
            text[5 * at] = f"v{k}x{at}"
        texts[k] = " ".join(text)
    sets = {i: shingles(texts[i]) for i in texts}
    hung = {i for i in texts if 100 * len(sets[0] & sets[i]) >= 75 * len(sets[0] | sets[i])}
    got = {r.doc_id: r.component_id for r in neardup.near_groups(frame(spark, texts), leaf=64).collect()}
    assert len(hung) == 1001 and not hung - {i for i in got if got[i] == 0}


def test_near_few_equal_tokens(spark, words):
    """A link at 0.756 of which only 76 of 128 minwise tokens are equal."""
    hub, r = prose(words, 5, 400).split(" "), random.Random(880)
    texts, other = {0: " ".join(hub)}, list(hub)
    for at in r.sample(range(80), 11):
        other[5 * at] = f"v880x{at}"
    texts[880] = " ".join(other)
    assert near_oracle(texts)[880][1] == 0
    short, _ = neardup.minwise(neardup.shingle_sets(list(texts.values())), 12)
    assert (short[0] == short[1]).sum() == 76
    assert {r.doc_id: r.component_id for r in neardup.near_groups(frame(spark, texts)).collect()} == {0: 0, 880: 0}


def test_near_edges(spark):
    assert neardup.near_groups(frame(spark, [])).count() == 0
    rows = neardup.near_groups(spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (3, "A B"), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows) == [
        (0, 1, 0, True),
        (3, 1, 3, True),
        (4, 0, 4, True),
        (5, 1, 3, False),
        (5, 1, 3, False)
    ]
    kept = neardup.drop_near(frame(spark, {3: "A B", 5: "a b", 6: None}))
    assert {r.doc_id for r in kept.collect()} == {3, 6}


def test_shingles_are_whole(words):
    texts = list(corpus(words).values())
    for text, found in zip(texts, neardup.shingle_sets([t or "" for t in texts])):
        assert len(found) == len(shingles(text))


def line_oracle(texts):
    lines = []
    for i in sorted(k for k in texts):
        for n, line in enumerate((texts[i] or "").translate(UP).split("\n")):
            w = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if w:
                lines.append(((i, n), w))
    return {k for j, (k, w) in enumerate(lines) if any(100 * len(w & v) >= 75 * len(w | v) for _, v in lines[:j])}


def test_lines(spark, words):
    r = random.Random(2)
    pool = [prose(words, k, r.randint(4, 30)) for k in range(12)]
    texts = {k: "\n".join(edited(r.choice(pool), words, k * 31 + j, r.choice([0, 0, 0.05, 0.1, 0.3])) for j in range(r.randint(0, 6))) for k in range(60)}
    texts |= {100: None, 101: "", 102: "a b c d\nA b c d", 103: "v w x y z\nz y x w v\r\nV W X Y Z", 104: prose(words, 77, 3000)}
    df = frame(spark, texts)
    assert {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(df).collect()} == line_oracle(texts)
    out = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    assert out[103].text == "v w x y z" and out[103].n_removed == 2 and out[100].text == "" and out[102].text == "a b c d"
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("part", [5, 4096])
def test_short_lines(spark, part):
    """Lines of few words from a small vocabulary, whose lists are long and parted."""
    r = random.Random(6)
    texts = {k: "\n".join(" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9))) for _ in range(5)) for k in range(60)}
    got = line_dedup.repeated_lines(frame(spark, texts), part=part).collect()
    assert {(g.doc_id, g.line_no) for g in got} == line_oracle(texts)


@pytest.mark.parametrize("part", [40, 131072])
def test_lists_of_near_copies(spark, words, part):
    """Lists beyond WHOLE members, of lines on both sides of LONG words, and letters whose lower case is not that of A-Z alone."""
    r = random.Random(8)
    base = prose(words, 5, 110)
    copies = {k: edited(base, words, k, r.choice([0.02, 0.1, 0.2]))[: r.choice([450, 540, 1000])] for k in range(200)}
    texts = copies | {300: "\u00c4b \u00e4b Cd\tef\u3000g", 301: "\u00e4b \u00c4b cD ef\u3000G", 302: "\u00e4b \u00e4B cd ef\u3000g", 303: "\u0130 \u03a3 x\rY", 304: "i\u0307 \u03c3 x y", 305: "\u0130 \u03a3 X y"}
    got = line_dedup.repeated_lines(frame(spark, texts), part=part).collect()
    assert {(g.doc_id, g.line_no) for g in got} == line_oracle(texts)


def test_lines_take_little_disk(spark, words):
    """Long lines that share rare words and are not similar are told apart by their summaries: neither their pairs nor they themselves are written."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    texts = {k: "\n".join(prose(words, 7 * k + j, 140) for j in range(3)) for k in range(400)}

    def size():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))

    before = size()
    assert line_dedup.drop_lines(frame(spark, texts)).count() == 400
    assert size() - before < 0.75 * sum(map(len, texts.values())), (size() - before) / sum(map(len, texts.values()))


def test_summaries_of_lines(spark, words):
    """A line's summary tells of 64 bits, 128 or 256 which got an odd number of words: it never differs by more bits than words do, and tells even long lines apart."""
    base = prose(words, 3, 260)
    texts = {k: edited(base, words, k, 0.05)[: 90 * (k % 20 + 1)] if k % 2 else prose(words, k, 40 + 8 * k) for k in range(30)}
    sets = line_dedup._sets(line_dedup._documents(frame(spark, texts), "doc_id", "text", None))
    rows = line_dedup._ranked(sets, line_dedup._rarity(sets)).alias("x")
    pairs = rows.join(rows.alias("y"), F.expr("x.doc_id < y.doc_id")).select("x.doc_id", F.col("y.doc_id").alias("other"), F.expr(line_dedup._differ("x.", "y.")).alias("least"))
    for r in pairs.collect():
        a, b = (set(texts[k].translate(UP).split()) for k in (r.doc_id, r.other))
        assert r.least <= len(a ^ b)
        if r.doc_id % 2 == r.other % 2 == 0 and min(len(a), len(b)) < 150:
            assert 7 * r.least > len(a) + len(b) or not 3 * len(a) <= 4 * len(b) <= 5.4 * len(a), (r, len(a), len(b))


def test_lines_of_repeated_rows(spark):
    """Of rows that repeat id and text one keeps the line; rows that share an id alone are documents of their own; a null id keeps all."""
    rows = [(1, "one two\n\nthree", 1), (1, "one two\n\nthree", 2), (1, "other words", 3), (2, "One two", 4), (None, "one two", 5), (None, "one two", 6)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, text_key long")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.text) for r in out) == [
        (0, 1, 0, "one two"),
        (0, 1, 0, "one two"),
        (1, 1, 0, "other words"),
        (1, 3, 0, "one two\n\nthree"),
        (1, 3, 2, ""),
        (2, 1, 1, "")
    ]


def test_near_repeats(spark, words):
    """A repeated id loses no other text; of rows of a group that repeat the smallest id one stays."""
    base = prose(words, 1, 60)
    near, other = edited(base, words, 3, 0.02), prose(words, 2, 60)
    rows = [
        (3, base, 1),
        (5, near, 2),
        (5, other, 3),
        (7, other + " x", 4),
        (3, near, 5),
        (8, None, 6),
        (8, "", 7),
        (None, base, 8),
        (9, prose(words, 4, 30), 9),
        (9, prose(words, 4, 30), 10)
    ]
    kept = neardup.drop_near(spark.createDataFrame(rows, "doc_id long, text string, row long"))
    assert kept.columns == ["doc_id", "text", "row"]
    got = {r.row for r in kept.collect()}
    assert len(got & {1, 5}) == 1 and len(got & {9, 10}) == 1 and got - {1, 5, 9, 10} == {3, 6, 7, 8}


@pytest.mark.parametrize("n,loose,block", [(40, 40, 7), (40, 3, 7), (41, 11, 5), (9, 0, 4), (3, 1, 256)])
def test_open_blocks_meet_every_open_pair(spark, n, loose, block):
    """Each pair with a member of the rest comes to one block pair, within a block or between two; pairs within the part do not."""
    rows = [(7, i, n, None if i < loose else 99, loose) for i in range(n)]
    units = spark.createDataFrame(rows, "unit long, doc_id long, size long, part long, rest long")
    groups = {}
    for r in neardup._open_blocks(units, block).collect():
        groups.setdefault(r.pair, []).append((r.doc_id, r.side))
    met = []
    for members in groups.values():
        sides = {s for _, s in members}
        assert len(sides) <= 2 and len(members) <= 4 * block
        met += [tuple(sorted((a, b))) for k, (a, s) in enumerate(members) for b, t in members[:k] if len(sides) == 1 or s != t]
    pairs = {(a, b) for b in range(n) for a in range(b) if a < loose}
    assert pairs <= set(met) and len(met) == len(set(met))
    if loose and n > loose:
        assert not {(a, b) for a, b in met if a >= loose} - pairs


def test_a_large_group_of_near_copies_moves_few_texts(spark, words, monkeypatch):
    """Six hundred near copies of one text in one group: chunks with the hub, and blocks for what is not linked with it."""
    text = prose(words, 3, 120)
    texts = {k: edited(text, words, k, 0.007) for k in range(600)}
    moved, grouped = [], neardup._grouped

    def counting(df, key, run):
        if "text" in df.columns:
            moved.append(df.count())
        return grouped(df, key, run)

    monkeypatch.setattr(neardup, "_grouped", counting)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(frame(spark, texts), block=16).collect()}
    assert got == near_oracle(texts)
    n = got and sum(1 for _ in set(texts.values()))
    assert sum(moved) < 0.3 * n * n / 16  # which all blocks against all would be
