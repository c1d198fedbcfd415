"""Near-duplicate documents by a chosen-path set similarity join.

Every document has the set of its 5-word shingles, and 128 minwise tokens of that set. Documents with equal sets are one
class from the start. In each of several independent trees, the classes branch by a selected minwise token: those that
agree on it go to the same child. A node with few members is a leaf and is compared exhaustively; a larger one branches
again, by three further tokens, or has all its pairs of blocks compared where branching would not part it. Two sets with
similarity J stay together at a token with probability J, so a pair survives a node of any size with probability u =
1 - (1 - J u) ** 3 at least, 0.98 at the threshold. The recall target is a loss of 1e-6: a share p of the 128 tokens is equal,
binomial about J, and the mean of (1 - p u(p)) ** 12 over it is 6e-7 at 0.75 for any number of levels.

Comparing in leaves is by minwise tokens and keeps what might be linked; its connected groups then come together
with whole texts, and links are confirmed on the full sets. In a group beyond ``BLOCK`` members all are first compared with one, its hub; those that are
linked with it are one part, and only pairs with one of the rest are still open. Open pairs are compared in blocks: the rest in blocks against each
other and against blocks of the part, so a group whose members are linked with its hub moves its texts once, whatever its size. A group beyond ``LEAF``
members is confirmed leaf by leaf in the same way where that moves fewer texts. No comparison gives more rows than its members: members that are
linked through others need no link of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import chunks, lean, saved, small, without
from lectern.llm.graph import components

WORDS = 5
#: Similarity in hundredths from which documents are linked.
PERCENT = 75
MINWISE, TREES, BRANCHES, LEAF, BLOCK = 128, 12, 3, 4096, 256
#: Least share of equal minwise tokens that is looked at; a link at 0.75 has fewer with probability 2.6e-8 (67 of 128 at most).
MAYBE = 0.53
#: Characters of text that a task hashes at a time.
BATCH = 1_500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(20).integers(1, 2**63, MINWISE + WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as they were needed."""

    base = 0x5851F42D4C957F2D
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 2 * BATCH)
            one = np.full(size, cls.base, np.uint64)
            back = np.full(size, pow(cls.base, -1, 2**64), np.uint64)
            one[0] = back[0] = 1
            cls.up, cls.down = np.cumprod(one), np.cumprod(back)
        return cls.up[:n], cls.down[:n]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; all texts are hashed side by side.

    Words are runs without space and U+0009 to U+000D, with A-Z in lower case. Fewer than five words are one
    shingle together; no words give the empty set.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    up, down = _Powers.upto(len(data) + 1)
    low *= up[: len(data)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low, dtype=np.uint64)))
    words = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX)
    bounds = np.cumsum([1] + [len(r) + 1 for r in raws])
    first = np.searchsorted(starts, bounds)
    shingles = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS if len(shingles) else 0):
        shingles += words[j : j + len(shingles)] * _ODD[MINWISE + j]
    shingles = _mixed(shingles)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(shingles[a : b - WORDS + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for j in range(a, b):
                one = one * _MIX + words[j]
            out.append(_mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each of 128 minwise tokens, and the whole tokens at which the trees begin; a row for each of the sets, none of which may be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    short, whole = np.empty((len(sets), MINWISE), np.uint16), np.empty((len(sets), trees), np.uint64)
    for k in range(MINWISE):
        token = np.minimum.reduceat(flat * _ODD[k], at)
        short[:, k] = (token * _MIX) >> np.uint64(48)
        if k < trees:
            whole[:, k] = token
    return short, whole


def _by_size(texts: list[str]):
    """(from, to) of runs of texts with about BATCH characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def set_key(s: np.ndarray) -> int:
    return int(s.sum(dtype=np.uint64).view(np.int64))


SIGNED = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("digest", pa.string()),
        ("n_shingles", pa.int64()),
        ("key1", pa.int64()),
        ("key2", pa.int64()),
        ("roots", pa.list_(pa.int64())),
        ("sig", pa.binary())
    ]
)


def _sign(trees: int):
    def run(batches):
        for batch in batches:
            heads, texts = batch.columns[:3], [t or "" for t in batch.column(3).to_pylist()]
            for a, b in _by_size(texts):
                sets = shingle_sets(texts[a:b])
                full = [s for s in sets if len(s)]
                short, whole = minwise(full, trees) if full else ((), ())
                tokens = iter(zip(short, whole))
                rows = []
                for s in sets:
                    if len(s):
                        sig, roots = next(tokens)
                        rows.append((len(s), set_key(s), int(_mixed(s + _MIX).sum(dtype=np.uint64).view(np.int64)), roots.view(np.int64).tolist(), sig.tobytes()))
                    else:
                        rows.append((0, None, None, None, None))
                yield pa.RecordBatch.from_arrays([*(h.slice(a, b - a) for h in heads), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(SIGNED)[3:]))], schema=SIGNED)

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """(uid, doc_id, digest, n_shingles, key1, key2, roots, sig) of each row as a written table; digest is the text's, and the keys are 128 bits of the set's, null for the empty one."""
    rows = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.sha2(F.col(text_col), 256), F.col(text_col))
    return saved(rows.mapInArrow(lean(_sign(trees), "near"), "uid long, doc_id long, digest string, n_shingles long, key1 long, key2 long, roots array<long>, sig binary"))


def leaves(reps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(node, doc_id, size) of every leaf with two members or more.

    Sizes are counted before members meet, and a node beyond ``leaf`` members never comes to one task. It branches by tokens that its
    path has not used, if its children have at most half as many pairs to compare as it has; so there are few levels. Else its members
    agree on too much, and it is dealt into blocks, of which each two are a leaf: none of its pairs is lost.
    """
    rows = reps.select("doc_id", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), F.array("tree").alias("used"), "doc_id")
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    held = saved(rows.join(sizes, "node").select("node", "used", "doc_id", "size"))
    out = held.filter(F.col("size") <= leaf).select("node", "doc_id", "size")
    chosen = F.expr(f"slice(array_sort(transform(array_except(sequence(0, {MINWISE - 1}), used), c -> struct(xxhash64(node, c) as h, c as c))), 1, {BRANCHES}).c")
    while not (large := held.filter(F.col("size") > leaf)).isEmpty():
        branch = large.select(
            F.col("node").alias("parent"),
            F.col("size").alias("above"),
            "used",
            "doc_id",
            F.explode(chosen).alias("c")
        ).join(reps.select("doc_id", "sig"), "doc_id")
        child = F.xxhash64("parent", "c", F.expr("substring(sig, cast(2 * c + 1 as int), 2)"))
        rows = saved(branch.select("parent", "above", child.alias("node"), F.concat("used", F.array("c")).alias("used"), "doc_id"))
        sizes = saved(rows.groupBy("parent", "above", "node").agg(F.count("*").alias("size")))
        parted = saved(sizes.groupBy("parent", "above").agg(F.sum(F.col("size") * F.col("size")).alias("work")).filter("2 * work <= above * above").select("parent"))
        stuck = large.join(parted.withColumnRenamed("parent", "node"), "node", "left_anti").select(F.col("node").alias("unit"), "doc_id", "size")
        pairs = _in_blocks(stuck, max(leaf // 2, 1)).select(F.col("pair").alias("node"), "doc_id", F.lit(leaf).cast("long").alias("size"))
        known = sizes.filter("size > 1").join(parted, "parent", "left_semi").select("node", "size")
        held = saved(rows.join(known, "node").select("node", "used", "doc_id", "size"))
        out = out.unionByName(pairs).unionByName(held.filter(F.col("size") <= leaf).select("node", "doc_id", "size"))
    return out


def distinct_leaves(rows: DataFrame) -> DataFrame:
    """rows of leaves without those leaves whose members another leaf has too: copies meet in most trees, and are compared once."""
    mark = F.xxhash64("doc_id", F.lit("member"))
    each = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(mark).alias("y"), F.min("doc_id").alias("low"))
    once = each.groupBy("n", "x", "y", "low").agg(F.min("node").alias("node")).select("node")
    return rows.join(once, "node", "left_semi")


class _Sets:
    """Union-find over the positions of a small group; the smaller position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i
        return i != j


def _alike(sigs: np.ndarray, side: np.ndarray) -> list[tuple[float, int, int]]:
    """(share of equal tokens, i, j) of pairs that may be linked, the likeliest first; with two sides, of pairs between them."""
    found, across = [], len(set(side.tolist())) > 1
    for i in range(len(sigs) - 1):
        share = (sigs[i + 1 :] == sigs[i]).mean(axis=1)
        near = share >= MAYBE
        if across:
            near &= side[i + 1 :] != side[i]
        found += [(float(share[j]), i, i + 1 + j) for j in np.flatnonzero(near).tolist()]
    return sorted(found, reverse=True)


def _groups(batches):
    """Rows of batches that are sorted by their first column, a group at a time, as columns without it."""
    held: list = []
    last = None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
        for a, b in zip(cut[:-1], cut[1:]):
            part = [c.slice(a, b - a) for c in batch.columns[1:]]
            if held and keys[a] == last:
                held.append(part)
                continue
            if held:
                yield held
            held, last = [part], keys[a]
    if held:
        yield held


def _lists(group: list) -> list[list]:
    return [[x for part in group for x in part[k].to_pylist()] for k in range(len(group[0]))]


def _columns(group: list) -> list[list]:
    """The columns of a group, each document once."""
    columns = _lists(group)
    first = {doc_id: i for i, doc_id in reversed(list(enumerate(columns[0])))}
    keep = [first[d] for d in sorted(first)]
    return [[c[i] for i in keep] for c in columns]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, MINWISE)


def _candidates(batches):
    """A star over each group of a leaf's members that are connected by pairs which may be linked: each member is compared with those that are not reached yet."""

    def rows():
        for group in _groups(batches):
            ids, sigs = _columns(group)
            tokens, left = _matrix(sigs), np.arange(1, len(ids))
            head, queue = 0, [0]
            while len(left):
                if not queue:
                    head, left = int(left[0]), left[1:]
                    queue = [head]
                    continue
                near = (tokens[left] == tokens[queue.pop()]).mean(axis=1) >= MAYBE
                for i in left[near].tolist():
                    queue.append(i)
                    yield ids[head], ids[i]
                left = left[~near]

    yield from chunks(rows(), LINKS, 16384)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= PERCENT * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirmed(batches):
    """A spanning forest of the open links of a group, confirmed on full sets: within a block, or between two; members of one part are linked already."""

    def rows():
        for group in _groups(batches):
            ids, sigs, texts, side, keys, parts = _lists(group)
            sets = [s for a, b in _by_size(texts) for s in shingle_sets(texts[a:b])]
            # Texts were found by id; where an id has several, the others are not the class's own.
            own = {ids[i]: i for i in reversed(range(len(ids))) if set_key(sets[i]) == keys[i]}
            ids, sigs, side, sets, parts = ([c[own[d]] for d in sorted(own)] for c in (ids, sigs, side, sets, parts))
            linked, first = _Sets(len(ids)), {}
            for i, part in enumerate(parts):
                linked.join(first.setdefault(part, i), i)
            for _, i, j in _alike(_matrix(sigs), np.array(side)):
                if linked.root(i) != linked.root(j) and similar(sets[i], sets[j]):
                    linked.join(i, j)
                    yield ids[i], ids[j]

    yield from chunks(rows(), LINKS, 16384)


def _with_hub(batches):
    """(hub, member) of each member of a chunk that is linked with the chunk's hub, whose side is -1."""

    def rows():
        for group in _groups(batches):
            ids, _, texts, side, keys, _ = _lists(group)
            sets = [s for a, b in _by_size(texts) for s in shingle_sets(texts[a:b])]
            own = {(side[i] < 0, ids[i]): i for i in reversed(range(len(ids))) if set_key(sets[i]) == keys[i]}
            hub = next(i for (is_hub, _), i in own.items() if is_hub)
            for (is_hub, doc_id), i in own.items():
                if not is_hub and doc_id != ids[hub] and similar(sets[hub], sets[i]):
                    yield ids[hub], doc_id

    yield from chunks(rows(), LINKS, 16384)


def _grouped(df: DataFrame, key: str, run) -> DataFrame:
    """run over df with the rows of a key together; groups are of bounded size, and a task has many."""
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(lean(run, "near"), "a long, b long")


def _dealt(number: str, size: str, block: int) -> Column:
    """A member's block, one of as many as its size needs."""
    return F.pmod(F.xxhash64(number, F.lit("block")), F.ceil(F.col(size) / block)).cast("int")


def _in_blocks(units: DataFrame, block: int) -> DataFrame:
    """(pair, doc_id, side) of units (unit, doc_id, size): a unit's members in blocks of about ``block``, and a pair key for each two blocks, a block with itself among them."""
    dealt = units.withColumn("_n", F.ceil(F.col("size") / block).cast("int")).withColumn("side", _dealt("doc_id", "size", block))
    each = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return each.select(F.xxhash64("unit", F.least("side", "_k"), F.greatest("side", "_k")).alias("pair"), "doc_id", "side")


def _open_blocks(units: DataFrame, block: int) -> DataFrame:
    """(pair, doc_id, side, part) of units (unit, doc_id, size, part, rest): blocks of the rest (those of no part) in pairs with each other and with the blocks of the part.

    rest is how many members of the unit are of no part; without any, the unit has no open pair.
    """
    n_rest, n_part = F.ceil(F.col("rest") / block).cast("int"), F.ceil((F.col("size") - F.col("rest")) / block).cast("int")
    rows = units.filter("rest > 0").withColumns({"_r": n_rest, "_p": n_part})
    loose = F.col("part").isNull()
    place = lambda n: F.pmod(F.xxhash64("doc_id", F.lit("block")), n).cast("int")
    rows = rows.withColumn("side", F.when(loose, place(F.col("_r"))).otherwise(F.col("_r") + place(F.greatest("_p", F.lit(1)))))
    last = F.when(loose, F.col("_r") + F.col("_p") - 1).otherwise(F.col("_r") - 1)
    each = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    return each.select(F.xxhash64("unit", F.least("side", "_k"), F.greatest("side", "_k")).alias("pair"), "doc_id", "side", F.coalesce("part", "doc_id").alias("part"))


def _hubs(members: DataFrame, maybe: DataFrame, whole, block: int) -> DataFrame:
    """(unit, doc_id, size, part) of members (unit, doc_id, size) of large units: part is the unit's hub where that is linked with the member, else null; a written table.

    The hub is the member of the most candidate pairs. Members come to it in chunks of ``block``, each with a copy of the hub.
    """
    degree = maybe.groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("degree"))
    ranked = members.join(degree, "doc_id", "left")
    hub = saved(ranked.groupBy("unit", "size").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "doc_id"))["doc_id"].alias("hub")))
    chunk = lambda k: F.xxhash64("unit", k).alias("pair")
    each = members.select(chunk(_dealt("doc_id", "size", block)), "doc_id", F.lit(0).alias("side"))
    copies = hub.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block).cast("int") - 1)))
    asked = each.unionByName(copies.select(chunk(F.col("_k")), F.col("hub").alias("doc_id"), F.lit(-1).alias("side"))).withColumn("part", F.col("doc_id"))
    near = saved(_grouped(whole(asked), "pair", _with_hub))
    linked = near.select(F.col("b").alias("doc_id"), F.col("a").alias("part")).unionByName(hub.select(F.col("hub").alias("doc_id"), F.col("hub").alias("part")))
    return saved(members.join(linked, "doc_id", "left"))


def _rows(docs: DataFrame, id_col: str, text_col: str, trees: int, leaf: int, block: int) -> DataFrame:
    """(doc_id, digest, n_shingles, linked, component_id) of each row; linked is a number that the rows of a component share, null where a row is linked with nothing by rule."""
    signed = signatures(docs, id_col, text_col, trees)
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    # From here to the end, a class of equal sets is known by the uid of its first row, and doc_id means that number.
    first = F.min(F.struct("doc_id", "uid")).alias("first")
    classes = usable.groupBy("key1", "key2", "n_shingles").agg(first, F.count("*").alias("copies"), F.first("roots").alias("roots"), F.first("sig").alias("sig"))
    reps = saved(classes.select(F.col("first.uid").alias("doc_id"), F.col("first.doc_id").alias("first_id"), "key1", "key2", "n_shingles", "copies", "roots", "sig"))
    leaf_rows = saved(distinct_leaves(leaves(reps.select("doc_id", "roots", "sig"), leaf)))
    sigs = reps.select("doc_id", "sig")
    maybe = saved(_grouped(leaf_rows.join(sigs, "doc_id").select("node", "doc_id", "sig"), "node", _candidates))
    groups = components(maybe).select(F.col("node").alias("doc_id"), F.col("component").alias("unit"))
    members = saved(groups.join(groups.groupBy("unit").agg(F.count("*").alias("size")), "unit"))
    # Only texts of groups are needed: others stay where they are if the groups' ids are few, and are moved once at most.
    wanted = saved(members.join(reps.select("doc_id", "first_id"), "doc_id").select("first_id").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("first_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(small(wanted), "first_id", "left_semi")
    many = members.filter(F.col("size") > block)
    hubs = not many.isEmpty()
    if hubs:
        texts = saved(texts)  # read by two comparisons

    def whole(rows: DataFrame) -> DataFrame:
        """rows (pair, doc_id, side, part) with the members' tokens, texts and keys."""
        known = rows.join(reps.select("doc_id", "first_id", "sig", "key1"), "doc_id")
        return known.join(texts, "first_id").select("pair", "doc_id", "sig", "text", "side", "key1", "part")

    no_part = F.lit(None).cast("long").alias("part")
    few = members.filter(F.col("size") <= block).select("unit", "doc_id", "size", no_part, F.col("size").alias("rest"))
    parts, open_units = None, few
    if hubs:
        parts = _hubs(many, maybe, whole, block)
        rest = saved(parts.groupBy("unit").agg(F.count_if(F.col("part").isNull()).alias("rest")))
        held = parts.join(rest, "unit").filter("rest > 0")
        open_units = few.unionByName(held.filter(F.col("size") <= leaf).select(few.columns))
        beyond = held.filter(F.col("size") > leaf)
        if not beyond.isEmpty():
            each = leaf_rows.join(beyond.select("doc_id", "unit", "part", "rest", F.col("size").alias("all")), "doc_id")
            r, n = F.col("rest"), F.col("all")
            in_blocks = r * F.ceil(n / block) + (n - r) * F.ceil(r / block)
            moved = F.sum(F.ceil(F.col("size") / block)) >= in_blocks
            at_once = saved(each.groupBy("unit", "all", "rest").agg(moved.alias("at_once")).filter("at_once").select("unit"))
            open_units = open_units.unionByName(beyond.join(at_once, "unit", "left_semi").select(few.columns))
            loose = F.sum(F.col("part").isNull().cast("long")).over(Window.partitionBy("node"))
            by_leaf = each.join(at_once, "unit", "left_anti").withColumn("rest", loose)
            open_units = open_units.unionByName(by_leaf.select(F.col("node").alias("unit"), "doc_id", "size", "part", "rest"))
    confirmed = _grouped(whole(_open_blocks(open_units, block)), "pair", _confirmed)
    if parts is not None:
        confirmed = confirmed.unionByName(parts.filter("part is not null").select(F.col("part").alias("a"), F.col("doc_id").alias("b")))
    linked = components(confirmed).select(F.col("node").alias("doc_id"), F.col("component").alias("linked"))
    named = saved(linked.join(reps.select("doc_id", "first_id"), "doc_id"))
    least = saved(named.groupBy("linked").agg(F.min("first_id").alias("component_id")))
    reached = named.join(small(least), "linked").select(F.col("doc_id").alias("rep"), "linked", "component_id")
    copied = reps.filter("copies > 1").select("key1", "key2", "n_shingles", F.col("doc_id").alias("class"), "first_id")
    found = signed.select("uid", "doc_id", "digest", "n_shingles", "key1", "key2").join(copied, ["key1", "key2", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    found = found.withColumn("rep", F.when(~alone, F.coalesce("class", "uid"))).join(reached, "rep", "left")
    own = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("first_id", "doc_id"))
    return found.select("doc_id", "digest", "n_shingles", F.coalesce("linked", "rep").alias("linked"), F.coalesce("component_id", own).alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): each row with the smallest id that it reaches by links.

    Null and empty texts have no shingles and are linked with nothing. Texts of any length count whole; a very long one is hashed alone and compared by its
    full set. Rows that repeat an id are each judged by their own text.
    A row without an id is linked with nothing and has a null component. Other
    columns are not read, and an empty table gives an empty result.
    """
    found = _rows(docs, id_col, text_col, trees, leaf, block)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the smallest id; all columns stay.

    Rows are told apart by id and text together, so a repeated id loses no other text. Of rows of a group that repeat its smallest id one stays.
    Rows without an id or without words stay.
    """
    found = saved(_rows(docs, id_col, text_col, trees, leaf, block).filter("linked is not null"))
    best = saved(
        found.groupBy("linked").agg(F.min(F.struct("doc_id", "digest")).alias("best"), F.count("*").alias("n")).filter("n > 1").select(
            "linked",
            F.col("best.doc_id").alias("best_id"),
            F.col("best.digest").alias("best_digest")
        )
    )
    key = [F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")]
    held = found.join(small(best), "linked")
    wins = (F.col("doc_id") == F.col("best_id")) & (F.col("digest") == F.col("best_digest"))
    gone = saved(held.filter(~wins).select(*key).distinct())
    twice = saved(held.filter(wins).groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select(*key))
    return without(docs, id_col, F.sha2(F.col(text_col), 256), gone, twice)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS z FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.z),
m AS (SELECT x, min(z) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
