"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target in words. The ratio of target to size is what a document is expected to be taken: its whole part is
taken for certain, its fraction is an inclusion probability. The cube method moves these fractions to 0 or 1 within the null
space of two constraints of the source, the expected words and the expected documents, so that both totals stay as they are:

1. flight: blocks of about ``BLOCK`` units of one source, dealt by hash, each move on their own; the largest unit goes first and
   all others of its block make up for it. A block leaves two fractional units at most, and they are among its smallest;
2. further flights: what ``MERGE`` blocks left is one block again, until a source is one block;
3. landing: the last block of a source has two fractional units at most. Of their four outcomes the one nearest to the
   expected words is taken, then the one nearest to the expected documents.

No task holds more than a block, however large a source is. All draws are seeded by source and block, so reruns agree.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved, unwrapped, wrapped
from lectern.operators.order import dense_number

#: Weights of the sources by code point, repeating, and how often a source may be repeated.
WEIGHTS, LIMIT = (5, 2, 1), 3
BLOCK, MERGE = 1024, 512
#: Rows that one task makes of a unit of repeated rows before they are dealt out anew.
REPEATS = 10_000
#: Fractions nearer than this to 0 or 1 are 0 or 1.
NEAR = 1e-9


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_no, source_size, n_units, target) from units (source, id, size, m), m rows each; a written table.

    Sources are numbered by code point, null last, and weigh ``weights``, repeating. They share all words by weight, but none gets over ``limit``
    times its own; the excess is shared again by weight until none is above. A source without words has the target 0.
    What meets in one task is a count for each partition of the sorted sources, and what the driver sees are four sums a round.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units"))
    ordered = dense_number(sizes.withColumn("place", F.struct(F.col("source").isNull(), "source")), "place", "source_no").drop("place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = saved(ordered.withColumn("weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * F.lit(limit)
    left, shared, before = float(total), None, -1
    while True:
        # Once over its limit a source stays there: what is left for a unit of weight only grows.
        over = F.lit(False) if shared is None else F.lit(left) * F.col("weight") / F.lit(shared) > most
        now = sources.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0)).alias("held"),
            F.count_if(over).alias("n_held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if now.n_held == before or not now.free:
            break
        before, left, shared = now.n_held, float(total - now.held), float(now.free)
    share = F.lit(left) * F.col("weight") / F.lit(shared or 1.0)
    return saved(sources.withColumn("target", F.least(share, most.cast("double"))).drop("weight"))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """chance with all but two entries at 0 or 1, or fewer left; the sums of chance and of chance * size stay. size falls from entry to entry.

    Each step takes the largest fractional unit t and moves along the vector of the null space that has 1 at t and spreads the
    opposite over the others by their room p (1 - p): a weighted regression on the sizes. The end of the move is drawn so that each
    chance keeps its mean. A step settles one unit at least; where the others are of one size and t is not, t cannot move and waits.
    """
    p = chance.astype(np.float64).copy()
    live = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
    p[p <= NEAR], p[p >= 1 - NEAR] = 0.0, 1.0
    while len(live) > 1:
        rest = live[1:]
        room = p[rest] * (1 - p[rest])
        total = room.sum()
        mean = (room * size[rest]).sum() / total
        off, away = size[rest] - mean, size[live[0]] - mean
        spread = (room * off * off).sum() / total
        if size[rest[0]] == size[rest[-1]]:  # all of one size
            if size[live[0]] != size[rest[0]]:
                live = rest  # the first one waits for the landing or for the next flight
                continue
            move = -room / total
        else:
            move = -room / total * (1 + away * off / spread)
        move = np.concatenate(([1.0], move))
        at = p[live]
        up, down = move > 0, move < 0
        ahead = min(np.min((1 - at[up]) / move[up], initial=np.inf), np.min(-at[down] / move[down], initial=np.inf))
        back = min(np.min(at[up] / move[up], initial=np.inf), np.min((at[down] - 1) / move[down], initial=np.inf))
        step = ahead if rng.random() * (ahead + back) < back else -back
        moved = np.clip(at + step * move, 0.0, 1.0)
        moved[moved <= NEAR], moved[moved >= 1 - NEAR] = 0.0, 1.0
        p[live] = moved
        live = live[(moved > 0) & (moved < 1)]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p with its few last fractions at 0 or 1: the outcome nearest to their words, then to their number, then the first."""
    live = np.flatnonzero((p > 0) & (p < 1))
    if len(live):
        chance, weight = p[live], size[live]
        outcomes = [np.array(x, dtype=np.float64) for x in product((0, 1), repeat=len(live))]
        p = p.copy()
        p[live] = min(outcomes, key=lambda x: (round(abs(float(((x - chance) * weight).sum())), 6), abs(float((x - chance).sum()))))
    return p


def _flown(level: int, seed: int):
    """One block's flight, and its landing where it is the only one of its source, as a function of its rows."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("id", "ascending")]).combine_chunks()
        size = block["size"].to_numpy().astype(np.float64)
        rng = np.random.default_rng([seed, level, block["source_no"][0].as_py(), block["block"][0].as_py()])
        p = flight(block["chance"].to_numpy(), size, rng)
        if block["blocks"][0].as_py() <= 1:
            p = landing(p, size)
        return block.set_column(block.column_names.index("chance"), "chance", pa.array(p, pa.float64()))

    return run


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, merge: int = MERGE, seed: int = 7
) -> DataFrame:
    """(id, source, size, m, copies, source_size, target): how many copies the m rows of an id, source and size get together; a written table.

    Null text has no words. Rows that agree in id, source and size are one unit of m rows, so that a repeated row never fills a block;
    a unit's copies are at most ``limit`` times m. Null ids are ids. An empty table gives an empty result; long texts are counted
    where they are read, and only ids, sources and sizes are shuffled. Other columns are not read. Texts of no words get copies too, as documents count.
    """
    if limit < 1 or block < 8 or merge < 2 or merge * 2 > block:
        raise ValueError("limit is 1 or more, block 8 or more and merge between 2 and half a block")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    units = saved(rows.groupBy("id", "source", "size").agg(F.count("*").alias("m")))
    sources = source_targets(units, weights, limit)
    other = sources.withColumnRenamed("source", "of")
    joined = units.join(other, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("m")).otherwise(0.0)
    blocks = F.ceil(F.col("n_units") / F.lit(block))
    state = joined.withColumn("expected", expected).withColumns(
        {"sure": F.floor(F.col("expected") + F.lit(NEAR)).cast("long"), "blocks": blocks.cast("long"), "block": F.pmod(F.xxhash64("id", "size"), blocks).cast("long")}
    )
    state = state.withColumn("chance", F.greatest(F.col("expected") - F.col("sure"), F.lit(0.0))).drop("expected")
    settled, level = [], 0
    while True:
        flown = saved(state.groupBy("source_no", "block").applyInArrow(_flown(level, seed), state.schema))
        fraction = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.filter(~fraction))
        left = flown.filter(fraction)
        if left.isEmpty():
            break
        state = left.withColumns({"block": F.floor(F.col("block") / F.lit(merge)).cast("long"), "blocks": F.ceil(F.col("blocks") / F.lit(merge)).cast("long")})
        level += 1
    plan = settled[0]
    for more in settled[1:]:
        plan = plan.unionByName(more)
    copies = F.col("sure") + F.col("chance").cast("long")
    return plan.select("id", "source", "size", "m", copies.alias("copies"), "source_size", "target")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs, as mix_plan says; taken is size times copies.

    The copies of a unit of repeated rows are spread over its rows as evenly as can be, so no row gets over ``limit``.
    """
    plan = mix_plan(docs, **options)
    few, many = plan.filter(F.col("m") <= REPEATS), plan.filter(F.col("m") > REPEATS)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(REPEATS).cast("long")))
    parts = many.withColumn("begin", begin).repartition("id", "begin")
    one = few.withColumn("begin", F.lit(0).cast("long")).unionByName(parts)
    nth = F.explode(F.sequence(F.col("begin") + 1, F.least(F.col("m"), F.col("begin") + REPEATS)))
    each = one.withColumn("nth", nth).withColumn("copies", _share("nth"))
    return each.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _share(nth: str) -> Column:
    """What the nth of m rows gets of a unit's copies."""
    return F.floor(F.col("copies") / F.col("m")).cast("long") + (F.col(nth) <= F.col("copies") % F.col("m")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: a row is left out or comes once or several times, as mix_plan says. All columns stay.

    Rows of one id, source and size are numbered by salts of their whole content, so that a repeated id is no single task's work.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options).select("id", "source", "size", "m", "copies")
    key = [F.col(k).alias(f"_{k}") for k in ("id", "source", "size")]
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    rows = docs.select(wrapped(), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    held = rows.join(plan.select(*key, "m", "copies").filter("copies > 0"), same).drop("_id", "_source", "_size")
    alone = held.filter("m = 1")
    again = _numbered(held.filter("m > 1")).withColumn("copies", _share("nth")).drop("nth")
    return unwrapped(alone.unionByName(again).withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))), docs.columns) if docs.columns else docs


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, 1 to m within their unit: their place in a salt of the unit after the salts before it."""
    from pyspark.sql import Window

    salted = rows.withColumn("digest", F.xxhash64("row")).withColumn("salt", F.pmod("digest", F.lit(64)))
    unit = ["id", "source", "size"]
    counted = salted.groupBy(*unit, "salt").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy(*unit).orderBy("salt")) - F.col("n"))
    other = before.select(*[F.col(k).alias(f"_{k}") for k in (*unit, "salt")], "before")
    same = F.col("salt") == F.col("_salt")
    for k in unit:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*unit, "salt").orderBy("digest")))
    return placed.join(other, same).withColumn("nth", F.col("nth") + F.col("before")).drop("digest", "salt", "before", *[f"_{k}" for k in (*unit, "salt")])
