"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

A round range-sorts the pieces that wait, and the gaps that are left, by size over the whole cluster, and deals both by their ranks to
slots of bounded size, so that every slot has its share of each size. Each slot then sweeps from long to short: a piece goes to its
successor, the smallest gap that holds it; where several want one gap, the first by rank takes it and the next ones go on to their next successor. Gaps
shrink as they are taken. A slot opens no more sequences than the tokens of its pieces need; what then fits nowhere waits with the gaps for
the next round, where fewer slots hold more of both. The last slot opens what it needs.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lectern.llm.common import chunks, kept, saved, trim

LENGTH = 2048
#: Pieces and gaps that a slot sweeps at most.
SLOT = 8192
#: Words that a worker remembers; beyond it, it forgets all and goes on.
REMEMBERED = 350_000
#: Bytes of text that a task tokenizes at a time: fewer take less memory and more time.
BATCH = 6_000_000
#: Words of which the tokenizer's steps before its model change nothing: small letters that do not compose, and then signs of ASCII, which it parts from them.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class Words:
    """Ids of whole texts, by the words between white space, which no token of this tokenizer crosses; every new word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        code = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {c: code(chr(c))[0][0] for c in range(0x21, 0x100) if PLAIN.fullmatch("a" + chr(c)) or PLAIN.fullmatch(chr(c))}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.many = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _merged(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.translate(self.bytes))]

    def _ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of new words in a row, and how many each has. Plain words go to the tokenizer's model piece by piece, all others through all its steps."""
        plain = list(map(PLAIN.fullmatch, words))
        rest = [word for word, match in zip(words, plain) if not match]
        slow: list[list[int]] = [[] for _ in rest]
        if rest:
            found = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            for i, of in zip(found.ids, found.word_ids):
                slow[of].append(i)
        others = iter(slow)
        tails: dict[str, list[int]] = {}
        out: list[int] = []
        ends = []
        for match in plain:
            if not match:
                out += next(others)
            else:
                core, signs = match.groups()
                at = self.place.get(core) if signs else None
                if at is None:
                    out += self._merged(core)
                else:
                    first = self.first[at]
                    out += self.pool[first : first + self.many[at]].tolist()
                if signs:
                    if signs not in tails:
                        tails[signs] = self._merged(signs)
                    out += tails[signs]
            ends.append(len(out))
        return out, ends

    def _learn(self, words: list[str]) -> None:
        found, ends = self._ids(words)
        ids, many = np.array(found, np.uint32), np.diff(ends, prepend=0)
        n, until, end = len(self.place), len(self.place) + len(words), self.used + len(ids)
        if until > len(self.first):
            self.first, self.many = np.resize(self.first, 2 * until), np.resize(self.many, 2 * until)
        if end > len(self.pool):
            self.pool = np.resize(self.pool, 2 * end)
        self.many[n:until] = many
        self.first[n:until] = self.used + np.cumsum(many) - many
        self.pool[self.used : end] = ids
        self.used = end
        self.place.update(zip(words, range(n, until)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end at last."""
        if len(self.place) > REMEMBERED:
            self._forget()
        # Lower case is the tokenizer's own next step, but after composing: a few small letters compose with a mark where their capitals do not.
        marks = pc.any(pc.match_substring_regex(texts, "[̀-ͯ]")).as_py()
        split = pc.ascii_split_whitespace(texts if marks else pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = list(map(self.place.get, words))
        if None in at:
            new = [w for w, k in zip(words, at) if k is None]
            for i in range(0, len(new), 4096):
                self._learn(new[i : i + 4096])
            at = list(map(self.place.__getitem__, words))
        which = np.array(at, np.int64)[coded.indices.to_numpy()]
        many = self.many[which]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
        ids = self.pool[np.repeat(self.first[which] - total[:-1], many) + np.arange(total[-1])]
        bounds = split.offsets.to_numpy()
        return ids, total[bounds - bounds[0]]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _slices(texts: pa.Array, batch: int = BATCH):
    """(from, to) of runs of texts with about batch bytes, at least one text each."""
    total = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + batch, "right")) - 1)
        yield at, end
        at = end


def cut(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a final id 0, in pieces of ``length`` of which the last may be shorter.

    Null text is empty and gives the final id alone. Repeated rows are cut each; other columns are not read.
    """

    def run(batches):
        words = kept(("words", path), lambda: Words(path))

        def rows():
            for part in batches:
                doc_ids, texts = part.column(0).to_pylist(), pc.fill_null(part.column(1), "")
                for a, b in _slices(texts, batch):
                    ids, bounds = words.encode(texts.slice(a, b - a))
                    ended = np.zeros(len(ids) + b - a, "<u4")
                    ended[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(bounds))] = ids
                    raw = memoryview(ended.tobytes())
                    for k, doc_id in enumerate(doc_ids[a:b]):
                        first, last = int(bounds[k]) + k, int(bounds[k + 1]) + k + 1
                        for piece, at in enumerate(range(first, last, length)):
                            until = min(at + length, last)
                            yield doc_id, piece, at - first, until - at, zlib.crc32(raw[4 * at : 4 * until])

        yield from chunks(rows(), PIECES, 8192)
        trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(sizes: list[int], gaps: list[tuple[int, int]], opening: int | None, length: int = LENGTH) -> tuple[list[tuple[int, int] | None], list[tuple[int, int]], int]:
    """One slot's sweep: (sequence or None, offset) of each piece, the gaps (sequence, size) that are left, how many sequences were opened.

    sizes are in order from long to short, gaps are (sequence, size). At most ``opening`` sequences are opened, any number if it is None; pieces of
    over half a sequence are not counted, as no two of them share one. Opened sequences are numbered -1, -2, ...
    """
    free: dict[int, list[int]] = {}
    held = 0  # bit s is set where there are gaps of size s
    for sequence, size in reversed(gaps):
        free.setdefault(size, []).append(sequence)
        held |= 1 << size
    out: list[tuple[int, int] | None] = []
    opened = counted = 0
    for size in sizes:
        above = held >> size
        if above:
            gap = size + (above & -above).bit_length() - 1
            sequence = free[gap].pop()
            if not free[gap]:
                held &= ~(1 << gap)
        elif opening is None or 2 * size > length or counted < opening:
            counted += 2 * size <= length
            opened += 1
            sequence, gap = -opened, length
        else:
            out.append(None)
            continue
        out.append((sequence, length - gap))
        if rest := gap - size:
            free.setdefault(rest, []).append(sequence)
            held |= 1 << rest
    return out, [(q, size) for size in sorted(free) for q in reversed(free[size])], opened


PLACED, WAITS, GAP = 0, 1, 2


def _swept(number: int, whole: bool, length: int):
    """The sweep of a slot as a function of its rows; ``whole`` lets it open what it needs."""

    def run(slot: pa.Table) -> pa.Table:
        slot = slot.sort_by([("kind", "ascending"), ("at", "ascending")]).combine_chunks()
        kind, size, sequence = (slot[c].to_numpy() for c in ("kind", "size", "sequence"))
        n = int((kind == WAITS).sum())
        gaps = list(zip(sequence[n:].tolist(), size[n:].tolist()))
        opening = max(0, int(size[:n].sum()) - int(size[n:].sum())) // length
        places, left, _ = sweep(size[:n].tolist(), gaps, None if whole else opening, length)
        # A sequence's number tells the round, the slot and which of the slot's own it is.
        base = (number << 56) + (int(slot["slot"][0].as_py()) << 16) if len(slot) else 0
        name = lambda q: q if q >= 0 else base - q
        rows = [(PLACED, name(p[0]), p[1]) if p else (WAITS, 0, 0) for p in places]
        rest = [(GAP, name(q), s) for q, s in left]
        columns = list(zip(*rows, *rest)) or [(), (), ()]
        return pa.table(
            {
                "kind": pa.array(columns[0], pa.int32()),
                "size": pa.array([*size[:n].tolist(), *(s for _, _, s in rest)], pa.int64()),
                "sequence": pa.array(columns[1], pa.int64()),
                "offset": pa.array([*(r[2] for r in rows), *(0 for _ in rest)], pa.int64()),
                "row": pa.concat_arrays([_one(slot["row"].slice(0, n)), pa.nulls(len(rest), slot["row"].type)]),
            }
        )

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _ranked(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """state, range-sorted by kind and falling size, as a table with each row's range partition and place in it; and where each partition's ranks begin."""
    ranged = state.repartitionByRange("kind", F.col("size").desc(), F.xxhash64("row", "sequence")).sortWithinPartitions("kind", F.col("size").desc())
    placed = saved(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    counted = placed.groupBy("kind", "part").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")
    return placed, counted.select("kind", "part", (before - F.col("low")).alias("begin"))


def pack(pieces: DataFrame, length: int = LENGTH, slot: int = SLOT) -> DataFrame:
    """pieces with (sequence_id, offset); their length is 1 to ``length``, and their other columns stay. Columns that have those two names are replaced.

    Any number of pieces may be equal: each row gets its own place. An empty table gives an empty result. A piece of no length or one beyond
    ``length`` is an error. Every round is a written table, so slots stay as they were dealt if an executor is lost.
    """
    if not 1 <= slot < 1 << 16:
        raise ValueError("a slot has 1 to 65535 rows")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fits = F.col("length").between(1, length)
    size = F.when(fits, F.col("length")).otherwise(F.raise_error(F.lit("a piece's length must be between 1 and the sequence length"))).cast("long")
    state = pieces.select(
        F.lit(WAITS).alias("kind"),
        size.alias("size"),
        F.lit(0).cast("long").alias("sequence"),
        F.lit(0).cast("long").alias("offset"),
        F.struct(*names).alias("row")
    )
    schema = StructType([StructField(f.name, f.dataType) for f in state.schema])  # a gap has no row
    done: list[DataFrame] = []
    whole, number = False, 0
    while True:
        ranked, begins = _ranked(state)
        n = ranked.count()
        slots = max(1, -(-n // slot))
        # A row for each range partition and kind: as many as Spark makes partitions.
        dealt = ranked.join(F.broadcast(begins), ["kind", "part"]).withColumn("at", F.col("begin") + F.col("place")).withColumn("slot", F.pmod("at", F.lit(slots)))
        swept = dealt.groupBy("slot").applyInArrow(_swept(number, whole or slots == 1, length), schema)
        found = saved(swept)
        done.append(found.filter(F.col("kind") == PLACED))
        now = found.agg(
            F.count_if(F.col("kind") == WAITS).alias("waits"),
            F.count_if(F.col("kind") == PLACED).alias("placed"),
            F.min(F.when(F.col("kind") == WAITS, F.col("size"))).alias("least")
        ).first()
        if not now.waits:
            break
        # A gap below the smallest waiting piece is never taken. Where a round placed little, the next one opens what it needs.
        state = found.filter((F.col("kind") == WAITS) | (F.col("kind") == GAP) & (F.col("size") >= now.least))
        whole, number = 8 * now.placed < now.waits, number + 1
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    return places.select(*[F.col("row")[c].alias(c) for c in names], F.col("sequence").alias("sequence_id"), "offset")


def pack_texts(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """Every document's pieces with their places. path is the tokenizer's place, which every executor must have."""
    return pack(saved(cut(docs, path, length, id_col, text_col, batch)), length)
