"""Byte-level BPE: ids as a tiktoken rank file gives them, and back to bytes.

A task splits its texts by the pattern and looks every piece up among those it has already encoded. New pieces are
gathered and merged together: pieces of like length fill a padded matrix of token ids, and in each round every row
merges its leftmost pair of the lowest rank. A pair's rank is found in an open hash table of sorted numpy arrays; rows
without a pair left are written out and the matrix is compacted.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks

#: Pieces longer than this are merged one by one with a heap: a matrix round costs its whole width.
MATRIX_MAX = 64
#: Pieces that a worker remembers; beyond it, it forgets all and goes on.
REMEMBERED = 400_000
_NONE = np.int64(1) << 40


class Ranks:
    """A rank file's vocabulary: bytes by id, and pairs of ids with the id that they merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        keys, to = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    to.append(rank)
        self._hashed(np.array(keys, np.int64), np.array(to, np.int64))
        self.known: dict[str, bytes] = {}

    def _hashed(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Open addressing with linear steps; the table is at most a quarter full."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.slots, self.merged = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.steps = 0
        while len(left):
            free = self.slots[at] < 0
            place, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.slots[place], self.merged[place] = keys[put], to[put]
            rest = self.slots[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & (size - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or a number above all ids."""
        keys = a << 20 | b
        at = self._slot(keys)
        out = np.full(keys.shape, _NONE, np.int64)
        seek = np.arange(keys.size)
        keys, at, flat = keys.reshape(-1), at.reshape(-1), out.reshape(-1)
        mask = len(self.slots) - 1
        for _ in range(self.steps):
            held = self.slots[at]
            hit = held == keys
            flat[seek[hit]] = self.merged[at[hit]]
            go = ~hit & (held >= 0)
            if not go.any():
                break
            seek, keys, at = seek[go], keys[go], (at[go] + 1) & mask
        return out

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of rows of at most width bytes, merged side by side."""
        lengths = np.array([len(r) for r in rows])
        ids = np.full((len(rows), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((len(rows), width), _NONE, np.int64)
        pairs = np.arange(width - 1) < lengths[:, None] - 1
        ranks[:, :-1][pairs] = self.pair_ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        out: list = [None] * len(rows)
        which = np.arange(len(rows))
        column = np.arange(width)
        while True:
            best = ranks.argmin(axis=1)  # the first of equals, so the leftmost
            lowest = ranks[np.arange(len(ids)), best]
            done = lowest >= _NONE
            if done.any():
                for row, n, k in zip(ids[done], lengths[done], which[done]):
                    out[k] = row[:n].copy()
                live = ~done
                ids, ranks, lengths, which, best, lowest = ids[live], ranks[live], lengths[live], which[live], best[live], lowest[live]
                if not len(ids):
                    return out
                wide = int(lengths.max())
                if wide < ids.shape[1]:
                    ids, ranks, column = ids[:, :wide], ranks[:, :wide], column[:wide]
            n = np.arange(len(ids))
            ids[n, best] = lowest
            # Close the gap behind each merged pair.
            source = np.minimum(column + (column > best[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            lengths = lengths - 1
            ids[column >= lengths[:, None]] = -1
            ranks[column >= lengths[:, None] - 1] = _NONE
            for at in (best, best - 1):
                ok = (at >= 0) & (at + 1 < lengths)
                ranks[n[ok], at[ok]] = self.pair_ranks(ids[n[ok], at[ok]], ids[n[ok], at[ok] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = [int(x) for x in self.byte_id[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        text = self.bytes

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(text[ids[i]] + text[ids[j]]) if j < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def learn(self, pieces) -> None:
        """Encode pieces that are not remembered yet, a matrix for each band of lengths."""
        bands: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_MAX:
                self.known[piece] = self._long(raw).astype("<u4").tobytes()
            else:
                bands.setdefault(4 * -(-len(raw) // 4), []).append((piece, raw))
        for width, band in bands.items():
            for i in range(0, len(band), 8192):
                part = band[i : i + 8192]
                for (piece, _), ids in zip(part, self._matrix([raw for _, raw in part], width)):
                    self.known[piece] = ids.astype("<u4").tobytes()

    def encode(self, split: list[list[str]]) -> list[bytes]:
        """Little-endian 32-bit ids of each list of pieces."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        self.learn(new.difference(self.known))
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        text = self.bytes
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def ranks_at(path: str) -> Ranks:
    """One vocabulary a worker process."""
    return Ranks(path)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encode(path: str, pattern: str, with_ids: bool):
    def run(batches):
        ranks, split = ranks_at(path), splitter(pattern)

        def rows():
            for batch in batches:
                doc_ids, texts = batch.columns
                at = 0
                while at < batch.num_rows:  # a few MB of text at a time
                    part, held, size = [], [], 0
                    while at < batch.num_rows and size < 4_000_000 and len(part) < 1024:
                        text = texts[at].as_py() or ""
                        part.append(split(text))
                        held.append(doc_ids[at].as_py())
                        size += len(text)
                        at += 1
                    for doc_id, ids in zip(held, ranks.encode(part)):
                        yield doc_id, len(ids) // 4, ids if with_ids else None, sha256(ids).hexdigest(), sha256(ranks.decode(ids)).hexdigest()

        yield from chunks(rows(), ENCODED, 256 if with_ids else 2048)

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each whole text; ids are little-endian 32-bit numbers.

    No special token is recognised or added. Null and the empty text have no ids. path is the rank file's place, which
    every executor must have. Repeated rows are encoded each; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_encode(path, pattern, ids), schema)


DECODED = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, content): the bytes of each row's ids. A null stays null; an id outside the vocabulary is an error."""

    def run(batches):
        ranks = ranks_at(path)
        yield from chunks(((i.as_py(), None if x.as_py() is None else ranks.decode(x.as_py())) for b in batches for i, x in zip(*b.columns)), DECODED, 256)

    return df.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, content binary")
