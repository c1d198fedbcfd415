"""TIFF media columns: one row a page, with strips or tiles decoded and predictors undone.

The decoder walks the chain of image directories of either byte order, and reads chunky and planar images of 8 or 16
bits a sample that are stored raw, as PackBits, as LZW or as deflate. The encoder writes single-page 8-bit files
in each of these ways, for media that a corpus has to store losslessly.
"""

from __future__ import annotations

import re
import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks

WIDTH = 576
#: TIFF tags, field types and compression schemes.
TAG = {
    "width": 256,
    "height": 257,
    "bits": 258,
    "compression": 259,
    "photometric": 262,
    "strips": 273,
    "samples": 277,
    "rows": 278,
    "strip_bytes": 279,
    "planar": 284,
    "predictor": 317,
    "tile_width": 322,
    "tile_height": 323,
    "tiles": 324,
    "tile_bytes": 325
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.extend(m[1])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _widths(since: np.ndarray) -> np.ndarray:
    """Bits of a code by how many codes came since the last clear code; a code grows one entry early, as TIFF has it."""
    entries = since + 258
    return 9 + (entries >= 512).astype(np.int64) + (entries >= 1024) + (entries >= 2048)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, between a clear code and an end code."""
    codes, table, free, held = [256], {}, 258, -1
    put, known = codes.append, table.get
    for byte in data:
        longer = held << 8 | byte
        if held < 0:
            held = byte
        elif (code := known(longer)) is not None:
            held = code
        else:
            put(held)
            table[longer] = free
            free += 1
            held = byte
            if free == 4095:
                put(256)
                table.clear()
                free = 258
    if held >= 0:
        put(held)
    put(257)
    all_codes = np.array(codes, np.int64)
    clear = np.flatnonzero(all_codes == 256)
    place = np.arange(len(all_codes))
    last = clear[np.searchsorted(clear, place) - 1]  # the clear code before each code; the first one has none
    width = _widths(np.where(place == 0, 0, place - last - 1))
    shift = width[:, None] - 1 - np.arange(12)
    bits = (all_codes[:, None] >> np.maximum(shift, 0)) & 1
    return np.packbits(bits[shift >= 0].astype(np.uint8)).tobytes()


def unlzw(data: bytes) -> bytes:
    """Widths follow from the count of codes since a clear code alone, so whole stretches of codes are cut at once."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, out = base[:], b"", []
    at, since, size = 0, 0, 8 * len(data)
    while True:
        width = _widths(np.maximum(np.arange(since, since + 4096), 0))
        start = at + np.cumsum(width) - width
        fits = int(np.searchsorted(start + width, size, "right"))
        start, width = start[:fits], width[:fits]
        byte = start >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = window >> (24 - (start & 7) - width) & ((1 << width) - 1)
        ends = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(ends[0]) if len(ends) else fits
        for code in codes[:stop].tolist():
            if not last:
                last = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of range")
                table.append(last + entry[:1])
                last = entry
            out.append(last)
        if len(ends) and codes[stop] == 256:
            at, since, table, last = int(start[stop] + width[stop]), 0, base[:], b""
        elif len(ends) or fits < 4096:
            return b"".join(out)
        else:
            at, since = int(start[-1] + width[-1]), since + 4096


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        return data
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == LZW:
        return unlzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} is not read")


def pack(data: bytes, compression: int) -> bytes:
    return {RAW: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def layout(payload: bytes, rows: int) -> dict:
    """How an 8-bit image is stored, by a checksum of its samples: each compression, strips and tiles, with and without a predictor, for images of any size."""
    mark = zlib.crc32(payload)
    compression, mark = (LZW, PACKBITS, DEFLATE)[mark % 3], mark // 3
    predictor, mark = (1 if compression == PACKBITS else 1 + mark % 2), mark // 2
    place = ({"rows": min(64, rows)}, {"rows": min(7, rows)}, {"tile": (192, 16)}, {"tile": (320, 64)})[mark % 4]
    return {"compression": compression, "predictor": predictor, **place}


def encode(payload: bytes, width: int = WIDTH, how: dict | None = None) -> bytes:
    """A little-endian TIFF of one page with 8-bit grey samples; the payload is a positive multiple of width long."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    rows = len(image)
    how = how or layout(payload, rows)
    if "tile" in how:
        w, h = how["tile"]
        padded = np.zeros((-(-rows // h) * h, -(-width // w) * w), np.uint8)
        padded[:rows, :width] = image
        blocks = [padded[y : y + h, x : x + w] for y in range(0, len(padded), h) for x in range(0, padded.shape[1], w)]
    else:
        blocks = [image[y : y + how["rows"]] for y in range(0, rows, how["rows"])]
    if how["predictor"] == 2:
        blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
    data = [pack(b.tobytes(), how["compression"]) for b in blocks]
    starts = np.cumsum([8, *map(len, data)])[:-1].tolist()
    end = 8 + sum(map(len, data))
    body = b"".join(data) + b"\0" * (end % 2)
    end += end % 2
    one = [
        ("width", 4, [width]),
        ("height", 4, [rows]),
        ("bits", 3, [8]),
        ("compression", 3, [how["compression"]]),
        ("photometric", 3, [1]),
        ("samples", 3, [1]),
        ("planar", 3, [1]),
        ("predictor", 3, [how["predictor"]])
    ]
    if "tile" in how:
        one += [("tile_width", 4, [how["tile"][0]]), ("tile_height", 4, [how["tile"][1]]), ("tiles", 4, starts), ("tile_bytes", 4, [len(d) for d in data])]
    else:
        one += [("strips", 4, starts), ("rows", 4, [how["rows"]]), ("strip_bytes", 4, [len(d) for d in data])]
    entries, extra = b"", b""
    after = end + 2 + 12 * len(one) + 4
    for name, kind, values in sorted(one, key=lambda x: TAG[x[0]]):
        raw = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(raw) > 4:
            place, extra = struct.pack("<I", after + len(extra)), extra + raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", TAG[name], kind, len(values)) + place
    return struct.pack("<2sHI", b"II", 42, end) + body + struct.pack("<H", len(one)) + entries + struct.pack("<I", 0) + extra


def directories(media: bytes):
    """The tags of each image directory in the order of the chain, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if not order or struct.unpack(order + "H", media[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", media[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", media, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
            size = SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", media, at + 10 + 12 * i)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind] * count, media, place)
        yield tags, order
        (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)


def page_samples(media: bytes, tags: dict, order: str) -> np.ndarray:
    """Rows x columns x samples of one directory."""
    one = lambda name, default: tags.get(TAG[name], (default,))[0]
    width, height, per, bits = one("width", 0), one("height", 0), one("samples", 1), one("bits", 1)
    compression, planar, predictor = one("compression", 1), one("planar", 1), one("predictor", 1)
    if bits not in (8, 16) or predictor not in (1, 2) or not width or not height:
        raise ValueError(f"{bits} bits a sample with predictor {predictor} are not read")
    kind = np.dtype(f"{order}u{bits // 8}")
    planes, inner = (per, 1) if planar == 2 else (1, per)
    tiled = TAG["tiles"] in tags
    w, h = (one("tile_width", 0), one("tile_height", 0)) if tiled else (width, min(one("rows", height), height))
    starts, sizes = tags[TAG["tiles" if tiled else "strips"]], tags[TAG["tile_bytes" if tiled else "strip_bytes"]]
    across, down = -(-width // w), -(-height // h)
    out = np.zeros((height, width, per), kind.newbyteorder("="))
    for k in range(planes * down * across):
        plane, y, x = k // (down * across), k // across % down * h, k % across * w
        tall = h if tiled else min(h, height - y)
        data = unpack(media[starts[k] : starts[k] + sizes[k]], compression, tall * w * inner * bits // 8)
        block = np.frombuffer(data, kind, tall * w * inner).reshape(tall, w, inner)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        high, wide = min(tall, height - y), min(w, width - x)
        out[y : y + high, x : x + wide, plane * inner : (plane + 1) * inner] = block[:high, :wide]
    return out


def feature(samples: np.ndarray) -> str:
    """Mean sample and a 64-bit gradient hash of 65 equal stretches of the page."""
    flat = samples.reshape(-1).astype(np.float64)
    edges = np.arange(65) * len(flat) // 65
    means = np.add.reduceat(flat, edges) / np.maximum(np.diff(np.append(edges, len(flat))), 1)
    bits = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    return f"mean={flat.mean():.4f};gradient={bits}"


PAGES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("page", pa.int32()),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("compression", pa.int32()),
        ("predictor", pa.int32()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("samples", pa.binary()),
        ("error", pa.string())
    ]
)
PAGES_DDL = "doc_id long, n_bytes long, page int, width int, height int, compression int, predictor int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples binary, error string"


def _pages(with_samples: bool):
    def rows(batches):
        for batch in batches:
            ids, sizes, media_col = batch.columns
            for i in range(batch.num_rows):
                media = media_col[i].as_py()
                head = ids[i].as_py(), sizes[i].as_py()
                if media is None:
                    yield *head, None, *[None] * 11, "no media"
                    continue
                mark = len(media), sha256(media).hexdigest()
                try:
                    for page, (tags, order) in enumerate(directories(media)):
                        samples = page_samples(media, tags, order)
                        raw = samples.tobytes()
                        yield *head, page, samples.shape[1], samples.shape[0], tags.get(TAG["compression"], (1,))[0], tags.get(TAG["predictor"], (1,))[0], len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), *mark, feature(samples), raw if with_samples else None, None
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as wrong:
                    yield *head, None, *[None] * 7, *mark, None, None, f"{type(wrong).__name__}: {wrong}"

    def run(batches):
        yield from chunks(rows(batches), PAGES, 256 if with_samples else 2048)

    return run


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str | None = None, samples: bool = True) -> DataFrame:
    """One row a page of each file: geometry, digests, a feature and (if asked) the samples.

    A null file, or one that cannot be read, gives a row with a null page and the reason in error, after the pages
    that could be read; nothing fails. Other columns are not read.
    """
    size = F.col(size_col).cast("long") if size_col else F.lit(None).cast("long")
    return df.select(F.col(id_col).cast("long"), size, F.col(media_col)).mapInArrow(_pages(samples), PAGES_DDL)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches):
    def rows():
        for batch in batches:
            ids, texts = batch.columns
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode("utf-8")
                yield ids[i].as_py(), len(raw), encode(raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH))

    yield from chunks(rows(), MEDIA, 512)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as the 8-bit samples of a TIFF page, padded with 255 to whole rows of 576. Null is the empty text, which gives one row of padding."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_store, "doc_id long, n_bytes long, media binary")
