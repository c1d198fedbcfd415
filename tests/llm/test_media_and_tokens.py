import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import bpe, packing, pages, tiff
from tests.llm.conftest import frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def texts(words):
    r = random.Random(3)
    some = [prose(words, k, k * 7) for k in range(12)] + ["".join(r.choice("abcde éß\n'st.,0129😀　") for _ in range(r.randint(0, 300))) for _ in range(60)]
    return [*some, None, "", " \n\n ", "a" * 9000, "ab" * 700, "<|endoftext|> x", "I'll don't ½ \x1c x\x1fy", prose(words, 5, 20000)]


def test_tiff_round_trip(spark, words):
    rows = texts(words)
    media = tiff.store_texts(frame(spark, rows)).cache()
    raw = {r.doc_id: bytes(r.media) for r in media.collect()}
    got = {r.doc_id: r for r in tiff.tiff_pages(media, size_col="n_bytes").collect()}
    kinds = set()
    for i, t in enumerate(rows):
        body = (t or "").encode()
        payload = body + b"\xff" * (-len(body) % 576 if body else 576)
        r = got[i]
        assert r.error is None and bytes(r.samples) == payload and r.n_bytes == len(body) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(raw[i]) and r.media_sha256 == hashlib.sha256(raw[i]).hexdigest()
        kinds.add((r.compression, r.predictor))
    assert kinds == {(tiff.LZW, 1), (tiff.LZW, 2), (tiff.PACKBITS, 1), (tiff.DEFLATE, 1), (tiff.DEFLATE, 2)}


def slow_lzw(data):
    """The codec by its definition, a code and a bit string at a time."""
    table, bits, width, held = {bytes([i]): i for i in range(256)}, format(256, "09b"), 9, b""
    for i in range(len(data)):
        byte = data[i : i + 1]
        if held + byte in table:
            held += byte
            continue
        bits += format(table[held], f"0{width}b")
        table[held + byte] = len(table) + 2
        if len(table) + 2 == 4095:
            bits += format(256, "012b")
            table, width = {bytes([j]): j for j in range(256)}, 9
        else:
            width = (len(table) + 2).bit_length()
        held = byte
    if held:
        bits += format(table[held], f"0{width}b")
        width = min(12, (len(table) + 3).bit_length())
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("n,alphabet", [(0, 1), (1, 1), (300, 256), (511, 256), (6000, 256), (40_000, 3), (9000, 90), (3838, 256), (3839, 256)])
def test_lzw(n, alphabet):
    r = random.Random(n)
    data = bytes(r.randrange(alphabet) for _ in range(n))
    assert tiff.lzw(data) == slow_lzw(data) and tiff.unlzw(tiff.lzw(data)) == data
    assert data.startswith(tiff.unlzw(tiff.lzw(data)[:-2]))


@pytest.mark.parametrize(
    "how",
    [
        {"compression": c, "predictor": p, **part} for c in (1, 5, 8, 32773) for p in (1, 2) for part in (
            {"rows": 7},
            {"rows": 500},
            {"tile": (192, 16)},
            {"tile": (640, 32)}
        )
    ]
)
def test_tiff_layouts(how):
    r = random.Random(1)
    payload = bytes(r.choice(b"eta oin\xff\xff\xff") for _ in range(33 * 576))
    media = tiff.encode(payload, how=how)
    ((tags, order),) = tiff.directories(media)
    assert tiff.page_samples(media, tags, order).tobytes() == payload


def test_tiff_pages_and_faults(spark):
    # Two pages in big-endian order: RGB with a predictor in two planes' worth of chunks, and 16 bits a sample.
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    deep = np.array([[1, 500, 65535]], np.uint16)
    data = zlib.compress(np.diff(rgb, axis=1, prepend=np.zeros((2, 1, 3), np.uint8)).astype(np.uint8).tobytes()), deep.astype(">u2").tobytes()

    def directory(at, nxt, w, h, bits, per, compression, predictor, start, size):
        tags = [(256, 3, w), (257, 3, h), (258, 3, bits), (259, 3, compression), (273, 4, start), (277, 3, per), (278, 3, h), (279, 4, size), (317, 3, predictor)]
        return struct.pack(">H", len(tags)) + b"".join(
            struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags
        ) + struct.pack(">I", nxt)

    size = 2 + 9 * 12 + 4
    first = 8 + len(data[0]) + len(data[1])
    media = struct.pack(">2sHI", b"MM", 42, first) + data[0] + data[1] + directory(first, first + size, 3, 2, 8, 3, 8, 2, 8, len(data[0])) + directory(
        first + size,
        0,
        3,
        1,
        16,
        1,
        1,
        1,
        8 + len(data[0]),
        len(data[1])
    )
    loop = media[: first + size - 4] + struct.pack(">I", first) + media[first + size :]
    df = spark.createDataFrame([(1, media), (2, None), (3, b"nope"), (4, loop), (5, media[:-3])], "doc_id long, media binary")
    got = defaultdict(list)
    for r in tiff.tiff_pages(df).collect():
        got[r.doc_id].append(r)
    assert [(r.page, r.width, r.height, bytes(r.samples)) for r in got[1]] == [(0, 3, 2, rgb.tobytes()), (1, 3, 1, deep.tobytes())]
    assert got[2][0].error == "no media" and "not a TIFF" in got[3][0].error
    assert got[4][0].page == 0 and "loop" in got[4][1].error and got[5][-1].error
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_bpe(spark, words):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts(words)
    encoded = bpe.encode_texts(frame(spark, rows), BYTES, public_tokenizers.PATTERN).cache()
    got = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(rows):
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(got[i].ids) == ids and got[i].n_tokens == len(ids) // 4 and got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.content).decode() for r in bpe.decode_ids(encoded, BYTES).collect()}
    assert back == {i: t or "" for i, t in enumerate(rows)}
    assert bpe.encode_texts(frame(spark, []), BYTES, public_tokenizers.PATTERN).count() == 0


def test_plain_words_skip_the_steps_before_the_model():
    """Small letters and signs go to the tokenizer's model alone; each word's ids are those of the whole tokenizer, in any order of words."""
    seen, words = [], packing.Words(WORDS)
    whole = words.tokenizer

    class Counting:
        def encode(self, given, **options):
            seen.extend(given)
            return whole.encode(given, **options)

    words.tokenizer = Counting()
    rng = random.Random(5)
    letters, signs = "abcdefghijklmnopqrstuvwxyzßàéîöøûÿ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    some = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(400)]
    plain = [*some, *(w + "".join(rng.choices(signs, k=rng.randrange(1, 4))) for w in some), "dogs'", "s'"]
    other = ["don't", "it's.", "<|endoftext|>", "a1", "12", "\u00c9t\u00e9", "e\u0301", "x<\u0338", "stra\u00dfe\u00d7", "\u0130", "'s", "...", "\u00aa", "a\u00b7b", "\u0141\u00f3d\u017a"]
    texts = [" ".join(rng.sample(plain + other, 60)) for _ in range(40)] + plain + other + [""]
    for part in (texts[:20], texts[20:]):
        ids, bounds = words.encode(pa.array(part))
        for k, text in enumerate(part):
            want = [i for w in text.split() for i in whole.encode(w, add_special_tokens=False).ids]
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want == whole.encode(text, add_special_tokens=False).ids
    assert seen and not set(seen) & set(plain)


def test_packing(spark, words):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rows = texts(words) + [prose(words, 1, 40)] * 300
    got = defaultdict(list)
    places = defaultdict(list)
    for r in packing.pack_texts(frame(spark, rows), WORDS).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in enumerate(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 2048
    assert len(places) <= total / 2048 * 1.05 + 1
    assert packing.pack_texts(frame(spark, []), WORDS).count() == 0


def best_fit(sizes, length):
    """Best-fit decreasing by its definition: how full each sequence is, in the order in which they were opened."""
    full = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, used in enumerate(full) if used + size <= length]
        if fits:
            full[max(fits, key=lambda k: full[k])] += size
        else:
            full.append(size)
    return full


@pytest.mark.parametrize("seed", range(5))
def test_sweep_is_best_fit(seed):
    r = random.Random(seed)
    sizes = sorted((min(64, int(r.expovariate(1 / 15)) + 1) for _ in range(500)), reverse=True)
    places, gaps, opened = packing.sweep(sizes, [], None, 64)
    want = best_fit(sizes, 64)
    assert opened == len(want) and sorted(64 - n for n in want if n < 64) == [s for _, s in gaps]
    used = defaultdict(list)
    for (sequence, offset), size in zip(places, sizes):
        used[sequence].append((offset, size))
    assert sorted(sum(s for _, s in held) for held in used.values()) == sorted(want)
    for held in used.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 64


def test_sweep_bounds():
    """Given gaps are taken by the first in rank; what would open more than its share waits, long pieces excepted."""
    places, gaps, opened = packing.sweep([40, 30, 30, 20, 5], [(7, 30), (8, 31)], 0, 64)
    assert places == [(-1, 0), (7, 34), (8, 33), (-1, 40), None]
    assert opened == 1 and packing.sweep([20, 20], [], 0, 64)[0] == [None, None]
    assert packing.sweep([], [(3, 9)], None, 64) == ([], [(3, 9)], 0)


@pytest.mark.parametrize("slot", [7, 40, 8192])
def test_pack_rounds(spark, slot):
    """Many slots and rounds: every row gets a place of its own, and few more sequences are opened than one best-fit over all opens."""
    r = random.Random(slot)
    sizes = [r.choice([3, 3, 3, 64, 33, 22, r.randint(1, 64)]) for _ in range(600)]
    rows = [(k // 2, 0, n, "s", "r", 5) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, size string, row string, sequence_id int")
    out = packing.pack(df, 64, slot)
    assert out.columns == ["doc_id", "piece", "length", "size", "row", "sequence_id", "offset"]
    used, seen = defaultdict(list), []
    for x in out.collect():
        used[x.sequence_id].append((x.offset, x.length))
        seen.append((x.doc_id, x.length, x.size, x.row))
    assert sorted(seen) == sorted((k // 2, n, "s", "r") for k, n in enumerate(sizes))
    for held in used.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 64
    one = len(best_fit(sizes, 64))
    assert len(used) <= {7: 1.25 * one, 40: 1.05 * one, 8192: one}[slot]  # slots this small cannot mix sizes well
    with pytest.raises(Exception, match="length must be between"):
        packing.pack(df.withColumn("length", df.length + 64), 64).count()


def test_pages(spark):
    body = "<article><h1>T &amp; U</h1><p><b>One   two three four.<br><p>Five &lt;six&gt;\nseven<aside>buy now</aside> eight</p></article>"
    around = '<html><head><title>no</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="ad">advert</div>{}<div id="comments"><p>first!</p></div><footer>&copy; x'
    want = "T & U\nOne two three four.\nFive <six> seven\neight"
    rows = [(k, "u", around.replace("{}", body, 1)) for k in range(20)] + [
        (50, "v", None),
        (51, None, ""),
        (52, "w", "<div><p>plain text</p></div>"),
        (53, "x", "<" * 3000),
        (54, "y", "<div>" * 3000 + "deep")
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = pages.fit(df)
    got = {r.page_id: r for r in pages.main_text(df, weights).collect()}
    assert all(got[k].text == want and got[k].n_chars == len(want) for k in range(20))
    assert got[50].text == got[51].text == "" and got[52].text == "plain text" and got[54].text == "deep"
    assert pages.main_text(df.limit(0), pages.fit(df.limit(0))).count() == 0


def test_best_region():
    r = random.Random(2)
    for _ in range(60):
        x = [r.choice([-2, -1, -0.5, 0, 1, 1.5]) for _ in range(r.randint(0, 14))]
        spans = [(sum(x[a:b]), -a, -b, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
        a, b = pages.best_region(x)
        assert sum(x[a:b]) == max([s[0] for s in spans if s[0] > 0], default=0)


LONG = " ".join(f"word{k}" for k in range(60))
MORE = " ".join(f"other{k}" for k in range(400))
LINKS = "".join(f"<li><a href=x>Link {k} here</a></li>" for k in range(60))
#: Pages unlike the ones that are learnt from, and their text by hand.
VARIANTS = [
    (
        f"<article><h1>Title</h1><p>First {LONG}.</p><aside><p>{LONG}</p><ul>" + "<li><a href=x>buy</a></li>" * 80 + f"</ul></aside><p>Last {LONG}.</p></article>",
        f"Title\nFirst {LONG}.\nLast {LONG}.",
    ),
    (
        f"<article><h1>Title</h1><p>Before the list.</p><ul>{LINKS}</ul><p>After it.</p></article><footer>f</footer>",
        "Title\nBefore the list.\n" + "\n".join(f"Link {k} here" for k in range(60)) + "\nAfter it.",
    ),
    (
        f'<nav>menu</nav><article><p>{LONG}</p><p class="market share">The share grew.</p><p class="share-buttons">Tell a friend</p><p>{LONG}</p></article>',
        f"{LONG}\nThe share grew.\n{LONG}",
    ),
    (
        f'<div class="cookie-notice">We use cookies</div><div id="content"><h2>Head</h2><p>{LONG}</p><p>More.</p></div><div class="comments"><p>first! {LONG}</p></div><footer>x</footer>',
        f"Head\n{LONG}\nMore.",
    ),
    (
        f"<header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>{LONG}</p><table><tr><td>a</td><td>b</td></tr></table><form>q</form></main>",
        f"Head\n{LONG}\na\nb",
    ),
    (f'<article><p>{LONG}</p><article class="comment"><p>nonsense {LONG}</p></article><p>end</p></article>', f"{LONG}\nend"),
    # Classes that hold a marked word among others.
    (
        f'<article><h1>Shares</h1><section class="share-price-history"><p>One {LONG}</p><p>Two</p></section><div class="job-search-guide"><p>Three</p><p>Four {LONG}</p></div></article>',
        f"Shares\nOne {LONG}\nTwo\nThree\nFour {LONG}",
    ),
    (f'<article><p>{LONG}</p><div class="td-related-wrap-x"><h4>Related</h4><ul>{LINKS}</ul></div><p>end</p></article>', f"{LONG}\nend"),
    # An article's own header, with and without an article element; a page's header.
    (f'<div class="post"><header><h1>Head</h1><p>By one</p></header><p>{LONG}</p></div><footer>x</footer>', f"Head\nBy one\n{LONG}"),
    (f'<div class="a"><header class="entry-header"><h1>Head</h1></header><div class="b"><p>{LONG}</p></div><footer>tags</footer></div>', f"Head\n{LONG}"),
    (f'<div id="page"><header class="top"><h1>Site</h1></header><nav>menu</nav><div><h2>Head</h2><p>{LONG}</p></div><footer>x</footer></div>', f"Head\n{LONG}"),
    # Formulas stand in their line.
    (
        f"<article><p>{LONG}</p><p>Let <math><mi>x</mi></math> be a number, <math><mrow><mi>y</mi><mo>=</mo><mn>2</mn></mrow></math>.</p></article>",
        f"{LONG}\nLet x be a number, y=2."
    ),
    # Sidebars that no class marks: prose beside an article, links where nothing is labelled.
    (f"<div><div><h3>About us</h3><p>{MORE}</p></div><article><h1>Head</h1><p>{LONG}</p></article><div><p>{MORE}</p></div></div>", f"Head\n{LONG}"),
    (f"<div><ul>{LINKS}</ul></div><div><h1>Head</h1><p>{LONG}</p><p>end</p></div><div><h3>More</h3><ul>{LINKS}</ul></div>", f"Head\n{LONG}\nend"),
    (f"<main><article><h1>Head</h1><p>{LONG}</p></article><div><h3>Also</h3><p>{MORE}</p></div></main>", f"Head\n{LONG}"),
    # Text in bare boxes with line breaks; a form around the whole page; a list of articles in a main element.
    (f'<div class="nav">menu</div><div>{LONG}<br>Second line {LONG}<br><br>Third</div>', f"{LONG} Second line {LONG} Third"),
    (f'<form id="aspnet"><nav>menu</nav><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><form><label>Name</label><input></form></form>', f"Head\n{LONG}\n{LONG}"),
    (f"<main><article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article></main>", f"One\n{LONG}\nTwo\n{LONG}"),
    # Attributes that break simple patterns, upper case, references, comments.
    (
        f'<ARTICLE><H1 title="a > b">A &lt; B &amp;amp; C</H1><!-- <p>no</p> --><P data-x=\'">\'>{LONG}<P>caf&eacute;&#33;<script>if (a < b) x("</p>")</script></ARTICLE>',
        f"A < B &amp; C\n{LONG}\ncafé!"
    ),
    (f'<article><p>{LONG}</p><div hidden><p>no</p></div><div style="display: none">no</div><div aria-hidden="true">no</div><pre>a\n  b</pre></article>', f"{LONG}\na b"),
]


def fitted(spark):
    around = (
        '<html><body><nav><a href="/">menu</a></nav><div class="ad">{0} advert</div><div class="teaserbox">{0} one more thing</div>'
        '<article><h1>T</h1><p>{0}</p><div class="body"><p>{0}</p></div></article><footer>x</footer>'
    )
    known = [(k, "u", around.replace("{0}", " ".join(f"w{k}x{i}" for i in range(12)))) for k in range(40)]
    return pages.fit(spark.createDataFrame(known, "page_id long, url string, html string"))


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    same = sum((a & b).values())
    return 2 * same / max(1, sum(a.values()) + sum(b.values()))


def test_page_variants(spark):
    weights = fitted(spark)
    assert ".teaserbox" in weights and ".body" not in weights
    rows = [(k, "u", f"<html><body>{h}</body></html>") for k, (h, _) in enumerate(VARIANTS)]
    rows += [(99, "u", f'<div><p>{LONG}</p><div class="teaserbox">x y z</div><p>end</p></div>')]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), weights).collect()}
    wrong = {k: (got[k], want) for k, (_, want) in enumerate(VARIANTS) if got[k] != want}
    assert not wrong, wrong
    assert min(f1(got[k], want) for k, (_, want) in enumerate(VARIANTS)) == 1.0
    assert got[99] == f"{LONG}\nend"


def built(r):
    """A random page and its text: article blocks of known kinds within furniture of known kinds."""
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    linked = lambda: "".join(f"<li><a href='/{word()}'>{some(1, 3)}</a></li>" for _ in range(r.randint(2, 9)))

    def furniture():
        return r.choice(
            [
                lambda: f"<nav><ul>{linked()}</ul></nav>",
                lambda: f"<aside><h4>{some(1, 3)}</h4><p>{some(3, 30)}</p></aside>",
                lambda: f'<div class="{r.choice(["ad", "ad-slot", "cookie-banner", "sidebar", "comment-list", "share-buttons"])}"><p>{some(2, 40)}</p></div>',
                lambda: f"<form><label>{word()}</label><button>{word()}</button></form>",
                lambda: f"<script>var p = '<p>{some(2, 9)}</p>';</script><style>p{{}}</style>",
                lambda: f"<!-- <p>{some(2, 9)}</p> -->",
            ]
        )()

    def block():
        text = some(1, 40)
        return r.choice(
            [
                lambda: (f"<p>{text}</p>", [text]),
                lambda: (f"<p>{text}", [text]),
                lambda: (f"<h2>{text}</h2>", [text]),
                lambda: (f"<blockquote><p>{text}</p></blockquote>", [text]),
                lambda: (f"<p>{text} <a href='/'>{word()}</a> <b>x</b>y<br>z</p>", [f"{text} {{}} xy z"]),
                lambda: (f"<ul><li>{text}<li>q</ul>", [text, "q"]),
                lambda: (f"<div class='job-search-guide'><p>{text}</p></div>", [text]),
                lambda: (f"<p>a &amp; b &lt;{text}&gt;</p>", [f"a & b <{text}>"]),
            ]
        )()

    html, want = [], []
    for _ in range(r.randint(1, 8)):
        if r.random() < 0.3:
            html.append(furniture())
        part, lines = block()
        if "{}" in lines[0]:
            lines = [lines[0].format(part.split("'/'>")[1].split("<")[0])]
        html.append(part)
        want += lines
    tag = r.choice(["article", "main"])
    before, after = ("".join(furniture() for _ in range(r.randint(0, 3))) for _ in range(2))
    return f"<html><body>{before}<{tag}>{''.join(html)}</{tag}>{after}<footer>{some(1, 20)}</footer></body></html>", "\n".join(want)


def test_built_pages(spark):
    """Whole pages against the text that they were built from."""
    weights = fitted(spark)
    r = random.Random(17)
    for _ in range(400):
        page, want = built(r)
        assert pages.extract(page, weights) == want, page


def test_the_region_is_the_best_of_all(spark):
    """The text of a page without labels is that of the best contiguous run of its pieces, by trying all of them."""
    weights, r = fitted(spark), random.Random(5)
    for _ in range(150):
        page = built(r)[0].replace("article>", "div>").replace("main>", "div>")
        elements, events = pages.parsed(page)
        assert pages.judged(elements) is None
        pieces = [(k, t, f) for k, t, f, _ in pages.runs(events, False) if k != "out"]
        score = lambda k, t, f: min(weights.get(f[0], -pages.TAG_COST), -pages.TAG_COST) if k == "tag" else len(t.split()) * pages.word_score(f, weights)
        sums = [0.0]
        for p in pieces:
            sums.append(sums[-1] + score(*p))
        best = max((sums[b] - sums[a], -a, -b) for a in range(len(sums)) for b in range(a, len(sums)))
        a, b = pages.best_region([score(*p) for p in pieces])
        assert abs((sums[b] - sums[a]) - best[0]) < 1e-9
        words = "".join(t if k == "text" else "\n" for k, t, _ in pieces[a:b])
        assert pages.extract(page, weights).split() == html_words(words)


def html_words(text):
    import html

    return html.unescape(text).split()
