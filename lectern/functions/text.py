"""Text columns: names and types of files, white space, markup, sentences and chunks."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it; Java's own class has only the ASCII part.
_SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The second one names ASCII first, which most signs are, so that they need one comparison.
SPACE, INK = f"[{_SPACES}]", f"[!-~[^{_SPACES}]]"
#: The same as characters.
BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

#: Media types by file extension.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "odt": "application/vnd.oasis.opendocument.text",
    "rtf": "application/rtf",
    "epub": "application/epub+zip",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
}

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "mx", "dr", "prof", "sr", "jr", "st", "ave", "blvd", "co",
    "corp", "inc", "ltd", "llc", "plc", "govt", "vs", "etc", "eg", "ie", "cf", "al",
    "pp", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov",
    "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun", "no", "vol", "ed", "eds",
    "trans", "rev",
]
#: Signs that end a sentence, signs that may close behind them, and what may follow an abbreviation's dot.
ENDS, CLOSES, FOLLOWS = ".!?。！？…", "'\"”’)", "A-Z0-9一-鿿぀-ヿ가-힯'\"‘“"


def file_extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.instr(name, ".") == 0, "").otherwise(F.lower(F.substring_index(name, ".", -1)))


def mime_type(extension: Column, fallback: Column) -> Column:
    """The media type of an extension in any case, else the fallback."""
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), fallback)


def trim_ws(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def collapse_ws(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def escape_html(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


#: Characters by named reference as browsers know them: Python's own table. Some names need no semicolon.
REFERENCES = {**{f"{n};": html5[f"{n};"] for n in ("amp", "lt", "gt", "quot", "nbsp", "apos")}, **html5}
BARE = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
#: What browsers make of the numbers 128 to 159: the signs of Windows-1252, where it has one.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9A-Fa-f]++;?|[A-Za-z][A-Za-z0-9]*+;?)"
#: Attributes of a tag; a > in quotes does not end it.
_ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+"""
#: Comments, elements whose content is no text, tags, and what browsers take for comments.
_MARKUP = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style|noscript|template|title)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    rf"|</?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z)|</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)|</[^a-z][^>]*(?:>|\z)"
)


def _character(number: Column) -> Column:
    """The character of a numeric reference: U+FFFD for 0, surrogates and numbers beyond Unicode."""
    windows = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])
    wrong = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(windows, number.cast("int")), plain)


def decode_references(text: Column) -> Column:
    """Character references as browsers read them in text: numbers, names, and the old names without a semicolon before whatever follows."""
    known = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")
    # More digits than Unicode needs are too large a number whatever they are.
    digits = lambda d, most: F.when(F.length(d) > most, F.lit(0x110000)).otherwise

    def one(r: Column) -> Column:
        ten, hexa = F.regexp_extract(r, "^&#0*([0-9]*);?$", 1), F.regexp_extract(r, "^&#[xX]0*([0-9A-Fa-f]*);?$", 1)
        number = F.when(
            r.rlike("^&#[xX]"),
            digits(hexa, 6)(F.coalesce(F.conv(hexa, 16, 10).cast("long"), F.lit(0)))
        ).otherwise(digits(ten, 7)(F.coalesce(ten.try_cast("long"), F.lit(0))))
        bare = F.regexp_extract(r, f"^&({'|'.join(BARE)})", 1)
        named = F.coalesce(F.try_element_at(known, F.substring(r, 2, 99)), F.when(bare != "", F.concat(F.try_element_at(known, bare), F.substr(r, F.length(bare) + F.lit(2)))), r)
        return F.when(r.startswith("&#"), _character(number)).otherwise(named)

    pieces = F.split(text, _REFERENCE, -1)
    signs = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one)
    decoded = F.array_join(F.zip_with(pieces, signs, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return F.when(F.instr(text, "&") > 0, decoded).otherwise(text)


def html_text(html: Column) -> Column:
    """Text of a page as a browser's parser has it: no scripts, styles, noscript parts, templates, title, comments or tags; references decoded; white space collapsed.

    Nothing is put between block elements, and a > in a quoted attribute ends no tag.
    """
    # The array of one text names it, so that the markup is taken out once.
    return F.get(F.transform(F.array(F.regexp_replace(html, _MARKUP, "")), lambda t: collapse_ws(decode_references(t))), F.lit(0))


def rtf_text(rtf: Column) -> Column:
    """Plain text of an RTF document: escapes to characters, par and line to newlines, tab to a tab; other control words and braces go.

    A minus before a character's number is skipped; escaped braces and backslashes lose their character, and the text of
    font tables stays. Two surrogate escapes in a row make one character.
    """
    tokens = F.regexp_extract_all(rtf, F.lit(r"(?:\\u-?[0-9]+\??)+|\\u-(?![0-9])\??|\\'[0-9A-Fa-f]{2}|\\[A-Za-z]*(?:-[0-9]*|[0-9]+)? ?|[{}]|[^\\{}]+"), F.lit(0))

    def units(run: Column) -> Column:
        hexes = F.transform(
            F.regexp_extract_all(run, F.lit(r"u-?([0-9]+)"), F.lit(1)),
            lambda n: F.lpad(F.hex(F.pmod(F.substring(n, -9, 9).cast("long") + F.when(F.length(n) > 9, 0).otherwise(0), F.lit(65536))), 4, "0")
        )
        paired = F.regexp_replace(F.array_join(hexes, " "), r"\b(D[89AB][0-9A-F]{2}) (D[C-F][0-9A-F]{2})\b", "$1$2")
        whole = F.regexp_replace(paired, r"(?<![0-9A-F])D[89A-F][0-9A-F]{2}(?![0-9A-F])", "FFFD")
        return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")

    word = lambda t: F.regexp_extract(t, r"^\\([A-Za-z]*)", 1)
    one = F.transform(
        tokens,
        lambda t: F.when(t.rlike(r"^\\u-?[0-9]"), units(t))
        .when(t.rlike(r"^\\u-"), "")
        .when(t.rlike(r"^\\'"), F.decode(F.unhex(F.substring(t, 3, 2)), "ISO-8859-1"))
        .when(t.startswith("\\"), F.when(word(t).isin("par", "line"), "\n").when(word(t) == "tab", "\t").otherwise(""))
        .when(t.isin("{", "}"), "")
        .otherwise(t),
    )
    steps = [(" {2,}", " "), ("\t +", "\t"), (" +\t", "\t"), ("\n{3,}", "\n\n")]
    return trim_ws(reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.array_join(one, "")))


def doc_text(content: Column) -> Column:
    """Printable runs of UTF-16LE characters in a legacy document, a line each: before a newline of any length, elsewhere of three or more."""
    letters = r"[\x20-\x7e\xa0-\xff]\x00"
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"(?:{letters})+\x0a\x00|(?:{letters}){{3,}}"), F.lit(0))
    clean = F.transform(runs, lambda r: trim_ws(F.replace(r, F.lit("\x00"), F.lit(""))))
    return F.array_join(F.filter(clean, lambda r: r != ""), "\n")


def utf8_text(content: Column) -> Column:
    """Bytes as UTF-8; invalid ones become U+FFFD and a leading byte order mark goes."""
    # By bytes and not by a pattern, which would copy a large file's text several times.
    bare = F.when(F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF")), F.substr(content, F.lit(4))).otherwise(content)
    return F.make_valid_utf8(bare.cast("string"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{INK}+"), F.lit(0))


def _pieces(paragraph: Column) -> Column:
    """A paragraph's sentences: a break after every end sign and after one closing sign behind it."""
    # The dot comes first: abbreviations are looked for before a dot only, and not at every letter.
    guard = rf"\.(?<=(?<![A-Za-z0-9_])(?i:{'|'.join(ABBREVIATIONS)})\.)(?={SPACE}+[{FOLLOWS}])"
    text = F.regexp_replace(trim_ws(paragraph), guard, "\u0001")
    # Two marks without a sign between them make a blank piece, which goes below.
    text = F.regexp_replace(text, f"([{ENDS}])([{CLOSES}])?", "$1\u0002$2\u0002")
    parts = F.transform(F.split(text, "\u0002"), lambda s: trim_ws(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def paragraph_array(text: Column) -> Column:
    """Pieces between blank lines; U+0001 and U+0002 are taken out, as sentences use them as marks."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", ""), f"\n{SPACE}*\n")


def sentence_array(text: Column) -> Column:
    """array<struct<text, words, global_index, paragraph_index>>; a text without a sentence of its own is one, a blank text none."""
    # Each paragraph's sentences with their place, then numbered over the document.
    by_paragraph = F.transform(paragraph_array(text), lambda p, i: F.transform(_pieces(p), lambda s: F.struct(s.alias("text"), i.cast("int").alias("paragraph_index"))))
    flat = F.flatten(by_paragraph)
    whole = trim_ws(F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", ""))
    alone = F.array(F.struct(whole.alias("text"), F.lit(0).alias("paragraph_index")))
    # The array of one array names the sentences, so that they are computed once.
    flat = F.transform(F.array(flat), lambda f: F.when((F.size(f) == 0) & (whole != ""), alone).otherwise(f))
    return F.transform(
        F.get(flat, F.lit(0)),
        lambda s, i: F.struct(
            s["text"].alias("text"),
            words(s["text"]).alias("words"),
            i.cast("int").alias("global_index"),
            s["paragraph_index"].alias("paragraph_index")
        )
    )


def chunk_ranges(lengths: Column, max_chars: int = 300) -> Column:
    """array<struct<first, last>> of sentences by their lengths: a chunk takes sentences while they and the spaces between them fit.

    A sentence longer than a chunk stands alone, and the chunk before it ends there.
    """
    return F.expr(
        f"""aggregate({{0}}, struct(cast(array() as array<struct<first:int,last:int>>) as out, 0 as first, 0 as at, -1 as size),
        (a, n) -> case
            when a.size + 1 + n <= {max_chars} then struct(a.out as out, a.first as first, a.at + 1 as at, cast(a.size + 1 + n as int) as size)
            when n > {max_chars} then struct(concat(if(a.at > a.first, array_append(a.out, struct(a.first as first, a.at - 1 as last)), a.out), array(struct(a.at as first, a.at as last))) as out, a.at + 1 as first, a.at + 1 as at, -1 as size)
            else struct(if(a.at > a.first, array_append(a.out, struct(a.first as first, a.at - 1 as last)), a.out) as out, a.at as first, a.at + 1 as at, cast(n as int) as size) end,
        a -> if(a.at > a.first, array_append(a.out, struct(a.first as first, a.at - 1 as last)), a.out))""".replace("{0}", lengths)
    )


#: Where symbols are put while they are looked up: a plane for private use, in which no text has a meaning.
_PLANE = 0x100000


def symbol_ids(text: Column, vocabulary: dict[str, int]) -> Column:
    """Ids of the UTF-16 units between two boundary signs; unknown ones are 0, so a character beyond the first plane gives two.

    Symbols are translated, by one hashed table for the whole text, to characters whose code point tells the id; ids are below 60,000.
    """
    if any(not 0 <= i < 60_000 for i in vocabulary.values()):
        raise ValueError("ids are from 0 to 59,999")
    single = {s: i for s, i in vocabulary.items() if len(s) == 1 and ord(s) < 0x10000}
    # Characters of the plane itself count as two unknown units, as all others beyond the first plane do.
    wide = F.regexp_replace(F.concat(F.lit("$"), text, F.lit("$")), r"[\x{10000}-\x{10FFFF}]", "\uFFFF\uFFFF")
    known = {k: i for k, i in single.items() if k != "\uFFFF"}
    moved = F.translate(wide, "".join(known), "".join(chr(_PLANE + i) for i in known.values()))
    return F.transform(F.split(moved, ""), lambda c: F.when(F.octet_length(c) == 4, F.ascii(c) - F.lit(_PLANE)).otherwise(F.lit(0)))


def quad_to_bbox(quad: Column) -> Column:
    """struct<x0, y0, x1, y1> around four corners x1, y1, ... x4, y4."""
    side = lambda k: F.filter(quad, lambda _, i: (i % 2 == k) & (i < 8))
    return F.struct(F.array_min(side(0)).alias("x0"), F.array_min(side(1)).alias("y0"), F.array_max(side(0)).alias("x1"), F.array_max(side(1)).alias("y1"))


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + F.lit(0.5))
