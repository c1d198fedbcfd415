"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Lines of equal sets are one class, of which the first line stands for all; so a line that
many documents share is one member of whatever follows. The words of a class are ordered by rarity, and two sets of similarity 0.75 share a word among
the first n - ceil(0.75 n) + 1 of each. Classes meet by such a word; length, position and a summary of the words in 64 bits, or 128 and 256
for longer lines, rule out pairs that cannot reach the threshold, and the rest are verified on the whole lines. A line goes if it is
similar to an earlier one, by document id and then by place.

The classes that share a word are a list, from one shuffle. All pairs of a list up to ``WHOLE`` members are looked at; in a longer one, each member meets
the earliest one and its ``NEIGHBOURS`` predecessors. A word that occurs more than ``LIST`` times has its list dealt into parts.
What is not removed then meets the rest of its longer or dealt lists, by bands of size. So no list of near copies is paired with itself.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, saved, small

#: Similarity in hundredths.
PERCENT = 75
#: Counters by which words are ranked; the table of their ranks has a byte each, whatever the corpus.
COUNTERS = 1 << 18
#: Steps of a rank for each doubling of a counter.
STEPS = 4
#: Members up to which all pairs of a list are looked at, predecessors that a member of a longer one meets, and occurrences of a word from which its list is dealt.
WHOLE, NEIGHBOURS, LIST = 128, 24, 131072
#: Words from which a line has 128 and 256 bits of summary.
LONG = (64, 192)
#: Bits of a word's number, below its rank.
RANK = 56
#: Rows up to which copies may be broadcast; their bytes decide before.
MANY = 1 << 20
#: The writer's options for words: groups of 16 MB, each with a dictionary of up to 6 MB.
DICTIONARY = {"parquet.block.size": 16 << 20, "parquet.dictionary.page.size": 6 << 20}
#: What a line is known by, in the order of lines: the document, a number of its text if several rows have its id, the place.
LINE = ["doc_id", "text_key", "line_no"]
BITS = ["b1", "b2", "b3", "b4"]
_WORDS = r"array_distinct(filter(split(line, '[\\x20\\x09-\\x0D]+'), w -> w <> ''))"


def _differ(x: str, y: str) -> str:
    """SQL for the least number of words that one of x and y has and the other lacks, by their summaries; that of a long line is folded for a shorter one."""
    all_, half = " + ".join(f"bit_count({x}{b} ^ {y}{b})" for b in BITS), " + ".join(f"bit_count({x}{a} ^ {x}{b} ^ {y}{a} ^ {y}{b})" for a, b in (("b1", "b3"), ("b2", "b4")))
    one = f"bit_count({' ^ '.join(r + b for r in (x, y) for b in BITS)})"
    least = f"least({x}np, {y}np)"
    return f"(case when {least} < {LONG[0] << 32}L then {one} when {least} < {LONG[1] << 32}L then {half} else {all_} end)"


def _bounds(x: str, y: str) -> str:
    """SQL for whether two rows of one list may reach the threshold: by size, by place in the order, by the words' summaries.

    The place is that of the first word that both have, by which each pair is met. Of the words of both, at most 25 of 175 differ, in whole numbers of common words.
    """
    (xn, xp), (yn, yp) = [(f"shiftright({r}np, 32)", f"({r}np & {(1 << 32) - 1}L)") for r in (x, y)]
    both, all_ = f"least({xn} - {xp}, {yn} - {yp})", f"({xn} + {yn})"
    least, most = PERCENT, 100 + PERCENT
    return f"""{yn} * 100 >= {PERCENT} * {xn} and {xn} * 100 >= {PERCENT} * {yn} and {both} * {most} >= {least} * {all_}
        and ({all_} - {_differ(x, y)}) * {most} >= {2 * least} * {all_}"""


def _earlier(x: str, y: str) -> str:
    """SQL for whether x comes before y in the order of lines."""
    a, b, c = [(x + name, y + name) for name in LINE]
    return f"({a[0]} < {a[1]} or {a[0]} = {a[1]} and ({b[0]} < {b[1]} or {b[0]} = {b[1]} and {c[0]} < {c[1]}))"


def _repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """The ids that several rows have, as a written table; none if there are none."""
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    ids = saved(ids.filter("rows > 1"))
    return None if ids.isEmpty() else ids


def _documents(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame | None) -> DataFrame:
    """(doc_id, text_key, text); text_key is 0 but for ids that several rows have."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ids is None:
        return texts.select("doc_id", F.lit(0).cast("long").alias("text_key"), "text")
    key = F.when(F.col("rows").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return texts.join(small(ids), "doc_id", "left").select("doc_id", key.alias("text_key"), "text")


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line) of documents with an id."""
    return documents.filter("doc_id is not null").select("doc_id", "text_key", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))


def _lower(line: Column) -> Column:
    """line with A-Z in lower case and nothing else changed; the slow way is for other letters or signs that may have a lower case."""
    plain = (F.octet_length(line) == F.length(line)) | ~line.rlike(r"[^\x00-\xBF\xDF-\xFF]") | ~line.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Nd}\p{Zs}]")
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _parts(lines: DataFrame) -> DataFrame:
    """lines with parts in place of line: its words with A-Z in lower case, and empty ones; one fixed character parts them."""
    others = "\t\n\x0b\f\r"
    spaced = F.when(reduce(or_, [F.contains("line", F.lit(c)) for c in others]), F.translate("line", others, " " * 5)).otherwise(F.col("line"))
    return lines.withColumn("line", spaced).select(*LINE, F.split(_lower(F.col("line")), " ").alias("parts"))


def _sets(documents: DataFrame) -> DataFrame:
    """A written row for each line that has words: its place, 128 bits of its set's digest, and the set, of words as 64-bit numbers.

    Most words are frequent ones, so a file's dictionary holds them and a word takes half its 8 bytes; that needs one larger than usual.
    """
    numbers = F.array_distinct(F.transform("parts", lambda w: F.xxhash64(w)))
    sets = _parts(lines_of(documents)).select(*LINE, F.sort_array(F.array_remove(numbers, F.xxhash64(F.lit("")))).alias("words"))
    keys = [F.xxhash64("words").alias("k1"), F.xxhash64("words", F.lit("again")).alias("k2")]
    return saved(sets.select(*LINE, *keys, "words"), **DICTIONARY).filter("size(words) > 0")


def _rarity(sets: DataFrame) -> bytes:
    """A byte for each counter: STEPS times the logarithm of how many words fell to it, rounded down."""
    words = sets.select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("k")).agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(COUNTERS, "u1")
    table[counts["k"].to_numpy()] = STEPS * np.log2(counts["n"].to_numpy() + 1)
    return table.tobytes()


def _ranked(sets: DataFrame, table: bytes) -> DataFrame:
    """(LINE, np, BITS, prefix): the set's size n and, in one number with it, room for a place in its order; its summary, and its prefix.

    A word is its rank and 56 bits of its number here: what two words share only adds pairs to verify.
    """
    ranks = F.lit(table)

    def ranked(h):
        rank = F.ascii(F.substring(ranks, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int") + 1, F.lit(1)).cast("string")).cast("long")
        return F.shiftleft(rank, RANK).bitwiseOR(F.shiftrightunsigned(h, 64 - RANK))

    words = sets.select(*LINE, F.size("words").alias("n"), F.sort_array(F.transform("words", ranked)).alias("words"))

    def bits(i: int):
        """64 bits, each of which tells whether an odd number of words fell to it; of longer lines, those words alone that have these flags."""
        flags = f"case when n >= {LONG[1]} then 192 when n >= {LONG[0]} then 64 else 0 end"
        some = "aggregate(words, 0L, (a, w) -> {})"
        one = "a ^ shiftleft(1L, cast(w & 63 as int))"
        part = some.format(f"if((w & ({flags})) = {64 * i}, {one}, a)")
        if i:
            return F.expr(f"case when n >= {LONG[i // 2]} then {part} else 0L end")
        return F.expr(f"case when n >= {LONG[0]} then {part} else {some.format(one)} end")

    prefix = F.expr(f"slice(words, 1, cast(n - ceil({PERCENT} * n / 100D) + 1 as int))")
    return words.select(*LINE, F.expr("shiftleft(cast(n as bigint), 32)").alias("np"), *[bits(i).alias(b) for i, b in enumerate(BITS)], prefix.alias("prefix"))


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The later lines of written pairs (of a line, and an earlier one y) that are similar as whole lines, as a written table."""
    first = whole.select(F.struct(*LINE).alias("y"), F.col("line").alias("earlier"))
    full = pairs.join(small(whole), LINE).join(small(first), "y")
    sets = full.select(*LINE, F.expr(_WORDS).alias("a"), F.expr(_WORDS.replace("line", "earlier")).alias("b")).withColumn("both", F.size(F.array_intersect("a", "b")))
    return saved(sets.filter(F.expr(f"100L * both >= {PERCENT}L * (size(a) + size(b) - both)")).select(*LINE).distinct())


def _settled(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The later lines of written pairs (of a line, an earlier one y, and the words that differ at least) that are similar; the likeliest pair of each goes first."""
    names = [F.col(f"y.{c}").alias(c) for c in LINE]
    need = saved(pairs.select(*LINE).unionByName(pairs.select(*names)).distinct())
    whole = saved(lines.join(small(need), LINE, "left_semi").dropDuplicates(LINE).select(*LINE, _lower(F.col("line")).alias("line")))
    best = saved(pairs.groupBy(*LINE).agg(F.min(F.struct("differ", "y")).alias("best")).select(*LINE, "best.y"))
    likely = _verified(best, whole)
    others = saved(pairs.join(small(likely), LINE, "left_anti").select(*LINE, "y").distinct().join(small(best), [*LINE, "y"], "left_anti"))
    return likely if others.isEmpty() else likely.unionByName(_verified(others, whole))


def _later(classes: DataFrame, lines: DataFrame, part: int) -> DataFrame:
    """The first lines of classes, as _ranked has them, that are similar to an earlier one."""
    # A word of a list is its rank and 40 bits; the part of its list stands above them.
    rank, sure, token = "shiftrightunsigned(word, 40)", int(STEPS * math.log2(part)) - 1, f"key & {(1 << 47) - 1}L"
    listed = classes.select(*LINE, "np", *BITS, F.posexplode_outer("prefix").alias("p", "word")).withColumn("word", F.shiftrightunsigned("word", RANK - 40))
    parts = F.expr(f"least(65535, cast(ceil(pow(2D, ({rank} + 1) / {STEPS}D) / {part}) as bigint))")
    key = F.when(F.expr(f"{rank} <= {sure}"), F.col("word")).otherwise(F.col("word").bitwiseOR(F.shiftleft(F.pmod(F.xxhash64(*LINE), parts), 47)))
    dealt = listed.select(F.coalesce(key, F.lit(0)).alias("key"), *LINE, F.expr("np | p").alias("np"), *BITS)
    # The rows of a list stand together from here on. Its size, beyond all others for a word that is dealt, alone tells how they are used, so all uses read one shuffle.
    size = F.count("*").over(Window.partitionBy("key")) + F.when(F.expr(f"{rank.replace('word', f'({token})')} > {sure}"), F.lit(1 << 40)).otherwise(F.lit(0))
    rows, most = dealt.withColumn("size", size), min(WHOLE, part)
    of_x, of_y = (f"struct({', '.join(f'{r}.{c}' for c in LINE)})" for r in "xy")
    x, y = (rows.filter(f"size between 2 and {most}").alias(r) for r in "xy")
    short = x.join(y, F.expr(f"x.key = y.key and {_earlier('y.', 'x.')} and {_bounds('x.', 'y.')}"))
    member = f"struct({token} as token, x.np, {', '.join('x.' + b for b in BITS)})"
    found = [F.expr(of_x).alias("later"), F.expr(of_y).alias("y"), F.expr(_differ("x.", "y.")).alias("differ")]
    # Columns that are never null make short code, which the JVM compiles.
    row = F.struct("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*LINE[1:], "np", *BITS]])
    lists = rows.filter(f"size > {most}").groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("list"))
    each = lists.select("key", "list", F.posexplode("list").alias("i", "x"))
    # Some of the members up to the one at i, and the first; itself is the last one.
    near = f"concat(if(i > {NEIGHBOURS}, slice(list, 1, 1), slice(list, 1, 0)), slice(list, greatest(i - {NEIGHBOURS - 1}, 1), least(i, {NEIGHBOURS}) + 1))"
    met = each.select("key", "x", F.expr(f"least(i, {NEIGHBOURS + 1})").alias("last"), F.posexplode(F.expr(near)).alias("j", "y"))
    met = met.filter(f"j = last or {_bounds('x.', 'y.')}").filter(f"j = last or {of_x} <> {of_y}")
    either = [F.when(F.expr("j < last"), c).alias(name) for c, name in zip(found[1:], ["y", "differ"])]
    met = met.select(found[0], *either, F.expr(f"if(j < last, null, {member})").alias("member"))
    none = F.lit(None).cast(met.schema["member"].dataType).alias("member")
    held = saved(short.select(*found, none).unionByName(met)).select("later.*", "y", "differ", "member")
    settled = _settled(held.filter("member is null").select(*LINE, "y", "differ"), lines)
    members = held.filter("member is not null").select(*LINE, "member.*")
    rest = members.join(small(settled), LINE, "left_anti")
    if rest.isEmpty():
        return settled
    # Sets that may be similar differ by a factor of 4/3 at most, so they are in one band or in neighbours.
    band = F.floor(F.log(F.shiftright("np", 32)) / math.log(100 / PERCENT) + 1e-9)
    x = rest.withColumn("band", band).alias("x")
    y = members.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("y")
    far = x.join(y, F.expr(f"x.token = y.token and x.band = y.band and {_bounds('x.', 'y.')} and {of_y} < {of_x}"))
    far = saved(far.select(*[F.col(f"x.{c}").alias(c) for c in LINE], F.expr(of_y).alias("y"), F.expr(_differ("x.", "y.")).alias("differ")).distinct())
    return settled if far.isEmpty() else settled.unionByName(_settled(far, lines))


def _repeated(documents: DataFrame, part: int, twice: bool) -> DataFrame:
    """The repeated lines as a written (doc_id, text_key, line_no); twice: several rows may have an id, and so the same lines."""
    sets = _sets(documents)
    table = _rarity(sets)
    counted = sets.groupBy("k1", "k2").agg(F.min(F.struct(*LINE)).alias("first"), F.count("*").alias("copies"))
    many = saved(counted.filter("copies > 1").select("k1", "k2", "first"))
    copies = saved(sets.join(small(many, MANY), ["k1", "k2"]).filter(F.struct(*LINE) != F.col("first")).select(*LINE))
    # By document, copies take half the room, and their join is broadcast for longer; if not, prefixes are shuffled and not whole sets.
    gone = saved(copies.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone")))
    firsts = _ranked(sets, table).join(small(gone, MANY), ["doc_id", "text_key"], "left").filter("gone is null or not array_contains(gone, line_no)").drop("gone")
    later = _later(firsts.dropDuplicates(LINE) if twice else firsts, lines_of(documents), part)
    return saved(copies.unionByName(later).distinct())


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = LIST) -> DataFrame:
    """(doc_id, line_no) of each line that is similar to an earlier one; line_no counts from 0.

    Lines are parted by U+000A alone. Lines without words are never removed. Null text is empty; rows without an id have no place in
    the order and keep their lines. Of rows that share an id and not a text, a number of the text decides which comes first; rows that repeat both are
    one document here. Only the two columns are read.
    """
    ids = _repeated_ids(docs, id_col)
    return _repeated(_documents(docs, id_col, text_col, ids), part, ids is not None).select("doc_id", "line_no")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = LIST) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each row without its repeated lines; null text gives the empty text.

    Of rows that repeat an id and its text, one keeps what the document keeps, and the others lose every line with words.
    """
    ids = _repeated_ids(docs, id_col)
    documents = _documents(docs, id_col, text_col, ids)
    gone = _repeated(documents, part, ids is not None).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    rows = documents.join(small(saved(gone)), ["doc_id", "text_key"], "left")
    twice = None if ids is None else saved(documents.filter("doc_id is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key"))
    if twice is not None and not twice.isEmpty():
        held = saved(rows.join(small(twice), ["doc_id", "text_key"], "left_semi").withColumn("uid", F.monotonically_increasing_id()))
        firsts = saved(held.groupBy("doc_id", "text_key").agg(F.min("uid").alias("uid")).withColumn("one", F.lit(True)))
        worded = F.expr(r"filter(transform(split(text, '\n', -1), (x, i) -> if(x rlike '[^\\x20\\x09-\\x0D]', i, -1)), i -> i >= 0)")
        again = held.join(small(firsts), ["doc_id", "text_key", "uid"], "left").withColumn("gone", F.when(F.col("one"), F.col("gone")).otherwise(worded))
        rows = rows.join(small(twice), ["doc_id", "text_key"], "left_anti").unionByName(again.drop("uid", "one"))
    all_lines = rows.select("doc_id", F.split("text", "\n", -1).alias("all"), F.expr("coalesce(gone, cast(array() as array<int>))").alias("gone"))
    return all_lines.select(
        "doc_id",
        F.size("all").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.expr("array_join(filter(all, (x, i) -> not array_contains(gone, i)), '\n')").alias("text")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
u AS (SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS raw FROM d),
w AS (SELECT doc_id, k, list_distinct(list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '')) AS s FROM u),
x AS (SELECT row_number() OVER (ORDER BY doc_id, k) AS id, doc_id, k, s, len(s) AS n FROM w WHERE len(s) >= 1),
t AS (SELECT id, n, unnest(s) AS t FROM x),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t),
o AS (SELECT id, t.t, n, row_number() OVER (PARTITION BY id ORDER BY df, t.t) AS p FROM t JOIN f USING (t)),
q AS (SELECT id, t, n FROM o WHERE p <= n - ceil(0.75 * n) + 1),
c AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM q a JOIN q b ON a.t = b.t AND b.id < a.id AND 4 * b.n >= 3 * a.n AND 4 * a.n >= 3 * b.n),
g AS (SELECT DISTINCT y.doc_id, y.k FROM c JOIN x y ON y.id = c.later JOIN x z ON z.id = c.earlier WHERE 100 * len(list_intersect(y.s, z.s)) >= 75 * (y.n + z.n - len(list_intersect(y.s, z.s))))
SELECT u.doc_id, count(*) AS n_lines, count(g.k) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY u.k) FILTER (g.k IS NULL), '') AS text FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.k = u.k GROUP BY u.doc_id
"""
