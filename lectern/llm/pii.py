"""Personal data and information-theoretic sanitisation, in DataFrame operations only.

Base kinds are found by pattern. The corpus then says which words beside an entity give it away: for an entity e
and a term t, PMI(t, e) = log2(n(t, e) N / (n(t) n(e))) over texts, and t discloses e when PMI(t, e) >= IC(e) / alpha with
IC(e) = log2(N / n(e)). That is the same as n(t, e) / n(t) >= (n(e) / N) ** (1 - 1 / alpha), and it is the lower confidence bound of
that share which has to reach it. Disclosing terms are added as spans of kind ``term``, and ``sanitise`` removes them, or
generalises those that are common enough.

Evidence is counted in different texts: copies of one text are one text, and a pair counts only if its texts are of two families at least. Near copies are
one family: texts that agree in a band of minima of their hashed pairs of words, and what is connected so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import saved, small, unwrapped, wrapped
from lectern.llm.graph import components
from lectern.llm.secrets import masked, renewed

#: Kinds in the order in which they are listed, and patterns. The look-behinds only skip starts at which
#: no match could begin, so that a long run is scanned once and not once from each of its characters.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can hold no span of the kind.
NEEDS = {"email": r"instr({0}, '@') > 0", "ip": r"{0} rlike '[0-9][.][0-9]'", "card": r"{0} rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": r"instr({0}, '+') > 0"}
DIGITS = "translate({0}, translate({0}, '0123456789', ''), '')"
LUHN = f"""aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + cast(case
    when (length({DIGITS}) - i) % 2 = 0 then int(substring({DIGITS}, i, 1))
    else int(substring('0246813579', int(substring({DIGITS}, i, 1)) + 1, 1)) end as int)) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split({0}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(int(nullif(ltrim('0', p), '')), 0) <= 255)",
    "card": f"length({DIGITS}) between 14 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 10 and 15",
}
#: A term is a whole run of so many letters, in lower case.
TERM = r"\p{L}{3,}"
#: Share of an entity's information that a term may give away is 1 / ALPHA; pairs seen in fewer different texts are chance. Z is the
#: width of the confidence interval in standard deviations. Texts are near copies if they share a band of BAND of their SKETCHES minima: of pairs of
#: texts with similarity 0.75 that finds 79 in 100, with 0.9 nearly all, with 0.5 twelve and with 0.4 three.
ALPHA, SUPPORT, Z, SKETCHES, BAND = 1.5, 2, 1.64, 48, 6
#: A disclosing term in at least so many documents is generalised; a rarer one is removed.
GENERALISE_FROM = 50


def _split(rows: DataFrame, kind: str, text: str) -> DataFrame:
    """rows with the matches of a kind and the gaps between them; both empty where the text can hold none."""
    pattern, needs = PATTERNS[kind], F.expr(NEEDS[kind].format(text))
    none = F.expr("cast(array() as array<string>)")
    return rows.withColumn(
        f"{kind}_m",
        F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    ).withColumn(f"{kind}_g", F.when(needs, F.split(text, pattern, -1)).otherwise(none))


def _spans(kind: str) -> Column:
    """Valid matches of a kind with their places in code points: lengths of gaps and matches add up to the places."""
    m, g = f"{kind}_m", f"{kind}_g"
    placed = f"""aggregate(arrays_zip({m}, slice({g}, 1, size({m}))), struct(cast(array() as array<struct<start:bigint,end:bigint,value:string>>) as out, 0L as at), (a, x) ->
        struct(concat(a.out, array(struct(a.at + length(x.`1`) as start, a.at + length(x.`1`) + length(x.{m}) as end, x.{m} as value))) as out,
               a.at + length(x.`1`) + length(x.{m}) as at), a -> a.out)"""
    return F.expr(f"filter({placed}, s -> {VALID[kind].format('s.value')})")


def _words(text: str) -> Column:
    """The terms of a text in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def _bands(words: Column) -> Column:
    """Hashes of bands of minima: the least hashes of pairs of neighbouring words, by so many hash functions."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(""))))
    held = F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.lit(0).cast("long")))
    least = lambda k: F.array_min(F.transform(held, lambda x: F.xxhash64(F.lit(k), x)))
    return F.array(*[F.xxhash64(F.lit(k), *[least(k + j) for j in range(BAND)]) for k in range(0, SKETCHES, BAND)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of each row, its distinct entities and terms as hashes, and bands that near copies share; a written table with the texts of those rows only that have an entity."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    base = [k for k in KINDS if k != "term"]
    for kind in base:
        rows = _split(rows, kind, "body")
    rows = rows.select("uid", "doc_id", "body", *[_spans(k).alias(k) for k in base])
    spans = ", ".join(f"transform({k}, s -> struct(s.start as start, {i} as rank, s.end as end, '{k}' as kind))" for i, k in enumerate(base))
    entities = ", ".join(f"transform({k}, s -> xxhash64('{k}', lower(s.value)))" for k in base)
    body = F.when(F.expr(" + ".join(f"size({k})" for k in base) + " > 0"), F.col("body"))
    held = rows.select(
        "uid",
        "doc_id",
        F.sha2("body", 256).alias("digest"),
        body.alias("body"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.expr(f"array_sort(concat({spans}))").alias("spans"),
        F.expr(f"array_distinct(concat({entities}))").alias("entities"),
        F.explode(F.array(_words("body"))).alias("words"),  # computed once
    )
    bands = F.when(F.col("body").isNotNull(), _bands(F.col("words")))
    terms = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))
    return saved(held.select("*", terms.alias("terms"), bands.alias("bands")).drop("words"))


def _once(scanned: DataFrame) -> DataFrame:
    """One row of scanned for each different text."""
    again = scanned.groupBy("digest").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = saved(scanned.select("uid", "digest").join(again, "digest").filter("uid <> first").select("uid"))
    return scanned.join(small(copies), "uid", "left_anti")


def _families(once: DataFrame) -> DataFrame:
    """once with family, the same number for texts that are near copies of each other. Only texts with an entity are looked at."""
    bands = saved(once.filter("body is not null").select("uid", F.explode("bands").alias("band")))
    shared = bands.groupBy("band").agg(F.min("uid").alias("low"), F.count("*").alias("n")).filter("n > 1").select("band", "low")
    linked = components(bands.join(shared, "band").select("uid", "low").distinct(), "uid", "low")
    return once.join(linked.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("family", F.coalesce("component", "uid")).drop("component")


def _groups(once: DataFrame, total: int, support: int) -> DataFrame:
    """(entity, gid, n_entity): entities in ``support`` texts or more, but not in all. Those that occur in the same texts share a group; a written table.

    Two sums of hashes of the texts tell a group, so that however many entities a text lists, its terms are counted with each group once.
    """
    mark = lambda k: F.sum(F.xxhash64(F.lit(k), "uid").cast("decimal(38,0)"))
    each = once.select("uid", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"), mark(1).alias("a"), mark(2).alias("b"))
    held = each.filter((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    return saved(held.select("entity", "n_entity", F.md5(F.concat_ws(":", "n_entity", "a", "b")).alias("gid")))


def _beside(rows: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """(uid, gid, term, more): each row's distinct terms against the groups of its entities."""
    held = rows.select("uid", F.explode("entities").alias("entity")).join(groups.select("entity", "gid"), "entity").groupBy("uid").agg(F.collect_set("gid").alias("held"))
    words = rows.filter("body is not null").join(held, "uid").select("uid", "held", *more, F.explode("terms").alias("term"))
    return words.select("uid", F.explode("held").alias("gid"), "term", *more)


def lower_share(both: Column, of: Column, z: float = Z) -> Column:
    """The lower end of Wilson's confidence interval of a share both / of."""
    p = both / of
    around = F.lit(z) * F.sqrt(p * (1 - p) / of + F.lit(z * z) / (4 * of * of))
    return (p + F.lit(z * z) / (2 * of) - around) / (1 + F.lit(z * z) / of)


def disclosing(scanned: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(gid, term, docs_with_term): pairs whose term gives the entities of a group away; and the groups. All counts are of different texts, over the whole corpus.

    Counting texts with a term explodes each text's distinct words once; what is shuffled is one partial count a term, or a pair, and task.
    """
    once = _once(scanned)
    total = max(once.count(), 1)
    groups = _groups(once, total, support)
    two = F.min("family") < F.max("family")
    pair = _beside(_families(once), groups, "family").groupBy("gid", "term").agg(F.count("*").alias("n_both"), two.alias("two"))
    pair = pair.filter((F.col("n_both") >= support) & F.col("two")).select("gid", "term", "n_both")
    term = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    sized = saved(pair.join(groups.select("gid", "n_entity").distinct(), "gid"))
    bound = F.pow(F.col("n_entity") / F.lit(float(total)), F.lit(1 - 1 / alpha))
    told = sized.join(term, "term").filter(lower_share(F.col("n_both"), F.col("n_term")) >= bound)
    return saved(told.select("gid", "term", F.col("n_term").alias("docs_with_term"))), groups


def _places(scanned: DataFrame, hits: DataFrame) -> DataFrame:
    """(uid, start, end, docs_with_term): every place of the terms of hits in their documents, in code points."""
    rows = scanned.join(hits.select("uid").distinct(), "uid").select("uid", F.regexp_extract_all("body", F.lit(TERM), F.lit(0)).alias("m"), F.split("body", TERM, -1).alias("g"))
    each = rows.select("uid", F.posexplode(F.expr("arrays_zip(m, slice(g, 1, size(m)))")).alias("k", "x")).select(
        "uid",
        "k",
        F.col("x.m").alias("word"),
        F.length(F.col("x")["1"]).cast("long").alias("gap")
    )
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("uid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("end", end).select("uid", F.xxhash64(F.lower("word")).alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")
    return placed.join(hits, ["uid", "term"]).drop("term")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """One row a document: base counts and digest, and all spans with the disclosing terms.

    Null text is empty; repeated ids are judged row by row; other columns are not read. Texts of any length are scanned whole, in time that grows with their
    length, and an empty table gives an empty result. Spans are in code points,
    end exclusive. All places of a disclosing term in a document with its entity are spans, but those inside a base span.
    A document whose words beside an entity are ordinary keeps them.
    """
    return _found(docs, id_col, text_col, alpha, support).select(
        "doc_id",
        *[f"n_{k}" for k in KINDS[:4]],
        F.sha2(F.expr("array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"), 256).alias("base_sha256"),
        F.expr("array_join(transform(array_sort(concat(spans, terms)), s -> concat_ws(':', s.kind, s.start, s.end)), ',')").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def _found(docs: DataFrame, id_col: str, text_col: str, alpha: float, support: int) -> DataFrame:
    scanned = scan(docs, id_col, text_col)
    found, groups = disclosing(scanned, alpha, support)
    told = saved(_beside(scanned, groups).join(found, ["gid", "term"]).select("uid", "term", "docs_with_term").distinct())
    hits = (
        _places(scanned, told)
        .groupBy("uid")
        .agg(
            F.collect_set(F.struct("start", F.lit(4).alias("rank"), "end", F.lit("term").alias("kind"))).alias("terms"),
            F.collect_set(F.when(F.col("docs_with_term") >= GENERALISE_FROM, F.col("start"))).alias("common")
        )
    )
    empty = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"
    clear = f"filter(coalesce(terms, {empty}), t -> not exists(spans, s -> s.start < t.end and t.start < s.end))"
    return scanned.drop("body", "entities", "terms", "bands").join(hits, "uid", "left").withColumn("terms", F.expr(clear)).withColumn(
        "common",
        F.expr("coalesce(common, cast(array() as array<bigint>))")
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """docs with base spans replaced by their kind in capitals, rare disclosing terms removed and common ones replaced by [TERM].

    Spans are found by the text, so rows that share an id and not a text are each sanitised in their own places. Overlapping spans are replaced
    once, by the kind that begins first. n_chars follows the new text where there is such a column.
    """
    found = _found(docs, id_col, text_col, alpha, support).select("digest", F.expr("array_sort(concat(spans, terms))").alias("spans"), "common")
    spans = saved(found.filter("size(spans) > 0").dropDuplicates(["digest"]))
    sign = "case when s.kind <> 'term' then concat('[', upper(s.kind), ']') when array_contains(common, s.start) then '[TERM]' else '' end"
    rows = docs.select(wrapped(), F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("digest")).join(small(spans), "digest", "left")
    return unwrapped(rows.withColumn("new", masked("text", "spans", sign)), docs.columns, **renewed(docs, text_col, "spans"))
