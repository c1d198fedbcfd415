"""Secret scans weighed by how many repositories and owners hold a candidate.

A scan finds candidates in every whole text. Their hashes are aggregated over the corpus by distinct
repositories and owners. A value that many owners hold is a widely copied example; one that few hold and that
looks live (mixed, high entropy, no placeholder word) is taken for a credential.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks, lean, saved, small, unwrapped, wrapped

#: A value counts as a widely copied example from so many owners; or, with more than one owner, from so many repositories.
COPIED_OWNERS, COPIED_REPOS = 3, 6
#: Bits a character that a live-looking value has at least; for a value of the assign kind, whose key word is evidence, scaled by
#: the most that its length allows against that of FULL characters.
MIN_ENTROPY, FULL = 3.0, 16
#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "owned")
#: Base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Any long token of an encoding's alphabet: what the method looks at besides the base kinds.
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|your|xxxx|dummy", re.IGNORECASE)

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("live", pa.bool_())])
SCANNED = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("digest", pa.string()),
        ("owner", pa.string()),
        ("repo", pa.string()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.list_(SPAN))
    ]
)
SCANNED_DDL = "uid long, doc_id long, digest string, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long,hash:long,live:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str, kind: str = "owned") -> bool:
    """Letters and digits mixed, enough entropy, and no placeholder word."""
    least = MIN_ENTROPY * min(1.0, math.log2(len(value)) / math.log2(FULL)) if kind == "assign" and value else MIN_ENTROPY
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value)) and not PLACEHOLDER.search(value) and entropy(value) >= least


def value_hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of base candidates, by start and then kind; then of the loose ones."""
    base = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    starts, reach, far = [s for _, s, _, _ in base], [], 0
    for _, _, end, _ in base:
        far = max(far, end)
        reach.append(far)
    clear = lambda m: not (k := bisect_left(starts, m.end())) or reach[k - 1] <= m.start()  # noqa: E731  no base span begins before its end and ends after its start
    return base + [("owned", m.start(), m.end(), m[0]) for m in LOOSE.finditer(text) if clear(m) and looks_live(m[0])]


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def _scan(batches):
    def rows():
        for batch in batches:
            for uid, doc_id, digest, owner, repo, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = find(text or "")
                base = [s for s in found if s[0] != "owned"]
                count = Counter(s[0] for s in base)
                spans = [{"kind": k, "start": s, "end": e, "hash": value_hash(v), "live": looks_live(v, k)} for k, s, e, v in found]
                yield uid, doc_id, digest, owner, repo, count["assign"], count["access"], count["hex"], sha256(joined(base).encode()).hexdigest(), spans

    yield from chunks(rows(), SCANNED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """Candidates of each row, as a written table without the texts. A repository is a (owner, repo) pair."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("long"),
        F.sha2(F.col(text_col), 256),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")),
        F.col(text_col),
    )
    return saved(rows.mapInArrow(lean(_scan, "secrets"), SCANNED_DDL))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners): distinct repositories and owners that hold a value.

    Each step aggregates in the tasks before it shuffles, so a value that every document has costs one row a task.
    """
    held = scanned.select("owner", "repo", F.explode("spans.hash").alias("hash")).groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def judged(scanned: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(uid, verdicts): each row's spans in order, with verdict copied, specific or dull.

    What one owner has in any number of its repositories is its own; what owners share is copied if they or their repositories are many.
    """
    spans = scanned.select("uid", F.inline("spans"))
    many = (F.col("n_owners") >= copied_owners) | (F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos)
    verdict = F.when(many, "copied").when(F.col("live"), "specific").otherwise("dull")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return (
        spans.join(ownership(scanned), "hash")
        .withColumn("verdict", verdict)
        .filter("kind <> 'owned' or verdict = 'specific'")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "verdict"))).alias("verdicts"))
    )


def find_secrets(docs: DataFrame, copied_owners: int = COPIED_OWNERS, **columns) -> DataFrame:
    """One row a document: base counts and digest, all spans, and how many are owner-specific or widely copied.

    Null text is empty; null owner or repository counts as one unnamed owner or repository. Rows that repeat an id are
    judged each on its own. Spans are in code points, end exclusive. Extra columns are not read.
    """
    scanned = scan(docs, **columns)
    verdicts = F.coalesce("verdicts", F.expr("cast(array() as array<struct<start:long,rank:long,end:long,kind:string,verdict:string>>)"))
    return (
        scanned.drop("spans", "digest")
        .join(judged(scanned, copied_owners), "uid", "left")
        .withColumn("verdicts", verdicts)
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            "base_sha256",
            F.expr("array_join(transform(verdicts, v -> concat_ws(':', v.kind, v.start, v.end)), ',')").alias("spans"),
            F.expr("cast(size(filter(verdicts, v -> v.verdict = 'specific')) as long)").alias("n_specific"),
            F.expr("cast(size(filter(verdicts, v -> v.verdict = 'copied')) as long)").alias("n_copied"),
        )
    )


def mask_secrets(docs: DataFrame, copied_owners: int = COPIED_OWNERS, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """docs with owner-specific, live-looking spans replaced by <secret>; other rows and columns are unchanged.

    Overlapping spans are masked once, as their union. n_chars follows the new text where there is such a column.
    Spans are found by the text, so rows that share an id and not a text are each masked in their own places.
    """
    scanned = scan(docs, id_col=id_col, text_col=text_col, **columns)
    live = F.expr("transform(filter(verdicts, v -> v.verdict = 'specific'), v -> struct(v.start, v.end))")
    held = judged(scanned, copied_owners).select("uid", live.alias("spans")).filter("size(spans) > 0")
    spans = saved(scanned.select("uid", "digest").join(held, "uid").select("digest", "spans").dropDuplicates(["digest"]))
    rows = docs.select(wrapped(), F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("digest")).join(small(spans), "digest", "left")
    return unwrapped(rows.withColumn("new", masked("text", "spans", "'<secret>'")), docs.columns, **renewed(docs, text_col, "spans"))


def masked(text: str, spans: str, sign: str) -> Column:
    """SQL columns: a text with its spans, in order, replaced by sign (of the span s); spans that overlap count once."""
    return F.expr(
        f"""aggregate({spans}, struct(cast('' as string) as done, 0L as at), (a, s) -> struct(
            case when s.start < a.at then a.done else concat(a.done, substring({text}, cast(a.at + 1 as int), cast(s.start - a.at as int)), {sign}) end as done,
            greatest(a.at, s.end) as at), a -> concat(a.done, substring({text}, cast(a.at + 1 as int))))"""
    )


def renewed(docs: DataFrame, text_col: str, spans: str) -> dict[str, Column]:
    """The columns of wrapped rows that change where there are spans: the text, and n_chars if docs has it."""
    same = F.col(spans).isNull()
    changed = {text_col: F.when(same, F.col("row")[text_col]).otherwise(F.col("new"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row")["n_chars"]).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return changed
