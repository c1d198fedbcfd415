"""Toxic passages as maximum-scoring segments of token log-odds.

Fit: labelled documents of a bounded sample give, for each word and each of its beginnings, in how many documents of
either label it occurs. A unit's share of toxic documents is shrunk towards that of its next shorter beginning (a chain
of Dirichlet priors), so that a word which was never seen is judged by its stem. The log-odds against the overall share,
less a constant drift, is a token's score.

Scan: one pass over a document's tokens finds all maximal scoring segments. Under the null model the best segment of n
tokens has P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda comes from the score distribution of clean documents and K from their best
segments. Segments of an expectation below a threshold are significant. A logistic curve, fitted on labelled documents that gave no
counts, turns the extreme-value evidence into a score between 0 and 1.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks, lean

#: Labelled documents that a fit uses at most (in expectation: they are taken by a hash of the id).
MAX_LABELLED = 30_000
#: Lengths of the beginnings in a word's chain of priors, the weight of each prior, documents that a unit needs, drift of a token.
BEGINNINGS, PRIOR, MIN_DOCS, DRIFT = range(2, 10), 4.0, 3, 2.0
#: Least likelihood ratio against the overall share with which a unit enters the model.
MIN_RATIO = 2.0
#: Segments expected fewer times than this in a clean document are significant.
EXPECTED = 0.05
REJECT = 0.7
WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> list[str]:
    """A word's beginnings from short to long, then the word itself."""
    return [word[:k] for k in BEGINNINGS if len(word) > k] + [word + "$"]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, end token, score), in linear time.

    Candidates are kept on a stack with the sums before and after them; a new positive score joins the candidates back to the
    nearest one that starts lower, unless that one also ends higher.
    """
    found = np.flatnonzero(scores > 0)
    if not len(found):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest lower start
    for i in found.tolist():
        first, left, right = i, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, i + 1, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(r - s)) for a, b, s, r, _ in stack]


@dataclass
class Model:
    """What every task needs: log-odds by unit (as many as a bounded sample gives), and the calibration's five numbers."""

    odds: dict[str, float]
    decay: float = 1.0
    scale: float = 1.0
    weights: tuple = (0.0, 1.0, 0.0)

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def token(self, word: str) -> float:
        for unit in reversed(units(word)):
            found = self.odds.get(unit)
            if found is not None:
                return found - DRIFT
        return -DRIFT

    def tokens(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 150_000:
            known.clear()
        for word in WORD.findall(text.lower()):
            score = known.get(word)
            if score is None:
                score = known[word] = self.token(word)
            out.append(score)
        return np.array(out, np.float64)

    def evidence(self, found: list, n: int) -> tuple[float, float, int]:
        """Of the best segment and of all significant ones together, as -log of the expected number; how many are significant."""
        base = math.log(self.scale * max(n, 1))
        each = sorted((self.decay * s - base for _, _, s in found), reverse=True)
        strong = [e for e in each if e > -math.log(EXPECTED)]
        best = max(each[0] if each else -base, -20.0)
        return min(best, 60.0), min(sum(strong), 200.0), len(strong)

    def score(self, evidence: tuple) -> float:
        a, b, c = self.weights
        x = a + b * evidence[0] + c * math.log1p(evidence[1])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _counts(batches):
    """(unit, toxic, documents) of the labelled documents of a task."""
    from collections import Counter

    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    seen = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            seen[toxic].update({u for w in set(WORD.findall((text or "").lower())) for u in units(w)})
            if len(seen[toxic]) > 500_000:
                yield from chunks(((u, toxic, n) for u, n in seen[toxic].items()), schema, 65536)
                seen[toxic].clear()
    for toxic in seen:
        yield from chunks(((u, toxic, n) for u, n in seen[toxic].items()), schema, 65536)


def labelled_sample(labels: DataFrame, bound: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic, role): labels that may be learnt from, a bounded part of them; role is count or calibrate.

    Of rows that repeat an id the larger label counts; rows without an id, or with a label other than 0 and 1, are left out.
    """
    usable = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    )
    n = usable.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000))
    role = F.when(F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(4)) == 0, "calibrate").otherwise("count")
    return usable.filter(draw < F.lit(round(1e6 * min(1.0, bound / max(n, 1))))).withColumn("role", role)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most about ``bound`` labelled documents. The sample's labels (two numbers a row) are broadcast; texts stay where they are.

    Without both labels in the sample, the model knows no unit and scores every document alike. Texts are read whole, whatever their length; null and
    empty ones teach no unit. Labels of ids that no document has, null ones and those other than 0 and 1 teach nothing, and columns other than those named are not read.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    part = texts.filter("role = 'count'")
    sizes = {r.toxic: r.n for r in part.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, weights=(math.log((n1 + 1) / (n0 + 1)), 0.0, 0.0))
    share = n1 / (n1 + n0)
    a, n = F.col("a"), F.col("n")
    side = lambda k, p: F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(0.0)
    counted = (
        part.select("text", "toxic")
        .mapInArrow(lean(_counts, "toxicity"), "unit string, toxic int, n long")
        .groupBy("unit")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
        .filter(n >= MIN_DOCS)
        .withColumn("ratio", 2 * (side(a, share) + side(n - a, 1 - share)))
        .filter(F.col("ratio") >= MIN_RATIO)
        .select("unit", "a", "n")
    )
    held = {r.unit: (r.a, r.n) for r in counted.collect()}
    root = math.log(share / (1 - share))
    shares: dict[str, float] = {}
    for unit in sorted(held, key=lambda u: (len(u.rstrip("$")), u.endswith("$"))):
        prior, word = share, unit.rstrip("$")
        for k in reversed(BEGINNINGS):
            if (k < len(word)) and word[:k] in shares:
                prior = shares[word[:k]]
                break
        toxic, total = held[unit]
        # Shares close in on 0 or 1 along a chain, and must not reach them.
        shares[unit] = min(max((toxic + PRIOR * prior) / (total + PRIOR), 1e-9), 1 - 1e-9)
    model = Model({u: math.log(p / (1 - p)) - root for u, p in shares.items()})
    return calibrated(model, texts.filter("role = 'calibrate'").select("text", "toxic"))


SEEN = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("bins", pa.list_(pa.int64()))])
WEIGHED = pa.schema([("toxic", pa.int32()), ("best", pa.float64()), ("all", pa.float64())])
_BIN, _LOW, _BINS = 0.1, -12.0, 240


def calibrated(model: Model, texts: DataFrame) -> Model:
    """model with the extreme-value law of clean documents and the logistic curve; what comes to the driver is a few numbers a sampled document."""

    def look(batches):
        def rows():
            bins = np.zeros(_BINS, np.int64)
            for batch in batches:
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    x = model.tokens(text or "")
                    best = max((s for _, _, s in segments(x)), default=0.0)
                    if not toxic:
                        bins += np.bincount(np.clip((x - _LOW) / _BIN, 0, _BINS - 1).astype(int), minlength=_BINS)
                    yield toxic, len(x), best, None
            yield None, 0, 0.0, bins.tolist()  # the task's scores of clean documents, as counts

        yield from chunks(rows(), SEEN, 512)

    seen = texts.mapInArrow(lean(look, "toxicity"), "toxic int, n long, best double, bins array<long>")
    rows = [(r.toxic, r.n, r.best, r.bins) for r in seen.collect()]
    counts = sum((np.array(r[3], float) for r in rows if r[0] is None), np.zeros(_BINS))
    rows = [r for r in rows if r[0] is not None]
    clean = [r for r in rows if not r[0]]
    if not clean or len(clean) == len(rows):
        return model
    value = _LOW + _BIN * (np.arange(_BINS) + 0.5)
    share = counts / max(counts.sum(), 1)
    low, high = 1e-3, 5.0
    for _ in range(60):  # the positive root of sum p exp(lambda x) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * value)).sum() < 1 else (low, mid)
    model.decay = max(low, 0.05)
    model.scale = max(len(clean) / max(sum(max(n, 1) * math.exp(-model.decay * best) for _, n, best, _ in clean), 1e-9), 1e-9)

    def weigh(batches):  # under the law that is known now, of all segments
        def rows():
            for batch in batches:
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    tokens = model.tokens(text or "")
                    yield toxic, *model.evidence(segments(tokens), len(tokens))[:2]

        yield from chunks(rows(), WEIGHED, 2048)

    weighed = texts.mapInArrow(lean(weigh, "toxicity"), "toxic int, best double, all double").collect()
    x = np.array([[1.0, r.best, math.log1p(r["all"])] for r in weighed])
    y = np.array([r.toxic for r in weighed], float)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic regression with a weak prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3), x.T @ (y - p) - 0.01 * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    model.weights = tuple(float(v) for v in w)
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_segments", pa.int64()), ("segments", pa.string())])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_segments, segments) of each whole text; segments lists start:end of the significant passages in code points.

    Null and empty texts have no tokens and get the score that no evidence gives. Repeated rows are scored each.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns)):
                    text = text or ""
                    x = model.tokens(text)
                    found = segments(x)
                    evidence = model.evidence(found, len(x))
                    spans = ""
                    if evidence[2]:
                        base = math.log(model.scale * max(len(x), 1))
                        strong = [(a, b) for a, b, s in found if model.decay * s - base > -math.log(EXPECTED)]
                        places = [m.span() for m in WORD.finditer(text)]
                        if len(places) == len(x):  # lower-casing may change a text's length, never in these alphabets
                            spans = ",".join(f"{places[a][0]}:{places[b - 1][1]}" for a, b in strong)
                    score = model.score(evidence)
                    yield doc_id, held_out, score, int(score >= reject), evidence[2], spans

        yield from chunks(rows(), SCORED)

    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select(F.col(id_col).cast("long"), held_out, F.col(text_col)).mapInArrow(
        lean(run, "toxicity"),
        "doc_id long, held_out boolean, score double, predicted int, n_segments long, segments string"
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs without the rows whose text scores at least ``reject``; all columns stay, and each row is judged where it is."""
    names, place = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = []
            for text in batch.column(place).to_pylist():
                x = model.tokens(text or "")
                keep.append(model.score(model.evidence(segments(x), len(x))) < reject)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(lean(run, "toxicity"), docs.schema)
