"""Audio tables: segments, timings, voices and synthesis by functions that the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import audio as A

RATE = 24_000
#: Characters that a backend is given in one call.
AT_ONCE = 16_000
STYLE = 256


def stitch_segments(segments: DataFrame, key: str = "job_id") -> DataFrame:
    """(job_id, audio): a job's segments in order as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "audio")))
    return segments.groupBy(key).agg(F.flatten(ordered["audio"]).alias("audio"))


def word_timings(segments: DataFrame, word_counts: DataFrame, rate: int = RATE, key: str = "job_id") -> DataFrame:
    """(job_id, word_timings) from segments (job_id, seq, phonemes, n_samples) and (job_id, n_words).

    Each sign of a segment's phonemes, white space apart, gives one time; words take them in turn until there are none left. A segment without
    such signs gives none and does not move the offset.
    """
    counted = segments.withColumn("m", F.length(F.regexp_replace("phonemes", r"\s+", ""))).filter("m > 0")
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("offset", F.coalesce(F.sum("n_samples").over(before), F.lit(0)) / rate).withColumn("taken", F.coalesce(F.sum("m").over(before), F.lit(0)))
    wanted = placed.join(word_counts, key).filter("taken < n_words")
    p = F.explode(F.sequence(F.lit(0), F.least(F.col("m"), F.col("n_words") - F.col("taken")).cast("int") - 1)).alias("p")
    times = wanted.select(key, "offset", "m", "n_samples", "taken", p)
    start = F.col("offset") + F.col("p") * (F.col("n_samples") / rate / F.col("m"))
    return times.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("taken") + F.col("p")).alias("i"), start.alias("t"))))["t"].alias("word_timings"))


def style_vector(jobs: DataFrame, voice_bank: DataFrame) -> DataFrame:
    """jobs (voice_id) with style, the first row of their voice's matrix, or an error for an unknown voice."""
    joined = jobs.join(voice_bank.select("voice_id", F.slice("values", 1, STYLE).alias("style")), "voice_id", "left")
    return joined.withColumn("error", F.when(F.col("style").isNull(), F.concat(F.lit("Unknown voice: "), F.col("voice_id"))))


def apply_speed(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """jobs with their audio resampled where the model does not change speed itself."""
    own = models.select(F.col("id").alias("model_id"), F.coalesce("custom", F.lit(False)).alias("_custom"))
    return jobs.join(own, "model_id", "left").withColumn(
        "audio",
        F.when(
            ~F.coalesce("_custom", F.lit(False)) & (F.col("speed") != 1.0),
            A.change_speed(F.col("audio"), F.col("speed"))
        ).otherwise(F.col("audio"))
    ).drop("_custom")


Backend = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class Backends:
    """Backends by model id. A backend loads once before its loop, and yields (job_id, audio, sample_rate, word_timings) for each batch of jobs; the last registration of an id holds."""

    def __init__(self):
        self.known: dict[str, Backend] = {}

    def register(self, model_id: str, backend: Backend) -> None:
        self.known[model_id] = backend

    def unregister(self, model_id: str) -> None:
        self.known.pop(model_id, None)

    def of(self, model_id: str) -> Backend:
        if model_id not in self.known:
            raise KeyError(f"Custom engine for {model_id} not registered")
        return self.known[model_id]


SYNTHESISED = "job_id string, model_id string, audio array<float>, sample_rate int, word_timings array<double>, error string"


def synthesize(jobs: DataFrame, backends: Backends) -> DataFrame:
    """(job_id, model_id, audio, sample_rate, word_timings, error) of jobs (job_id, model_id, voice_id, text, speed).

    A batch holds jobs of any models; each model's rows go to its backend, a call for texts of AT_ONCE characters, as audio takes far more room than
    its text. A job whose backend fails or is missing becomes a row with the error, and the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def failed(rows: pd.DataFrame, wrong: Exception) -> pd.DataFrame:
            message = str(wrong.args[0] if isinstance(wrong, KeyError) else wrong)
            return rows[["job_id", "model_id"]].assign(audio=None, sample_rate=None, word_timings=None, error=message)

        def parts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Rows in order, as many as have AT_ONCE characters, and one at least."""
            ends = rows["text"].str.len().fillna(0).cumsum()
            yield from (part for _, part in rows.groupby(ends // AT_ONCE, sort=False))

        for batch in batches:
            for model_id, rows in ((m, part) for m, whole in batch.groupby("model_id", sort=False) for part in parts(whole)):
                try:
                    backend = backends.of(model_id)
                    done = pd.concat(list(backend(iter([rows]))))
                    yield done.assign(model_id=model_id, error=None)
                except Exception as whole:  # noqa: BLE001  one job must not fail the others
                    if len(rows) == 1 or isinstance(whole, KeyError):
                        yield failed(rows, whole)
                        continue
                    for i in range(len(rows)):
                        one = rows.iloc[i : i + 1]
                        try:
                            yield pd.concat(list(backend(iter([one])))).assign(model_id=model_id, error=None)
                        except Exception as wrong:  # noqa: BLE001
                            yield failed(one, wrong)

    wanted = SYNTHESISED.split(", ")
    names = [w.split()[0] for w in wanted]
    return jobs.mapInPandas(lambda it: (d[names] for d in run(it)), SYNTHESISED)
