"""Audio columns: arrays of float samples. Sums are in double and stored as float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_speed(audio: Column, speed: Column) -> Column:
    """Linear interpolation to max(1, floor(n / speed)) samples; unchanged at speed 1, at 0 and below. An empty array gives one NaN."""
    n = F.size(audio)
    count = F.greatest(F.lit(1), F.floor(n / speed)).cast("int")

    def sample(i: Column) -> Column:
        at = i.cast("double") * speed
        low = F.floor(at).cast("int")
        part = at - low
        pick = lambda k: F.coalesce(F.get(audio, k).cast("double"), F.lit(float("nan")))
        return (pick(low) * (1 - part) + pick(F.least(low + 1, n - 1)) * part).cast("float")

    return F.when((speed == 1.0) | (speed <= 0), audio).otherwise(F.transform(F.sequence(F.lit(0), count - 1), sample))


def pcm16(audio: Column) -> Column:
    """Samples clamped to [-1, 1] as 16-bit numbers: negative ones times 32768, others times 32767, halves rounded up; NaN is 0."""

    def quantise(x: Column) -> Column:
        v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(x.cast("double"), F.lit(0.0))))
        return F.floor(F.when(v < 0, v * 32768).otherwise(v * 32767) + 0.5).cast("short")

    return F.transform(audio, quantise)


def clean_audio(audio: Column) -> Column:
    return F.transform(audio, lambda x: F.nanvl(x, F.lit(0.0).cast("float")))


def normalize_quiet(audio: Column) -> Column:
    """Raised to a peak of 0.5 where the peak is above 0 and below 0.1."""
    peak = F.array_max(F.transform(audio, lambda x: F.abs(x.cast("double"))))
    return F.when((peak > 0) & (peak < 0.1), F.transform(audio, lambda x: (x.cast("double") * (0.5 / peak)).cast("float"))).otherwise(audio)


def wav_header(audio: Column, rate: Column) -> Column:
    """The numbers of a mono 16-bit header: rate, block_align, byte_rate, data_length, total_length."""
    data = F.size(audio).cast("long") * 2
    return F.struct(
        rate.cast("int").alias("rate"),
        F.lit(2).alias("block_align"),
        (rate * 2).cast("int").alias("byte_rate"),
        data.alias("data_length"),
        (data + 44).alias("total_length")
    )
