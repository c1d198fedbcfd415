"""From a playback position to the word that is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.order import last_seen


def _safe(time: Column) -> Column:
    ok = time.isNotNull() & ~F.isnan(time) & (time > 0) & (time != float("inf"))
    return F.when(ok, time).otherwise(0.0)


def word_at_ratio(total: Column, time: Column, duration: Column) -> Column:
    """The word by the share of the duration that has passed; the first without words, and for times that are no number."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _safe(time) / F.greatest(duration, F.lit(1e-6))))
    return F.when(total <= 0, 0).otherwise(F.least(F.floor(share * total), total - 1)).cast("int")


def word_at_time(total: Column, time: Column, duration: Column, timings: Column) -> Column:
    """The last word that has begun, by sorted timings if there is one for each word; else by the share of the duration."""
    begun = F.size(F.filter(F.slice(timings, 1, F.greatest(total, F.lit(1))), lambda t: t <= _safe(time)))
    timed = F.greatest(F.lit(0), begun - 1)
    return F.when(total <= 0, 0).when(F.coalesce(F.size(timings), F.lit(-1)) >= total, timed).otherwise(word_at_ratio(total, time, duration)).cast("int")


def asof_word(positions: DataFrame, timings: DataFrame, key: str = "session_id") -> DataFrame:
    """positions (session_id, time) with word, the last whose start (session_id, word, start) is not after the time; 0 before the first.

    An as-of join by one range sort of both tables together: the last word seen is carried on within a range, and from one to the next of the same
    session, so a session of any size is spread over tasks. The sorted rows are written as a table when this is called.
    """
    p = positions.select(key, F.col("time").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_w"), F.struct(*positions.columns).alias("_p"))
    t = timings.select(key, F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.col("word").cast("int").alias("_w"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    both = p.unionByName(t)
    order = [F.col(c) for c in ("_t", "_kind", "_w")]
    seen = last_seen(both, [key], [*order, F.xxhash64("_p")], "_w", "_seen")
    return seen.filter("_kind = 1").select("_p.*", F.coalesce("_seen", F.lit(0)).alias("word"))


def locate_word(targets: DataFrame, sentences: DataFrame, keys: tuple = ("doc_id", "chunk_index")) -> DataFrame:
    """targets (keys, word) with global_index and word_index: the sentence of the chunk whose words hold the target. sentences have n_words."""
    before = Window.partitionBy(*keys).orderBy("global_index").rowsBetween(Window.unboundedPreceding, -1)
    ranged = sentences.withColumn("_start", F.coalesce(F.sum("n_words").over(before), F.lit(0))).withColumn("_end", F.col("_start") + F.col("n_words"))
    ranged = ranged.select(*keys, "global_index", "_start", "_end")
    return targets.join(ranged, list(keys)).filter("word >= _start and word < _end").withColumn("word_index", F.col("word") - F.col("_start")).drop("_start", "_end")


def chunk_words(sentences: DataFrame, keys: tuple = ("doc_id", "chunk_index")) -> DataFrame:
    """(keys, n_words, ranges): every chunk's sentences (keys, global_index, n_words) in one row, each with the words of the chunk before it.

    Ranges are array<struct<global_index, first_word, n_words>> in order. A chunk is of bounded size, so its row is, too; tables of them join with streams.
    """
    rows = sentences.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("global_index", "n_words"))).alias("s"))
    before = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0), lambda n, x: (n + x["n_words"]).cast("int"))
    ranges = F.transform("s", lambda x, i: F.struct(x["global_index"].alias("global_index"), before(i).alias("first_word"), x["n_words"].cast("int").alias("n_words")))
    return rows.select(*keys, before(F.size("s")).alias("n_words"), ranges.alias("ranges"))


def word_range(ranges: Column, word: Column) -> Column:
    """The range of chunk_words that holds a word of the chunk; null if none does."""
    holds = F.filter(ranges, lambda r: (r["first_word"] <= word) & (word < r["first_word"] + r["n_words"]))
    return F.get(holds, F.lit(0))


def highlights(positions: DataFrame, chunks: DataFrame, sentences: DataFrame, keys: tuple = ("doc_id", "chunk_index")) -> DataFrame:
    """(position's columns, sentence_index, word_index) for positions (keys, ts, time, duration); none where there is no duration, chunk or word.

    chunks have n_words and may have word_timings.
    """
    c = chunks.select(*keys, F.col("n_words").alias("_n"), (F.col("word_timings") if "word_timings" in chunks.columns else F.lit(None).cast("array<double>")).alias("_timings"))
    usable = positions.filter("duration > 0 and not isnan(duration) and duration < double('infinity')")
    target = usable.join(c, list(keys)).filter("_n > 0").withColumn("word", word_at_time(F.col("_n"), F.col("time"), F.col("duration"), F.col("_timings"))).drop("_n", "_timings")
    return locate_word(target, sentences, keys).withColumnRenamed("global_index", "sentence_index").drop("word")


def highlight_changes(rows: DataFrame, key: str = "session_id", order: str = "ts") -> DataFrame:
    """Rows whose (sentence, word) differs from the one before, with past_sentence, the sentence that is then over."""
    w = Window.partitionBy(key).orderBy(order)
    seen = rows.withColumn("_s", F.lag("sentence_index").over(w)).withColumn("_w", F.lag("word_index").over(w))
    changed = seen.filter(~(F.col("_s").eqNullSafe(F.col("sentence_index")) & F.col("_w").eqNullSafe(F.col("word_index"))))
    return changed.withColumn("past_sentence", F.when(F.col("_s") != F.col("sentence_index"), F.col("_s"))).drop("_s", "_w")


def chunk_timeline(jobs: DataFrame, key: str = "session_id") -> DataFrame:
    """jobs (session_id, chunk_index, duration) with starts_at, ends_at, and finishes on the last chunk of a session."""
    w = Window.partitionBy(key).orderBy("chunk_index")
    rows = jobs.withColumn("starts_at", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.withColumn("ends_at", F.col("starts_at") + F.col("duration")).withColumn("finishes", F.lead("chunk_index").over(w).isNull())
