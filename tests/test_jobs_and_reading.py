import datetime as dt
import random
from functools import cmp_to_key

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.operators import audio, catalog, jobs, layout, reading
from lectern.plans import layout as layout_plans

T0 = dt.datetime(2024, 1, 1)


def test_pcm_and_speed(spark):
    df = spark.createDataFrame([([2.5, -3.0, float("nan"), 1.0],), ([-0.99998, 0.99998, 1.0, -1.0],), ([],)], "a array<float>")
    assert [r.x for r in df.select(A.pcm16(F.col("a")).alias("x")).collect()] == [[32767, -32768, 0, 32767], [-32767, 32766, 32767, -32768], []]
    ramp = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i.cast("float")).alias("a"))
    fast, slow, same = ramp.select(*[A.change_speed(F.col("a"), F.lit(s)).alias(f"s{i}") for i, s in enumerate((2.0, 0.5, 1.0))]).first()
    assert len(fast) == 500 and len(slow) == 2000 and len(same) == 1000 and fast[10] == 20.0 and slow[3] == 1.5
    quiet = spark.createDataFrame([([0.05, -0.02],), ([0.5],), ([0.0],)], "a array<float>").select(A.normalize_quiet(F.col("a")).alias("x")).collect()
    assert [round(r.x[0], 4) for r in quiet] == [0.5, 0.5, 0.0]


def test_word_timings(spark):
    s = spark.createDataFrame([("j", 0, "ab c", 2400), ("j", 1, "  ", 9999), ("j", 2, "de", 2400), ("k", 0, "", 10)], "job_id string, seq int, phonemes string, n_samples int")
    n = spark.createDataFrame([("j", 4), ("k", 2)], "job_id string, n_words int")
    rows = {r.job_id: r.word_timings for r in audio.word_timings(s, n).collect()}
    assert list(rows) == ["j"] and rows["j"] == pytest.approx([0, 0.1 / 3, 0.2 / 3, 0.1])


def test_synthesis(spark):
    backends = audio.Backends()

    def speak(batches):
        for b in batches:
            if (b["text"] == "bad").any():
                raise ValueError("cannot speak")
            yield pd.DataFrame({"job_id": b["job_id"], "audio": [[0.1] * len(t) for t in b["text"]], "sample_rate": 8000, "word_timings": None})

    backends.register("m", None)
    backends.register("m", speak)
    df = spark.createDataFrame([("1", "m", "hey"), ("2", "m", "bad"), ("3", "x", "hey")], "job_id string, model_id string, text string")
    rows = {r.job_id: r for r in audio.synthesize(df, backends).collect()}
    assert len(rows["1"].audio) == 3 and rows["1"].error is None
    assert rows["2"].error == "cannot speak" and rows["3"].error == "Custom engine for x not registered"
    backends.unregister("m")
    with pytest.raises(KeyError):
        backends.of("m")


def test_catalogue(spark):
    models = catalog.models_df(spark)
    assert models.count() == 14 and catalog.catalogue_checks(models).count() == 0
    assert [r.language for r in catalog.supported_languages(models).orderBy("position").collect()] == ["en", "ar", "de", "es", "fr", "hi", "ko", "pt", "ru"]
    voices = catalog.voices_df(models)
    assert voices.count() == 28 * 2 + 2 + 8 * 2 and voices.filter("voice_id = 'af_heart'").first().name == "Heart (en-us, Female)"


@pytest.fixture(scope="module")
def queue(spark):
    rows = [
        (f"job-{i}", i, m, s, T0 + dt.timedelta(seconds=i), None, None, "s") for i, (m, s) in enumerate(
            [("a", "pending"), ("a", "pending"), ("b", "pending"), ("a", "generating"), ("b", "done")],
            1
        )
    ]
    return spark.createDataFrame(rows, "job_id string, job_no int, model_id string, status string, created_at timestamp, completed_at timestamp, error string, session_id string")


def test_queue(spark, queue):
    assert jobs.next_job(queue, "a").count() == 0 and jobs.next_job(queue, "b").first().job_id == "job-3"
    assert [r.job_id for r in jobs.drain_order(queue).filter("model_id = 'a'").orderBy("run_order").collect()] == ["job-2", "job-1"]
    assert jobs.queue_counts(queue).first().label == "1 running · 4 in queue"
    switched = {r.job_id: r.status for r in jobs.cancel_on_switch(queue, "b", F.current_timestamp()).collect()}
    assert switched == {"job-1": "cancelled", "job-2": "cancelled", "job-3": "pending", "job-4": "generating", "job-5": "done"}
    ids = spark.createDataFrame([("job-4",), ("job-5",), ("zz",)], "job_id string")
    assert {r.job_id for r in jobs.cancel_jobs(queue, ids, F.current_timestamp()).filter("status = 'cancelled'").collect()} == {"job-4"}
    results = spark.createDataFrame([("job-4", False, "boom", T0), ("job-5", False, "late", T0), ("zz", True, None, T0)], "job_id string, ok boolean, message string, at timestamp")
    after = {r.job_id: (r.status, r.error) for r in jobs.apply_results(queue, results).collect()}
    assert after["job-4"] == ("error", "boom") and after["job-5"] == ("done", None) and len(after) == 5
    assert {r.job_id for r in jobs.clear_finished(queue).collect()} == {"job-1", "job-2", "job-3", "job-4"}


def test_buffered(spark):
    df = spark.createDataFrame(
        [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 0, False), ("c", 0, True), ("c", 1, True), ("d", 0, None)],
        "session_id string, chunk_index int, ready boolean"
    )
    assert {r.session_id: r.buffered_index for r in jobs.buffered_index(df).collect()} == {"a": 1, "b": -1, "c": 1, "d": -1}


@pytest.mark.parametrize(
    "n,time,duration,timings,word",
    [
        (6, 1.5, 6.0, [0.0, 1, 2, 3, 4, 5], 1),
        (6, 3.0, 6.0, [0.0, 1, 2, 3, 4, 5], 3),
        (10, 5.0, 10.0, None, 5),
        (10, 100.0, 10.0, None, 9),
        (10, float("nan"), 10.0, None, 0),
        (10, 5.0, 10.0, [0.0, 9.0], 5),
        (0, 1.0, 1.0, None, 0),
        (3, -1.0, 2.0, [0.0, 1, 2], 0),
        (3, float("inf"), 2.0, [0.0, 1, 2], 0)
    ]
)
def test_word_at_time(spark, n, time, duration, timings, word):
    df = spark.createDataFrame([(n, time, duration, timings and [float(x) for x in timings])], "n int, t double, d double, w array<double>")
    assert df.select(reading.word_at_time(F.col("n"), F.col("t"), F.col("d"), F.col("w"))).first()[0] == word


def test_lines_of_words(spark):
    rows = [("d", 1, 1000.0, i, t, (x, y, x + 9, y + 10)) for i, (t, x, y) in enumerate([("b", 50.0, 12.0), ("a", 10.0, 10.0), ("c", 10.0, 80.0), (" ", 10.0, 500.0)])]
    words = spark.createDataFrame(rows, "doc_id string, page int, page_height double, seq int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    blocks = layout.line_blocks(layout.words_to_lines(words)).orderBy("line_no").collect()
    assert [(b.text, b.x, b.y, b.width, b.height) for b in blocks] == [("a b", 5.0, 5.0, 24.5, 6.0), ("c", 5.0, 40.0, 4.5, 5.0)]


def test_word_lines_of_all_pages(spark, tmp_path):
    r = random.Random(8)
    items = [(page, line, r.randint(1, 2000), float(r.randint(1, 50)), float(r.randint(900, 9000))) for page in range(1, 41) for line in range(1, r.randint(2, 8))]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = {}
    for page in range(1, 41):
        words = sorted((q * 10, x, part * 100 + line) for p, line, part, q, x in items if p == page)
        words.sort(key=cmp_to_key(lambda a, b: a[0] - b[0] if abs(a[0] - b[0]) > 15 else a[1] - b[1]))
        tops = []
        for top, _, _ in words:
            near = [i for i, y in enumerate(tops) if abs(y - top - 3) <= 15]
            if near:
                tops[near[0]] = min(tops[near[0]], top)
            else:
                tops.append(top + 3)
        expected[str(page // 1000), page] = (len(tops), len(words))
    got = layout_plans.word_lines(spark, str(tmp_path)).collect()
    assert {(g.doc_id, g.page): (g.lines, g.words) for g in got} == expected and len(got) == 40


def test_lines_of_items(spark):
    df = spark.createDataFrame(
        [("p", 1, 0, "a", 100.0), ("p", 1, 1, "", 50.0), ("p", 1, 2, "b", 98.0), ("p", 1, 3, "c", 80.0), ("p", 2, 0, "d", 80.0)],
        "path string, page int, seq int, str string, y double"
    )
    lines = layout.items_to_lines(df)
    assert layout.assemble_document(lines).first().text == "a b\n\nc\n\nd"
    kept, report = layout.cap_pages(df, 1)
    assert kept.count() == 4 and report.first().truncated


def plain_lines(words):
    """The fold in its plain form: each word in reading order joins the first line near its centre, or begins one."""
    import functools

    limit = words[0]["h"] * 0.025
    rows = sorted(words, key=lambda w: (w["y0"], w["x0"], w["seq"]))
    rows = sorted(rows, key=functools.cmp_to_key(lambda a, b: a["y0"] - b["y0"] if abs(a["y0"] - b["y0"]) > limit else a["x0"] - b["x0"]))
    tops, out = [], {}
    for w in rows:
        centre = (w["y0"] + w["y1"]) / 2
        near = [k for k in range(len(tops)) if abs(tops[k] - centre) <= limit]
        if near:
            tops[near[0]] = min(tops[near[0]], w["y0"])
        else:
            tops.append(centre)
        out[w["seq"]] = near[0] if near else len(tops) - 1
    return out


def test_words_to_lines_is_the_plain_fold(spark):
    r = random.Random(4)
    pages = {
        (f"d{d}", p): [
            {
                "seq": k,
                "h": 600.0,
                "y0": (y := r.uniform(0, 200)),
                "y1": y + r.uniform(2, 12),
                "x0": r.choice([1.0, r.uniform(0, 400)])
            } for k in range(r.randint(1, 60))
        ] for d in range(6) for p in range(5)
    }
    rows = [(d, p, w["h"], w["seq"], "t", (w["x0"], w["y0"], w["x0"] + 5, w["y1"])) for (d, p), ws in pages.items() for w in ws]
    df = spark.createDataFrame(rows, "doc_id string, page int, page_height double, seq int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # so that pages span batches
    try:
        got = {(x.doc_id, x.page, x.seq): x.line_id for x in layout.words_to_lines(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, p, seq): line for (d, p), ws in pages.items() for seq, line in plain_lines(ws).items()}


def test_dense_number(spark):
    values = [5, 10**12, -3, 0, 7 * 10**9] + list(range(100, 160))
    rows = jobs.dense_number(spark.createDataFrame([(v,) for v in values], "v long").repartition(4), "v").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r._n)] == sorted(values) and sorted(r._n for r in rows) == list(range(1, len(values) + 1))


def test_backends_are_given_bounded_texts(spark):
    """However many jobs a batch has, a call of a backend gets about AT_ONCE characters, and one that fails spoils no other call."""
    from lectern.operators import audio

    def backend(batches):
        import pandas as pd

        for rows in batches:
            if (rows["text"] == "").any():
                raise ValueError("nothing")
            size = int(rows["text"].str.len().sum())
            yield pd.DataFrame({"job_id": rows["job_id"], "audio": [[0.0]] * len(rows), "sample_rate": size, "word_timings": None})

    backends = audio.Backends()
    backends.register("m", backend)
    jobs = spark.range(41).selectExpr("cast(id as string) as job_id", "'m' as model_id", "repeat('x', if(id = 40, 0, 4000)) as text").coalesce(1)
    rows = {r.job_id: r for r in audio.synthesize(jobs, backends).collect()}
    assert len(rows) == 41 and rows["40"].error == "nothing" and all(r.error is None for k, r in rows.items() if k != "40")
    assert max(r.sample_rate or 0 for r in rows.values()) <= audio.AT_ONCE
