"""Numbers and carried values along an order, with groups that hold most of the rows."""

import bisect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import jobs, order, reading


def hot(seed, n):
    """Rows (group, order, id) of which two thirds are in one group, with ties in the order."""
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "a", "b", None, "c"][: 6 if k % 3 == 0 else 2]), r.randint(0, n // 4), k) for k in range(n)]


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows, so that groups span many of them."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_ranked(spark, many_ranges, n):
    rows = hot(1, n)
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(5)
    got = defaultdict(list)
    for r in order.ranked(df, ["g"], [F.desc("o"), F.desc("id")], "rank").collect():
        got[r.g].append((r["rank"], r.id))
    want = defaultdict(list)
    for g, o, i in sorted(rows, key=lambda x: (-x[1], -x[2])):
        want[g].append((len(want[g]) + 1, i))
    assert {g: sorted(v) for g, v in got.items()} == dict(want)


def test_a_hot_group_is_spread_over_ranges(spark, many_ranges):
    df = spark.createDataFrame(hot(2, 900), "g string, o int, id int")
    parts = order.ranged(df, F.col("g"), F.col("o"), F.col("id")).groupBy("g").agg(F.countDistinct("_part").alias("n"), F.count("*").alias("rows"))
    n = {r.g: (r.n, r["rows"]) for r in parts.collect()}
    assert n["hot"][1] > 600 and n["hot"][0] >= 8


@pytest.mark.parametrize("n", [0, 2, 60, 600])
def test_asof_of_a_hot_session(spark, many_ranges, n):
    r = random.Random(n)
    session = lambda k: "hot" if k % 4 else r.choice(["a", None, "b"])
    timings = [(session(k), k, float(r.randint(0, n // 2))) for k in range(n)]
    positions = [(session(k), k, r.randint(-2, n) / 2) for k in range(n)]
    t = spark.createDataFrame(timings, "session_id string, word int, start double")
    p = spark.createDataFrame(positions, "session_id string, n int, time double")
    by = defaultdict(list)
    for s, w, at in timings:
        by[s].append((at, w))
    by = {s: sorted(x) for s, x in by.items()}

    def want(s, time):
        k = bisect.bisect_right(by.get(s, []), (time, float("inf")))
        return by[s][k - 1][1] if k else 0

    got = {x.n: x.word for x in reading.asof_word(p, t).collect()}
    assert got == {k: want(s, time) for s, k, time in positions}


def test_next_jobs_are_those_of_each_model(spark):
    rows = [("job-1", 1, "a", "pending", 5), ("job-2", 2, "b", "pending", 9), ("job-3", 3, "a", "done", 11), ("job-4", 4, "c", "pending", 9)]
    queue = spark.createDataFrame(rows, "job_id string, job_no int, model_id string, status string, created_at int")
    models = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "model_id string")
    each = {m: [r.job_id for r in jobs.next_job(queue, m).collect()] for m in "abc"}
    assert each == {"a": [], "b": [], "c": ["job-4"]}
    assert [(r.model_id, r.job_id) for r in jobs.next_jobs(queue, models).collect()] == [("c", "job-4")]


def test_symbols_beyond_the_first_plane(spark):
    """Emoji are two units, as are characters of the plane in which symbols are looked up; unknown ones of the first plane are one."""
    text = "a\U0001f600b\U00100007\U0010ffff￿é"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    vocabulary = {"$": 3, "a": 7, "b": 9, "é": 59_999, "\U0001f600": 8, "ab": 5, "￿": 4}
    got = [r[0] for r in df.select(T.symbol_ids(F.col("t"), vocabulary)).collect()]
    units = [7, 0, 0, 9, 0, 0, 0, 0, 0, 59_999]
    assert got == [[3, *units, 3], [3, 3], None]
    with pytest.raises(ValueError):
        T.symbol_ids(F.col("t"), {"a": 60_000})
