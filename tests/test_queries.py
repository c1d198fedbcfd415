"""Every query with SQL against that SQL in DuckDB, and every other one for rows."""

import glob
import math
import os

import duckdb
import pytest

from lectern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return c


def cell(x):
    return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


ODD_PAGES = [
    "<p>a&&&ampHaan &am &ampamp; &amp;copy &copyright &notit; &quot &NotEqualTilde; &bogus; &amp</p>",
    "&#0;&#150;&#150 x&#129;&#xD800;&#x110000;&#99999999;&#xFFFFFFFFF;&#x41;&#065 &#x;&#; &#38;lt;",
    "<script src='a>b'>x</script y>one<title>t</title ><STYLE>s</style>two<template/>no</template><noscript>",
    "<p title='a > b' x=\"c > d\" y=e>in</p><a t=\"b>c x <b ==q>d</b><!--> x --> y <!-- z --!> w <!doctype q> </ p> <1 < 2",
    "<scripty>kept</scripty><!-- never closed",
    "\u000b  <title>gone",
    "",
    None,
]


@pytest.mark.parametrize("name", ["html_text", "html_references", "html_quarantine", "extracted_corpus"])
def test_pages_with_any_markup_and_references(spark, tmp_path, name):
    """The SQL states the rule of the queries for all references and tags, and not for those of one table only."""
    tables = {
        "pages": (list(enumerate(ODD_PAGES)), "page_id long, html string"),
        "documents": ([(1, "a"), (2, None), (10, "b")], "doc_id long, text string"),
        "conversations": ([(1, 1, "user", 'say "x"'), (1, 2, "bot", None)], "conv_id long, turn long, role string, text string"),
    }
    duck = duckdb.connect()
    for t, (rows, ddl) in tables.items():
        path = str(tmp_path / f"{t}.parquet")
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path)
        duck.execute(f"create view {t} as select * from '{path}/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    cursor = duck.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})")
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(cell, r)) for r in cursor.fetchall())


def test_word_lines_is_bounded_in_a_task(spark, sf_dir):
    """Lines are counted by their last number, so a page is one row of the aggregate, and the words are dealt to partitions that follow the table's splits."""
    from lectern.operators import layout

    df = registry.QUERIES["word_lines"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and "hashpartitioning(doc_id" in plan and plan.count("keys=[doc_id") == 2
    splits = spark.read.parquet(f"{sf_dir}/lineitem.parquet").rdd.getNumPartitions()
    assert f", {max(4, layout.SPLIT * splits)}), REPARTITION_BY_NUM" in plan
