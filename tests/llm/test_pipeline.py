import zlib

import pytest

from lectern.llm import queries
from tests.llm.conftest import edited, frame, prose
from tests.llm.test_dedup import UP, near_oracle

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, words, tmp_path):
    """The stages against plain Python on a planted corpus: what goes, what stays, and what is packed."""
    texts, labels = {}, []
    for k in range(400):
        text = prose(words, k, 30 + k % 50)
        if k % 8 == 0:
            text += " grobla grobli groblu groblo"
        texts[k] = text
        labels.append((k, int(k % 8 == 0), 1))
    for k in range(400, 420):
        texts[k] = texts[1].upper()
    for k in range(420, 440):
        texts[k] = edited(texts[2] + " " + prose(words, 999, 60), words, k, 0.01)
    texts[440] = "key token=q8Zr4kL0pX7vB2nM here"
    texts[441] = None
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.text for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert set(texts) - set(kept) == {k for k in range(0, 400, 8)}
    groups = {}
    for i, t in kept.items():
        body = (t or "").translate(UP)
        groups[body] = max(groups.get(body, -1), i)
    once = {i: texts[i] for i in groups.values()}
    near = {i for i, (_, _, keep) in near_oracle(once).items() if keep}
    assert near < set(once)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == near
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        text = "key <secret> here" if r.doc_id == 440 else once[r.doc_id] or ""
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_names():
    assert {n for n in range(1, 14)} == {int(k[2:].split("_")[0]) for k in queries.QUERIES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]


CLASHING = ("gone_id", "gone_digest", "digest", "row", "spans", "new", "id", "linked", "uid", "node", "best_id", "component", "score", "label")
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
FILLER = [(1000 + k, k % 5 == 0) for k in range(60)]


def odd(spark, words, tmp_path, texts):
    """Rows (doc_id, text) among filler that the model learns from, with columns whose names the operators use inside."""
    filler = [(i, prose(words, i, 25) + (" grobla grobli groblu" if bad else "")) for i, bad in FILLER]
    rows = [(i, t, None, None, None, *CLASHING) for i, t in [*texts, *filler]]
    spark.createDataFrame([(i, int(bad), 1) for i, bad in FILLER], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.createDataFrame(rows, DDL).repartition(3)


def test_stages_of_odd_rows(spark, words, tmp_path):
    """Repeated and null ids, null and empty texts and clashing names, in each stage on its own."""
    a, b, c = (prose(words, k, 40) for k in range(3))
    a2 = edited(a + " " + prose(words, 9, 40), words, 1, 0.0)
    long_a = a + " " + prose(words, 9, 40) + " tail"
    secret = "my token=q8Zr4kL0pX7vB2nM here"
    texts = [(1, a2), (1, a2), (1, b), (None, c), (None, c), (2, long_a), (3, None), (3, ""), (4, secret), (4, secret), (5, a2.upper())]
    docs = odd(spark, words, tmp_path, texts)
    stages = dict(corpus_pipeline.STAGES)

    def left(stage):
        out = stages[stage](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = [r for r in out.collect() if r.doc_id is None or r.doc_id < 1000]
        assert all(r[x] == x for r in rows for x in CLASHING)
        return sorted(((r.doc_id, r.text) for r in rows), key=str)

    assert left("toxicity") == sorted(texts, key=str)
    exact = left("exact_dedup")
    assert sorted(i for i, _ in exact if i is not None) == [1, 2, 3, 4, 5] and (1, b) in exact and (5, a2.upper()) in exact
    assert [t for i, t in exact if i is None] == [c]
    near = left("near_dedup")
    assert [t for i, t in near if i == 1] in ([a2, b], [b, a2]) and not any(i in (2, 5) for i, _ in near)
    assert [t for i, t in near if i is None] == [c, c] and sum(i == 3 for i, _ in near) == 2 and sum(i == 4 for i, _ in near) == 1
    masked = left("secrets")
    assert len(masked) == len(texts) and [t for i, t in masked if i == 4] == ["my <secret> here"] * 2
    assert sorted((i, t) for i, t in masked if i in (1, 2, 5)) == sorted((i, t) for i, t in texts if i in (1, 2, 5))
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len(pieces) == docs.count() and sum(p.doc_id is None for p in pieces) == 2 and sum(p.doc_id == 3 for p in pieces) == 2


def test_stages_of_an_empty_table(spark, words, tmp_path):
    docs = odd(spark, words, tmp_path, [])
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == [], name
        assert name == "packing" or out.columns == docs.columns
