"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import bpe, codes, exact_dedup, line_dedup, mixing, neardup, negatives, packing, pages, pii, secrets, tiff, toxicity
from lectern.llm.common import table


def op1_tiff_pages(spark, sf_dir):
    pages = tiff.tiff_pages(tiff.store_texts(table(spark, sf_dir, "documents", "doc_id")), size_col="n_bytes", samples=False)
    return pages.drop("samples")


def op2_secret_ownership(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id"))


def op3_toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_chosen_path(spark, sf_dir):
    return neardup.near_groups(table(spark, sf_dir, "documents", "doc_id"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id"))


def op6_similar_lines(spark, sf_dir):
    return line_dedup.drop_lines(table(spark, sf_dir, "documents", "doc_id"))


def op7_information_sanitising(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents", "doc_id"))


def op8_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack_texts(table(spark, sf_dir, "documents", "doc_id"), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False).drop("ids")


def op10_best_region(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "page_id")
    return pages.main_text(rows, pages.fit(rows))


def op11_cube_mixing(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents", "doc_id"))


def op12_tree_negatives(spark, sf_dir):
    """Labels of ids divisible by 7 are one further, which makes some of them wrong."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.integer_points(table(spark, sf_dir, "embeddings", "vec_id").withColumn("label", shifted)))


def op13_cover_tree_codes(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings", "vec_id"))


QUERIES = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_chosen_path": op4_chosen_path,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_similar_lines": op6_similar_lines,
    "op7_information_sanitising": op7_information_sanitising,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_best_region": op10_best_region,
    "op11_cube_mixing": op11_cube_mixing,
    "op12_tree_negatives": op12_tree_negatives,
    "op13_cover_tree_codes": op13_cover_tree_codes,
}

ORACLES = {
    "op4_chosen_path": neardup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_similar_lines": line_dedup.ORACLE,
    "op12_tree_negatives": negatives.ORACLE,
    "op13_cover_tree_codes": codes.ORACLE,
}
