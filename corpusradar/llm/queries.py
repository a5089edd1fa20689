"""Registered queries of this subpackage, and the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusradar.llm import (byte_bpe, exact_dedup, hard_negatives, language_id, minhash_tensor, ngram_join, packing, pii, progressive_jpeg, quality,
                             ranked_search, reply_trees, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_salvage": warc.query,
    "op2_progressive_jpeg": progressive_jpeg.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_reply_trees": reply_trees.query,
    "op5_quality": quality.query,
    "op6_best_fit_packing": packing.query,
    "op7_language_id": language_id.query,
    "op8_ngram_join": ngram_join.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_pii": pii.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_ranked_search": ranked_search.query,
    "op13_minhash_tensor": minhash_tensor.query,
    "language_id_pages": language_id.pages_query,
    "ngram_links": ngram_join.links_query,
}

ORACLES: dict[str, str] = {
    "op1_warc_salvage": warc.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_reply_trees": reply_trees.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_ranked_search": ranked_search.SQL,
}
