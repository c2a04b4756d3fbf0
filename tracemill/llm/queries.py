"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontam, jaccard, lines, minhash, pages, piece_codec, quality, sharding, spans, target_resampling, token_counts
from .common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read_table(spark, sf_dir, "documents"), n_shards=16)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_matched", "coverage", "kind")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, read_table(spark, sf_dir, "labels"), carry=["doc_id"])


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.drop_repeated_spans(docs, changed_only=True, grow=True)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, percent=75)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read_table(spark, sf_dir, "pages"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return target_resampling.resample_to_target(docs, read_table(spark, sf_dir, "benchmark"), percent=10, buckets=10_000, min_words=1, max_words=1, least_words=20, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_token_counts, op4_quality, op5_piece_codec, op6_spans, op7_neighbours, op8_jaccard, op9_lines, op10_pages, op11_minhash, op12_alignment, op13_target)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.ORACLE, "op8_jaccard": jaccard.ORACLE, "op9_lines": lines.ORACLE, "op11_minhash": minhash.ORACLE, "op13_target": target_resampling.ORACLE}
