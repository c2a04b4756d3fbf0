"""A corpus pipeline of five stages, each one of the training-data operators over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontam, jaccard, lines, piece_codec, quality
from tracemill.llm.common import free_name, read_table, recording, release, stored
from tracemill.llm.queries import tokenizer_file


def _aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its own columns of the names that an operator gives its results under other names, and those names."""
    names = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(names), names


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps; those it rejects go."""
    own, names = _aside(docs, "log_weight", "gumbel_key")
    return quality.resample(own, read_table(spark, sf_dir, "labels")).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of recurring templates; n_chars is the length of what stays."""
    own, names = _aside(docs, "n_lines", "n_dropped")
    cut = lines.drop_recurring_lines(own)
    return cut.select(*(F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars") if c == "n_chars" else F.col(names.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Texts without words are in no group."""
    return jaccard.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as written or with other numbers and names."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    return piece_codec.piece_round_trip(docs, tokenizer_file("piece_bpe_32k.model"), with_text=True).drop("decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: The classifier and the encoder have no SQL form. tests/llm holds each stage against brute force, SQL or the library, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is stored in the shared folder and read again. What a stage stored on its way, and its input, is deleted once its output lies there."""
    docs, last = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recording() as own:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, [*last, *own[:-1]])
        last = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
