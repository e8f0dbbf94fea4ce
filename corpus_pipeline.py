"""A training-data pipeline over `documents`: quality, near-copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before kept. `run` writes each stage's result
as Parquet to the shared folder and reads it again; what a stage stored on its way is deleted then. All but the last return the columns of
`documents`, and further columns whatever their names; the last returns a row for each document with the number of its tokens and the digests of its
token ids and decoded bytes. Every stage takes texts whole, however long, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import bpe, decontaminate, near_join, pii, quality
from tidepool.llm._common import forget, settled, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null texts, texts without words and perplexities equal to a threshold are kept;
    repeated rows are judged alike and stay together."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the least id, of repeated rows (equal id and text) one. Null texts and texts without words are
    nobody's copies and all stay, repeated rows among them."""
    return near_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`. Null and empty texts hold none; repeated rows go or stay together; without items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked in their texts. Null texts stay null; of candidates that tie the earlier, then the longer is
    masked; repeated rows are masked alike."""
    return pii.redact(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; null texts count as empty ones, repeated rows each give a row, other
    columns are left out."""
    import public_tokenizers

    encoded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("byte_bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(lambda s=stage, d=docs: s(spark, d, sf_dir), f"pipeline-{name}")
        forget(before)
    return docs


#: Classifier, MinHash and tokens have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None
