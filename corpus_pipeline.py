"""A training-corpus pipeline over ``documents``: each stage keeps, orders or encodes what the one before it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chronoloom.llm import decontaminate, mixing, simhash, tokens, toxicity
from chronoloom.llm.queries import byte_bpe, table
from chronoloom.llm.storage import materialize, scratch

END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels that are not held out."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies: five-word shingles, similarity 0.8 or more.

    By the binomial formula for differing bits a pair of similarity 0.8 is found with chance 0.9998; each link is verified.
    """
    return simhash.drop_near_duplicates(docs, lanes=3, limit=48, key_bits=13, recall=0.9999, verify=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the shingles of every benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture; files written from it keep the order."""
    return mixing.mix(docs)


def stored_order(docs: DataFrame) -> list[Column]:
    """Sort columns that give the rows as they lie in the files; the order of ids where they come from no files."""
    columns = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*columns)
    except AnalysisException:
        return [F.col("doc_id")]
    return columns


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture, read back: (doc_id, start, n_tokens, ids_crc32)."""
    uri = scratch(spark, "pipeline-tokens")
    tokens.write_token_files(docs, uri, byte_bpe(), END_ID, order=stored_order(docs))
    return tokens.digest_tokens(spark, uri)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]
#: A learned classifier, hashes and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
