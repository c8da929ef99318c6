"""The queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, languages, mixing, neighbours, pii, resampling, simhash, suffixes, tokens, toxicity, tries, warc
from .storage import scratch

#: Key of the surrogates that the registered query draws; a real run keeps its own secret.
PII_KEY = b"example key of the registered query"
ORACLE_SQL: dict[str, str] = {
    "op6_size_partitioned_minhash": decontaminate.ORACLE_SQL,
    "op9_pfair_mixing": mixing.ORACLE_SQL,
    "op11_conversation_trie": tries.ORACLE_SQL,
    "op13_importance_resampling": resampling.ORACLE_SQL,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with surrogates for personal data: (doc_id, text, n_replaced)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "n_replaced")


def op2_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` whose 64-bit fingerprints of 3-word shingles link at 2 or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, lanes=1, limit=2, key_bits=None)


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all ``pages``, read back and assembled: one row for each capture."""
    uri = scratch(spark, "op3")
    warc.write_archives(table(spark, sf_dir, "pages"), uri)
    return warc.digest_captures(spark, uri)


def op4_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes that strings of 400 bytes cover which also start elsewhere.

    ``text`` is what is left, with a mark where a cut falls inside a character.
    """
    made = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all ``documents`` in doc_id order, read back: where each document starts, its length, its checksum."""
    uri = scratch(spark, "op5")
    tokens.write_token_files(table(spark, sf_dir, "documents"), uri, byte_bpe(), 2)
    return tokens.digest_tokens(spark, uri)


def op6_size_partitioned_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` of which ``documents`` hold 0.8 or more of the 5-word shingles."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_nb_scaled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from the labels that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all ``embeddings`` for each whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all ``documents`` in a mixture by the square roots of the sources' sizes."""
    made = mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return made.select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "place")])


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all ``conversations``, rebuilt to share their groups' openings."""
    return tries.prefix_trie(*tries.rebuilt(tries.ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents``, learned from those that are not held out, with spans of each language."""
    return languages.identify(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all ``documents`` towards ``benchmark`` and the draw of five of a hundred."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_simhash_gray_index": op2_simhash_gray_index,
    "op3_warc_transactions": op3_warc_transactions,
    "op4_columnwise_suffix_dedup": op4_columnwise_suffix_dedup,
    "op5_ranked_token_files": op5_ranked_token_files,
    "op6_size_partitioned_minhash": op6_size_partitioned_minhash,
    "op7_nb_scaled_toxicity": op7_nb_scaled_toxicity,
    "op8_collision_counting": op8_collision_counting,
    "op9_pfair_mixing": op9_pfair_mixing,
    "op10_wrapper_induction": op10_wrapper_induction,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_language_spans": op12_language_spans,
    "op13_importance_resampling": op13_importance_resampling,
}
