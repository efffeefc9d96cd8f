"""One query per operator over its whole table; each derives the contract's columns from the operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
BPE_FILE, LIMIT = "byte_bpe_50k.json", 1024


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _crc(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    usable = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1
    net = train(docs, usable)
    return identify(docs, net).select("doc_id", (F.coalesce(_crc(3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    counts = token_counts(_docs(spark, sf_dir), public_tokenizers.path(BPE_FILE), budget=LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._scratch import scratch_path
    from .token_files import digests, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(_docs(spark, sf_dir), path, public_tokenizers.path(BPE_FILE), end_id=2)
    return digests(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(BPE_FILE))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    scores = score_texts(docs, _crc(7) != 2)
    return scores.select("doc_id", F.coalesce(_crc(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 8).alias("base_score"), F.round("score", 8).alias("score"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_docs(spark, sf_dir).select("doc_id", "text"))[0].select("doc_id", "n_shingles", "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


_ALL = (
    op1_language_id, op2_embedding_dedup, op3_quality_rules, op4_token_counts, op5_lm_scores,
    op6_token_files, op7_packing, op8_ngram_jaccard, op9_mixing, op10_substring_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
