"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ontolith.llm import backoff, chat, decontaminate, embeddings, line_dedup, minhash, mixing, passages, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document of its near-duplicate class."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fold."""
    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from normalised archives."""
    return warc.archive(_table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier three-line windows."""
    return line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the role that its transcript shows, rendered."""
    return chat.recover(_table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language-model score, with counts over all documents."""
    return backoff.scores(_table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of words that repeats a passage of another place."""
    return passages.repeated(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_decontaminate, op3_toxicity, op4_warc, op5_line_dedup, op6_chat, op7_mixing, op8_backoff, op9_embeddings, op10_passages)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op4_warc": warc.SQL, "op5_line_dedup": line_dedup.SQL, "op8_backoff": backoff.SQL}
