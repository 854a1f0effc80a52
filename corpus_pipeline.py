"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again as the next stage's documents. All but the last return the columns of
documents. Other columns of documents are dropped; empty tables give empty stages; documents with a
null text or doc_id pass every stage but the last, which has them with size 0 or a null doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontolith.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from ontolith.plans.shared import discard, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones outside the held-out fold, doesn't reject; null texts stay."""
    return toxicity.score(docs.select(COLUMNS), _table(spark, sf_dir, "labels")).where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier windows; documents that lose all their lines go."""
    cut = line_dedup.drop_repeated_lines(docs.select(COLUMNS))
    cut = cut.where("n_removed = 0 OR n_removed < n_lines")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id, once.

    Of rows that share a doc_id the one with the least text stays, the text that was compared; of those
    that share it too, the least row. Rows without a doc_id all stay.
    """
    docs = docs.select(COLUMNS)
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    stay = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(COLUMNS)
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if not again.isEmpty():
        row = F.min(F.struct(F.col("text").isNull().alias("none"), *COLUMNS[1:])).alias("row")
        least = stay.join(again, "doc_id").groupBy("doc_id").agg(row).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS[1:]])
        stay = stay.join(again, "doc_id", "left_anti").select(COLUMNS).unionByName(least)
    return stay.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(COLUMNS), _table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes from it."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return docs


#: Scores of a trained classifier decide the first stage, which SQL can't express.
ORACLE_SQL = None
