"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.llm import darts, near
from ontolith.llm import text as T
from ontolith.plans.shared import discard, written

ROWS, BANDS = 6, 40
SIMILAR = 0.8
_SIGNED = "doc_id long, d1 long, d2 long, bands array<long>"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [T.word_hashes(x or "") for x in batch["text"]]
        ids = batch["doc_id"].array
        keys: list = [None] * len(words)
        some = [i for i, w in enumerate(words) if len(w)]
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            signature = darts.signatures([T.bag(T.shingle_hashes(words[i])) for i in part], ROWS * BANDS)
            for i, row in zip(part, darts.bands(signature, ROWS), strict=True):
                keys[i] = row
        digests = [T.digest(w) if len(w) else (None, None) for w in words]
        yield pd.DataFrame({"doc_id": ids, "d1": pd.array([d[0] for d in digests], "Int64"), "d2": pd.array([d[1] for d in digests], "Int64"), "bands": keys})


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id, kept: one row per row of ``docs``.

    Two texts are linked if their bags of five-word shingles (words as in ``text``; a shorter text is
    one shingle) have a weighted Jaccard similarity of ``least`` or more. A class is a connected
    component of links, class_id its smallest doc_id, and the row with kept is that document. Texts
    with equal words are copies: they are collapsed first and only one of them is compared. Null and
    empty texts, and those without a word, are linked with nothing. Rows that share a doc_id are one
    document, kept or not together; should their texts differ, the least one stands for it. A null doc_id has a null class_id and is kept.

    40 bands of 6 values find a pair at similarity 0.8 with probability 1 - 5e-6, above it more
    surely. Each pair found is verified on the whole texts.
    """
    near.bound_batches(docs.sparkSession)
    docs = rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.where("doc_id IS NOT NULL").mapInPandas(_sign, _SIGNED), "signed")
    torn = not signed.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").isEmpty()
    if torn:
        docs = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
        discard(signed)
        signed = written(docs.mapInPandas(_sign, _SIGNED), "signed")
    copies = signed.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    copies = written(copies, "copies")
    keys = copies.select(F.explode("bands").alias("key"), "id")
    texts = docs.withColumnRenamed("doc_id", "id")
    at, links = near.classes([keys], lambda used: texts.hint("merge").join(used, "id"), least)
    of = signed.join(copies.select("d1", "d2", "id"), ["d1", "d2"], "left").select("doc_id", F.coalesce("id", "doc_id").alias("id"))
    named = of.join(at.withColumnRenamed("v", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("class_id"))
    out = named.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    if torn:
        out = rows.join(out.distinct(), "doc_id").select(out.columns)
    none = rows.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    out = written(out.unionByName(none), "classes")
    discard(signed, copies, links, at)
    return out
