"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a fractional number of copies, target(source) / size(source). Whole parts are
taken as they are; the fractional parts are rounded by the pivotal method: two documents of a source
meet, words move from one to the other until one of them is an integer, the direction being drawn so
that no expectation changes. Words, not probabilities, are moved, so a source's expected words stay
exact through every meeting, and the last document left over decides how far the mix ends from its
target: by less than that one document. Long documents meet first, so the last one is short. Meetings happen inside bounded blocks of a source; each block
leaves at most one fractional document, and those meet on the next level of a reduction tree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontolith.llm.rows import copies
from ontolith.plans.shared import discard, written

#: A word is a run of characters other than blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
ROWS_PER_BLOCK = 8192
FAN_IN = 64
BLOCK = "source string, block long, no_id boolean, doc_id long, size long, whole long, part double, left boolean"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) -> one row per source: source, source_size, target.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all words.
    A target stops at ``most`` times its source's size, and the excess is dealt again by weight: all
    open sources then have one level per weight, found by as many sums as there are rounds of closing.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # Ranks: sources sorted into parts, each part's first rank from the sizes of those before it.
    parts = written(by.withColumn("none", F.col("source").isNull()), "sizes")
    parts = written(parts.repartitionByRange(max(1, parts.count() // 100_000), "none", "source").withColumn("part", F.spark_partition_id()), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.groupBy("part").agg(F.count("*").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("none", "source")) - 1
    weigh = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    by = written(parts.join(start, "part").select("source", "source_size", "n", weigh.alias("weight")), "sources")
    words = by.agg(F.sum("source_size")).first()[0] or 0
    cap, level = most * F.col("source_size"), 0.0
    closed = None
    while True:
        full = F.lit(False) if closed is None else cap <= F.lit(level) * F.col("weight")
        n, shut, open_weight = by.agg(
            F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == closed or not open_weight:
            break
        closed, level = n, (share * words - shut) / open_weight
    return by.select("source", "source_size", "n", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _draws(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big"))


def _rounded(key: tuple, rows: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """One block of one source: all parts become 0 or 1 but one, which ``left`` marks."""
    source, block = (None if pd.isna(x) else x for x in key)
    rows = rows.sort_values(["no_id", "doc_id", "size"], ignore_index=True)
    size, part = rows["size"].to_numpy(np.float64), rows["part"].to_numpy(np.float64).copy()
    part[size == 0] = 0.0  # nothing to take
    draw = _draws(source, block, level)
    shuffled, luck = draw.permutation(len(rows)), draw.random(len(rows))
    order = shuffled[np.argsort(-size[shuffled], kind="stable")]
    hold = -1  # the document that still has a fraction
    for i in order:
        if not 0.0 < part[i] < 1.0:
            continue
        if hold < 0:
            hold = i
            continue
        a, b = part[hold] * size[hold], part[i] * size[i]  # words
        up, down = min(size[hold] - a, b), min(a, size[i] - b)  # most that hold can gain or lose
        if luck[i] * (up + down) < down:
            a, b, hit = a + up, b - up, up == size[hold] - a
        else:
            a, b, hit = a - down, b + down, down == a
        part[hold], part[i] = a / size[hold], b / size[i]
        if hit:
            part[hold] = float(round(part[hold]))
        else:
            part[i] = float(round(part[i]))
        if not 0.0 < part[hold] < 1.0:
            part[hold] = float(round(part[hold]))
            hold = i if 0.0 < part[i] < 1.0 else -1
    if last and hold >= 0:
        part[hold], hold = float(draw.random() < part[hold]), -1
    left = np.zeros(len(rows), bool)
    if hold >= 0:
        left[hold] = True
    return rows.assign(part=part, left=left)[[x.split()[0] for x in BLOCK.split(", ")]]


def _meetings(level: int, last: bool):  # noqa: ANN202
    return lambda key, rows: _rounded(key, rows, level, last)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Draw a mix of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns one row per row of ``docs``: doc_id, size, source_size, target, taken. ``size`` counts
    words (null and empty texts: 0, and 0 taken), ``taken`` is size times the number of copies. A null
    source is a source. Rows that repeat a doc_id, or whose doc_id is null, are documents of their
    own; equal ones are interchangeable, so the result, as a bag of rows, is the same on every run.
    An empty table gives an empty mix. Draws are seeded by source and block, never by partition.
    """
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Equal rows are numbered, so that they are dealt to different blocks, and to the same ones on every run.
    sizes = docs.select("source", "doc_id", count.alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("_times"))
    sizes = written(copies(written(sizes, "sizes"), F.col("_times"), "copy").drop("_times"), "rows")
    aim = written(targets(sizes, weights, share, most), "targets")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_block)).cast("long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    all_docs = sizes.join(aim.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "source", F.pmod(F.xxhash64("doc_id", "size", "copy"), blocks).alias("block"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "size", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"), F.lit(False).alias("left")
    )
    most_blocks = aim.agg(F.max(blocks)).first()[0] or 1
    now, done, rounds, level = all_docs, [], [], 0
    while True:
        last = most_blocks == 1
        now = written(now.groupBy("source", "block").applyInPandas(_meetings(level, last), BLOCK), "rounded")
        rounds.append(now)
        done.append(now.where("NOT left"))
        if last:
            break
        level, most_blocks = level + 1, -(-most_blocks // FAN_IN)
        now = now.where("left").withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("left", F.lit(False))
    decided = done[0]
    for x in done[1:]:
        decided = decided.unionByName(x)
    taken = (F.col("size") * (F.col("whole") + F.round("part").cast("long"))).alias("taken")
    aim = aim.withColumnRenamed("source", "of")
    out = decided.join(F.broadcast(aim) if _small(aim) else aim, F.col("source").eqNullSafe(F.col("of")))
    out = written(out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", taken), "mix")
    discard(sizes, *rounds)
    return out


def _small(aim: DataFrame, most: int = 100_000) -> bool:
    """Whether there are so few sources that their table may be broadcast."""
    return aim.count() <= most
