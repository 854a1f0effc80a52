"""Rows that repeat: one stands for all, and later there are as many again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4096


def copies(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 as ``name``; a row of very many copies is dealt to many tasks."""
    several = rows.withColumn("_n", n).withColumn("_step", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / STEP) - 1)))
    if not several.where("_step > 0").isEmpty():
        several = several.repartition("_step", *rows.columns)
    within = F.sequence(F.lit(0), F.least(F.lit(STEP), F.col("_n") - STEP * F.col("_step")).cast("int") - 1)
    each = several.withColumn("_at", F.explode(within))
    return each.withColumn(name, F.col("_at") + STEP * F.col("_step")).drop("_n", "_step", "_at")
