"""Line dedup over overlapping windows of three lines.

A window is three consecutive lines. All but the first occurrence of a window, in the order of
documents and lines, are repeats; a line goes when any repeat covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines() -> Column:
    return F.split("text", "\n", -1)


def drop_repeated_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` cut, plus n_lines and n_removed.

    Documents are ordered by doc_id, null last, then by a hash of their text; rows that repeat both
    are one document and get the same result. Windows are compared by 128 bits of hash, from
    two hashes of each line. A null text
    stays null (0 lines); a text shorter than ``width`` lines has no window and stays whole; a
    document all of whose lines go keeps an empty text. Lines are what "\\n" separates, compared
    exactly. Other columns pass through, but columns named n_lines or n_removed are replaced.

    The first occurrence is a minimum per hash, combined before the shuffle, and finding the repeats
    is an equi-join that AQE may split, so a window in a third of all documents is no hot spot.
    Whole texts are shuffled once, when the covered positions come back to them.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.withColumn("_th", F.xxhash64("text"))
    hashes = keyed.select("doc_id", "_th", F.transform(_lines(), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("lh")).where(F.size("lh") >= width)
    windows = hashes.select(
        "doc_id",
        "_th",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("lh") - width + 1),
                lambda i: F.struct(
                    F.xxhash64(*[F.element_at("lh", i + k)["a"] for k in range(width)]).alias("h1"),
                    F.xxhash64(F.lit(width), *[F.element_at("lh", i + k)["b"] for k in range(width)]).alias("h2"),
                ),
            )
        ).alias("pos", "h"),
    ).select("doc_id", "_th", "pos", "h.h1", "h.h2")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_th", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = windows.join(first, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "_th", "pos")
    covered = repeats.groupBy("doc_id", "_th").agg(F.collect_set("pos").alias("_pos")).withColumnsRenamed({"doc_id": "_id", "_th": "_t"})
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t")), "left")
    gone = F.array_distinct(F.flatten(F.transform("_pos", lambda p: F.sequence(p + 1, p + width))))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_l")), gone)
    text = F.when(F.col("_pos").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("_l", i.cast("int"))), "\n"))
    counted = joined.withColumn("_l", _lines()).withColumn("_n", F.when(F.col("text").isNull(), 0).otherwise(F.size("_l")))
    removed = F.when(F.col("_pos").isNull(), 0).otherwise(F.size(gone))
    out = counted.withColumn("_r", removed).withColumn("text", text)
    return out.select(*docs.columns, F.col("_n").cast("long").alias("n_lines"), F.col("_r").cast("long").alias("n_removed"))


#: The same rows in SQL.
SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT r, i, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM (SELECT r, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
o AS (SELECT r, i, row_number() OVER (PARTITION BY a, b, c ORDER BY r, i) AS k FROM w),
g AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM o WHERE k > 1),
x AS (SELECT d.r, p.i, d.l[p.i] AS line FROM d, unnest(range(1, len(d.l) + 1)) AS p(i)),
k AS (SELECT x.r, string_agg(CASE WHEN g.i IS NULL THEN x.line END, chr(10) ORDER BY x.i) AS text, count(*) AS n_lines, count(g.i) AS n_removed
      FROM x LEFT JOIN g ON x.r = g.r AND x.i = g.i GROUP BY x.r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM d LEFT JOIN k ON d.r = k.r
"""
