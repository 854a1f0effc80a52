"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

A window is as many consecutive words of a document as a benchmark item has. Windows that share no
shingle with any item have similarity zero with all of them. A window and an item that are ``least``
alike share at least a known number of shingles, so every window, wherever it starts, that has an item's
shingles at that many of its places is fingerprinted, and no other: none of the rest can be alike. Fingerprints are 64-bit SimHashes of the
words. An index over 16 blocks of 4 bits finds every item of the window's size within 15 bits: two
fingerprints that differ in fewer bits than there are blocks agree on a block. What is found is
verified by the weighted Jaccard similarity of the bags of five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontolith.plans.shared import written

#: Between words, in lower-cased text: what is ASCII but no letter, digit or underscore.
GAP = r"[\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+"
SHINGLE = 5
SIMILAR = 0.8
BLOCKS, BLOCK_BITS = 16, 4
RADIUS = BLOCKS - 1
_LOWEST = sum(1 << BLOCK_BITS * k for k in range(BLOCKS))
#: Rows of a table of benchmark items up to which it is broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000


def _words(text: str = "text") -> Column:
    """64-bit hashes of the words, in order; null and empty texts have none."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP, -1), lambda x: x != ""), lambda x: F.xxhash64(x))


def _shingles(words: str, width: int) -> Column:
    """Hashes of all runs of ``width`` words of an array column; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<long>"))


def _simhash(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of one word hash ``h`` each -> ``by`` and their SimHash ``fp``; ties are zero bits."""
    bit = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(bit(b)).alias(f"b{b}") for b in range(64)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.shiftleft((2 * F.col(f"b{b}") > F.col("n")).cast("long"), b))
    return sums.select(*by, fp.alias("fp"))


def _blocks(prints: DataFrame) -> DataFrame:
    """One row for each block of each fingerprint: its number, its bits, and marks of the blocks before it."""
    each = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).alias("bits"), F.lit(_LOWEST & ((1 << k * BLOCK_BITS) - 1)).alias("before"))
        for k in range(BLOCKS)
    ]
    return prints.select("*", F.inline(F.array(*each)))


def _bounded(items: DataFrame, rows: int) -> DataFrame:
    """``items`` to be broadcast if it is known to have few rows, else to be shuffled."""
    return F.broadcast(items) if rows <= BROADCAST_ROWS else items.hint("merge")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, text_hash, item_id, similarity, word_start.

    One row for each document and item of which some window has a similarity of ``least`` or more: the
    best such window, the first of the best. Items shorter than five words are one shingle; items and
    documents without words match nothing; a document shorter than an item is one window. Repeated
    rows give one row; documents that share a doc_id but not the text are told apart by text_hash. Null
    ids are ids like others. Empty tables give no rows. Other columns are ignored.
    """
    items = benchmark.select("item_id", _words().alias("iw")).where(F.size("iw") > 0).distinct()
    items = written(items.withColumn("item", F.xxhash64("item_id", "iw")).withColumn("size", F.size("iw")).withColumn("width", F.least("size", F.lit(SHINGLE))), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # 1 to 5
    doc = ["doc_id", "text_hash"]
    docs = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    words = docs.select(*doc, _words().alias("w"))
    grams, seeds = None, None
    for width in widths:
        mine = items.where(F.col("width") == width)
        at = mine.select("item", "item_id", "size", "width", F.posexplode(_shingles("iw", width)).alias("place", "h"))
        grams = at if grams is None else grams.unionByName(at)
    if grams is None:
        return docs.select(*doc, F.lit(None).cast(dict(benchmark.dtypes)["item_id"]).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("word_start")).where("false")
    grams = written(grams, "grams")
    many = grams.count()
    for width in widths:
        there = words.select(*doc, F.size("w").alias("length"), F.posexplode(_shingles("w", width)).alias("pos", "h"))
        of = grams.where(F.col("width") == width).select("h", "item", "size").distinct()
        hits = there.join(_bounded(of, many), "h").select(*doc, "item", "size", "length", "pos", F.lit(width).alias("width")).distinct()
        seeds = hits if seeds is None else seeds.unionByName(hits)
    hits = written(seeds, "hits")
    places = F.least("size", "length") - F.col("width") + 1  # shingles of a window
    need = F.ceil(least * (places + F.col("size") - F.col("width") + 1) / (1 + least) - 1e-9)
    group = [*doc, "item", "size", "length", "width"]
    enough = hits.groupBy(*group).agg(F.count("*").alias("n")).where((F.col("n") >= need) & (F.col("n") > 0))
    enough = enough.select(*[F.col(c).alias(f"_{c}") for c in group[:3]])
    alike = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("item") == F.col("_item"))
    last = F.greatest(F.lit(0), F.col("length") - F.col("size"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - places + 1), F.least("pos", last))
    at = hits.join(enough, alike).select(*group, F.explode(starts).alias("start"))
    at = at.groupBy(*group, "start").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    # A window is looked up among the items whose shingles it has enough of, not among all of its size.
    wanted = written(at.select(*doc, "size", "start", "width", "item").distinct(), "windows")
    seeds = wanted.drop("item").distinct()
    texts = docs.hint("merge").join(seeds.select(*doc).distinct().toDF("d", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi").distinct()
    held = texts.select(*doc, _words().alias("w")).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    window = [*doc, "size", "start", "width"]
    cut = seeds.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select(*window, F.slice("w", F.col("start") + 1, F.col("size")).alias("ww"))
    cut = written(cut, "cut")
    prints = _blocks(_simhash(cut.select(*window, F.explode("ww").alias("h")), window))
    kept = items.select("item", "item_id", "size", F.explode("iw").alias("h"))
    known = _blocks(_simhash(kept, ["item", "item_id", "size"])).select("item", "item_id", F.col("size").alias("s"), F.col("fp").alias("ifp"), F.col("block").alias("k"), F.col("bits").alias("v"))
    unlike = F.col("fp").bitwiseXOR(F.col("ifp"))
    some = unlike
    for i in range(1, BLOCK_BITS):
        some = some.bitwiseOR(F.shiftrightunsigned(unlike, i))
    first = some.bitwiseAND(F.col("before")) == F.col("before")  # no block before this one agrees
    mine = wanted.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t", "size": "_s", "start": "_a", "item": "_i"}).drop("width")
    of = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")) & (F.col("size") == F.col("_s")) & (F.col("start") == F.col("_a"))
    on = (F.col("_i") == F.col("item")) & (F.col("block") == F.col("k")) & (F.col("bits") == F.col("v")) & first & (F.bit_count(unlike) <= RADIUS)
    pairs = written(prints.join(mine, of).join(_bounded(known, items.count() * BLOCKS), on).select(*window, "item", "item_id"), "candidates")
    bag = None
    for width in widths:
        of = cut.where(F.col("width") == width).select(*window, F.explode(_shingles("ww", width)).alias("h"))
        bag = of if bag is None else bag.unionByName(of)
    bag = bag.groupBy(*window, "h").agg(F.count("*").alias("c")).withColumnsRenamed({c: f"_{c}" for c in window})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in window[1:]:
        same &= F.col(c) == F.col(f"_{c}")
    theirs = grams.groupBy(F.col("item").alias("i"), F.col("h").alias("ih")).agg(F.count("*").alias("ic"))
    both = pairs.join(bag, same).join(_bounded(theirs, many), (F.col("item") == F.col("i")) & (F.col("h") == F.col("ih")))
    shared = both.groupBy(*window, "item", "item_id").agg(F.sum(F.least("c", "ic")).alias("shared"))
    length = cut.select(*[F.col(c).alias(f"_{c}") for c in window], F.greatest(F.size("ww") - F.col("width") + 1, F.lit(0)).alias("many"))
    union = F.col("many") + F.col("size") - F.col("width") + 1 - F.col("shared")
    scored = shared.join(length, same).select(*doc, "item_id", (F.col("shared") / union).alias("similarity"), F.col("start").alias("word_start")).where(F.col("similarity") >= least)
    best = scored.groupBy(*doc, "item_id").agg(F.max(F.struct("similarity", (-F.col("word_start")).alias("m"))).alias("best"))
    return best.select(*doc, "item_id", "best.similarity", (-F.col("best.m")).cast("long").alias("word_start"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; see ``contaminated``."""
    found = written(contaminated(docs, benchmark, least).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left_anti")


#: The same rows in SQL, by all windows on a shared shingle, without fingerprints.
SQL = r"""
WITH i AS (SELECT item_id, w FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+') AS w FROM benchmark) WHERE len(w) >= 5),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
g AS (SELECT item_id, len(w) AS size, p, array_to_string(w[p:p+4], ' ') AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
e AS (SELECT r, len, p, array_to_string(x, ' ') AS h FROM (SELECT r, len(w) AS len, p, w[p:p+4] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5))),
s AS (SELECT DISTINCT r, size, item_id, greatest(1, least(e.p - g.p + 1, len - size + 1)) AS start FROM e JOIN g USING (h)),
v AS (SELECT s.r, s.item_id, s.start, s.size, count(*) AS c, any_value(e.len) AS len, e.h FROM s JOIN e ON s.r = e.r AND e.p BETWEEN s.start AND s.start + s.size - 5 GROUP BY s.r, s.item_id, s.start, s.size, e.h),
ib AS (SELECT item_id, h, count(*) AS c FROM g GROUP BY item_id, h),
o AS (SELECT v.r, v.item_id, v.start, any_value(v.size) AS size, any_value(v.len) AS len, sum(least(v.c, ib.c)) AS shared FROM v JOIN ib USING (item_id, h) GROUP BY v.r, v.item_id, v.start),
q AS (SELECT r, item_id, start, shared / (least(size, len) - 4 + size - 4 - shared) AS sim FROM o)
SELECT d.doc_id, item_id, max(sim) AS similarity, (arg_min(start, (-sim, start)) - 1)::BIGINT AS word_start FROM q JOIN d USING (r) WHERE sim >= 0.8 GROUP BY d.doc_id, d.r, item_id
"""
