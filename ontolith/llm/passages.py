"""Substring dedup: repeated passages by MinHash banding of content-defined paragraphs.

Passages repeat in the middle of lines, so lines can't be the paragraphs. A paragraph begins at an
anchor: of every ``span`` consecutive words the one with the least hash. The choice depends on those
words alone, so documents that share ``span`` + ``length`` - 1 words, anywhere in them, share a whole
paragraph of ``length`` words. There are two kinds. ``SHORT`` ones are compared as they are: two
documents that share 50 words share one. ``LONG`` ones are compared by similarity, since a changed word in the
middle of 50 leaves a similarity of 0.8: equal ones are collapsed, the others are banded, those that
collide are joined and verified by exact Jaccard similarity, and links are clustered. A document
without a long paragraph is one paragraph as a whole.

All paragraphs of a cluster but the first are removals. Removals of a document that overlap are one
stretch. At either end a stretch grows word by word while it agrees with the text that its outermost
paragraph repeats, or loses the words that don't: what is removed is the whole shared passage, not the
paragraphs that found it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontolith.llm import near
from ontolith.llm import text as T
from ontolith.plans.shared import discard, release, written

SPAN, SHORT = 26, 25
LONG_SPAN, LONG = 51, 50
#: Bands of so many values find 98.6 % of the pairs of long paragraphs at a similarity of 0.8, and more above it.
BANDS, ROWS = 6, 3
SIMILAR = 0.8
#: Words on either side of a run that can be shared without a paragraph of their own.
AROUND = SPAN + SHORT
#: Words at one end of a long paragraph that can differ at a similarity of 0.8.
EDGE = 5
_U = np.uint64
_A = _U(0x9E3779B97F4A7C15)
_LOW = _U(0xFFFFFFFF)
_KEYS = [f"k{b}" for b in range(BANDS)]
_UNITS = "doc_id long, word int, size int, banded boolean, digest long, also int, " + ", ".join(f"{k} long" for k in _KEYS)


def _mark(k: np.ndarray, seed: int) -> np.ndarray:
    """What tells the ``k``-th word of a run from the others."""
    return T.mixed(k.astype(_U) * _A + _U(seed))


def run_hashes(words: np.ndarray, width: int, seed: int = 1, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of ``width`` words from each place on, or from all; fewer words give none."""
    at = np.arange(max(0, len(words) - width + 1)) if at is None else at
    out = np.full(len(at), width * seed, _U)
    for k, mark in enumerate(_mark(np.arange(width), seed)):
        out += T.mixed(words[at + k] ^ mark)
    return T.mixed(out)


def whole_hashes(words: np.ndarray, size: np.ndarray, seed: int = 1) -> np.ndarray:
    """The same hashes of texts of ``size`` words, all of which lie one after another in ``words``."""
    begin = np.cumsum(size) - size
    marked = T.mixed(words ^ _mark(np.arange(len(words)) - np.repeat(begin, size), seed))
    return T.mixed(np.add.reduceat(marked, begin) + (size * seed).astype(_U))


def _sliding(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def anchors(words: np.ndarray, of: np.ndarray, span: int) -> np.ndarray:
    """Positions of the winnowed words: of each run of ``span`` words of one text the last with the least hash."""
    if len(words) < span:
        return np.zeros(0, np.int64)
    h = T.mixed(words * _A)
    h[:-1] = np.where(of[:-1] == of[1:], T.mixed(words[:-1] * _A ^ words[1:]), h[:-1])
    later = _LOW - np.arange(len(h), dtype=_U)
    at = (_LOW - (_sliding((h & ~_LOW) | later, span) & _LOW)).astype(np.int64)
    at = at[of[: len(at)] == of[span - 1 :]]
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def bands(shingles: np.ndarray, at: np.ndarray, width: int | None) -> list[np.ndarray]:
    """The band keys of the sets of ``width`` shingles from each place on, or of those up to the next place."""
    short, keys = (shingles >> _U(32)).astype(np.uint32), []
    for band in range(BANDS):
        key = np.full(len(at), band + 1, _U)
        for r in range(band * ROWS, band * ROWS + ROWS):
            seed = int(T.mixed(np.array([r + 1], _U))[0])
            values = (short ^ np.uint32(seed >> 32)) * np.uint32(seed & 0xFFFFFFFF | 1)
            least = _sliding(values, width)[at] if width else np.minimum.reduceat(values, at)
            key = T.mixed(key * _A ^ least)
        keys.append(key.view(np.int64))
    return keys


def _unit(doc_id: np.ndarray, word: np.ndarray, size: int | np.ndarray, digest: np.ndarray, also: np.ndarray, keys: list[np.ndarray] | None) -> pd.DataFrame:
    n = len(word)
    cols = {"doc_id": doc_id, "word": word.astype(np.int32), "size": np.full(n, size, np.int32), "banded": np.full(n, keys is not None)}
    cols |= {"digest": digest.view(np.int64), "also": (also >> _U(32)).astype(np.uint32).view(np.int32)}
    return pd.DataFrame(cols | dict(zip(_KEYS, keys or [np.zeros(n, np.int64)] * BANDS, strict=True)))


def paragraphs(ids: np.ndarray, texts: list[str]) -> Iterator[pd.DataFrame]:
    """The paragraphs of texts; see ``_UNITS``."""
    words, size = T.words_of(texts)
    of, begins = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)])
    each = np.split(words, begins[1:-1])
    long = np.zeros(len(each), bool)
    for span, length, banded in ((SPAN, SHORT, False), (LONG_SPAN, LONG, True)):
        at = anchors(words, of, span)
        at = at[at + length <= begins[of[at] + 1]]
        if not len(at):
            continue
        doc = of[at]
        keys = bands(T.shingle_hashes(words), at, length - T.SHINGLE + 1) if banded else None
        if banded:
            long[doc] = True
        yield _unit(ids[doc], at - begins[doc], length, run_hashes(words, length, 1, at), run_hashes(words, length, 7, at), keys)
    whole = np.flatnonzero(~long & (size > 0))
    if len(whole):
        words, size = np.concatenate([each[i] for i in whole]), size[whole]
        shingles = [T.shingle_hashes(each[i]) for i in whole]
        n = np.array([len(x) for x in shingles])
        keys = bands(np.concatenate(shingles), np.cumsum(n) - n, None)
        yield _unit(ids[whole], np.zeros(len(whole), int), size, whole_hashes(words, size), whole_hashes(words, size, 7), keys)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch["doc_id"].to_numpy(), batch["text"].to_list()
        held, cut = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > 2_000_000 or i == len(texts) - 1:
                if frames := list(paragraphs(ids[cut : i + 1], texts[cut : i + 1])):
                    yield pd.concat(frames)
                held, cut = 0, i + 1


def _spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = text.lower().encode("utf-8", "surrogatepass")
    return raw, *T.word_spans(np.frombuffer(raw, np.uint8))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole texts and (word, size) of the paragraphs wanted of them -> doc_id, word, text."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, wanted in zip(batch["doc_id"], batch["text"], batch["wanted"], strict=True):
            raw, begin, end = _spans(text)
            for x in wanted:
                w, n = int(x["word"]), int(x["size"])
                out.append((doc_id, w, raw[begin[w] : end[w + n - 1]].decode("utf-8", "surrogatepass")))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["doc_id", "word", "text"])
                    out = []
        yield pd.DataFrame(out, columns=["doc_id", "word", "text"]).astype({"doc_id": "int64", "word": "int32"})


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole texts and places wanted of them -> the words before and after each place, the nearest first."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, wanted in zip(batch["doc_id"], batch["text"], batch["wanted"], strict=True):
            w = (T.word_hashes(text) >> _U(32)).astype(np.uint32).view(np.int32)
            for p in map(int, wanted):
                out.append((doc_id, p, w[max(0, p - AROUND) : p][::-1], w[p : p + AROUND]))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["doc", "at", "before", "after"])
                    out = []
        yield pd.DataFrame(out, columns=["doc", "at", "before", "after"]).astype({"doc": "int64", "at": "int32"})


def _agree(a: str, b: str) -> Column:
    """How many words two arrays have in common from their beginnings on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _beyond(a: str, b: str) -> Column:
    """How many words on the inner side of a run's edge differ before the first that agrees, if that is near."""
    first = F.array_position(F.zip_with(F.slice(a, 1, EDGE + 1), F.slice(b, 1, EDGE + 1), lambda x, y: F.coalesce(x == y, F.lit(False))), True)
    return F.when(first > 0, first - 1).otherwise(0).cast("int")


def _apart(a: Column, b: Column) -> Column:
    """Whether two places are in different documents or don't overlap."""
    return (a["doc_id"] != b["doc_id"]) | (F.abs(a["word"] - b["word"]) >= LONG)


def _alike(docs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """The banded paragraphs that repeat, exactly or nearly, with the first of their cluster."""
    units = units.where("banded")
    place = F.struct("doc_id", "word")
    first, alone = near.first_of(["digest", "also", "size"], "doc_id", "word")
    sets = units.select("digest", "also", "size", place.alias("id"), *_KEYS, first.alias("first"), (~alone).alias("several"))
    sets = written(sets.where("first").drop("first"), "paragraphs")
    release(docs.sparkSession)

    def fetch(used: DataFrame) -> DataFrame:
        wanted = used.join(sets.select("id", "size"), "id").groupBy(F.col("id.doc_id").alias("doc_id"))
        wanted = wanted.agg(F.collect_list(F.struct("id.word", "size")).alias("wanted"))
        cut = docs.hint("merge").join(wanted, "doc_id").mapInPandas(_cut, "doc_id long, word int, text string")
        return cut.select(place.alias("id"), "text")

    at, links = near.classes([sets.select(F.col(k).alias("key"), "id") for k in _KEYS], fetch, least, _apart)
    shared = sets.join(at.withColumnRenamed("v", "id"), "id", "left").where("several OR component IS NOT NULL")
    shared = shared.select("digest", "also", "size", F.coalesce("component", "id").alias("rep"))
    found = written(units.hint("merge").join(shared, ["digest", "also", "size"]).select("doc_id", "word", "size", "rep"), "alike")
    discard(sets, links, at)
    release(docs.sparkSession)
    return found


def _equal(units: DataFrame) -> DataFrame:
    """The short paragraphs that repeat exactly, with the first of them."""
    units = units.where("NOT banded").select("digest", "also", "doc_id", "word", "size")
    _, alone = near.first_of(["digest", "also"], "doc_id", "word")
    so_far = Window.partitionBy("digest", "also").orderBy("doc_id", "word").rowsBetween(Window.unboundedPreceding, 0)
    rep = F.first(F.struct("doc_id", "word")).over(so_far)
    return units.withColumns({"rep": rep, "alone": alone}).where("NOT alone").select("doc_id", "word", "size", "rep")


def _merged(rows: DataFrame, by: str, *more: Column) -> DataFrame:
    """Rows (first, end) merged where they overlap or touch."""
    order = Window.partitionBy(by).orderBy("first", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce((F.col("first") > so_far).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(order))
    return rows.groupBy(by, "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), *more).drop("run")


def _stretches(again: DataFrame) -> DataFrame:
    """Repeated paragraphs (doc_id, first, end, rdoc, shift) -> doc_id, first, end, and what the outermost ones repeat.

    Paragraphs are one stretch if they overlap or touch, or if they repeat one text at one distance and
    lie no further apart than anchors do.
    """
    order = Window.partitionBy("doc_id").orderBy("first", "end", "rdoc", "shift")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    like = (F.lag("rdoc").over(order) == F.col("rdoc")) & (F.lag("shift").over(order) == F.col("shift"))
    apart = (F.col("first") > so_far + SPAN) | ((F.col("first") > so_far) & ~like)
    rows = again.withColumn("fresh", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(order))
    of = F.struct("rdoc", "shift")
    runs = rows.groupBy("doc_id", "run").agg(
        F.min("first").alias("first"), F.max("end").alias("end"),
        F.min_by(of, F.struct("first", "end", "rdoc", "shift")).alias("head"), F.max_by(of, F.struct("end", "first", "rdoc", "shift")).alias("tail"),
    )
    return runs.drop("run")


def repeated(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, text) -> doc_id, first_word, n_words, kept, class_doc, class_word.

    One row for each maximal stretch of a document that repeats passages of earlier places (by doc_id,
    then position), and, with ``kept``, one for each stretch that they repeat. Words are counted from 0
    (see ``text``). class_doc and class_word name the place that the stretch's first passage repeats; a kept
    stretch names itself. A kept stretch may repeat an earlier one in turn, and then has rows of both
    kinds. Paragraphs of one document that overlap are never compared.

    Null texts, those without a word, and null doc_ids have no row. Rows that share a doc_id are one
    document with its least text. Doc_ids are any 64-bit integers, and texts of any length are read
    whole. Empty tables give no rows. Other columns are ignored.
    """
    near.bound_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    torn = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if torn:
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    units = written(docs.mapInPandas(_paragraphs, _UNITS), "units")  # keys of short ones are zeros, which take no room
    alike = _alike(docs, units, least)
    again = alike.unionByName(_equal(units)).select("doc_id", "word", "size", F.col("rep.doc_id").alias("rdoc"), F.col("rep.word").alias("rword"))
    later = (F.col("doc_id") != F.col("rdoc")) | (F.col("word") >= F.col("rword") + F.col("size"))
    again = again.where(later).select("doc_id", "rdoc", (F.col("word") - F.col("rword")).alias("shift"), F.col("word").alias("first"), (F.col("word") + F.col("size")).alias("end"))
    again = written(again, "again")
    discard(units, alike)
    release(docs.sparkSession)
    runs = written(_stretches(again), "runs")
    edges = [(F.col("doc_id"), F.col("first")), (F.col("doc_id"), F.col("end"))]
    edges += [(F.col("head.rdoc"), F.col("first") - F.col("head.shift")), (F.col("tail.rdoc"), F.col("end") - F.col("tail.shift"))]
    wanted = runs.select(F.explode(F.array(*[F.struct(d.alias("doc_id"), p.alias("at")) for d, p in edges])).alias("x")).select("x.*")
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("at").alias("wanted"))
    around = docs.hint("merge").join(wanted, "doc_id").mapInPandas(_around, "doc long, at int, before array<int>, after array<int>")
    around, grown = written(around, "around"), runs
    for out_of, into, edge, of in (("before", "after", "first", "head"), ("after", "before", "end", "tail")):
        one, two = (around.select(F.col("doc").alias(f"d{k}"), F.col("at").alias(f"p{k}"), F.col(out_of).alias(f"o{k}"), F.col(into).alias(f"i{k}")) for k in (1, 2))
        grown = grown.join(one, (F.col("doc_id") == F.col("d1")) & (F.col(edge) == F.col("p1")))
        grown = grown.join(two, (F.col(f"{of}.rdoc") == F.col("d2")) & (F.col(edge) - F.col(f"{of}.shift") == F.col("p2")))
        more = _agree("o1", "o2")
        grown = grown.withColumn(f"{edge}_n", F.when(more > 0, more).otherwise(-_beyond("i1", "i2"))).drop(*[f"{c}{k}" for c in "dpoi" for k in (1, 2)])
    grown = grown.select("doc_id", "head", "tail", (F.col("first") - F.col("first_n")).alias("first"), (F.col("end") + F.col("end_n")).alias("end"), "first_n", "end_n")
    grown = written(grown, "grown")
    of = F.min_by(F.struct("head.rdoc", (F.col("first") - F.col("head.shift")).alias("rword")), F.struct("first", "end")).alias("of")
    gone = _merged(grown, "doc_id", of).select("doc_id", "first", "end", F.lit(False).alias("kept"), "of.rdoc", "of.rword")
    # What is repeated: the paragraphs, and the words that stretches grew by.
    theirs = again.select(F.col("rdoc").alias("doc_id"), (F.col("first") - F.col("shift")).alias("first"), (F.col("end") - F.col("shift")).alias("end"))
    for part, low, high in (("head", F.col("first"), F.col("first") + F.col("first_n")), ("tail", F.col("end") - F.col("end_n"), F.col("end"))):
        more = grown.select(F.col(f"{part}.rdoc").alias("doc_id"), (low - F.col(f"{part}.shift")).alias("first"), (high - F.col(f"{part}.shift")).alias("end"))
        theirs = theirs.unionByName(more.where("first < end"))
    stay = _merged(theirs.distinct(), "doc_id").select("doc_id", "first", "end", F.lit(True).alias("kept"), F.col("doc_id").alias("rdoc"), F.col("first").alias("rword"))
    out = gone.unionByName(stay).select("doc_id", F.col("first").alias("first_word"), (F.col("end") - F.col("first")).alias("n_words"), "kept", F.col("rdoc").alias("class_doc"), F.col("rword").alias("class_word"))
    out = written(out, "passages")
    discard(again, runs, around, grown)
    return out
