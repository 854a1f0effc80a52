"""Stupid-backoff language-model scores, from n-gram counts over all documents.

A document is scored by the counts of all other documents: those of all, less its own. Texts are dealt to
chunks, and the hashes of n-grams to as many buckets by range. For each order, the distinct n-grams of each
chunk are rows (chunk, bucket, n-grams, occurrences), the n-grams of a row packed and sorted; rows are grouped by bucket
and their n-grams summed there. An n-gram is in one row a chunk at most, so that even the most frequent one is no more often in its
bucket than there are chunks. An n-gram is only asked for if its first and its last words are known to occur together elsewhere. The
counts go back to their chunk in the order of its n-grams, so they need no n-grams beside them; there each document's positions
look them up, fold the backoff, and are summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.llm import text as T
from ontolith.llm.near import bound_batches
from ontolith.llm.rows import copies
from ontolith.plans.shared import discard, release, written

ALPHA = 0.4
#: The longest n-grams.
ORDER = 3
CHUNK_BYTES = 6 << 20
#: So many parts of the chunks, or of the n-grams, are on their way one after another, from so many chunks a part on.
PARTS, LEAST_CHUNKS = 4, 8
_U = np.uint64
#: A word, in lower-cased text; as in ``text``.
WORD = r"[^\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+"
_SCORED = "doc_id long, weight long, words long, backoffs long, score_micro long"


def grams(words: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that each word ends, whatever lies before it; see ``ends``."""
    out = T.mixed(words ^ _U(order * 0xD6E8FEB86659FD93 % 2**64))
    for k in range(1, order):
        before = np.concatenate([np.zeros(min(k, len(words)), _U), words[: max(0, len(words) - k)]])
        out = T.mixed(out * _U(0x9E3779B97F4A7C15) ^ before)
    return out


def ends(of: np.ndarray, order: int) -> np.ndarray:
    """Whether a word has ``order`` - 1 words of its text before it."""
    out = np.zeros(len(of), bool)
    out[order - 1 :] = of[order - 1 :] == of[: len(of) - order + 1]
    return out


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of all texts in order, and the numbers of their texts."""
    words, size = T.words_of(texts)
    return words, np.repeat(np.arange(len(texts)), size)


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of n-grams; a larger n-gram is never in a lower one."""
    return ((gram >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _sorted(gram: np.ndarray) -> np.ndarray:
    """The order by n-gram, then place: places stand in the low bits of what is sorted."""
    low = _U(max(1, len(gram)).bit_length())
    keys = (gram >> low << low) | np.arange(len(gram), dtype=_U)
    keys.sort()
    at = (keys & ((_U(1) << low) - _U(1))).astype(np.int64)
    g = gram[at]
    return at if (g[1:] >= g[:-1]).all() else np.argsort(gram, kind="stable")  # rarely n-grams differ in low bits only


def _begins(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _lengths(begins: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begins, n))


def _asked(words: np.ndarray, of: np.ndarray, order: int, known: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the positions that ask for their n-gram, by n-gram; these n-grams; where distinct ones begin; and at each
    position how often other documents have its n-gram, if the counts of the order's distinct n-grams are known."""
    left = None
    for k in range(1, order + 1):
        gram, keep = grams(words, k), ends(of, k)
        if left is not None:
            keep[1:] &= (left[1:] > 0) & (left[:-1] > 0)
        places = np.flatnonzero(keep)
        places = places[_sorted(gram[places])]
        gram, left = gram[places], np.zeros(len(words), np.int64)
        new = _begins(gram)
        if k <= len(known):
            own = _lengths(_begins(gram, of[places]), len(gram))
            left[places] = np.repeat(known[k - 1], _lengths(new, len(gram))) - np.repeat(own, own)
        yield places, gram, new, left


def _unpacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _known(answers: pd.DataFrame, order: int) -> list[np.ndarray]:
    """The counts of a chunk's distinct n-grams of each order, as sorted there."""
    answers = answers.sort_values("bucket")
    return [_unpacked(answers.loc[answers["k"] == k, "n"], np.int64) for k in range(1, order + 1)]


def _occurring(order: int, buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def occurring(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The distinct n-grams of a chunk and how often they occur, a row for each bucket."""
        words, of = _words(list(group["text"]))
        *_, (places, gram, new, _) = _asked(words, of, order, _known(answers, order - 1))
        occurs = np.add.reduceat(group["weight"].to_numpy(np.int64)[of[places]], new) if len(new) else np.zeros(0, np.int64)
        gram = gram[new]
        at = _bucket(gram, buckets)
        cuts = _begins(at)
        packed = {c: [x.tobytes() for x in np.split(v, cuts[1:])][: len(cuts)] for c, v in (("grams", gram), ("occurs", occurs))}
        return pd.DataFrame({"chunk": np.full(len(cuts), group["chunk"].iloc[0] if len(group) else 0), "bucket": at[cuts]} | packed)

    return occurring


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's rows: how often all chunks together have each of their n-grams."""
    gram, occurs = _unpacked(rows["grams"], _U), _unpacked(rows["occurs"], np.int64)
    at = _sorted(gram)
    new = _begins(gram[at])
    n = np.empty(len(gram), np.int64)
    n[at] = np.repeat(np.add.reduceat(occurs[at], new), _lengths(new, len(gram)))
    begin = np.cumsum([0, *[len(g) // 8 for g in rows["grams"]]])[:-1]
    packed = [x.tobytes() for x in np.split(n, begin[1:])]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "occurs": np.add.reduceat(occurs, begin), "n": packed})


def _scoring(total: int, alpha: float, order: int):  # noqa: ANN202
    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        words, of = _words(list(docs["text"]))
        place = np.arange(len(of)) - np.searchsorted(of, of)
        size = np.bincount(of, minlength=len(docs))
        value, used, before = np.zeros(len(words)), np.zeros(len(words), np.int64), None
        most = np.minimum(place + 1, order)
        for k, (*_, n) in enumerate(_asked(words, of, order, _known(answers, order)), 1):
            if k == 1:
                value, used = alpha ** (most - 1.0) * np.maximum(n, 1) / np.maximum(total - size[of], 1), np.ones(len(words), np.int64)
            else:
                context = np.concatenate([np.ones(1, np.int64), before[:-1]])
                value = np.where(n > 0, alpha ** (most - float(k)) * n / np.maximum(context, 1), value)
                used = np.where(n > 0, k, used)
            before = n
        micro = np.rint(1e6 * np.log(value)) if len(value) else value
        ids = pd.array([None if i is None else int(i) for i in docs["doc_id"]], "Int64")
        sums = {"words": size, "backoffs": np.bincount(of, used < most, len(docs)), "score_micro": np.bincount(of, micro, len(docs))}
        return pd.DataFrame({"doc_id": ids, "weight": docs["weight"].to_numpy()} | {c: np.rint(v).astype(np.int64) for c, v in sums.items()})

    return score


def scores(docs: DataFrame, alpha: float = ALPHA, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, words, backoffs, score_micro, log_score: one row per row of ``docs``.

    A word (see ``text``) is scored after the up to ``order`` - 1 words of its text before it: by
    count(n-gram) / count(n-gram without the word) if another document has the n-gram, else ``alpha``
    times its score after one word less, and in the end by count(word) / all words. Counts are those of
    all other rows; a word that none of them has counts once. backoffs is the number of words that weren't
    scored by their longest n-gram. score_micro adds the natural logarithms in whole millionths, so that
    no order of addition changes it; log_score is the same in units. Null and empty texts have 0 words and
    score 0. Rows that repeat a doc_id or a text are rows of their own, and count. Null ids stay null. An
    empty table gives an empty result. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")  # pandas would make floats of nullable integers
    same = docs.groupBy("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.count("*").alias("weight"))
    several = not same.where("weight > 1").isEmpty()
    if several:
        docs = docs.groupBy("doc_id", "text").agg(F.count("*").alias("weight"))
    else:
        docs = docs.withColumn("weight", F.lit(1).cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, size // chunk_bytes)
    parts = PARTS if chunks >= LEAST_CHUNKS * PARTS else 1
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    answers, total, spent = dealt.sparkSession.createDataFrame([], "k int, chunk long, bucket long, n binary" + ", part int" * (parts > 1)), 0, []

    def texts(p: int) -> DataFrame:
        return dealt if parts == 1 else dealt.where(F.pmod("chunk", F.lit(parts)) == p)

    def part(df: DataFrame, p: int) -> DataFrame:
        return df if parts == 1 else df.where(F.col("part") == p).drop("part")

    def by_part(df: DataFrame, name: str, by: str) -> DataFrame:
        # Each part has a folder of its own, so that no part reads the others' rows.
        return written(df, name) if parts == 1 else written(df.withColumn("part", F.pmod(by, F.lit(parts)).cast("int")), name, "part")

    for k in range(1, order + 1):
        pieces = []
        for p in range(parts):
            known = part(answers, p).groupBy("chunk")
            piece = texts(p).groupBy("chunk").cogroup(known).applyInPandas(_occurring(k, chunks), "chunk long, bucket long, grams binary, occurs binary")
            if parts > 1:  # the shuffles of texts and answers go before the next part's
                piece = by_part(piece, "rows", "bucket")
                release(dealt.sparkSession)
            pieces.append(piece)
        rows, tables = reduce(DataFrame.unionByName, pieces), []
        for p in range(parts):
            counted = part(rows, p).groupBy("bucket").applyInPandas(_summed, "chunk long, bucket long, occurs long, n binary")
            tables.append(by_part(counted, "words" if k == 1 else f"counts{k}", "chunk"))
            release(dealt.sparkSession)
        discard(*pieces)
        spent += tables
        counts = reduce(DataFrame.unionByName, tables)
        if k == 1:
            total = counts.agg(F.sum("occurs")).first()[0] or 0
        answers = answers.unionByName(counts.withColumn("k", F.lit(k)).drop("occurs"))
    out = []
    for p in range(parts):
        scored = texts(p).groupBy("chunk").cogroup(part(answers, p).groupBy("chunk")).applyInPandas(_scoring(total, alpha, order), _SCORED)
        if several:
            scored = copies(scored, F.col("weight"), "copy").drop("copy")
        out.append(written(scored.drop("weight").withColumn("log_score", F.col("score_micro") / 1e6), "scores"))
        release(docs.sparkSession)
    discard(*spent)
    return reduce(DataFrame.unionByName, out)


#: The same rows in SQL, for n-grams of up to three words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+') AS w FROM documents),
t AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT r, i,
             count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS n1,
             count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) AS n2,
             count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) AS n3,
             count(*) OVER () - count(*) OVER (PARTITION BY r) AS m
      FROM t),
p AS (SELECT *, lag(n1) OVER (PARTITION BY r ORDER BY i) AS p1, lag(n2) OVER (PARTITION BY r ORDER BY i) AS p2 FROM n),
s AS (SELECT r, NOT ((i > 2 AND n3 > 0) OR (i = 2 AND n2 > 0) OR i = 1) AS back,
             CASE WHEN i > 2 AND n3 > 0 THEN n3::DOUBLE / p2
                  WHEN i > 1 AND n2 > 0 THEN (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END) * n2 / p1
                  ELSE pow(0.4::DOUBLE, least(i, 3) - 1) * greatest(n1, 1) / greatest(m, 1) END AS value
      FROM p),
g AS (SELECT r, count(*) AS words, count(*) FILTER (WHERE back) AS backoffs, sum(round(1e6::DOUBLE * ln(value))::BIGINT)::BIGINT AS m FROM s GROUP BY r)
SELECT doc_id, coalesce(words, 0) AS words, coalesce(backoffs, 0) AS backoffs, coalesce(m, 0)::BIGINT AS score_micro, coalesce(m, 0) / 1e6::DOUBLE AS log_score
FROM d LEFT JOIN g USING (r)
"""
