"""Toxicity scores from a counterfactually regularised linear classifier.

Features of a text are its lower-cased words and the openings of its longer words, each counted by
presence. The classifier is a logistic regression fitted in a task to a bounded sample of labelled
rows; the driver gets its weights only. Beside the usual loss it pays for every change of a score that follows from swapping a term for
one group in a labelled sentence for a term for another: neutral mentions of a group carry no weight,
and no group carries more than another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.llm.near import bound_batches
from ontolith.plans.shared import discard, written

WORD = re.compile(r"\w+")
OPENINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Labelled rows that the fit sees at most, and characters of their whole texts; scoring has no such bounds.
FIT_ROWS, FIT_CHARS = 6_000, 48_000_000
#: Weight of the counterfactual penalty.
PENALTY = 20.0
SCREEN = 2.5

# Terms that name groups; terms of one line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrant", "citizen", "refugee", "foreigner"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young"),
)


def features(text: str | None) -> set[str]:
    """The features of a whole text: words, and openings marked by a trailing asterisk."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in OPENINGS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def counterfactuals(words: set[str], swap: dict[str, tuple[str, ...]]) -> list[tuple[str, str | None]]:
    """The swaps of a text: each identity term in it for each of its alternatives, and for none."""
    return [(w, other) for w in sorted(words) if w in swap for other in (*(x for x in swap[w] if x != w), None)]


def _gaps(texts: list[str], index: dict[str, int], terms: tuple[tuple[str, ...], ...]) -> list[tuple[list[int], list[float]]]:
    """Feature differences of whole texts and their counterfactuals.

    All occurrences of a term are swapped, or dropped. A text that names no group gets a neutral mention
    of one, chosen in turn, and that is swapped, so that each term is seen. Only what the swapped
    words change is looked at.
    """
    swap = {w: line for line in terms for w in line}
    every = [w for line in terms for w in line]
    of = {w: features(w) for w in every}
    out, turn = [], 0
    for text in texts:
        words = set(WORD.findall(text.lower()))
        if every and not any(w in swap for w in words):
            words.add(every[turn % len(every)])
            turn += 1
        for w, other in counterfactuals(words, swap):
            rest = words - {w}
            stays = {f for f in of[w] | (of[other] if other else set()) if f in rest or f[-1] == "*" and any(x.startswith(f[:-1]) and len(x) >= len(f) - 1 for x in rest)}
            lost, won = of[w] - stays, (of[other] if other else set()) - stays
            gap = [(index[f], 1.0) for f in sorted(lost - won) if f in index] + [(index[f], -1.0) for f in sorted(won - lost) if f in index]
            if gap:
                out.append(([i for i, _ in gap], [x for _, x in gap]))
    return out


class _Rows:
    """A sparse matrix of rows (columns, values) for products with vectors."""

    def __init__(self, rows: list[tuple[list[int], list[float]]]) -> None:
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(c) for c, _ in rows])
        self.col = np.array([x for c, _ in rows for x in c], np.int64)
        self.val = np.array([x for _, v in rows for x in v], np.float64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row] * self.val, width)


def fit(texts: list[str], toxic: list[int], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY, ridge: float = 0.01, rounds: int = 250) -> tuple[dict[str, float], float]:
    """Weights by feature, and the intercept.

    Minimises the logistic loss + ``ridge`` |w|^2 / 2 + ``penalty`` times the mean squared change of the
    logit between sentences and their counterfactuals, by Nesterov steps on scaled features. Features
    of fewer than three texts, and those that go with the label by less than ``SCREEN`` standard
    deviations, are left out, but identity terms are always in. Without both labels the
    weights are empty and the intercept says the label seen, not toxic if there is none.
    """
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return {}, 4.0 if len(y) and y[0] else -4.0
    named = sorted(set().union(*(features(w) for line in terms for w in line))) if terms else []
    ids: dict[str, int] = {f: i for i, f in enumerate(named)}
    sets = [np.array(sorted(ids.setdefault(f, len(ids)) for f in sorted(features(t))), np.int32) for t in texts]
    seen = np.bincount(np.concatenate(sets), minlength=len(ids)).astype(float)
    bad = np.bincount(np.concatenate([s for s, label in zip(sets, toxic, strict=True) if label]), minlength=len(ids))
    # By how many standard deviations presence goes with the label: weak features are left out or shrunk.
    rate = y.mean()
    weight = np.abs(bad - rate * seen) / np.sqrt(seen * rate * (1 - rate) + 1.0)
    keep = (seen >= 3) & (weight >= SCREEN)
    keep[: len(named)] = True
    scale = np.clip(weight[keep] / 6.0, 0.02, 1.0)
    place = np.cumsum(keep) - 1
    index = {f: int(place[i]) for f, i in ids.items() if keep[i]}
    del ids
    x = _Rows([(c := place[s[keep[s]]].tolist(), [1.0] * len(c)) for s in sets])
    x.val = scale[x.col]
    z = _Rows(_gaps(texts, index, terms))
    z.val = z.val * scale[z.col] if len(z.val) else z.val
    # One step length for all coordinates, by power iteration on the loss's bound X'X / 4n.
    n, width = len(y), len(index)
    v = np.ones(width) / math.sqrt(width)
    for _ in range(12):
        u = x.back(x.times(v), width) / (4 * n) + (2 * penalty * z.back(z.times(v), width) / max(z.n, 1) if z.n else 0)
        top = np.linalg.norm(u)
        v = u / max(top, 1e-12)
    step = 1.0 / (1.1 * top + ridge / n + 0.3)
    w, b, w0, b0 = np.zeros(width), math.log(rate / (1 - rate)), np.zeros(width), math.log(rate / (1 - rate))
    for k in range(1, rounds + 1):
        m = (k - 1) / (k + 2)
        vw, vb = w + m * (w - w0), b + m * (b - b0)
        g = 1 / (1 + np.exp(-np.clip(x.times(vw) + vb, -40, 40))) - y
        grad = x.back(g, width) / n + ridge * vw / n
        if z.n:
            grad += 2 * penalty * z.back(z.times(vw), width) / z.n
        w0, b0, w, b = w, b, vw - step * grad, vb - step * g.mean()
    weights = {f: float(w[i] * scale[i]) for f, i in index.items() if abs(w[i] * scale[i]) > 1e-3}
    return weights, float(b)


def scorer(weights: dict[str, float], intercept: float):  # noqa: ANN201
    """A function from texts to scores."""
    get = weights.get
    openings = [n for n in OPENINGS if any(len(f) == n + 1 and f[-1] == "*" for f in weights)]

    def score(texts: pd.Series) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            total, opened = intercept, set()
            for w in set(WORD.findall(t.lower())) if t else ():
                total += get(w, 0.0)
                for n in openings:
                    if len(w) >= n:
                        opened.add(w[:n])
            for o in opened:
                total += get(o + "*", 0.0)
            out[i] = 1 / (1 + math.exp(-min(40.0, max(-40.0, total))))
        return out

    return score


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All fitted rows (doc_id, toxic, text), in order -> the weights by feature; a null feature has the intercept."""
    texts, toxic = [], []
    for batch in batches:
        texts += batch["text"].to_list()
        toxic += batch["toxic"].to_list()
    weights, intercept = fit(texts, toxic)
    yield pd.DataFrame({"feature": [None, *weights], "weight": [intercept, *weights.values()]})


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[dict[str, float], float]:
    """Fit on labelled documents whose crc32(doc_id) mod 4 is not 2, the least by hash.

    At most ``rows`` of them and ``chars`` characters in all; a text that no longer fits is passed over, so the task that
    fits gets a bounded number of bytes, in whole texts, and the driver none of them. Rows without a text or a label are left out; repeated labels
    count once, and of repeated doc_ids the least text.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    have = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    have = written(have.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    left, fitting = chars, []
    for r in have.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            left -= r.n
            fitting.append((r.doc_id,))
    some = docs.sparkSession.createDataFrame(fitting, have.select("doc_id").schema)
    got = have.join(F.broadcast(some), "doc_id").repartition(1).sortWithinPartitions("doc_id")
    weights = {r.feature: r.weight for r in got.mapInPandas(_fitted, "feature string, weight double").collect()}
    discard(have)
    intercept = weights.pop(None, None)
    return weights, fit([], [])[1] if intercept is None else intercept


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted.

    The score is that of the whole text; null and empty texts get the score of a text without
    features. A null doc_id is scored like any other and counts as not held out. Columns of ``docs``
    named like results are replaced; no column but text is an input of the score. Without labels no
    text is predicted toxic. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    weigh = scorer(*train(docs, labels))
    docs = docs.drop("held_out", "score", "predicted")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(weigh(texts))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = docs.withColumn("score", scored("text"))
    return out.select(*docs.columns, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
