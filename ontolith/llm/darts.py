"""DartMinHash signatures of weighted sets.

Darts fall at random times on every unit of weight of every element, as a Poisson process that the
element's hash alone determines, and each dart names one of k coordinates. A coordinate's value is
the earliest dart that hits the set's weight: two sets agree on it with probability equal to their
weighted Jaccard similarity. Sets look at the darts of the first theta of time only, so a set of any
weight sees about k ln k + 2k darts; coordinates that stay empty look at twice the time, and so on.
"""

from __future__ import annotations

import numpy as np

from ontolith.llm.text import mixed

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def signatures(bags: list[np.ndarray], k: int) -> np.ndarray:
    """Rows of k values, one row for each bag of unit weights (see ``text.bag``); none may be empty."""
    out = np.zeros((len(bags), k), _U)
    best = np.full((len(bags), k), np.inf)
    throws = k * np.log(k) + 2 * k
    weight = np.array([len(b) for b in bags])
    open_sets, theta = np.arange(len(bags)), throws / weight
    while len(open_sets):
        _throw([bags[i] for i in open_sets], open_sets, theta[open_sets], best, out)
        open_sets = open_sets[np.isinf(best[open_sets]).any(axis=1)]
        theta[open_sets] *= 2
    return out


def _throw(bags: list[np.ndarray], rows: np.ndarray, theta: np.ndarray, best: np.ndarray, out: np.ndarray) -> None:
    k = best.shape[1]
    unit = np.concatenate(bags)
    size = [len(b) for b in bags]
    row, until = np.repeat(rows, size), np.repeat(theta, size)
    time, turns = np.zeros(len(unit)), 0
    while len(unit):
        turns += 1
        turn = _U(turns * int(_STEP) % 2**64)
        dart = mixed(unit + turn)
        time = time - np.log(((dart >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53)
        early = time < until
        unit, row, until, time, dart = unit[early], row[early], until[early], time[early], mixed(dart[early] ^ turn)
        place = row * k + (dart % _U(k)).astype(np.int64)
        flat, values = best.reshape(-1), out.reshape(-1)
        np.minimum.at(flat, place, time)
        won = flat[place] == time
        values[place[won]] = dart[won]


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Signed 64-bit keys of all bands of ``rows`` values; the band's number is part of its key."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    key = np.broadcast_to(mixed(np.arange(1, k // rows + 1, dtype=_U) * _STEP), (n, k // rows))
    for j in range(rows):
        key = mixed(key * _STEP ^ parts[:, :, j])
    return key.view(np.int64)
