"""Words and word shingles of texts, hashed without a Python object per word.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text. Blanks, punctuation and letter case therefore never tell two texts apart.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

SHINGLE = 5
_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], _U)
_LONG = 64  # bytes from which a word is hashed alone


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, by value."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words in ``data`` (uint8), and the bytes after their last."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of ``text``, in order."""
    return _hashes(text.lower().encode("utf-8", "surrogatepass"))[0]


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of lower-cased text, in order, and their first bytes."""
    data = np.frombuffer(raw, np.uint8)
    begin, end = word_spans(data)
    if not len(begin):
        return np.zeros(0, _U), begin
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - begin
    out = mixed((eight[begin] & _MASK[np.minimum(size, 8)]) + size.astype(_U) * _U(0x9E3779B97F4A7C15))
    more, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        out[more] = mixed(out[more] * _U(0x9E3779B97F4A7C15) ^ (eight[begin[more] + at] & _MASK[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]])
    return out, begin


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one shingle, no words give none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, _U)
    for k in range(width):
        out = mixed(out * _U(0x9E3779B97F4A7C15) ^ words[k : k + n])
    return out


def bag(shingles: np.ndarray) -> np.ndarray:
    """A sorted set of hashes for a bag: the k-th copy of a shingle has a hash of its own."""
    if not len(shingles):
        return shingles
    s = np.sort(shingles)
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    if new.all():
        return s
    first = np.flatnonzero(new)
    copy = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    again = copy > 0
    s[again] = mixed(s[again] + copy[again].astype(_U) * _U(0xD6E8FEB86659FD93))
    return np.sort(s)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags (shared weight over united weight); 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def text_bag(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The bag of word shingles of a text; null is empty."""
    return bag(shingle_hashes(word_hashes(text or ""), width))


def text_bags(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """``text_bag`` of each text, by one pass over many of them."""
    held, cut, out = 0, 0, []
    for i, t in enumerate(texts):
        held += len(t)
        if held > 500_000 or i == len(texts) - 1:
            out += _bags(texts[cut : i + 1], width)
            held, cut = 0, i + 1
    return out


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ``word_hashes`` of all texts, one after another, and how many each has; by one pass over many of them."""
    held, cut, words, sizes = 0, 0, [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > 500_000 or i == len(texts) - 1:
            some, first = _many(texts[cut : i + 1])
            words.append(some)
            sizes.append(np.diff(first))
            held, cut = 0, i + 1
    return np.concatenate(words), np.concatenate(sizes)


def _many(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of all texts, and the first of each text among them, and their end."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([0, *[len(r) + 1 for r in raw]])
    words, begin = _hashes(b"\n".join(raw))
    return words, np.searchsorted(begin, bounds)


def _bags(texts: list[str], width: int) -> list[np.ndarray]:
    words, first = _many(texts)
    size = np.diff(first)
    few = np.flatnonzero(size < width)
    if len(few) == len(texts):
        return [bag(shingle_hashes(words[a:b], width)) for a, b in zip(first[:-1], first[1:], strict=True)]
    of = np.repeat(np.arange(len(texts)), size)
    whole = np.flatnonzero(of[: len(of) - width + 1] == of[width - 1 :])
    s, of = shingle_hashes(words, width)[whole], of[whole]
    at = np.lexsort((s, of))
    s, new = s[at], np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    if not new.all():
        begins = np.flatnonzero(new)
        copy = np.arange(len(s)) - np.repeat(begins, np.diff(np.append(begins, len(s))))
        again = copy > 0
        s[again] = mixed(s[again] + copy[again].astype(_U) * _U(0xD6E8FEB86659FD93))
        s = s[np.lexsort((s, of))]
    ends = np.cumsum(np.maximum(size - width + 1, 0))
    out = [s[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
    for i in few:
        out[i] = bag(shingle_hashes(words[first[i] : first[i + 1]], width))
    return out


def digest(words: Iterable[int] | np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a sequence of words, as two signed integers."""
    h = xxhash.xxh3_128_digest(np.asarray(words, _U).tobytes())
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)
