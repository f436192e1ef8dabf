"""Vectorised views of a batch of texts: code points, word spans and 64-bit word hashes."""

from __future__ import annotations

import functools

import numpy as np

from sparkfeat.llm.bpe import LETTERS, NUM, char_classes
from sparkfeat.llm.common import AT_END, mix64

BASE = 0x9E3779B97F4A7C15


@functools.cache
def letter_table() -> np.ndarray:
    return np.isin(char_classes(), LETTERS)


@functools.cache
def word_table() -> np.ndarray:
    return letter_table() | (char_classes() == NUM)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@AT_END.append
def drop_powers() -> None:
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, more than n; the longest ones made are kept."""
    if len(_POWERS[0]) <= n:
        size = (n // (1 << 18) + 1) << 18
        for i, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def code_points(texts: list[str], sep: str = "\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by a separator; first place of each; ends)."""
    joined = sep.join(texts) + sep
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.cumsum(sizes + len(sep)) - sizes - len(sep)
    return cps, firsts, firsts + sizes


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the values in each span: equal contents, equal hashes."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def blocks(texts: list[str], chars: int = 500_000):
    """Cuts a batch into runs of texts of bounded total size: (first text, texts)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield first, texts[first:i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, words per text); words are runs of letters
    and digits, in lower case."""
    cps, firsts, _ = code_points([t.lower() for t in texts])
    a, b = spans(word_table()[cps])
    counts = np.diff(np.append(np.searchsorted(a, firsts), len(a)))
    return span_hashes(cps, a, b), counts
