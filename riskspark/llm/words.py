"""Words of whole texts as arrays of 64-bit hashes, computed over an Arrow batch at once.

A word's hash is a polynomial in its UTF-8 bytes taken from running sums, so no
Python string is made for a word. Texts are handled in runs of about ``RUN`` bytes
to bound memory; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Word bytes: anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: digits, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wraps around)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


class _Powers:
    """Powers of the base and of its inverse, made anew in each process: code that is sent to workers leaves them behind."""

    def __init__(self):
        self.tables = [np.ones(1, _U), np.ones(1, _U)]

    def __reduce__(self):
        return type(self), ()

    def upto(self, which: int, n: int) -> np.ndarray:
        if len(self.tables[which]) < n:
            step = np.full(max(n, 2 * RUN), (_BASE, _INVERSE)[which], _U)
            step[0] = 1
            self.tables[which] = np.multiply.accumulate(step)
        return self.tables[which]


_POWERS = _Powers()


@dataclass
class Run:
    """Some consecutive texts: their bytes, where each begins, and their words."""

    data: np.ndarray      # bytes, lower-cased
    offsets: np.ndarray   # n + 1 byte positions
    starts: np.ndarray    # of each word
    ends: np.ndarray
    hashes: np.ndarray    # of each word
    doc: np.ndarray       # text number of each word, within the run
    counts: np.ndarray    # words of each text

    @property
    def first(self) -> np.ndarray:
        """Position of each text's first word, n + 1 entries."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = RUN) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes, never splitting a text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def run_of(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray = LOWER) -> Run:
    data, n, k = fold[raw], len(raw), len(offsets) - 1
    if not n:
        none, z = np.zeros(0, np.int64), np.zeros(0, _U)
        return Run(data, offsets, none, none, z, none, np.zeros(k, np.int64))
    word = np.zeros(n + 2, bool)
    word[1:-1] = word_bytes[data]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | begin[:n]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | begin[1:])) + 1
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _POWERS.upto(0, n)[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _POWERS.upto(1, n)[starts] + (ends - starts).astype(_U))
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Run(data, offsets, starts, ends, hashes, doc, np.bincount(doc, minlength=k))


def runs(texts: pa.Array, word_bytes: np.ndarray, limit: int = RUN) -> Iterator[tuple[int, int, Run]]:
    """(first text, text after the last, their words) for all texts of a batch."""
    raw, offsets = as_bytes(texts)
    for a, b in spans(offsets, limit):
        yield a, b, run_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], word_bytes)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` consecutive words (windows across texts included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(size):
        out += hashes[i: i + n] * _U((0xD6E8FEB86659FD93 * (2 * i + 1) + 2 * i) % (1 << 64) | 1)
    return mix(out + _U(size))


def shingle_sets(run: Run, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets.

    A text of fewer words is one shingle; without words the set is empty.
    """
    first, n = run.first, len(run.counts)
    wide = window_hashes(run.hashes, size)
    sets, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            s = np.unique(wide[a: b - size + 1])
        elif b > a:
            s = window_hashes(run.hashes[a:b], b - a)
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate(([0], np.cumsum(sizes)))
