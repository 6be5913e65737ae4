"""Word shingle sets of texts as sorted 64-bit hashes, and Fast Similarity Sketches of them.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, on UTF-8 bytes. A set holds
the distinct runs of ``width`` words; a text with fewer words is one run, a text
without words has the empty set. Hashes of 64 bits stand for the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from riskflow.llm.common import mix, seeded

SEGMENT = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = seeded(256, 3)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = seeded(16, 4)


def _powers(n: int, have: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006 - grows once per process
    if len(have[0]) < n:
        size = max(n, 64)
        have[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
    return have[0]


def _word_hashes(buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer; no word crosses an edge."""
    word = ~_SPACE[buf]
    split = np.zeros(len(buf) + 1, bool)
    split[edges] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | split[:-1]))
    after = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~after | split[1:])) + 1
    if not len(start):
        return start, np.zeros(0, np.uint64)
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters = _BYTE[buf[word]] * _powers(int(size.max()))[at]
    total = np.add.reduceat(letters, np.cumsum(size) - size)
    return start, mix(total + size.astype(np.uint64))


def _texts(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text, computed over segments of about SEGMENT bytes."""
    row, n = 0, len(off) - 1
    while row < n:
        last = row + 1
        while last < n and off[last + 1] - off[row] <= SEGMENT:
            last += 1
        if last == row + 1 and off[last] - off[row] > SEGMENT:       # one long text, cut at spaces
            a, parts = off[row], []
            while a < off[last]:
                b = min(a + SEGMENT, off[last])
                while b < off[last] and not _SPACE[buf[b]]:
                    b += 1
                parts.append(_word_hashes(buf[a:b], np.array([0]))[1])
                a = b
            yield row, np.concatenate(parts)
        else:
            start, h = _word_hashes(buf[off[row]:off[last]], off[row:last] - off[row])
            cut = np.searchsorted(start, off[row:last + 1] - off[row])
            for k in range(last - row):
                yield row + k, h[cut[k]:cut[k + 1]]
        row = last


def sets(buf: np.ndarray, off: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for row, w in _texts(buf, off):
        if len(w) >= width:
            h = np.zeros(len(w) - width + 1, np.uint64)
            for k in range(width):
                h += w[k:len(w) - width + 1 + k] * _RUN[k]
            yield row, np.unique(mix(h))
        elif len(w):
            yield row, mix((w * _RUN[:len(w)]).sum(keepdims=True) + np.uint64(len(w)))
        else:
            yield row, np.zeros(0, np.uint64)


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(np.bitwise_xor.reduce(mix(h + k)).view(np.int64) if len(h) else 0) for k in (_RUN[8], _RUN[9]))


class Sketcher:
    """Fast similarity sketching into ``size`` coordinates.

    Round i < size throws every element into a random bin with the value (i, hash) and
    each bin keeps its least value; rounds stop once every bin is filled. Round
    size + b puts the least element into bin b, so every coordinate fills.
    """

    def __init__(self, size: int):
        self.size = size
        self.seeds = seeded(2 * size, 5)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        i = 0
        empty = np.ones(self.size, bool)
        while i < self.size and empty.any():
            rounds = min(max(1, 1000 // len(h)), self.size - i)
            x = mix(h[None, :] ^ self.seeds[i:i + rounds, None])
            place = ((x >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)
            value = (np.arange(i, i + rounds, dtype=np.uint64)[:, None] << np.uint64(40)) | (x * _BASE >> np.uint64(24))
            np.minimum.at(out, place.ravel(), value.ravel())
            empty = out == np.iinfo(np.uint64).max
            i += rounds
        for b in np.flatnonzero(empty):
            out[b] = (np.uint64(self.size + b) << np.uint64(40)) | (mix(h ^ self.seeds[self.size + b]) >> np.uint64(24)).min()
        return out
