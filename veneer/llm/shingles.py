"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = Powers()


def word_hashes(data: bytes | memoryview) -> np.ndarray:
    """Hashes of the words of one text, A-Z lower-cased; words are runs of anything but ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers.to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _runs(words: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of `run` words. A run is hashed with its length and every word's place in it."""
    n = len(words) - run + 1
    sums = np.full(n, (run * 0xD6E8FEB86659FD93) % (1 << 64), np.uint64)
    for k in range(run):
        sums = mixed(sums + words[k:n + k])
    return sums


def shingle_set(data: bytes | memoryview, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; a shorter text with words has one, the whole sequence."""
    words = word_hashes(data)
    n = len(words)
    return np.unique(_runs(words, min(size, n))) if n else words


def _words_of_texts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie end to end, text i from at[i] to at[i + 1], and where each text's begin."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    before, after = np.append(True, space[:-1]), np.append(space[1:], True)
    before[at[at < n]] = True
    after[at[at > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, size: int = 5, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """`shingle_set` of each text (null: empty), some texts of about `most` bytes at a time: number of the first text,
    the sets end to end and where each begins, with the end of the last."""
    texts = texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offset = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offset, offset[first] + most, "right")) - 1)
        own = offset[first:last + 1]
        words, begin = _words_of_texts(raw[own[0]:own[-1]], own - own[0])
        count = np.diff(begin)
        whole = count >= size
        runs = np.where(whole, count - size + 1, count > 0)
        at = np.append(0, np.cumsum(runs))
        flat = np.empty(at[-1], np.uint64)
        long_runs = np.repeat(whole, runs)
        if long_runs.any():
            flat[long_runs] = _runs(words, size)[(np.repeat(begin[:-1] - at[:-1], runs) + np.arange(at[-1]))[long_runs]]
        for i in np.flatnonzero(~whole & (count > 0)).tolist():
            flat[at[i]] = _runs(words[begin[i]:begin[i + 1]], int(count[i]))[0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            flat[a:b].sort()
        new = np.append(True, flat[1:] != flat[:-1])[:len(flat)]
        new[at[:-1][runs > 0]] = True
        yield first, flat[new], np.append(0, np.cumsum(new))[at]
        first = last
