"""Words of many texts at once as arrays: where they stand, which row holds them, and 64-bit hashes of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veneer.llm.shingles import Powers, mixed

#: Bytes of text that are worked on together; a longer text is a part of its own.
PART_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = Powers()


def word_bytes(separators: bytes) -> np.ndarray:
    """Table of 256 flags: which bytes belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def parts(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column of texts with their bytes and the rows' bounds in these; nulls count as empty."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every maximal run of flagged bytes; no run goes over a row's bound."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, final = bounds[:-1], bounds[1:] - 1
    begin, final = begin[begin < len(inside)], final[final >= 0]
    first[begin] = inside[begin]
    last[final] = inside[final]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, "right") - 1


def _long_hash(raw: np.ndarray) -> np.uint64:
    total = np.uint64(0)
    for at in range(0, len(raw), PART_BYTES):
        part = raw[at:at + PART_BYTES].astype(np.uint64) + np.uint64(1)
        up, _ = _powers.to(PART_BYTES + 1)
        total = total * up[len(part)] + (part * up[:len(part)]).sum(dtype=np.uint64)
    return total


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of [start, end) runs, which are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + PART_BYTES, "right"))
        if to <= at:  # one run longer than a part
            with np.errstate(over="ignore"):
                out[at] = _long_hash(raw[starts[at]:ends[at]])
            at += 1
            continue
        base = starts[at]
        block = raw[base:ends[to - 1]]
        up, down = _powers.to(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * down[starts[at:to] - base]
        at = to
    return mixed(out + (ends - starts).astype(np.uint64))


def joined(*columns: np.ndarray) -> np.ndarray:
    """One hash of several hashes in order."""
    out = np.full(len(columns[0]), (len(columns) * 0xD6E8FEB86659FD93) % (1 << 64), np.uint64)
    for c in columns:
        out = mixed(out + c)
    return out


def counted(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each distinct kind, and the counts (or sums of weights) of the kinds. Rows are compared
    column by column: rows of one hash that differ are told apart."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = columns[0] if len(columns) == 1 else joined(*columns)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    if len(columns) > 1:
        rows = [c[order] for c in columns]
        differ = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in rows]))
        if (differ & ~new).any():
            order = np.lexsort(columns)
            new = np.append(True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]))
    at = np.flatnonzero(new)
    if weights is None:
        return order[at], np.diff(np.append(at, n))
    return order[at], np.add.reduceat(weights[order], at)


def byte_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs themselves as one Arrow array of strings (valid UTF-8 as the texts are)."""
    size = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data.tobytes())).cast(pa.string())


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, by ranges that double."""
    n, reach = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[width - reach:width - reach + n])


def run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the runs [first, end) of words."""
    up, down = _powers.to(len(hashes) + 1)
    found = []
    for own in (hashes, mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))):
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[:-1], out=sums[1:])
        found.append(mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)))
    return found[0], found[1]
