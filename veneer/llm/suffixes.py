"""Suffix array of a bounded block of bytes in two stages, and its adjacent common prefixes."""

from __future__ import annotations

import numpy as np

from veneer.llm.shingles import Powers

#: Ends every string of a block; it occurs in no UTF-8 text.
SEPARATOR = 0xFF
_powers = Powers()


def ascending(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (the one that starts a byte later); the last is not."""
    n = len(data)
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)  # last place of each run of equal bytes
    up = np.append(data[ends[:-1]] < data[ends[:-1] + 1], False)
    return np.repeat(up, np.diff(np.concatenate(([-1], ends))))


def _words(data: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from each place on as a number that compares as they do; `beyond` places past the end are zeros."""
    padded = np.concatenate((data, np.zeros(8 + beyond, np.uint8)))
    return np.ndarray(len(padded) - 7, ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def _sorted_directly(block: bytes, data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of what starts there: by words of 8 bytes all at once, and by the rest among equal words: couples
    all together, word by word, and larger groups so that the keys of one group only are held at a time."""
    word = _words(data, depth)
    order = np.argsort(word[places], kind="stable")
    places = places[order]
    first = word[places]
    cuts = np.concatenate(([0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(places)]))
    sizes = np.diff(cuts)
    left = cuts[:-1][sizes == 2]
    i, j = places[left], places[left + 1]  # i < j
    for at in range(8, depth, 8):
        if not len(left):
            break
        a, b = word[i + at], word[j + at]
        if at + 8 > depth:
            a, b = a >> np.uint64(8 * (at + 8 - depth)), b >> np.uint64(8 * (at + 8 - depth))
        turned, even = a > b, a == b
        places[left[turned]], places[left[turned] + 1] = j[turned], i[turned]
        left, i, j = left[even], i[even], j[even]
    short = j + depth > len(data)  # what ends within the depth comes before what goes on with zeros
    places[left[short]], places[left[short] + 1] = j[short], i[short]
    text = block.decode("latin-1")  # compares as its bytes do
    for a, b in zip(cuts[:-1][sizes > 2].tolist(), cuts[1:][sizes > 2].tolist()):
        places[a:b] = sorted(places[a:b].tolist(), key=lambda i: text[i + 8:i + depth])
    return places


def suffix_array(block: bytes, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` bytes.

    Only suffixes smaller than their successors are sorted directly. The buckets of first bytes are then scanned in
    order: each suffix puts the one that starts a byte before it, if that is greater, behind what its bucket has so far.
    """
    data = np.frombuffer(block, np.uint8)
    n = len(data)
    small = ascending(data)
    direct = _sorted_directly(block, data, np.flatnonzero(small), depth)
    first = data[direct] if len(direct) else np.zeros(0, np.uint8)
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))  # put there by the empty suffix
    out = []
    for byte in range(256):
        own = waiting[byte]
        fresh = np.concatenate(own) if own else np.zeros(0, np.int64)
        whole = [fresh]
        while len(fresh):  # a run of this byte puts its earlier places into the same bucket
            before = fresh[fresh > 0] - 1
            fresh = before[(data[before] == byte) & ~small[before]]
            whole.append(fresh)
        bucket = np.concatenate([*whole, direct[bounds[byte]:bounds[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        target = data[before]
        order = np.argsort(target, kind="stable")
        before, target = before[order], target[order]
        cuts = np.flatnonzero(target[1:] != target[:-1]) + 1
        for piece in np.split(before, cuts):
            if len(piece):
                waiting[data[piece[0]]].append(piece)
    return np.concatenate(out)


def common_prefixes(block: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the next in order, up to `depth`: the longest prefixes of equal hash, by
    halving. Equal prefixes have equal hashes, so none is too short."""
    padded = np.frombuffer(block + bytes(depth), np.uint8)
    up, down = _powers.to(len(padded) + 1)
    sums = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum((padded.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    left, right = order[:-1], order[1:]
    from_left, from_right, at_left, at_right = sums[left], sums[right], down[left], down[right]
    prefix = np.zeros(len(left), np.int64)
    step = 1 << (depth.bit_length() - 1)
    while step:
        longer = np.minimum(prefix + step, depth)
        same = (sums[left + longer] - from_left) * at_left == (sums[right + longer] - from_right) * at_right
        prefix = np.where(same, longer, prefix)
        step >>= 1
    return prefix


def agreeing(block: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share their first `length` bytes with the next in order, all of them inside the block."""
    data = np.frombuffer(block, np.uint8)
    up, down = _powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    n = max(0, len(data) - length + 1)
    hashes = (sums[length:] - sums[:n]) * down[:n]
    inside = np.flatnonzero((order[:-1] < n) & (order[1:] < n))
    same = inside[hashes[order[inside]] == hashes[order[inside + 1]]]
    # hashes only pick the couples that are compared
    equal = [block[a:a + length] == block[b:b + length] for a, b in zip(order[same].tolist(), order[same + 1].tolist())]
    return same[np.array(equal, bool)]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the starts of those of its substrings of `length` bytes that occur elsewhere in the block."""
    starts = np.cumsum([0] + [len(s) + 1 for s in strings])
    block = bytes([SEPARATOR]).join(strings) + bytes([SEPARATOR])
    order = suffix_array(block, length)
    same = agreeing(block, order, length)
    found = np.zeros(len(block), bool)
    found[order[same]] = True
    found[order[same + 1]] = True
    return [np.flatnonzero(found[a:a + max(0, len(s) - length + 1)]) for a, s in zip(starts, strings)]
