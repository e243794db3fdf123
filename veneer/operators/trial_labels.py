"""Labels of many trials from a few stored columns per row.

A trial gives each row a label: 1, 0, or ABSENT if the row is not in the trial. What decides it is stored once per row
in a compact form (bit words, ranks); tasks expand it for the trials they are working on, a batch at a time. Adding
trials therefore adds neither rows nor expressions to the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veneer.functions.draws import WORD_BITS

ABSENT = -1


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of an array column whose entries are equally many."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def bit(words: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Bits `which` of rows of words with WORD_BITS bits each."""
    return (words[:, which // WORD_BITS] >> (which % WORD_BITS)[None, :]) & 1


def packed(flags: Column, n: int) -> Column:
    """ARRAY<BIGINT> of bit words from an ARRAY of n zeros and ones; entry i is bit i % WORD_BITS of word i / WORD_BITS."""
    word = lambda b: F.aggregate(F.reverse(F.slice(flags, b * WORD_BITS + 1, WORD_BITS)), F.lit(0).cast("long"),
                                 lambda acc, x: acc * 2 + x)
    return F.array(*[word(b) for b in range(max(1, -(-n // WORD_BITS)))])


class Stored:
    """Column y: one stored label per trial."""

    def take(self, batch: pa.RecordBatch, which: np.ndarray) -> np.ndarray:
        return matrix(batch.column("y"), batch.num_rows)[:, which]


class Words:
    """Columns y, words: trial 0 has the row's own label, trial i the bit i - 1 of its words."""

    def take(self, batch, which):
        own = batch.column("y").to_numpy(zero_copy_only=False)
        bits = bit(matrix(batch.column("words"), batch.num_rows), np.maximum(which - 1, 0))
        return np.where(which[None, :] == 0, own[:, None], bits).astype(np.int8)


class Members:
    """Columns y, words: the row's own label where the trial's bit of its words is set."""

    def take(self, batch, which):
        own = batch.column("y").to_numpy(zero_copy_only=False)
        inside = bit(matrix(batch.column("words"), batch.num_rows), which) == 1
        return np.where(inside, own[:, None], ABSENT).astype(np.int8)


class Survivors(Members):
    """Columns y, words: the row's own label where the trial's bit is not set."""

    def take(self, batch, which):
        own = batch.column("y").to_numpy(zero_copy_only=False)
        gone = bit(matrix(batch.column("words"), batch.num_rows), which) == 1
        return np.where(gone, ABSENT, own[:, None]).astype(np.int8)


class Steps:
    """Columns y, gone (step at which each trial removed the row's pair, below 0: none): the row's own label while it is there."""

    def take(self, batch, which):
        own = batch.column("y").to_numpy(zero_copy_only=False)
        gone = matrix(batch.column("gone"), batch.num_rows)[:, which] >= 0
        return np.where(gone, ABSENT, own[:, None]).astype(np.int8)


@dataclass
class Prefixes:
    """Columns y, ranks (position in each order, 0: in none), held (bit words, one bit per split).

    A trial takes the first `keep` rows of an order: all of them, or those on one side of a split.
    """

    order: np.ndarray
    keep: np.ndarray
    split: np.ndarray   # -1: both sides
    hold: np.ndarray    # which side

    def take(self, batch, which):
        own = batch.column("y").to_numpy(zero_copy_only=False)
        ranks = matrix(batch.column("ranks"), batch.num_rows)[:, self.order[which]]
        inside = (ranks > 0) & (ranks <= self.keep[which][None, :])
        split = self.split[which]
        side = bit(matrix(batch.column("held"), batch.num_rows), np.maximum(split, 0)) == 1
        inside &= (split < 0)[None, :] | (side == self.hold[which][None, :])
        return np.where(inside, own[:, None], ABSENT).astype(np.int8)

    def read(self, batch):
        """What `nested` needs of a batch: own labels, ranks, held."""
        return (batch.column("y").to_numpy(zero_copy_only=False), matrix(batch.column("ranks"), batch.num_rows),
                matrix(batch.column("held"), batch.num_rows))

    def nested(self, read, rows: np.ndarray, which: np.ndarray):
        """(rows in an order, places in `which` by size, how many of these rows each has) per order and side of a split.

        A row is put beside the trials that may have it only: those of its side, as far as its rank.
        """
        _, ranks, held = read
        for split, hold in np.unique(np.stack([self.split[which], self.hold[which]]), axis=1).T:
            side = rows if split < 0 else rows[bit(held[rows], np.array([split]))[:, 0] == hold]
            mine = np.flatnonzero((self.split[which] == split) & (self.hold[which] == hold))
            for order in np.unique(self.order[which[mine]]):
                at = mine[self.order[which[mine]] == order]
                at = at[np.argsort(self.keep[which[at]], kind="stable")]
                rank = ranks[side, order]
                inside = np.flatnonzero((rank > 0) & (rank <= self.keep[which[at[-1]]]))
                inside = inside[np.argsort(rank[inside], kind="stable")]
                yield side[inside], at, np.searchsorted(rank[inside], self.keep[which[at]], "right")


@dataclass
class Additions:
    """Columns y, base (0/1), spot (place among candidates, -1: none): the base set and, of the candidates, those from
    `first` to `last`, if the trial isn't the base alone (last < first)."""

    first: np.ndarray
    last: np.ndarray

    def take(self, batch, which):
        own, base, spot = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("y", "base", "spot"))
        inside = (base == 1) | ((spot >= self.first[which][None, :]) & (spot <= self.last[which][None, :]))
        return np.where(inside, own, ABSENT).astype(np.int8)


@dataclass
class Swaps:
    """Columns y, base (0/1), spot (place among candidates), lead (place among members): the base set with one candidate
    for one member."""

    enters: np.ndarray
    leaves: np.ndarray

    def take(self, batch, which):
        own, base, spot, lead = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("y", "base", "spot", "lead"))
        inside = ((base == 1) & (lead != self.leaves[which][None, :])) | (spot == self.enters[which][None, :])
        return np.where(inside, own, ABSENT).astype(np.int8)


@dataclass
class Labels:
    """Columns to store for the trials' labels, what expands them, and how many there are."""

    columns: dict[str, Column]
    reader: object
    n: int


def stored(labels: Column | list[Column], n: int | None = None) -> Labels:
    if isinstance(labels, list):
        labels, n = F.array(*labels), len(labels)
    return Labels({"y": F.transform(labels, lambda v: v.cast("tinyint"))}, Stored(), n)


def words(column: str, n: int, label: str = "label") -> Labels:
    """Own labels as trial 0 and n trials from bit words."""
    return Labels({"y": F.col(label).cast("tinyint"), "words": F.col(column)}, Words(), n + 1)


def members(column: Column, n: int, label: str = "label") -> Labels:
    return Labels({"y": F.col(label).cast("tinyint"), "words": column}, Members(), n)


def survivors(column: Column, n: int, label: str = "label") -> Labels:
    return Labels({"y": F.col(label).cast("tinyint"), "words": column}, Survivors(), n)
