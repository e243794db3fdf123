"""Deterministic randomness from md5.

A draw depends only on (seed, stream, key), never on partitioning or task order, so
every shuffle, sample and split is repeatable, survives recomputation after executor
loss and can be restated in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 52
# fixed values: cumulative Poisson(1) probabilities scaled to 16 bits
POISSON_STEPS = (24109, 48219, 60274, 64292, 65296, 65497, 65531, 65535)


def draw_word(seed, stream, *key) -> Column:
    """52 random bits as a BIGINT: leading 13 hex digits of md5('seed:stream:key')."""
    parts = [F.lit(p) if not isinstance(p, Column) else p for p in (seed, stream)]
    parts += [F.col(k) if isinstance(k, str) else k for k in key]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def uniform(seed, stream, *key) -> Column:
    return draw_word(seed, stream, *key) / F.lit(float(1 << WORD_BITS))


def coin_flips(seed, n: int, *key) -> Column:
    """ARRAY<INT> of ``n`` fair bits; one md5 feeds 52 of them."""
    words = [draw_word(seed, block, *key) for block in range((n + WORD_BITS - 1) // WORD_BITS)]
    bits = [F.getbit(words[i // WORD_BITS], F.lit(i % WORD_BITS)).cast("int") for i in range(n)]
    return F.array(*bits)


def poisson_weight(word: Column, slot: int) -> Column:
    """Poisson(1) weight from 16-bit slot 0, 1 or 2 of a draw word."""
    piece = F.shiftright(word, 16 * slot).bitwiseAND(F.lit(65535))
    return sum([F.when(piece >= s, 1).otherwise(0) for s in POISSON_STEPS], F.lit(0))
