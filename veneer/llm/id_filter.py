"""A Bloom filter, sized by the number of ids, that keeps rows of large tables from being moved for joins they have no part in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veneer.llm.shingles import mixed

_ROUNDS = 3
#: Bits per id: about one in a hundred other ids passes.
_BITS_PER_ID = 12
#: A filter of more bits (64 MB) isn't built: all rows pass then, and the join that follows moves them.
MOST_BITS = 29


class IdFilter:
    """Which ids may be among those the filter was built from. It never rejects one of them."""

    def __init__(self, bits: int | None, words: np.ndarray | None):
        self.bits, self.words = bits, words

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([mixed(ids.view(np.uint64) + np.uint64(k * 0x632BE5AB)) >> np.uint64(64 - bits) for k in range(_ROUNDS)])

    @classmethod
    def of(cls, ids: DataFrame, column: str = "rid") -> IdFilter:
        ids = ids.select(F.col(column).alias("rid"))
        n = ids.count()
        bits = max(16, (n * _BITS_PER_ID).bit_length())
        if bits > MOST_BITS:
            return cls(None, None)

        def words(batches):
            for batch in batches:
                at = cls.places(batch.column("rid").to_numpy(), bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)),
                                                  pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

        rows = ids.mapInArrow(words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        return cls(bits, table.view(np.uint64))

    def passing(self, ids: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.ones(len(ids), bool)
        at = self.places(ids, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).reshape(_ROUNDS, -1).all(axis=0)


def likely(docs: DataFrame, ids: DataFrame, column: str = "rid") -> DataFrame:
    """Rows of `docs` whose id is among `ids`, and a few others: what a join by id then has to move."""
    shared = docs.sparkSession.sparkContext.broadcast(IdFilter.of(ids, column))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.passing(batch.column(column).to_numpy())))

    return docs.mapInArrow(run, docs.schema)
