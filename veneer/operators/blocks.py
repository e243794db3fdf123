"""Stored rows as Arrow batches of an RDD.

Loops of many small passes over the same rows spend their time on planning a query for each. A pass over blocks is one job
without a plan; its body is the same as for ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from veneer.session import set_checkpoints

#: Rows that are worth a task.
ROWS = 1 << 13
Body = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def tasks(n_rows: int) -> int:
    return max(1, -(-n_rows // ROWS))


class Blocks:
    """Batches that are kept; lost ones are computed again from what they came from."""

    def __init__(self, rdd: RDD, n_rows: int):
        self.rdd, self.n_rows = rdd.persist(StorageLevel.MEMORY_AND_DISK), n_rows

    @classmethod
    def of(cls, df: DataFrame, n_rows: int, cut: Body | None = None) -> Blocks:
        """Rows of a table as it is partitioned. ``cut`` makes the batches anew."""
        rdd = df.mapInArrow(lambda batches: _pack(cut(batches) if cut else batches), "block binary").rdd
        return cls(rdd.map(lambda row: pa.ipc.open_stream(row[0]).read_next_batch()), n_rows)

    def passed(self, body: Body) -> pa.Table | None:
        """What the tasks yield, gathered: a few rows each."""
        found = self.rdd.mapPartitions(body).collect()
        return pa.Table.from_batches(found) if found else None

    def added(self, body: Body, add: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch]) -> pa.Table | None:
        """The sum of what the tasks yield, a batch each at most, added up by tasks first."""
        found = self.rdd.mapPartitions(lambda batches: [list(body(batches))]).treeReduce(lambda a, b: [add(a[0], b[0])] if a and b else a or b)
        return pa.Table.from_batches(found) if found else None

    def grouped(self, body: Body, keys: int, values: Callable[[list], tuple], groups: int) -> list[tuple]:
        """(keys..., values of the group's rows...) of what the tasks yield; a row's first ``keys`` columns name its group."""
        rows = self.rdd.mapPartitions(lambda batches: (
            (row[:keys], row[keys:]) for batch in body(batches) for row in zip(*[c.to_pylist() for c in batch.columns])))
        return [(*k, *v) for k, v in rows.groupByKey(max(1, min(groups, self.rdd.getNumPartitions()))).mapValues(lambda v: values(list(v))).collect()]

    def changed(self, body: Body, cut: bool = False) -> Blocks:
        """The blocks that a body makes of these. ``cut`` writes them to the shared folder when they are first read."""
        out = Blocks(self.rdd.mapPartitions(body), self.n_rows)
        if cut:
            set_checkpoints(out.rdd.context)
            out.rdd.checkpoint()
        return out

    def release(self) -> None:
        self.rdd.unpersist()
