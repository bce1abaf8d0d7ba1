"""Sums over blocks of examples that stay where they lie, for models that are fitted to more rows than one process holds.

A block is a row whose body packs some thousand examples. A task unpacks its blocks one after the other, and returns one array of
numbers, whatever the number of its blocks; the arrays are cut into slices that Spark adds up by slice. What reaches the driver is one
array of that length, so it does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lectern.llm.textblocks import tidy

SLICES = 16
_SLICE = "slice int, task int, body binary"
_ARROW_SLICE = pa.schema([("slice", pa.int32()), ("task", pa.int32()), ("body", pa.binary())])


def task_sums(blocks: DataFrame, run: Callable[[Iterator[pa.Buffer]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of what `run` makes of the bodies of each task; None where no task has anything to say."""
    return batch_sums(blocks.select("body"), lambda batches: run(body.as_buffer() for batch in batches for body in batch.column(0)))


def batch_sums(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of what `run` makes of the rows of each task, sent in single precision; None where no task has anything to say."""

    def slices(task: int, total: np.ndarray) -> pa.RecordBatch:
        bodies = [piece.astype(np.float32).tobytes() for piece in np.array_split(total, SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array(bodies, pa.binary())], schema=_ARROW_SLICE)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        if total is not None:
            yield slices(TaskContext.get().partitionId(), total)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # sums of one order, so that a run can be repeated
        total = sum(np.frombuffer(body.as_buffer(), np.float32).astype(np.float64) for body in table.column("body"))
        return table.slice(0, 1).set_column(2, "body", pa.array([total.tobytes()], pa.binary()))

    summed = rows.mapInArrow(tidy(part), _SLICE).groupBy("slice").applyInArrow(add, _SLICE).collect()
    return np.concatenate([np.frombuffer(r.body, np.float64) for r in sorted(summed, key=lambda r: r.slice)]) if summed else None
