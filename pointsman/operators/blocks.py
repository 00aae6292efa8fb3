"""Iterative fits: rows packed into blocks once, then one small job per step.

A block holds the matrices of some thousand rows as bytes, so a step moves no rows between the
engine's formats one by one. Blocks are written to the shared folder and cached; a step adds up an
array per task, merges the arrays in the cluster, and gives the driver one array as large as the model. Blocks
are planned as a table once; the steps run on their rows, so none of them is planned anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsman.session import written

ROWS = 4096
#: Arrays that one task merges.
FAN_IN = 16


@dataclass
class Blocks:
    """Cached blocks, the names of their parts, and the number of tasks that read them."""

    frame: DataFrame
    parts: list[str]
    tasks: int

    def total(self, add: Callable[..., None], size: int) -> np.ndarray:
        """The sum over all blocks of what `add(out, n, *parts)` adds to an array of `size` zeros."""

        def run(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            out, seen = np.zeros(size), False
            for row in rows:
                add(out, *row)
                seen = True
            if seen:
                yield out

        return merged(self.rows.mapPartitions(run), size, self.tasks)

    @cached_property
    def rows(self) -> RDD:
        return self.frame.select("n", *self.parts).rdd

    def release(self) -> None:
        self.frame.unpersist()


def dense(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a list column; nulls are NaN. A row of another width fails the job."""
    if len(column) and (column.null_count or not (column.value_lengths().to_numpy() == width).all()):
        raise ValueError(f"rows must have {width} values")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def cleaned(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def pack(rows: DataFrame, columns: list[str], build: Callable[[dict[str, pa.Array]], dict[str, bytes]], parts: list[str]) -> Blocks:
    """Blocks of `rows`: n and the binary `parts` that `build` makes of the columns of up to `ROWS` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                made = build({c: part.column(c) for c in columns})
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), *[pa.array([made[p]], pa.binary()) for p in parts]], ["n", *parts])

    schema = ", ".join(["n long", *[f"{p} binary" for p in parts]])
    made = written(rows.select(*columns).mapInArrow(run, schema), "blocks")
    # Small blocks are read together: as many tasks as whole blocks, and at least one.
    rows_in = made.agg(F.sum("n")).first()[0] or 0
    frame = made.coalesce(max(1, -(-rows_in // ROWS))).persist()
    return Blocks(frame, parts, frame.rdd.getNumPartitions())


def floats(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, width) if width else np.zeros((0, 0))


def merged(arrays: RDD, size: int, tasks: int) -> np.ndarray:
    """The sum of arrays (at most one per task) of `size` numbers. They are added in the cluster; the driver gets one, however many tasks there are."""

    def merge(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
        out = np.zeros(size)
        for _, z in parts:
            out += z
        yield out

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)

        def dealt(i: int, parts: Iterator[np.ndarray], tasks=tasks) -> Iterator[tuple[int, np.ndarray]]:
            return ((i % tasks, z) for z in parts)

        arrays = arrays.mapPartitionsWithIndex(dealt).partitionBy(tasks, lambda k: k).mapPartitions(merge)
    out = np.zeros(size)
    for z in arrays.collect():
        out += z
    return out
