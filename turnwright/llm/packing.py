"""Filling containers of fixed capacity with items: bounded-space online best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.session import stage

OPEN = 64
#: Containers that one task fills at the least, so that its last, open ones are few among them.
PER_TASK = 4000
MERGE = 16
#: Tasks at the most; beyond that each fills more containers, which costs time but no memory.
MOST_TASKS = 20_000


class Windows:
    """At most OPEN open containers of one task, kept in order of the room they have left."""

    def __init__(self, capacity: int, first: int, most: int = OPEN):
        self.capacity, self.next, self.most = capacity, first, most
        self.open: list[tuple[int, int]] = []  # room, container

    def put(self, size: int) -> int:
        """The container of an item that fits the capacity: the fullest one with room for it. Where none has, a new one is opened, and the
        fullest is closed if too many are open."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, c = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            room, c, self.next = self.capacity, self.next, self.next + 1
        insort(self.open, (room - size, c))
        return c


_SCHEMA = "item bigint, piece_no int, first_token bigint, n_tokens bigint, container bigint, open boolean"


def _filler(capacity: int, level: int):
    names = ["item", "piece_no", "first_token", "n_tokens", "container", "open"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(capacity, (level << 56) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            rows: list[tuple] = []
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece, at = 1, 0
                while size - at > capacity:  # only an item larger than a container is cut
                    rows.append((item, piece, at, capacity, w.put(capacity), False))
                    piece, at = piece + 1, at + capacity
                rows.append((item, piece, at, size - at, w.put(size - at), False))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)
        last = [(None, None, None, w.capacity - room, c, True) for room, c in w.open]
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*last, strict=True), kinds, strict=True)], names=names)

    return run


def pack(sizes: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece_no, first_token, n_tokens, container): every item once, or in pieces if it alone exceeds the capacity.

    Items are dealt to tasks by hash and taken in order of their key, so a task that runs again fills the same containers. Each task keeps OPEN
    containers open; those left open at the end are merged by the same method among MERGE tasks at a time until one task is left. Items of size
    null or 0 take no room but lie in a container. Item keys are whole numbers; repeated ones are items of their own.
    """
    d = sizes.select(F.col(item).cast("bigint").alias("i"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    d = stage(d, "p9-sizes")
    total = d.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, round(total / capacity / PER_TASK)))
    filled = stage(d.repartition(tasks, F.xxhash64("i")).sortWithinPartitions("i", "n").mapInArrow(_filler(capacity, 0), _SCHEMA), "p9-filled")
    rows = filled.where("not open").drop("open")
    rest = filled.where("open").select(F.col("container").alias("i"), F.col("n_tokens").alias("n"))
    moves = rest.select(F.col("i").alias("was"), F.col("i").alias("now"))
    level = 0
    while tasks > 1:
        tasks, level = -(-tasks // MERGE), level + 1
        again = stage(rest.repartition(tasks, F.xxhash64("i")).sortWithinPartitions(F.desc("n"), "i").mapInArrow(_filler(capacity, level), _SCHEMA), "p9-merged")
        step = again.where("not open").select(F.col("item").alias("now"), F.col("container").alias("then"))
        moves = moves.join(step, "now", "left").select("was", F.coalesce("then", "now").alias("now"))
        rest = again.where("open").select(F.col("container").alias("i"), F.col("n_tokens").alias("n"))
    out = rows.join(moves, rows["container"] == moves["was"], "left")
    return out.select(F.col("item").alias(item), "piece_no", "first_token", "n_tokens", F.coalesce("now", "container").alias("container"))
