"""A stated set of queries against all rows: shards built where rows are read, and met by blocks of queries.

A shard is a row that holds an index of some thousand rows, a block one that holds some hundred queries. Shards are dealt
to groups, and each block visits all groups; within one the best results go along from shard to shard, so only the best
of each group leave it. A task holds the shards of its group, and blocks stream past them one by one: no row of a shard is
joined to a row of a block, which would copy the shard for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shards that one group should hold.
TOGETHER = 4
NONE = np.iinfo(np.int64).min


def comparable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null or non-finite components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; raises OverflowError where an inner product may not fit in 64 bits."""
    x = np.floor(scale * x.astype(np.float64))
    if x.size and np.abs(x).max() ** 2 * x.shape[1] >= 2.0**62:
        raise OverflowError(f"components up to {np.abs(x).max():g} have inner products beyond 64 bits")
    return x.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes each as hold them all."""
    return x.astype(np.int16) if not x.size or np.abs(x).max() < 1 << 15 else x.astype(np.int32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b; in doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if most < 2.0**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def held(batches: Iterator[pa.RecordBatch], columns: list[str], scale: int, most: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Number (unique over all tasks), columns and matrix of up to ``most`` rows of vectors of one length at a time."""
    task, number, count = TaskContext.get().partitionId(), 0, 0
    waiting: dict[int, list[tuple[list[np.ndarray], np.ndarray]]] = {}

    def flushed() -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        nonlocal number
        for size in list(waiting):
            own = waiting.pop(size)
            yield (task << 32) + number, [np.concatenate(x) for x in zip(*(c for c, _ in own))], np.concatenate([x for _, x in own])
            number += 1

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, most - count)
            at, count = at + piece.num_rows, count + piece.num_rows
            lists = piece.column("embedding")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                x = flat[start[own][:, None] + np.arange(size)[None, :]].reshape(len(own), size)
                waiting.setdefault(size, []).append(([piece.column(c).to_numpy()[own] for c in columns], whole(x, scale)))
            if count >= most:
                yield from flushed()
                count = 0
    yield from flushed()


def _numbered(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The key of each row, and a number below ``most`` that deals the rows evenly."""
    return rows.select(F.col(key).alias("_key"), F.pmod(F.row_number().over(Window.orderBy(key)), F.lit(most)).cast("int").alias("_own"))


def gathered(blocks: DataFrame, shards: DataFrame, most_blocks: int, most_shards: int) -> DataFrame:
    """Partitions of the shards of one group and, after them, blocks that are to visit these; all blocks visit all groups.

    Both are stored tables without a column in common. Shards are large rows, so one is sent once where there are as many
    groups as tasks are needed; with fewer, blocks are dealt to some copies of each group.
    """
    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-most_shards // TOGETHER), min(most_shards, -(-tasks // max(1, most_blocks))))
    copies = max(1, min(most_blocks, -(-tasks // groups)))
    to = lambda c, most: F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias(c)
    of_block = _numbered(blocks, "block", copies).select("*", to("_group", groups)).select("_key", (F.col("_group") * copies + F.col("_own")).alias("_task"))
    of_shard = _numbered(shards, "shard", groups).select("*", to("_copy", copies)).select("_key", (F.col("_own") * copies + F.col("_copy")).alias("_task"))
    left = blocks.join(F.broadcast(of_block), F.col("block") == F.col("_key")).drop("_key")
    right = shards.join(F.broadcast(of_shard), F.col("shard") == F.col("_key")).drop("_key")
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(groups * copies, "_task")
    return both.drop("_task").sortWithinPartitions(F.asc_nulls_first("block"), "shard")


def met(batches: Iterator[pa.RecordBatch], begin: Callable[[dict], object], visit: Callable[[object, object], None], end: Callable[[object], Iterator[pa.RecordBatch]], keep: tuple[str, ...] = (), opened: Callable[[dict], object] = lambda row: row) -> Iterator[pa.RecordBatch]:
    """Has what ``begin`` makes of a block ``visit`` what ``opened`` makes of each shard of the group, which came before it.

    Binary columns come as buffers, those of ``keep`` (lists) as Arrow arrays, all others as Python values.
    """

    def value(column: pa.Array, name: str, i: int) -> object:
        if not column[i].is_valid:
            return None
        if pa.types.is_binary(column.type):
            return column[i].as_buffer()
        return column[i].values if name in keep else column[i].as_py()

    shards = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: value(batch.column(c), c, i) for c in batch.schema.names}
            if row["block"] is None:
                shards.append(opened(row))
                continue
            state = begin(row)
            for shard in shards:
                visit(state, shard)
            yield from end(state)


class Best:
    """The best ``k`` of (score, id) of each of ``n`` queries: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The k-th score of each query, NONE while there are fewer."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(query)
        k = self.score.shape[1]
        q = np.concatenate((np.repeat(rows, k), query))
        s, i = np.concatenate((self.score[rows].ravel(), score)), np.concatenate((self.id[rows].ravel(), ids))
        order = np.lexsort((i, ~s, q))
        start = np.searchsorted(q[order], rows)
        first = order[start[:, None] + np.arange(k)[None, :]]
        self.score[rows], self.id[rows] = s[first], i[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, at = np.nonzero(self.score != NONE)
        return q, self.score[q, at], self.id[q, at]


def ranked(found: DataFrame, key: list[str], score: str, ids: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key, and their rank from 1."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), F.asc_nulls_last(ids))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
