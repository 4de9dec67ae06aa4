"""Exact top-k inner products by an impact-ordered index, score at a time.

A shard holds, for each axis, its rows in the order of their component; the rows of one component are a segment. What
they gain on an axis over the shard's worst row there is the segment's impact, |q| times the difference of components. A
query takes the segments of all axes by descending impact. Once those above t are taken, a row with sum a of impacts on m
axes seen can have at most a + B(t) - m t, where B(t) is the sum over all axes of the smaller of t and the axis' largest
impact: what isn't seen is t at most.

A query stops only where that bound proves that few rows can reach its k-th score, which is taken from rows already
scored exactly, in this shard or those before. Rows that the bound doesn't exclude, equal scores included, are scored
exactly by their whole components; once all impacts are seen the sums are exact themselves.

Components are floor(scale * x) in doubles, scores whole numbers. Null vectors, and those with null or non-finite
components, take no part; rows without an id neither. Vectors of different lengths are not compared. A query's own are
all rows of its id. Repeated rows are candidates of their own, and each repeated query has its own result. Components
so large that an inner product may not fit in 64 bits raise OverflowError. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.blocks import Best, NONE, comparable, gathered, held, met, narrow, products, ranked
from binforge.llm.common import bounded_batches, stage

SCALE = 64
K = 20
LEVELS = (0.52, 0.6, 0.68, 0.76, 0.84, 1)  # parts of a query's postings after which its bound is looked at
SHARD = 32_768  # rows of a shard, so that a place in it takes 16 bits
BLOCK = 128  # queries of a block
FEW = 8  # rows are scored once no more than one in so many can still be among the best


def _number(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def query_blocks(vectors: DataFrame, scale: int, most: int = BLOCK) -> DataFrame:
    """block, ids and x (rows of whole components, 8 bytes each) of up to ``most`` rows of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids,), x in held(batches, ["vec_id"], scale, most):
            yield pa.RecordBatch.from_pydict({"block": [number], "size": [x.shape[1]], "ids": [_number(ids)], "x": [_number(x)]}, pa.schema([("block", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())]))

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "block long, size int, ids binary, x binary")


def segments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Postings of all axes after each other, where each segment starts, and its component."""
    order = np.argsort(x, axis=0, kind="stable").T
    values = np.take_along_axis(x.T, order, axis=1)
    new = np.ones(values.shape, bool)
    new[:, 1:] = values[:, 1:] != values[:, :-1]
    return {"postings": order.astype(np.uint16), "segments": np.flatnonzero(new), "values": values[new]}


def index(vectors: DataFrame, scale: int = SCALE, most: int = SHARD) -> DataFrame:
    """shard, and its rows and their segments. Holds every comparable row."""
    names = ("members", "rows", "postings", "segments", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("shard", pa.int64()), ("width", pa.int32()), ("bits", pa.int32()), *((c, pa.binary()) for c in names)])
        for number, (ids,), x in held(batches, ["vec_id"], scale, most):
            made = {"members": ids, "rows": narrow(x), **segments(narrow(x))}
            yield pa.RecordBatch.from_pydict({"shard": [number], "width": [x.shape[1]], "bits": [8 * made["rows"].itemsize], **{c: [_number(made[c])] for c in names}}, kind)

    rows = comparable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "shard long, width int, bits int, " + ", ".join(f"{c} binary" for c in names))


class Shard:
    """An index row's arrays."""

    def __init__(self, row: dict):
        kind, self.size = np.dtype(f"int{row['bits']}"), row["width"]
        self.ids = np.frombuffer(row["members"], np.int64)
        self.x = np.frombuffer(row["rows"], kind).reshape(len(self.ids), self.size)
        self.postings = np.frombuffer(row["postings"], np.uint16)
        self.start = np.frombuffer(row["segments"], np.int64)
        self.value = np.frombuffer(row["values"], kind).astype(np.int64)
        self.length = np.diff(np.append(self.start, len(self.postings)))
        self.axis = self.start // max(1, len(self.ids))
        self.low, self.high = (self.x.min(axis=0), self.x.max(axis=0)) if len(self.ids) else (self.x, self.x)

    def possible(self, q: np.ndarray, k: int, floor: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that may be among the k best and reach ``floor``, their exact scores, and how many postings were read."""
        n = len(self.ids)
        worst = q * np.where(q > 0, self.low, self.high).astype(np.int64)
        most, base = np.abs(q) * (self.high.astype(np.int64) - self.low), int(worst.sum())
        impact = q[self.axis] * self.value - worst[self.axis]
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]  # the others add nothing
        read = np.cumsum(self.length[order])
        # One number holds how many axes of a row are seen, and what they gained below that.
        unit = 1 << int(most.sum()).bit_length()
        if unit * (self.size + 1) >= 1 << 53:
            unit = 0
        gained, seen, done = np.zeros(n, np.int64 if unit == 0 else np.float64), np.zeros(n, np.int64), 0
        for part in LEVELS:
            end = min(len(order), int(np.searchsorted(read, part * n * np.count_nonzero(q))) + 1) if part < 1 else len(order)
            t = int(impact[order[end]]) if end < len(order) else 0  # what isn't seen is at most this
            now = np.sort(order[done:end])
            done = max(done, end)
            if len(now):
                cut = np.flatnonzero(np.diff(now) != 1)
                first, last = now[np.append(0, cut + 1)], now[np.append(cut, len(now) - 1)]
                rows = np.concatenate([self.postings[i:j] for i, j in zip(self.start[first].tolist(), (self.start[last] + self.length[last]).tolist())])
                if unit:
                    gained += np.bincount(rows, np.repeat(impact[now] + float(unit), self.length[now]), n)
                else:
                    np.add.at(gained, rows, np.repeat(impact[now], self.length[now]))
                    seen += np.bincount(rows, minlength=n)
            total = gained.astype(np.int64)
            count = total // unit if unit else seen
            total = total - count * unit + base
            at_most = total + int(np.minimum(most, t).sum()) - count * t
            at_most[own] = NONE
            if n - len(own) >= k:
                # The k-th score of some rows that look best, scored exactly, is one that the k-th of all can't be below.
                look = np.argpartition(at_most, n - min(n, 2 * k))[n - min(n, 2 * k) :]
                some = products(q[None, :], self.x[look[at_most[look] != NONE]])[0]
                if len(some) >= k:
                    floor = max(floor, int(np.partition(some, len(some) - k)[len(some) - k]))
            left = np.flatnonzero((at_most >= floor) & (at_most != NONE))
            if t == 0 or len(left) <= max(2 * k, n // FEW):
                break
        return left, (total[left] if t == 0 else products(q[None, :], self.x[left])[0]), int(read[done - 1]) if done else 0


def search(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score (long): the k best rows for each row where ``is_query`` holds."""
    bounded_batches(vectors.sparkSession)
    shards = stage(index(vectors, scale, shard), "impact-index")
    queries = stage(query_blocks(comparable(vectors).where(is_query), scale, block), "queries")

    def begin(row: dict) -> tuple:
        ids = np.frombuffer(row["ids"], np.int64)
        return row["block"], ids, np.frombuffer(row["x"], np.int64).reshape(len(ids), row["size"]), Best(len(ids), k)

    def visit(state: tuple, own: Shard) -> None:
        _, ids, x, best = state
        if own.size != x.shape[1]:
            return
        found = []
        for i, q in enumerate(x):
            rows, score, _ = own.possible(q, k, int(best.least()[i]), np.flatnonzero(own.ids == ids[i]))
            fine = score >= best.least()[i]
            found.append((np.full(int(fine.sum()), i), score[fine], own.ids[rows[fine]]))
        best.add(*map(np.concatenate, zip(*found)))

    def end(state: tuple) -> Iterator[pa.RecordBatch]:
        number, ids, _, best = state
        q, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number)), pa.array(q.astype(np.int32)), pa.array(ids[q]), pa.array(found), pa.array(score)], names=["block", "at", "query_id", "vec_id", "score"])

    groups = gathered(queries, shards, queries.count(), shards.count())
    found = groups.mapInArrow(lambda b: met(b, begin, visit, end, opened=Shard), "block long, at int, query_id long, vec_id long, score long")
    return ranked(found, ["block", "at"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)


#: Plain products of all pairs, for small tables.
OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_dot_product(q.x, c.x), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
), o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM o WHERE rank <= {K}
"""
