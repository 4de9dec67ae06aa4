"""Hard-negative mining by branch and bound over ball trees.

Each task builds the trees of the rows it reads: one for each label with a leaf of rows or more in a shard, one for all
others together. A node is a ball, whose centre and radius bound the inner products of its rows with an anchor above
and below. A search goes down a tree with all anchors of a block at once and drops from a node

* anchors whose label rules out the node's (a node of one label),
* those whose score window lies wholly above or below the node's bounds,
* those whose k-th score so far, or a score that k rows of their nearest leaf reach, is above the node's upper bound.
  Equal ones stay, as a smaller id may win.

Both steps are such searches over the same trees: the best rows of the anchor's label are its positives, and then for
each of these the best rows of other labels whose score lies between ``least`` percent of the positive's and it.

Components are floor(scale * x) in doubles, scores whole numbers; equal ones are ordered by id. Rows with a null label,
a null vector, or null or non-finite components take no part; rows without an id neither. Vectors of different lengths
are not compared. Rows of the anchor's id are not among its positives. Repeated rows are rows of their own: a repeated
anchor has its own results, and a repeated positive has equal ones again. A positive of negative score has an empty
window. Components so large that an inner product may not fit in 64 bits raise OverflowError. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.blocks import NONE, Best, comparable, gathered, held, met, narrow, products, ranked
from binforge.llm.common import bounded_batches, stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST, MOST = 80, 100  # percent of the positive's score
SHARD = 16_384  # rows of a shard
LEAF = 64
BLOCK = 256  # anchors of a block
MIXED = -1  # a node of several labels


def _split(x: np.ndarray, rows: np.ndarray, leaf: int) -> list[tuple[np.ndarray, int]]:
    """Nodes of one tree in depth-first order: rows, and how many nodes its subtree has."""
    if len(rows) <= leaf:
        return [(rows, 1)]
    own = x[rows]
    axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if own.shape[1] else 0
    order = rows[np.argsort(own[:, axis], kind="stable")] if own.shape[1] else rows
    half = len(rows) // 2
    below = _split(x, order[:half], leaf) + _split(x, order[half:], leaf)
    return [(np.concatenate([r for r, n in below if n == 1]), len(below) + 1), *below]


def forest(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Rows in tree order, and of each node in depth-first order: first row, end, nodes of its subtree, label, centre and radius."""
    kinds, of, n = np.unique(labels, return_inverse=True, return_counts=True)
    trees = [np.flatnonzero(of == i) for i in np.flatnonzero(n >= leaf)]
    rest = np.flatnonzero(n[of] < leaf)
    nodes = [node for rows in (*trees, *([rest] if len(rest) else [])) for node in _split(x, rows, leaf)]
    order = np.concatenate([rows for rows, size in nodes if size == 1])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own = [x[rows].astype(np.float64) for rows, _ in nodes]
    centre = np.stack([m.mean(axis=0) for m in own])
    radius = np.array([np.sqrt(((m - c) ** 2).sum(axis=1).max()) for m, c in zip(own, centre)])
    one = [labels[rows] for rows, _ in nodes]
    return {
        "members": ids[order], "labels": labels[order], "rows": narrow(x[order]),
        "nodes": np.array([(place[rows].min(), place[rows].min() + len(rows), size, (m == m[0]).all(), m[0]) for (rows, size), m in zip(nodes, one)], np.int64),
        "centres": centre, "radii": radius,
    }


def _shards(rows: DataFrame, scale: int, most: int, leaf: int) -> DataFrame:
    names = ("members", "labels", "rows", "nodes", "centres", "radii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, labels), x in held(batches, ["vec_id", "label"], scale, most):
            made = forest(ids, labels, x, leaf)
            arrays = [pa.array([number]), pa.array([x.shape[1]], pa.int32()), pa.array([8 * made["rows"].itemsize], pa.int32()), *(pa.array([np.ascontiguousarray(made[c]).tobytes()], pa.binary()) for c in names)]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "width", "bits", *names])

    return rows.mapInArrow(run, "shard long, width int, bits int, " + ", ".join(f"{c} binary" for c in names))


def _anchors(rows: DataFrame, scale: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, labels), x in held(batches, ["vec_id", "label"], scale, most):
            arrays = [pa.array([number]), pa.array([x.shape[1]], pa.int32()), *(pa.array([np.ascontiguousarray(y).tobytes()], pa.binary()) for y in (ids, labels, x))]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "size", "ids", "own", "x"])

    return rows.mapInArrow(run, "block long, size int, ids binary, own binary, x binary")


class Wanted:
    """Searches of one block: of row ``at`` of ``x``, for scores from lo to hi, among rows of the same label or of others."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.x, self.at, self.lo, self.hi, self.same = ids, labels, x, at, lo, hi, same
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.best = Best(len(at), k)
        self.scored = 0  # inner products taken with rows

    def visit(self, row: dict) -> None:
        size = row["width"]
        if size != self.x.shape[1]:
            return
        ids, labels = np.frombuffer(row["members"], np.int64), np.frombuffer(row["labels"], np.int64)
        x = np.frombuffer(row["rows"], np.dtype(f"int{row['bits']}")).reshape(len(ids), size)
        nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 5)
        centres = np.frombuffer(row["centres"], np.float64).reshape(len(nodes), size)
        radii = np.frombuffer(row["radii"], np.float64)
        near = centres @ self.x.T.astype(np.float64)
        far = radii[:, None] * self.norm
        slack = 1e-9 * (np.sqrt((centres**2).sum(axis=1))[:, None] * self.norm + far) + 1e-6
        high, low = near + far + slack, near - far - slack
        leaves = np.flatnonzero(nodes[:, 2] == 1)
        floor = self._promise(ids, labels, x, nodes[leaves], near[leaves])
        stack = [(node, np.arange(len(self.at))) for node in self._roots(nodes, near)]
        while stack:
            node, left = stack.pop()
            begin, end, below, one, label = nodes[node].tolist()
            at = self.at[left]
            fine = (high[node, at] >= self.lo[left]) & (low[node, at] <= self.hi[left]) & (high[node, at] >= np.maximum(floor[left], self.best.least()[left]))
            if one:
                fine &= (self.labels[at] == label) == self.same
            left = left[fine]
            if not len(left):
                continue
            if below > 1:
                first = node + 1
                second = first + int(nodes[first, 2])
                turn = (near[first, self.at[left]] > near[second, self.at[left]]).mean() > 0.5
                stack += [(second, left), (first, left)] if turn else [(first, left), (second, left)]
            else:
                i, j, score = self._fitting(ids[begin:end], labels[begin:end], x[begin:end], left, np.maximum(floor[left], self.best.least()[left]))
                if len(i):
                    self.best.add(left[i], score, ids[begin + j])

    def _promise(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaves: np.ndarray, near: np.ndarray) -> np.ndarray:
        """A score that k rows of the leaf nearest to each search reach, NONE if so many don't fit: the k-th can't be below."""
        k, floor = self.best.score.shape[1], np.full(len(self.at), NONE)
        out = (leaves[:, 3] == 1)[:, None] & ((leaves[:, 4][:, None] == self.labels[self.at]) != self.same)
        nearest = np.argmax(np.where(out, -np.inf, near[:, self.at]), axis=0) if len(leaves) else floor
        for leaf in np.unique(nearest).tolist():
            left, (begin, end) = np.flatnonzero(nearest == leaf), leaves[leaf, :2].tolist()
            i, _, score = self._fitting(ids[begin:end], labels[begin:end], x[begin:end], left, self.lo[left])
            order = np.lexsort((~score, i))
            first = np.searchsorted(i[order], np.arange(len(left)))
            many = np.flatnonzero(np.bincount(i, minlength=len(left)) >= k)
            floor[left[many]] = score[order[first[many] + k - 1]]
        return floor

    def _roots(self, nodes: np.ndarray, near: np.ndarray) -> list[int]:
        """Trees, the most promising last."""
        found, at = [], 0
        while at < len(nodes):
            found.append(at)
            at += int(nodes[at, 2])
        return sorted(found, key=lambda i: near[i].mean())

    def _fitting(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, left: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Searches (places in ``left``), rows and scores where a row's label fits and its score is in the window and ``floor`` at least."""
        of, back = np.unique(self.at[left], return_inverse=True)
        self.scored += len(of) * len(x)
        score = products(self.x[of], x)[back]
        at = self.at[left]
        fine = (score >= np.maximum(self.lo[left], floor)[:, None]) & (score <= self.hi[left][:, None]) & ((labels[None, :] == self.labels[at][:, None]) == self.same)
        if self.same:
            fine &= ids[None, :] != self.ids[at][:, None]
        i, j = np.nonzero(fine)
        return i, j, score[i, j]


def _searched(blocks: DataFrame, shards: DataFrame, counts: tuple[int, int], same: bool, k: int) -> DataFrame:
    """block, at, place (of the positive), id and score: the best of each group of shards."""

    def begin(row: dict) -> tuple:
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64)
        x = np.frombuffer(row["x"], np.int64).reshape(len(ids), row["size"])
        if same:
            at, place = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            lo, hi = np.full(len(ids), NONE + 1), np.full(len(ids), np.iinfo(np.int64).max)
        else:
            found = np.array([(p["at"], p["place"], p["score"]) for p in row["positives"] if p["score"] >= 0], np.int64).reshape(-1, 3)
            at, place, hi = found[:, 0], found[:, 1], found[:, 2] * MOST // 100
            lo = -(-LEAST * found[:, 2] // 100)
        return row["block"], place, Wanted(ids, labels, x, at, lo, hi, same, k)

    def end(state: tuple) -> Iterator[pa.RecordBatch]:
        number, place, wanted = state
        q, score, found = wanted.best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number)), pa.array(wanted.at[q].astype(np.int32)), pa.array(place[q].astype(np.int32)), pa.array(wanted.ids[wanted.at[q]]), pa.array(found), pa.array(score)], names=["block", "at", "place", "anchor_id", "vec_id", "score"])

    groups = gathered(blocks, shards, *counts)
    return groups.mapInArrow(lambda b: met(b, begin, lambda state, row: state[2].visit(row), end), "block long, at int, place int, anchor_id long, vec_id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score and negative_score for each row where ``is_anchor`` holds.

    ``vectors`` has vec_id, label and embedding. Labels are told apart by their number, or a hash where they are none.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    number = dict(vectors.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    rows = comparable(vectors).where(F.col("label").isNotNull())
    label = (F.col("label").cast("long") if number else F.xxhash64("label")).alias("label")
    shape = [F.col("vec_id").cast("long").alias("vec_id"), label, "embedding"]
    shards = stage(_shards(rows.select(*shape), scale, shard, leaf), "ball-trees")
    blocks = stage(_anchors(rows.where(is_anchor).select(*shape), scale, block), "anchors")
    counts = blocks.count(), shards.count()
    found = ranked(_searched(blocks, shards, counts, True, positives), ["block", "at"], "score", "vec_id", positives)
    found = stage(found.select("block", "at", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), "score"), "positives")
    of = found.groupBy(F.col("block").alias("_b")).agg(F.collect_list(F.struct("at", "place", "score")).alias("positives"))
    asked = stage(blocks.join(of, F.col("block") == F.col("_b")).drop("_b"), "asked")
    out = ranked(_searched(asked, shards, counts, False, negatives), ["block", "at", "place"], "score", "vec_id", negatives)
    out = out.select("block", "at", "place", "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(found.withColumnRenamed("score", "positive_score"), ["block", "at", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, F.col("vec_id") % 100 == 0)


#: Plain products of all pairs, for small tables.
OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.r AS rc, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_dot_product(a.x, c.x), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND len(a.x) = len(c.x) AND (a.vec_id <> c.vec_id OR a.label <> c.label)
), p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r AND p.place <= {POSITIVES} AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score
)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
