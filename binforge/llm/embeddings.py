"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are normalised and turned by a fixed random rotation, which moves no distance. Cosine c means squared distance
2 - 2c. The rotated axes are split into blocks, and each block gets a share of that distance in proportion to its axes;
two vectors within the whole distance are within the share of one block at least.

Each block is range-joined on all of its axes: a vector lives in one cell of a grid on the first of them and visits the
later cells that its ball reaches, taking with it only the block's coordinates (16 bits each; what rounding can move is
added to the range). Vectors themselves then travel to those cells only where they have a partner within the share,
and just these pairs are verified exactly, by cosine in double precision on the vectors as given. A pair is counted in
the first block whose share it keeps and in no other, so links are counted, not collected.

Vectors are compared within a label and number of components. Null vectors or labels, zero vectors and vectors with
null or non-finite components link with nothing. Equal vectors are one point with a weight. Rows without an id take
part, with null as id; repeated ids are rows of their own and share a component. A cell with more than ``TOGETHER``
points is compared in blocks of that size, each pair of blocks a task of its own. Other columns are dropped.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.common import components, stage

COSINE = 0.98
AXES = 16  # axes of a block
GRID = 2  # of them spanned by the grid
UNITS = 32767  # steps from 0 to 1 of a coordinate that travels
PAIRS = 1 << 15  # cosines taken at once
TOGETHER = 4096
SLACK = 1e-9
SEED = 7


@functools.lru_cache(8)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks(size: int, cosine: float = COSINE, axes: int = AXES) -> list[tuple[slice, float]]:
    """Axes and radius of each block; the squared radii add up to the squared distance that ``cosine`` allows."""
    far = 2 - 2 * cosine
    return [(slice(i, min(i + axes, size)), float(np.sqrt(far * (min(i + axes, size) - i) / size)) + SLACK) for i in range(0, size, axes)]


def _turned(m: np.ndarray) -> np.ndarray:
    return (m / np.linalg.norm(m, axis=1, keepdims=True)) @ rotation(m.shape[1])


def _points(vectors: DataFrame) -> DataFrame:
    """Distinct comparable vectors: point (smallest row of equal ones), label, vector, weight, size."""
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of columns of whole numbers."""
    h = np.full(len(parts[-1]), 0x9E3779B97F4A7C15, np.uint64)
    for x in parts:
        h = (h ^ np.asarray(x).astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _visits(points: DataFrame, cosine: float) -> DataFrame:
    """A row for each point, block and cell: cell (hash of label, size, block and place), point, place (size, block and home in one number) and axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                point, label = (batch.column(c).to_numpy() for c in ("point", "label"))
                rows = [np.array(x, np.float64) for x in batch.column("embedding").to_pylist()]
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    turned = _turned(np.stack([rows[i] for i in at]))
                    for number, (own, radius) in enumerate(blocks(int(size), cosine)):
                        axes = [x.tobytes() for x in np.rint(turned[:, own] * UNITS).astype(np.int16)]
                        x = turned[:, own][:, :GRID] / (2 * radius)
                        cell = np.floor(x)
                        for step in itertools.product((-1, 0, 1), repeat=x.shape[1]):
                            if step < (0,) * len(step):
                                continue
                            way = np.array(step)
                            gap = np.where(way > 0, cell + 1 - x, np.where(way < 0, x - cell, 0))
                            near = np.flatnonzero((gap * gap).sum(axis=1) <= 0.25 * (1 + SLACK))
                            of, n = at[near], len(near)
                            place = _mixed(label[of], np.full(n, size), np.full(n, number), *(cell[near] + way).T)
                            kind = (int(size) << 20) + 2 * number + (not any(step))
                            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(point[of]), pa.array(np.full(n, kind, np.int64)), pa.array([axes[i] for i in near], pa.binary())], names=["cell", "point", "place", "axes"])

    return points.select("point", F.xxhash64("label").alias("label"), "embedding").mapInArrow(run, "cell long, point long, place long, axes binary")


def _placed(place: int) -> tuple[int, int]:
    """Vector size and block of a place."""
    return place >> 20, (place & 0xFFFFF) >> 1


def _sliced(rows: DataFrame, name: str) -> DataFrame:
    """Cells above TOGETHER rows cut into slices: a row for each pair of slices (lo, hi) that its own slice meets in."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER)
    sizes = stage(sizes.select(F.col("cell").alias("_cell"), F.ceil(F.col("_n") / TOGETHER).cast("int").alias("slices")), name)
    rows = rows.join(sizes, F.col("cell") == F.col("_cell"), "left").drop("_cell").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("point"), F.col("slices")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: F.struct(F.least(i, F.col("slice")).alias("lo"), F.greatest(i, F.col("slice")).alias("hi")))
    return rows.withColumn("_pair", F.explode(pair)).select("*", "_pair.lo", "_pair.hi").drop("_pair", "slices")


def _within(x: np.ndarray, far: float, home: np.ndarray, part: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices i, j of rows of x (slices lo and hi, one of the two at home) at most ``far`` apart, each pair once."""
    square = (x * x).sum(axis=1)
    for left, right in (((part == lo) & home, part == hi), ((part == hi) & home, (part == lo) & ~home))[: 1 + (lo != hi)]:
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        for at in np.array_split(left, max(1, -(-len(left) // 512))):
            near = square[at][:, None] + square[right][None, :] - 2 * (x[at] @ x[right].T) <= far * far + 1e-12
            i, j = np.nonzero(near)
            i, j = at[i], right[j]
            once = i < j if lo == hi else np.ones(len(i), bool)
            if lo == hi:
                once |= ~home[j]  # of a visitor and a row at home the latter is on the left
            yield i[once], j[once]


def candidates(visits: DataFrame, cosine: float) -> DataFrame:
    """cell, point and place of each visit with a partner within the block's share, and how many partners (pairs)."""

    def close(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        size, block = _placed(int(place[0]))
        own, radius = blocks(size, cosine)[block]
        axes = own.stop - own.start
        x = np.frombuffer(b"".join(table.column("axes").to_pylist()), np.int16).reshape(len(place), axes) / UNITS
        n = np.zeros(len(place), np.int64)
        for i, j in _within(x, radius + float(np.sqrt(axes)) / UNITS, (place & 1) > 0, table.column("slice").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()):
            n += np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
        some = np.flatnonzero(n)
        return pa.table({"cell": table.column("cell").take(some), "point": table.column("point").take(some), "place": place[some], "pairs": n[some]})

    found = _sliced(visits, "cells").groupBy("cell", "lo", "hi").applyInArrow(close, "cell long, point long, place long, pairs long")
    return found.groupBy("cell", "point", "place").agg(F.sum("pairs").alias("pairs"))


def linked(m: np.ndarray, i: np.ndarray, j: np.ndarray, turned: np.ndarray, block: int, cosine: float) -> np.ndarray:
    """Which of the pairs i, j of rows of m, all within the share of ``block``, link, if it is the first whose share they keep."""
    link = np.ones(len(i), bool)
    for own, radius in blocks(m.shape[1], cosine)[:block]:
        at = np.flatnonzero(link)
        link[at] = ((turned[i[at], own] - turned[j[at], own]) ** 2).sum(axis=1) > radius * radius
    left, norm = np.flatnonzero(link), np.linalg.norm(m, axis=1)
    for k in range(0, len(left), PAIRS):
        at = left[k : k + PAIRS]
        link[at] = (m[i[at]] * m[j[at]]).sum(axis=1) / (norm[i[at]] * norm[j[at]]) >= cosine
    return link


def _joined(points: DataFrame, cosine: float) -> DataFrame:
    """Rows a, b, n: a linked with n rows of other points (b null), or one link of a spanning forest (n null)."""
    wanted = stage(candidates(_visits(points, cosine), cosine).drop("pairs"), "candidates")
    vectors = points.select(F.col("point").alias("_p"), "weight", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    rows = _sliced(wanted, "close-cells").join(vectors, F.col("point") == F.col("_p")).drop("_p")

    def meet(table: pa.Table) -> pa.Table:
        point, weight, place, part = (table.column(c).to_numpy() for c in ("point", "weight", "place", "slice"))
        size, block = _placed(int(place[0]))
        m = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(point), size)
        turned = _turned(m)
        own, radius = blocks(size, cosine)[block]
        n, group = np.zeros(len(m), np.int64), np.arange(len(m))
        edges: list[tuple[int, int]] = []
        for i, j in _within(turned[:, own], radius, (place & 1) > 0, part, table.column("lo")[0].as_py(), table.column("hi")[0].as_py()):
            link = linked(m, i, j, turned, block, cosine)
            i, j = i[link], j[link]
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            begin = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
            for k in range(len(begin) - 1):  # all links of one row: join the groups that they touch
                x, others = i[begin[k]], j[begin[k] : begin[k + 1]]
                groups, first = np.unique(group[others], return_index=True)
                new = groups != group[x]
                if new.any():
                    edges += [(int(point[x]), int(point[y])) for y in others[first[new]]]
                    group[np.isin(group, groups[new])] = group[x]
        some = np.flatnonzero(n)
        k = len(edges)
        return pa.table({
            "a": pa.array([*point[some].tolist(), *(e[0] for e in edges)], pa.int64()),
            "b": pa.array([*[None] * len(some), *(e[1] for e in edges)], pa.int64()),
            "n": pa.array([*n[some].tolist(), *[None] * k], pa.int64()),
        })

    return stage(rows.groupBy("cell", "lo", "hi").applyInArrow(meet, "a long, b long, n long"), "met")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable) and kept, for each row."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    shape = F.xxhash64("label", "embedding")
    points = _points(vectors).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")).withColumn("point", shape)
    points = stage(points, "points")
    met = _joined(points, cosine)
    count = met.where("b is null").groupBy(F.col("a").alias("_p")).agg(F.sum("n").alias("n"))
    group = components(met.where("b is not null").select("a", "b"))
    own = points.select("point", "weight", "first").join(count, F.col("point") == F.col("_p"), "left").join(group, F.col("point") == F.col("node"), "left")
    own = own.select("point", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    own = own.join(least, "component").select(F.col("point").alias("_point"), "n_links", "component_id")
    plain = vectors.withColumn("_shape", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), shape)).select("vec_id", "_shape")
    out = plain.join(own, F.col("_shape") == F.col("_point"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
