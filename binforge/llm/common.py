"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split`` cuts at exactly these bytes.
ASCII_SPACE = " \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one in local mode if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="binforge-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: Bytes of an Arrow batch that goes to Python, a little below what ``pieces_of`` takes at once.
BATCH_BYTES = 3_900_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by 10,000 rows alone, for this session unless it has a bound of its own."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_STAGED: list[str] = []


def to_release(path: str) -> str:
    """Have ``release`` delete a folder, too."""
    _STAGED.append(path)
    return path


def release() -> None:
    """Delete what this driver has staged, once no result that was made from it is needed any more."""
    from pyarrow import fs

    while _STAGED:
        system, path = fs.FileSystem.from_uri(_STAGED.pop())
        system.delete_dir(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads survive a lost executor. See ``release``."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """With the id, identifies a row by content, so rows that share an id but not a text stay apart."""
    return F.xxhash64(F.col(text))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return freed memory to the system; a worker that waits or goes on would hold the most that it ever took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most about ``most`` bytes of text (one row at least), in order.

    ``text`` is a column, or row.text for a field of a struct. What was freed goes back to the system after each batch.
    """
    column, _, inner = text.partition(".")
    for batch in batches:
        at, size = 0, 0
        texts = batch.column(column)
        for i, n in enumerate(pc.binary_length(pc.struct_field(texts, inner) if inner else texts).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)
        give_back()


_BLOCK = 1 << 16  # bytes hashed at once, so that the arrays stay in the cache
LONG_WORD = 32  # bytes above which a word is hashed by itself
_SPACES = np.zeros(256, bool)
_SPACES[list(ASCII_SPACE.encode())] = True
_ALL = np.uint64((1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which each bit moves about half of all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def folded(code: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The code of a sequence with one more word. Not a sum, so words that change places don't cancel out."""
    x = (code ^ h) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where they begin.

    A word's bytes go in eight at a time and are mixed in between; words of eight bytes or less differ for certain from
    others of their length. Long ones are hashed by xxh3.
    """
    space = _SPACES[data]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    size = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 - start
    if not len(start):
        return np.zeros(0, np.uint64), start
    padded = np.concatenate((data, np.zeros(LONG_WORD, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, LONG_WORD, 8):
        own = np.flatnonzero(size > at) if at else slice(None)
        bits = np.minimum(size[own] - at, 8).astype(np.uint64) * np.uint64(8)
        h[own] = mixed(h[own] ^ (eight[start[own] + at] & (_ALL >> (np.uint64(64) - bits))))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return h, start


def _hash(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and beginnings of all words, by blocks that end between words."""
    out, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while at < len(data):
        end = at + _BLOCK
        if end < len(data) and (end := max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))) <= at:
            found = [x for x in (data.find(b" ", at + _BLOCK), data.find(b"\n", at + _BLOCK)) if x > 0]
            end = min(found, default=len(data))
        h, start = _hashed(np.frombuffer(data[at:end], np.uint8))
        out.append((h, start + at))
        at = end
    return tuple(map(np.concatenate, zip(*out)))


def hash_text(data: bytes) -> np.ndarray:
    """64-bit hashes of all words of a text in order."""
    return _hash(data)[0]


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many each text has."""
    h, begins = _hash(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    return h, np.diff(np.concatenate(([0], np.searchsorted(begins, ends)))).astype(np.int64)


#: Links of one node above which its rows are worth more than one task.
HOT_LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for each node in ``links`` (a, b: long).

    Large-star and small-star steps until only stars are left, none if they come as such. Each round is a stored table,
    so a lost executor costs one round. Minima are aggregated before they are joined, and the rows of a node with very
    many links are split.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("leaf").alias("l"), F.sum("centre").alias("c"))
        more, most = ends.agg(F.max(F.expr("l > 1 or l > 0 and c > 0")), F.max(F.expr("l + c"))).first()
        if not more:
            break
        # With a node of very many links, minima are stored: both sides of a join are plain exchanges then, and Spark splits it.
        held = (lambda df: stage(df, "least")) if most > HOT_LINKS else (lambda df: df)
        both = edges.union(edges.select("v", "u"))
        least = held(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = held(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stage(small.where("u <> v").distinct(), "edges")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select("v", "v").distinct())


#: Rows of (id, key) pairs up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is not among those of ``gone`` (doc_id, key)."""
    gone = stage(gone.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_d"]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == gone["_k"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
