"""Compaction of a folder of Parquet files into few, in order and without a shuffle.

Files are taken in the order of their names and dealt on the driver, by their bytes, to packs of neighbours. A pack is one
task that reads its files one after another and writes their rows as they come: so rows are in the order of the sorted
files, within a file and over all files by name, and no row goes over the network. Only neighbouring small files are read
together, up to ``RUN_BYTES``, and sorted by file and row. A file that is much larger than a pack is read by several tasks,
each of which writes what it reads; where its row groups are larger than a pack, a limit on the records of an output file
cuts it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input to one output file, input that is sorted at once, and packs that are written by one job.
FILE_BYTES = 256 << 20
RUN_BYTES = 16 << 20
TOGETHER = 64


def packs(files: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Neighbours in order, about ``target`` bytes together: from half to one and a half of it where single files allow."""
    out: list[list[str]] = []
    sizes: list[int] = []
    for path, size in files:
        if out and (sizes[-1] + size <= 1.25 * target or sizes[-1] < target // 2):
            out[-1].append(path)
            sizes[-1] += size
        else:
            out.append([path])
            sizes.append(size)
    if len(out) > 1 and sizes[-1] < target // 2 and sizes[-1] + sizes[-2] <= 2 * target:
        out[-2:] = [out[-2] + out[-1]]
    return out


def runs(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Neighbours in order that are read at once: small files up to ``most`` bytes together, larger ones alone."""
    out: list[list[str]] = []
    room = 0
    for path, size in files:
        if size <= room:
            out[-1].append(path)
            room -= size
        else:
            out.append([path])
            room = most - size
    return out


@contextmanager
def _separate(spark: SparkSession, split: int) -> Iterator[None]:
    """Files are cut into pieces of ``split`` bytes only, and a union of tables of one partition each is not one partition."""
    settings = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.files.maxPartitionBytes": f"{split}b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def compact(spark: SparkSession, folder: str, out: str, files: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """All Parquet files below ``folder`` as files of about ``file_bytes`` of input each (or ``files`` of them) with zstd; fails if there are none.

    Columns are those of all files, null where a file lacks one. More than ``TOGETHER`` packs go to numbered folders.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    found = sorted(map(tuple, listed.collect()))
    if not found:
        raise FileNotFoundError(f"no Parquet files below {folder}")
    total = sum(n for _, n in found)
    target = max(1, -(-total // files) if files else file_bytes)
    schema = spark.read.option("mergeSchema", True).parquet(*[p for p, _ in found]).schema
    large = 1.5 * target  # files above it are packs of their own, and cut if their number is free
    split = total + 1 if files else int(large)
    made = packs(found, target) if files else [own for alone, group in groupby(found, lambda x: x[1] > large) for own in ([[p] for p, _ in group] if alone else packs(list(group), target))]
    rows = spark.read.schema(schema).parquet(*[p for p, _ in found]).count() if len(found) > len(made) or total > target else 0
    limit = int(large * rows / total) + 1 if files is None and any(n > large for _, n in found) else 0
    size = dict(found)

    def pack(own: list[str]) -> DataFrame:
        if not files and size[own[0]] > large:
            return spark.read.schema(schema).parquet(*own)  # one partition a piece, in order
        # A file alone is read in its order; of several, Spark reads the largest first.
        read = [(len(p), spark.read.schema(schema).parquet(*p).coalesce(1)) for p in runs([(p, size[p]) for p in own], RUN_BYTES)]
        read = [df.sortWithinPartitions("_metadata.file_path", "_metadata.row_index") if n > 1 else df for n, df in read]
        return reduce(DataFrame.unionAll, read).coalesce(1)

    with _separate(spark, split):
        for first in range(0, len(made), TOGETHER):
            own = [pack(p) for p in made[first : first + TOGETHER]]
            writer = reduce(DataFrame.unionAll, own).write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", limit)
            writer.parquet(out if len(made) <= TOGETHER else f"{out}/{first // TOGETHER:05d}")
    return spark.read.option("recursiveFileLookup", True).parquet(out)
