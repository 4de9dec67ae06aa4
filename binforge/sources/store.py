"""Histograms that grow with their files: partial sums on disk, merged when they are read.

``parts/part=<id>`` holds the partial histogram of some files, ``files/part=<id>`` their names, lengths and times. An id
is made from these, so a part that is written again replaces itself, and it counts only once its files are listed, which
is the last step. A file is filled once, whatever batch it comes in and however often: a stream may be stopped and started
anew, with its checkpoint or without, and a batch may be delivered twice. Sums are exact, so the result is the same in
every bit as that of one pass over all files.

Compaction writes all live parts as one of a higher generation, which replaces them; ``vacuum`` deletes what is replaced
or was never finished. One writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions import exact
from binforge.operators.fill import KEYS

FILE = "struct<path: string, length: bigint, modified: timestamp>"
_PARTS = ", ".join(f"{k} string" for k in KEYS) + f", bin int, count bigint, sumw {exact.SUM}, sumw2 {exact.SUM}, part string"
_FILES = "path string, length bigint, modified timestamp, generation int, setup string, part string"


def file_of() -> Column:
    """The file that a row of a table read from files comes from, as ``_file``."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified")).alias("_file")


def plain_path(path: str) -> str:
    """A path as the local disk names it, or with its scheme in another store."""
    at = urlparse(path)
    return unquote(at.path) if at.scheme in ("", "file") else unquote(path)


class HistogramStore:
    """``setup`` names what the histograms depend on besides events (cuts, bins, weights): a store has one."""

    def __init__(self, spark: SparkSession, path: str, setup: str = ""):
        self.spark, self.path, self.setup = spark, path.rstrip("/"), hashlib.sha256(setup.encode()).hexdigest()[:16]

    def _at(self, what: str) -> tuple[JavaObject, JavaObject]:
        """A folder of the store, and the file system that it is in."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, what: str, schema: str) -> DataFrame:
        at, system = self._at(what)
        if not system.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def _listed(self) -> DataFrame:
        """Every file with the part that counts for it: that of the highest generation."""
        last = F.max_by(F.struct("length", "modified", "part", "setup"), F.struct("generation", "part"))
        return self._read("files", _FILES).groupBy("path").agg(last.alias("f"), F.max("generation").alias("generation")).select("path", "f.*", "generation")

    def files(self) -> DataFrame:
        """path, length and modified of all files that are filled."""
        return self._listed().select("path", "length", "modified")

    def _live(self) -> DataFrame:
        live = self._listed().select(F.col("part").alias("_part")).distinct()
        return self._read("parts", _PARTS).join(live, F.col("part") == F.col("_part"), "left_semi").drop("part")

    def add(self, events: DataFrame, plan: Callable[[DataFrame], DataFrame]) -> int:
        """Fill the files of ``events`` (with ``_file``) that aren't filled yet by ``plan`` (see ``fill.partial``); how many."""
        seen = events.select("_file.*").distinct()
        old = self._listed().select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modified").alias("_modified"), "setup")
        both = seen.join(old, F.col("path") == F.col("_path"), "left")
        same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
        number = F.xxhash64("path", "length", "modified")
        new = F.col("_path").isNull()
        n, one, two, known, changed, other = both.agg(
            F.count_if(new), F.bit_xor(F.when(new, number)), F.sum(F.when(new, F.pmod(number, F.lit(1 << 31)))), F.count_if(~new), F.min(F.when(~new & ~same, F.col("path"))), F.count_if(~new & (F.col("setup") != self.setup)),
        ).first()
        if changed is not None:
            raise ValueError(f"{changed} has changed since it was filled")
        if other:
            raise ValueError("the store was filled with another setup")
        if not n:
            return 0
        part = f"p{one & ((1 << 64) - 1):016x}{two & ((1 << 64) - 1):016x}-{n}"
        fresh = both.where(new).select("path", "length", "modified")
        if known:
            events = events.join(fresh.select(F.col("path").alias("_path")), F.col("_file.path") == F.col("_path"), "left_semi")
        self._write(part, plan(events), fresh, 0)
        return n

    def _write(self, part: str, sums: DataFrame, files: DataFrame, generation: int) -> None:
        sums.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/parts/part={part}")
        files.select("path", "length", "modified", F.lit(generation).alias("generation"), F.lit(self.setup).alias("setup")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/files/part={part}")

    def sums(self) -> DataFrame:
        return self._live().groupBy(*KEYS, "bin").agg(F.sum("count").alias("count"), exact.merged("sumw").alias("sumw"), exact.merged("sumw2").alias("sumw2"))

    def histogram(self) -> DataFrame:
        """The histogram of all files: what ``fill.histogram`` makes of them in one pass, with exact sums."""
        return self.sums().withColumns({c: exact.value(F.col(c)) for c in ("sumw", "sumw2")})

    def compact(self) -> None:
        """All live parts as one. Readers see the old ones until the new one is complete."""
        listed = self._listed()
        n, generation, parts = listed.agg(F.count(F.lit(1)), F.max("generation"), F.count_distinct("part")).first()
        if parts > 1:
            self._write(f"m{generation + 1}-{n}", self.sums().coalesce(1), listed, generation + 1)

    def vacuum(self) -> list[str]:
        """Delete the parts that don't count; their names."""
        live = {r["part"] for r in self._listed().select("part").distinct().collect()}
        gone = []
        for what in ("files", "parts"):  # a part without its files is not read
            at, system = self._at(what)
            for found in system.listStatus(at) if system.exists(at) else ():
                name = found.getPath().getName()
                if name.startswith("part=") and name[5:] not in live:
                    system.delete(found.getPath(), True)
                    gone.append(f"{what}/{name}")
        return gone
