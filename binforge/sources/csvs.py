"""CSV files by their own headers, with those left out and listed that cannot be read.

Whatever the number of files, two jobs find out about them, and a third if some are archives: one takes the first line
of each, the other reads all rows once, by header, and learns for each file whether its rows fit the header and for each
column which type holds all its values. Archives (gz and bz2, up to 512 MB) are unpacked before, as Spark would use what
comes before a break. A file is left out if it has no line, cannot be read (a broken archive), or has a row with more values than its
header has names. Rows with fewer values are filled with nulls.
"""

from __future__ import annotations

import bz2
import csv
import logging
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions.binning import local

log = logging.getLogger(__name__)

_MORE = "_more"
#: Bytes up to which an archive is unpacked to see whether it is whole.
ARCHIVE_BYTES = 1 << 29

_OPTIONS = {"mode": "PERMISSIVE", "ignoreCorruptFiles": True, "ignoreMissingFiles": True}


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and header (the first line that isn't blank) of each file that has one."""
    lines = spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True).text(paths)
    first = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).where("at = 0 and trim(value) <> ''")
    first = first.withColumn("number", F.monotonically_increasing_id())  # grows in the order of a task's lines
    return first.groupBy("path").agg(F.min_by("value", "number").alias("header"))


def _whole(data: memoryview, gz: bool) -> bool:
    """Whether an archive can be unpacked to its end."""
    step = 1 << 20
    try:
        while len(data):
            unpack = zlib.decompressobj(31) if gz else bz2.BZ2Decompressor()
            while len(data) and not unpack.eof:
                unpack.decompress(data[:step])
                rest = len(unpack.unused_data)
                data = data[min(step, len(data)) - rest :]
            if not unpack.eof:
                return False
    except (zlib.error, OSError, EOFError):
        return False
    return True


def broken(spark: SparkSession, paths: list[str]) -> list[str]:
    """Archives that cannot be unpacked to their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                if not _whole(memoryview(data.as_buffer()), path.as_py().endswith(".gz")):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()])], names=["path"])

    found = spark.read.format("binaryFile").load(paths).where(f"length <= {ARCHIVE_BYTES}").select("path", "content")
    return [r["path"] for r in found.mapInArrow(run, "path string").collect()]


def names_of(header: str) -> list[str]:
    """Column names of a header line; one without a name or with a name that is taken gets its number."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header.lstrip("﻿").rstrip("\r")]))):
        name = name.strip() or f"_c{i}"
        out.append(f"{name}{i}" if name in out else name)
    return out


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _raw(spark: SparkSession, names: list[str], paths: list[str]) -> DataFrame:
    """All values as text, and ``_MORE`` with what follows the last column."""
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in (*names, _MORE))
    return spark.read.options(**_OPTIONS, header=True, enforceSchema=True).schema(schema).csv(paths)


def _about(value: Column) -> Column:
    """What a value rules out: [it is one, not int, not bigint, not double, not boolean]."""
    return F.array(value.isNotNull(), *[value.isNotNull() & value.try_cast(kind).isNull() for kind in ("int", "bigint", "double", "boolean")])


def _kind(seen: list[bool]) -> str:
    there, *no = seen
    return "string" if not there else next((k for k, ruled_out in zip(("int", "bigint", "double", "boolean"), no) if not ruled_out), "string")


def read_csv(spark: SparkSession, paths: list[str], types: dict[str, str] | None = None, files: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rows of all good files by name, and path and reason of the others; fails if there is no good one.

    A column has one type in all files: that of ``types``, or int, bigint, double or boolean if all its values are such,
    else string. With ``files`` rows carry their file as ``_file``.
    """
    from binforge.sources.store import file_of, plain_path

    plain = {plain_path(p): p for p in paths}
    archives = [p for p in paths if p.endswith((".gz", ".bz2"))]
    torn = {plain_path(p) for p in broken(spark, archives)} if archives else set()
    bad = [(plain[p], "the archive is broken") for p in plain if p in torn]
    paths = [p for p in paths if plain_path(p) not in torn]
    found = {plain_path(r["path"]): names_of(r["header"]) for r in (headers(spark, paths).collect() if paths else [])}
    groups: dict[tuple[str, ...], list[str]] = {}
    for p, names in found.items():
        groups.setdefault(tuple(names), []).append(plain.get(p, p))
    bad += [(plain[p], "no line could be read") for p in plain if p not in found and p not in torn and not any(f.startswith(f"{p.rstrip('/')}/") for f in found)]
    checks = []
    for i, (names, own) in enumerate(groups.items()):
        raw = _raw(spark, list(names), own)
        seen = F.array(*[F.array(*[F.max(_about(_quoted(n))[k]) for k in range(5)]) for n in names]) if types is None else F.lit(None).cast("array<array<boolean>>")
        each = raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(_MORE).alias("more"), seen.alias("seen"))
        good = F.when(F.col("more") == 0, F.col("seen"))
        kinds = F.array(*[F.array(*[F.bool_or(F.get(F.get(good, j), k)) for k in range(5)]) for j in range(len(names))]) if types is None else F.lit(None).cast("array<array<boolean>>")
        checks.append(each.agg(F.lit(i).alias("group"), F.collect_list(F.when(F.col("more") > 0, F.struct("path", "more"))).alias("bad"), kinds.alias("kinds")))
    seen_of: dict[str, list[bool]] = {}
    for r in reduce(DataFrame.union, checks).collect() if checks else []:
        names = list(groups)[r["group"]]
        out = {plain.get(plain_path(x["path"]), x["path"]): x["more"] for x in r["bad"]}
        bad += [(p, f"{n} rows have more values than the header has names") for p, n in out.items()]
        groups[names] = [p for p in groups[names] if p not in out]
        for name, own in zip(names, r["kinds"] or ()):
            seen_of[name] = [a or bool(b) for a, b in zip(seen_of.get(name, [False] * 5), own)]
    for p, reason in bad:
        log.warning("left out %s: %s", p, reason)
    good = [(names, own) for names, own in groups.items() if own]
    if not good:
        raise ValueError(f"no CSV file can be read: {bad[:3]}")
    kind = lambda n: (types or {}).get(n, "string") if types is not None else _kind(seen_of.get(n, [False] * 5))
    frames = []
    for names, own in good:
        columns = [_quoted(n).try_cast(kind(n)).alias(n) if kind(n) != "string" else _quoted(n) for n in names]
        frames.append(_raw(spark, list(names), own).select(*columns, *([file_of()] if files else [])))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows, local(spark, sorted(bad), "path string, reason string")
