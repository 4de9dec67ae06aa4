"""The first rows of samples and files, read without the others.

Each head is a job that starts with one task on the first file and stops it after n rows, so it costs a batch of rows
whatever the file's size; further files are opened only while rows are missing. Heads of several samples run side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from binforge.sources import catalog
from binforge.sources.config import Sample

#: Jobs at a time.
TOGETHER = 8


def first_rows(spark: SparkSession, files: list, fmt: str, n: int, plan: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[list[Row], StructType | None]:
    """The first n rows in the order of files, and their schema. ``plan`` may select rows and columns; it sees one file at a time."""
    rows: list[Row] = []
    schema = None
    for f in files:
        if len(rows) >= n:
            break
        df = plan(catalog.read(spark, [f], fmt))
        if schema is None or df.schema == schema:
            schema = df.schema
            rows += df.limit(n - len(rows)).collect()
        else:  # columns by name, those of the first file
            df = df.select(*[(F.col(f"`{c.name}`") if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema])
            rows += df.limit(n - len(rows)).collect()
    return rows, schema


def _together(spark: SparkSession, found: list[tuple[dict, list[Row], StructType | None]]) -> DataFrame:
    frames = [spark.createDataFrame(rows, schema).withColumns({k: F.lit(x) for k, x in about.items()}) for about, rows, schema in found if schema is not None]
    if not frames:
        raise ValueError("no sample has files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def head_of_samples(spark: SparkSession, samples: tuple[Sample, ...], n: int, root: str = ".", plan: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The first n rows of each sample that has files, with ``sample``; columns a sample lacks are null."""
    index = catalog.index(samples, root, spark)
    with ThreadPoolExecutor(TOGETHER) as pool:
        found = list(pool.map(lambda x: ({"sample": x[0].name}, *first_rows(spark, x[1], x[2], n, plan)), index))
    return _together(spark, found)


def head(spark: SparkSession, samples: tuple[Sample, ...], n: int, root: str = ".", plan: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The first n rows of all samples in order: groups of samples are opened only until n rows are there."""
    index, found, have = catalog.index(samples, root, spark), [], 0
    for at in range(0, len(index), TOGETHER):
        with ThreadPoolExecutor(TOGETHER) as pool:
            group = list(pool.map(lambda x: ({"sample": x[0].name}, *first_rows(spark, x[1], x[2], n, plan)), index[at : at + TOGETHER]))
        for about, rows, schema in group:
            found.append((about, rows[: n - have], schema))
            have += len(found[-1][1])
        if have >= n:
            break
    return _together(spark, found)


def head_of_files(spark: SparkSession, files: list, fmt: str, n: int = 1) -> DataFrame:
    """The first n rows of each file, with ``file``."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        found = list(pool.map(lambda f: ({"file": str(f)}, *first_rows(spark, [f], fmt, n)), files))
    return _together(spark, found)
