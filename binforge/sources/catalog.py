"""Files of samples: resolution, formats, merged files, and catalogues made from a folder tree."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binforge.functions.binning import local
from binforge.functions.scalar import group_of
from binforge.operators.ordering import coloured
from binforge.sources.compaction import compact as compact
from binforge.sources.config import Sample
from binforge.sources.csvs import read_csv
from binforge.sources.store import file_of

log = logging.getLogger(__name__)

MERGED = "merged.parquet"
FORMATS = {".parquet": "parquet", ".csv": "csv"}


def resolve_files(root: str | Path, files: tuple[str, ...]) -> list[Path]:
    """Absolute paths, each once, in order."""
    return list(dict.fromkeys(p if p.is_absolute() else Path(root) / p for p in map(Path, files)))


def scan_dirs(root: str | Path, dirs: tuple[str, ...]) -> list[Path]:
    found: list[Path] = []
    for d in resolve_files(root, dirs):
        if not d.is_dir():
            log.warning("no such folder: %s", d)
            continue
        found += sorted(p for p in d.rglob("*") if p.suffix in FORMATS)
    return found


def prefer_merged(files: list[Path]) -> list[Path]:
    merged = [p for p in files if p.name == MERGED]
    return merged if merged and len(files) > len(merged) else files


def format_of(files: list[Path]) -> str:
    files = [Path(p) for p in files]
    kinds = {FORMATS.get(p.suffix.lower()) for p in files}
    if not kinds:
        return "unknown"
    if len(kinds) > 1 or None in kinds:
        raise ValueError(f"mixed or unknown formats: {sorted({p.suffix for p in files})}")
    return kinds.pop()


def _stored(spark: SparkSession, folder: str) -> list[str]:
    """Files below a folder of any store that Spark reads."""
    try:
        return sorted(r["path"] for r in listing(spark, folder).select("path").collect())
    except AnalysisException as e:
        log.warning("no such folder: %s (%s)", folder, e.getCondition())
        return []


def _files_of(sample: Sample, root: str | Path, spark: SparkSession | None) -> list[Path] | list[str]:
    """Files that exist, each once. Names with a scheme (or a root with one) are left to Spark, others to the local disk."""
    if spark is None or not any("://" in str(x) for x in (root, *sample.files, *sample.dirs)):
        return prefer_merged([p for p in dict.fromkeys([*resolve_files(root, sample.files), *scan_dirs(root, sample.dirs)]) if p.exists()])
    full = lambda x: x if "://" in x or x.startswith("/") else f"{str(root).rstrip('/')}/{x}"
    found = list(dict.fromkeys(f for x in (*sample.files, *sample.dirs) for f in _stored(spark, full(x))))
    merged = [f for f in found if f.rpartition("/")[2] == MERGED]
    return merged or found


def index(samples: tuple[Sample, ...], root: str | Path = ".", spark: SparkSession | None = None) -> list[tuple[Sample, list[Path], str]]:
    """Each sample that has files, with these and their format; with ``spark`` in any store, not the local disk alone."""
    out = []
    for s in samples:
        files = _files_of(s, root, spark)
        if files:
            out.append((s, files, format_of(files)))
        else:
            log.warning("%s has no files", s.name)
    return out


def read(spark: SparkSession, files: list[Path] | list[str], fmt: str, with_file: bool = False) -> DataFrame:
    """Rows of all files by name; with ``with_file`` also ``_file``. CSV files that cannot be read are left out with a warning."""
    paths = [str(p) for p in files]
    if fmt == "parquet":
        df = spark.read.parquet(*paths)
        return df.select("*", file_of()) if with_file else df
    if fmt == "csv":
        return read_csv(spark, paths, files=with_file)[0]
    raise ValueError(f"unknown format {fmt!r}")


def schema_names(spark: SparkSession, files: list[Path], fmt: str) -> list[str]:
    return read(spark, files if fmt == "csv" else files[:1], fmt).columns if files else []


def listing(spark: SparkSession, folder: str, pattern: str = "*.{parquet,csv}") -> DataFrame:
    """path, length and modificationTime of all files below a folder, listed by Spark without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def merged_first(files: DataFrame) -> DataFrame:
    """``files`` (sample, path) without those of samples that have a merged file besides."""
    merged = F.substring_index("path", "/", -1) == MERGED
    has = F.max(merged).over(Window.partitionBy("sample"))
    return files.withColumn("_m", merged).withColumn("_has", has).where(F.col("_m") | ~F.col("_has")).drop("_m", "_has")


def deduplicated(files: DataFrame) -> DataFrame:
    """Each path of a sample once, at its first position."""
    return files.groupBy("sample", "path").agg(F.min("pos").alias("pos"))


def sample_catalogue(files: DataFrame, base: str, year: str, channel: str) -> DataFrame:
    """sample and sorted files from paths base/year/channel/sample/...; Parquet before CSV, merged before parts."""
    inner = F.regexp_extract("path", rf"\Q{base.rstrip('/')}/{year}/{channel}/\E([^/]+)/", 1)
    rows = files.withColumn("sample", inner).where("sample <> ''").withColumn("csv", F.endswith("path", F.lit(".csv")))
    both = F.min("csv").over(Window.partitionBy("sample"))
    rows = merged_first(rows.withColumn("_c", both).where(F.col("csv") == F.col("_c")).drop("_c"))
    return rows.groupBy("sample").agg(F.sort_array(F.collect_list("path")).alias("files"))


def process_map(samples: DataFrame) -> DataFrame:
    """process, samples and color from sample names, by the group patterns."""
    return coloured(samples.groupBy(group_of(F.col("sample")).alias("process")).agg(F.sort_array(F.collect_list("sample")).alias("samples")))


def format_path(path: str | Path, root: str | Path, mode: str = "auto") -> str:
    """A path as absolute, relative to the root, or relative only if it lies below it."""
    full, root = Path(path).resolve(), Path(root).resolve()
    below = full.is_relative_to(root)
    if mode == "absolute" or (mode == "auto" and not below):
        return str(full)
    if not below:
        raise ValueError(f"{full} is not below {root}")
    return str(full.relative_to(root))


def select_file(spark: SparkSession, path: str | Path, cuts: dict[str, float] | None) -> DataFrame:
    """One Parquet or CSV file after the cuts on the columns it has."""
    from binforge.operators.selection import select

    return select(read(spark, [path], format_of([Path(path)])), cuts)


def read_processes(spark: SparkSession, samples: tuple[Sample, ...], processes: dict[str, tuple[str, ...]], root: str | Path = ".") -> DataFrame:
    """All events of all processes' samples, with process and sample; columns a sample lacks are null."""
    of = {s: p for p, own in processes.items() for s in own}
    found = [read(spark, files, fmt).withColumns({"sample": F.lit(s.name), "process": F.lit(of[s.name])}) for s, files, fmt in index(samples, root, spark) if s.name in of]
    if not found:
        raise ValueError("no process has files")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def inspect(spark: SparkSession, samples: tuple[Sample, ...], root: str | Path = ".") -> DataFrame:
    """kind, sample, column and type of the first sample of each kind that has files."""
    rows, seen = [], set()
    for s, files, fmt in index(samples, root, spark):
        if s.kind not in seen:
            seen.add(s.kind)
            rows += [(s.kind, s.name, c, t) for c, t in read(spark, files[:1], fmt).dtypes]
    return local(spark, rows, "kind string, sample string, column string, type string")


def head_of_files(df: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each file that ``df``, read from files, comes from.

    Of any n groups of a file's rows, the largest of their least values is one that the n-th of all rows can't be above.
    So rows above it are left out before what is left is sorted; no task sorts what it reads.
    """
    file = F.col("_metadata.file_path")
    groups = df.select(file.alias("_of"), F.shiftright(F.monotonically_increasing_id(), 10).alias("_group"), F.col(order[0]).alias("_x")).where(F.col("_x").isNotNull())
    least = groups.groupBy("_of", "_group").agg(F.min("_x").alias("_least"))
    least = least.withColumn("_n", F.row_number().over(Window.partitionBy("_of").orderBy("_least"))).where(F.col("_n") <= n)
    bound = least.groupBy("_of").agg(F.max("_least").alias("_most"), F.max("_n").alias("_n")).where(F.col("_n") == n).drop("_n")
    rows = df.withColumn("_file", file).join(F.broadcast(bound), F.col("_file") == F.col("_of"), "left")
    rows = rows.where(F.col("_most").isNull() | F.col(order[0]).isNull() | (F.col(order[0]) <= F.col("_most"))).drop("_of", "_most")
    rank = F.row_number().over(Window.partitionBy("_file").orderBy(*order))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_file", "_n")


def next_folder(parent: str | Path, prefix: str = "Plots-") -> Path:
    """The first of prefix0, prefix1, ... that doesn't exist, made."""
    i = 0
    while True:
        path = Path(parent) / f"{prefix}{i}"
        try:
            path.mkdir(parents=True)
            return path
        except FileExistsError:
            i += 1
