"""The histogram store: one row a histogram with dense arrays, and the long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions.scalar import clean


def dense(hist: DataFrame, value: str = "sumw") -> DataFrame:
    """plot_type, variable, sample, counts, sumw2 and bin_edges from a dense long histogram (family, var, process, bin, lo, hi)."""
    row = F.struct("bin", "lo", "hi", clean(F.col(value)).alias("v"), clean(F.col("sumw2")).alias("v2"))
    by = hist.groupBy(F.col("family").alias("plot_type"), F.col("var").alias("variable"), F.col("process").alias("sample")).agg(F.sort_array(F.collect_list(row)).alias("b"))
    return by.select("plot_type", "variable", "sample", F.col("b.v").alias("counts"), F.col("b.v2").alias("sumw2"), F.concat(F.col("b.lo"), F.array(F.element_at("b.hi", -1))).alias("bin_edges"))


def write(histograms: DataFrame, path: str, codec: str = "zstd") -> None:
    histograms.write.mode("overwrite").option("compression", codec).parquet(path)


SCHEMA = "plot_type string, variable string, sample string, counts array<double>, sumw2 array<double>, bin_edges array<double>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All histograms of a file, folder or glob, each sample of a plot once: the last by file name and row. Files that cannot be read are left out (see ``left_out``)."""
    own = F.struct("counts", "sumw2", "bin_edges")
    rows = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", True).parquet(path).groupBy("plot_type", "variable", "sample").agg(F.max_by(own, F.struct("_metadata.file_path", "_metadata.row_index")).alias("h"))
    return rows.select("plot_type", "variable", "sample", "h.*")


def left_out(spark: SparkSession, path: str) -> DataFrame:
    """path of each Parquet file of a store that gives no histogram: broken, or empty."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    given = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", True).parquet(path).select(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"[+]", "%2B")).alias("_path")).distinct()
    return found.join(given, plain("path") == plain("_path"), "left_anti")


def long(histograms: DataFrame) -> DataFrame:
    """plot_type, variable, sample, bin, lo, hi and count; NaN and null count as 0, empty counts as zeros."""
    n = F.size("bin_edges") - 1
    counts = F.when(F.size("counts") == n, F.col("counts")).otherwise(F.array_repeat(F.lit(0.0), n))
    zipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("bin"), F.get("bin_edges", i).alias("lo"), F.get("bin_edges", i + 1).alias("hi"), clean(F.get(counts, i)).alias("count")))
    return histograms.where("size(bin_edges) > 1").select("plot_type", "variable", "sample", F.explode(zipped).alias("b")).select("plot_type", "variable", "sample", "b.*")
