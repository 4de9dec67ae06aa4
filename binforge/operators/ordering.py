"""Draw order, stacks, colours and heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binforge.functions.binning import few, local

#: Colours given to processes by rank, in turn; colours of processes without one.
PALETTE = ["tab:blue", "tab:orange", "tab:green", "tab:red", "tab:purple", "tab:brown", "tab:pink", "tab:gray"]
NO_COLOUR = "#999999"
SAMPLE_COLOUR = "tab:blue"
DATA_COLOUR = "black"


def ordered(rows: DataFrame, order: list[str], *, ignore_case: bool = True, listed_only: bool = False, position: str = "position") -> DataFrame:
    """``rows`` (process, position) with draw_idx: listed processes first in the list's order, then the others by position.

    An exact match comes before one that ignores case. With ``listed_only`` matches are exact and others are dropped.
    """
    spark = rows.sparkSession
    listed = F.broadcast(local(spark, [(name, i) for i, name in enumerate(order)], "_name string, _i int"))
    exact = rows.join(listed, F.col("process") == F.col("_name"), "inner" if listed_only else "left").drop("_name")
    if listed_only:
        return _numbered(exact, [F.col("_i")]).drop("_i")
    if ignore_case:
        low = F.broadcast(listed.groupBy(F.lower("_name").alias("_low")).agg(F.min("_i").alias("_j")))
        exact = exact.join(low, F.lower("process") == F.col("_low"), "left").withColumn("_i", F.coalesce("_i", "_j")).drop("_low", "_j")
    return _numbered(exact, [F.col("_i").isNull(), F.col("_i"), F.col(position)]).drop("_i")


def _numbered(rows: DataFrame, by: list[Column]) -> DataFrame:
    # One row a process: a window without partitions is fine on a dimension table.
    return rows.withColumn("draw_idx", F.row_number().over(Window.orderBy(*by)) - 1)


def without_data(rows: DataFrame) -> DataFrame:
    """Processes other than data, of rows with kind."""
    return rows.where(F.col("kind") != "data")


def stacked(hist: DataFrame, value: str = "sumw") -> DataFrame:
    """bottom and top of each process in its bin's stack, by draw_idx, from a histogram with draw_idx."""
    w = Window.partitionBy("var", "bin").orderBy("draw_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.sum(value).over(w)
    return hist.withColumn("top", top).withColumn("bottom", F.col("top") - F.col(value))


def coloured(processes: DataFrame) -> DataFrame:
    """A colour for each process by its rank in name order, in turn through the palette."""
    rank = F.row_number().over(Window.orderBy("process")) - 1
    palette = F.array(*map(F.lit, PALETTE))
    return processes.withColumn("color", F.element_at(palette, (F.pmod(rank, F.lit(len(PALETTE))) + 1).cast("int")))


def styled(rows: DataFrame, styles: DataFrame) -> DataFrame:
    """``rows`` with color and label of their process; without a style grey (black for data) and the process's name."""
    s = few(styles.select(F.col("process").alias("_p"), F.col("color").alias("_c"), F.col("label").alias("_l")))
    out = rows.join(s, F.col("process") == F.col("_p"), "left")
    default = F.when(F.lower("process") == "data", DATA_COLOUR).otherwise(NO_COLOUR)
    return out.withColumn("color", F.coalesce("_c", default)).withColumn("label", F.coalesce("_l", "process")).drop("_p", "_c", "_l")


def sample_coloured(samples: DataFrame, colours: DataFrame, default: str = SAMPLE_COLOUR) -> DataFrame:
    """``samples`` (sample) with color from ``colours`` (sample, color), the default where there is none."""
    c = few(colours.select(F.col("sample").alias("_s"), F.col("color").alias("_c")))
    return samples.join(c, F.col("sample") == F.col("_s"), "left").withColumn("color", F.coalesce("_c", F.lit(default))).drop("_s", "_c")


def head_of_each(rows: DataFrame, group: str, order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group in each task before it shuffles."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def head(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows in all: the first of each group, groups in name order, as an event display takes them."""
    return head_of_each(rows, group, order, n).orderBy(group, *order).limit(n)
