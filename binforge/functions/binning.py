"""Histogram binnings and the exact bin of a value."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bins of a variable without a configuration, and the limits it is shown in.
DEFAULT_BINS = 20
DEFAULT_CONTROL = (-100.0, 100.0)
DEFAULT_RESOLUTION = (-1.0, 1.0)


@dataclass(frozen=True)
class Binning:
    """n equal bins from lo to hi; all but the last exclude their upper edge."""

    lo: float
    hi: float
    n: int

    @classmethod
    def of_width(cls, lo: float, hi: float, width: float) -> Binning:
        """As many whole bins as fit; they are stretched to end at hi."""
        return cls(float(lo), float(hi), int((hi - lo) / width))

    @cached_property
    def edges(self) -> list[float]:
        step = (self.hi - self.lo) / self.n
        return [self.lo + i * step for i in range(self.n)] + [self.hi]


def limits(x: float | list[float] | tuple[float, float]) -> tuple[float, float]:
    """A pair as it is; one number as the limits on either side of 0."""
    return (float(x[0]), float(x[1])) if isinstance(x, (list, tuple)) else (-float(x), float(x))


def resolve(var: str, variables: dict[str, dict], *, resolution: bool = False, xlim=None, bins: int = DEFAULT_BINS, bin_width: float | None = None) -> Binning:
    """The configured binning of a variable (res_<var> for a resolution), or ``bins`` bins over the limits."""
    own = variables.get(f"res_{var}") if resolution else variables.get(var)
    if own and {"x_min", "x_max"} <= own.keys():
        lo, hi = float(own["x_min"]), float(own["x_max"])
        return Binning.of_width(lo, hi, float(own["bin_width"])) if own.get("bin_width") else Binning(lo, hi, bins)
    lo, hi = limits(xlim if xlim is not None else DEFAULT_RESOLUTION if resolution else DEFAULT_CONTROL)
    return Binning.of_width(lo, hi, bin_width) if bin_width else Binning(lo, hi, bins)


def bin_of(value: Column, lo: Column, hi: Column, step: Column, n: Column, edges: Column) -> Column:
    """The bin of a value, exact at every edge; null outside, for NaN and for null.

    An arithmetic guess is corrected against the edges themselves, all inside generated code.
    """
    inside = (value >= lo) & (value <= hi)
    guess = F.greatest(F.lit(0), F.least(F.floor((F.when(inside, value).otherwise(lo) - lo) / step).cast("int"), n - 1))
    low, high = F.get(edges, guess), F.get(edges, guess + 1)
    move = F.when(value < low, -1).when((guess < n - 1) & (value >= high), 1).otherwise(0)
    return F.when(inside, (guess + move).cast("int"))


def bin_index(value: Column, binning: Binning) -> Column:
    """``bin_of`` for one binning."""
    step = (binning.hi - binning.lo) / binning.n
    return bin_of(value.cast("double"), F.lit(float(binning.lo)), F.lit(float(binning.hi)), F.lit(step), F.lit(binning.n), F.array(*[F.lit(float(e)) for e in binning.edges]))


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver has; part of the plan itself, so it takes no job to broadcast."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), schema)


#: Rows of a dimension table up to which it is broadcast.
FEW = 100_000


def few(table: DataFrame, must: bool = False) -> DataFrame:
    """A dimension table marked for a broadcast if it is small; else as it is, or an error if there is no other way to join it."""
    bound = table._jdf.queryExecution().optimizedPlan().maxRows()  # known to the optimizer for tables the driver has made; no job then
    if (bound.isDefined() and bound.get() <= FEW) or table.limit(FEW + 1).count() <= FEW:
        return F.broadcast(table)
    if must:
        raise ValueError(f"more than {FEW} rows to compare with each row")
    return table


def bins_table(spark: SparkSession, binnings: dict[str, Binning]) -> DataFrame:
    """var, bin, lo, hi, last, centre and width of every bin: a small dimension table."""
    rows = [(var, i, b.edges[i], b.edges[i + 1], i == b.n - 1) for var, b in binnings.items() for i in range(b.n)]
    table = local(spark, rows, "var string, bin int, lo double, hi double, last boolean")
    return table.withColumn("centre", (F.col("lo") + F.col("hi")) / 2).withColumn("width", F.col("hi") - F.col("lo"))


#: The level of bins that no grid can hold: those with an infinite edge, or without a width.
_ANY = 9999


def _level(lo: Column, hi: Column) -> Column:
    """The smallest whole number whose power of 2 is the bin's width or above."""
    width = hi - lo
    fine = (width > 2.0**-1000) & (width < 2.0**1000) & (F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf"))
    up = F.ceil(F.log2(width)).cast("int")
    # The logarithm may be off next to a power of 2.
    return F.when(F.coalesce(fine, F.lit(False)), F.when(F.pow(F.lit(2.0), up) < width, up + 1).otherwise(up)).otherwise(_ANY)


def _cell(x: Column, level: Column) -> Column:
    scaled = x * F.pow(F.lit(2.0), -level)
    return F.when(level == _ANY, F.lit(0)).when((x < 0) & (scaled == 0), F.lit(-1)).otherwise(F.floor(scaled))  # tiny values may scale to 0


def range_candidates(values: DataFrame, bins: DataFrame) -> DataFrame:
    """``values`` with each bin of a cell that the value lies in: what ``range_joined`` compares."""
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    b = bins.select(F.col("var").alias("_var"), "bin", lo.alias("lo"), hi.alias("hi"), "last").where("lo <= hi").withColumn("_level", _level(F.col("lo"), F.col("hi")))
    levels = b.groupBy(F.col("_var").alias("_of")).agg(F.collect_set("_level").alias("_levels"))
    first, last = (_cell(F.col(c), F.col("_level")) for c in ("lo", "hi"))
    ends = F.when(~F.col("last") & (last * F.pow(F.lit(2.0), F.col("_level")) == F.col("hi")), last - 1).otherwise(last)  # an upper edge that starts a cell
    b = b.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, ends))))
    rows = values.join(few(levels), F.col("var") == F.col("_of")).withColumn("_at", F.explode("_levels")).drop("_of", "_levels")
    at = (F.col("var") == F.col("_var")) & (F.col("_at") == F.col("_level")) & (_cell(F.col("x").cast("double"), F.col("_at")) == F.col("_cell"))
    return rows.join(few(b), at).drop("_var", "_at", "_level", "_cell")


def range_joined(values: DataFrame, bins: DataFrame) -> DataFrame:
    """``values`` (var, x, ...) with the bins of ``bins`` (var, bin, lo, hi, last: a row each) they lie in; for binnings that are data.

    Bins of any width, with gaps or overlaps. A bin is put on a grid whose cells are as wide as it or wider, by a factor of 2
    at most, so it lies in two cells at most and a cell holds three disjoint bins at most; a value looks up its cell on each
    grid that its variable has. Both joins are by key, and a side is broadcast only after a check of its size. The last
    bin includes its upper edge. Null and NaN values are in no bin.
    """
    inside = (F.col("x") >= F.col("lo")) & ((F.col("x") < F.col("hi")) | (F.col("last") & (F.col("x") == F.col("hi")))) & ~F.isnan(F.col("x").cast("double"))
    return range_candidates(values, bins).where(inside).drop("lo", "hi", "last")
