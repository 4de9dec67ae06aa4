"""Weighted histograms of many variables in one pass: explode the fills, bin, and aggregate once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions import exact
from binforge.functions.binning import Binning, bin_index, bin_of, local
from binforge.functions.scalar import finite, quoted, relative, wrapped

KEYS = ["family", "var", "region", "process"]


@dataclass(frozen=True)
class Pair:
    """A resolution: reconstructed against true column."""

    truth: str
    reco: str
    angle: bool = False
    relative: bool = True
    #: Wrap the difference of what is no angle, too.
    wrap_all: bool = True

    @property
    def name(self) -> str:
        return f"{self.reco}_vs_{self.truth}"


def resolution(pair: Pair) -> Column:
    """The pair's difference; null unless both are finite and the truth is not 0.

    An angle, and unless the pair says otherwise any difference that is not relative, is wrapped to [-pi, pi).
    """
    truth, reco = quoted(pair.truth).cast("double"), quoted(pair.reco).cast("double")
    if pair.angle or not pair.relative:
        value = wrapped(reco - truth) if pair.angle or pair.wrap_all else reco - truth
    else:
        value = relative(reco, truth)
    return F.when(finite(truth) & finite(reco) & (truth != 0), value)


def _fill(family: str, var: str, region: Column, x: Column, keep: Column, weight: Column, weight2: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), F.lit(var).alias("var"), region.alias("region"), F.when(keep, x).alias("x"), weight.alias("w"), weight2.alias("w2"))


def fills(events: DataFrame, control: list[str], pairs: list[Pair] = (), agreement: list[str] = ()) -> DataFrame:
    """A row for each fill: family, var, region, process, x, w and w2.

    ``events`` is a normalised table: process, scale, w_mc, weight, region, trigger and the variables. Control and
    resolution fills carry the sample's scale; agreement fills the event weight times w_mc, and need the trigger.
    """
    scale, none, one = F.col("scale"), F.lit(None).cast("string"), F.lit(True)
    made = [_fill("control", v, none, quoted(v).cast("double"), finite(quoted(v)), scale, scale * scale) for v in control]
    made += [_fill("resolution", p.name, none, resolution(p), one, scale, scale * scale) for p in pairs]
    w = F.col("weight") * F.col("w_mc")
    passed = F.col("trigger") & F.col("region").isNotNull()
    made += [_fill("mc_data", v, F.col("region"), quoted(v).cast("double"), finite(quoted(v)) & passed, w, w * F.col("w_mc")) for v in agreement]
    return events.select("process", F.explode(F.array(*made)).alias("f")).select("process", "f.*").where(F.col("x").isNotNull())


def _axes(spark: SparkSession, binnings: dict[tuple[str, str], Binning]) -> DataFrame:
    """A row for each binning, with its edges: as many as the configuration names, so always fit for a broadcast."""
    rows = [(f, v, b.lo, b.hi, (b.hi - b.lo) / b.n, b.n, b.edges) for (f, v), b in binnings.items()]
    return F.broadcast(local(spark, rows, "_family string, _var string, _lo double, _hi double, _step double, _n int, _edges array<double>"))


def _binned(rows: DataFrame, binnings: dict[tuple[str, str], Binning]) -> DataFrame:
    """One bin expression serves all variables, whose axes are looked up, so the generated code stays small enough to be
    compiled however many there are.
    """
    axes = _axes(rows.sparkSession, binnings)
    at = bin_of(F.col("x"), F.col("_lo"), F.col("_hi"), F.col("_step"), F.col("_n"), F.col("_edges"))
    return rows.join(axes, (F.col("family") == F.col("_family")) & (F.col("var") == F.col("_var")), "left").withColumn("bin", at)


def histogram(rows: DataFrame, binnings: dict[tuple[str, str], Binning], exact_sums: bool = False) -> DataFrame:
    """family, var, region, process, bin, count, sumw, sumw2; bin is null for values outside, which keep a process present.

    With ``exact_sums`` the sums are the same in every bit however the rows are ordered and partitioned.
    """
    if exact_sums:
        return partial(rows, binnings).withColumns({c: exact.value(F.col(c)) for c in ("sumw", "sumw2")})
    return _binned(rows, binnings).groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("count"), F.sum("w").alias("sumw"), F.sum("w2").alias("sumw2"))


def partial(rows: DataFrame, binnings: dict[tuple[str, str], Binning]) -> DataFrame:
    """The same with exact sums as they can be merged with others (see ``functions.exact``)."""
    return _binned(rows, binnings).groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("count"), exact.exact_sum(F.col("w")).alias("sumw"), exact.exact_sum(F.col("w2")).alias("sumw2"))


def densify(hist: DataFrame, binnings: dict[tuple[str, str], Binning]) -> DataFrame:
    """Every bin of every process that has a finite value in the variable, 0 where it has none inside.

    ``hist`` is used once, so the events behind it are read once: a process's bins are collected (as many as the
    variable has), and those that are missing put in between.
    """
    cell = F.struct("count", "sumw", "sumw2")
    own = hist.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", cell.alias("cell"))))).alias("_cells"))
    own = own.join(_axes(hist.sparkSession, binnings), (F.col("family") == F.col("_family")) & (F.col("var") == F.col("_var")))
    own = own.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_cell", F.try_element_at("_cells", F.col("bin")))
    edges = [F.get("_edges", F.col("bin") + i).alias(name) for i, name in enumerate(("lo", "hi"))]
    return own.select(*KEYS, "bin", *edges, F.coalesce("_cell.count", F.lit(0)).cast("long").alias("count"), *[F.coalesce(f"_cell.{c}", F.lit(0.0)).alias(c) for c in ("sumw", "sumw2")])


def filled(events: DataFrame, column: str, binning: Binning, weights: dict[str, Column], exact_sums: bool = False) -> DataFrame:
    """bin and a sum of each weight over all rows with a value in range: the asymmetry's histograms."""
    rows = events.withColumn("bin", bin_index(quoted(column), binning)).where(F.col("bin").isNotNull())
    if not exact_sums:
        return rows.groupBy("bin").agg(*[F.sum(w).alias(k) for k, w in weights.items()])
    sums = rows.groupBy("bin").agg(*[exact.exact_sum(w.cast("double")).alias(k) for k, w in weights.items()])
    return sums.select("bin", *[exact.value(F.col(k)).alias(k) for k in weights])


def asymmetry(hist: DataFrame, even: str = "even", odd: str = "odd") -> DataFrame:
    """One row: sum of |odd - even| over sum of odd + even, 0 unless that is positive."""
    top, all_ = F.sum(F.abs(F.col(odd) - F.col(even))), F.sum(F.col(odd) + F.col(even))
    return hist.agg(F.coalesce(F.when(all_ > 0, top / all_), F.lit(0.0)).alias("asymmetry"))
