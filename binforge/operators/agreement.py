"""Algebra on filled histograms: background from the same-sign region, totals, ratios and their uncertainties.

All inputs are dense histograms as ``fill.densify`` returns them, a few thousand rows whatever the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QCD = "QCD"


def with_kind(hist: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` is process and kind, one row each; a process without one is mc. Spark broadcasts it where it is small, or where the caller says so."""
    k = kinds.select(F.col("process").alias("_p"), F.col("kind").alias("_k"))
    return hist.join(k, F.col("process") == F.col("_p"), "left").withColumn("kind", F.coalesce("_k", F.lit("mc"))).drop("_p", "_k")


def kinds_of(samples: DataFrame) -> DataFrame:
    """process and kind from sample, process and kind: data if any of its samples is."""
    return samples.groupBy("process").agg(F.min(F.when(F.col("kind") == "data", "data").otherwise("mc")).alias("kind"))


_BIN = ["family", "var", "bin", "lo", "hi"]
_ROW = ["region", "process", "count", "sumw", "sumw2", "kind"]


def _with_estimate(hist: DataFrame, fake_factor: float, keep: bool) -> DataFrame:
    """The rows of each bin (two regions of each process) side by side, with those of QCD after them, or these alone.

    Written as SQL expressions, which take far fewer calls to build than columns do.
    """
    by = hist.groupBy(*_BIN).agg(F.expr(f"collect_list(struct({', '.join(_ROW)}))").alias("_rows"))
    data, mc = "filter(_rows, r -> r.region = 'SS' and r.kind = 'data')", f"filter(_rows, r -> r.region = 'SS' and r.kind <> 'data' and lower(r.process) <> '{QCD.lower()}')"
    by = by.selectExpr(*_BIN, "_rows", f"{data} as _data", f"{mc} as _mc")
    total = lambda rows, c: f"aggregate({rows}, 0D, (a, r) -> a + r.{c})"
    by = by.selectExpr(*_BIN, "_rows", f"{total('_data', 'sumw')} - {total('_mc', 'sumw')} as _ss", f"{total('_data', 'sumw2')} + {total('_mc', 'sumw2')} as _ss2", "size(_data) > 0 and size(_mc) > 0 as _both")
    made = ", ".join(f"named_struct('region', '{r}', 'process', '{QCD}', 'count', 0L, 'sumw', _ss * {k}, 'sumw2', _ss2 * {k} * {k}, 'kind', 'mc')" for r, k in (("SS", "1D"), ("OS", f"double('{float(fake_factor)!r}')")))
    own = f"if(_both, array({made}), cast(array() as array<struct<region: string, process: string, count: bigint, sumw: double, sumw2: double, kind: string>>))"
    rows = by.selectExpr(*_BIN, f"inline({f'concat(_rows, {own})' if keep else own})")
    return rows.select("family", "var", "region", "process", "bin", "lo", "hi", "count", "sumw", "sumw2", "kind")


def qcd(hist: DataFrame, fake_factor: float = 1.0) -> DataFrame:
    """QCD rows for both regions: SS data minus SS simulation, scaled in OS by the fake factor and variances by its square.

    Negative bins stay. Nothing for a variable whose SS region lacks either data or simulation.
    """
    return _with_estimate(hist, fake_factor, keep=False)


def with_qcd(hist: DataFrame, fake_factor: float = 1.0, enabled: bool = True) -> DataFrame:
    """``hist``, which is used once, and its QCD rows."""
    return _with_estimate(hist, fake_factor, keep=True) if enabled else hist


def data_mc(hist: DataFrame, region: str = "OS") -> DataFrame:
    """For each variable and bin: data and simulation, uncertainties, the simulation's band, and their ratio with its own."""
    sums = [f"sum(if(kind {'=' if kind == 'data' else '<>'} 'data', {c}, 0D)) as {name}" for kind, c, name in (("data", "sumw", "data"), ("data", "sumw2", "data2"), ("mc", "sumw", "mc"), ("mc", "sumw2", "mc2"))]
    by = hist.where(F.col("region") == region).groupBy(*_BIN).agg(*map(F.expr, sums))
    by = by.selectExpr("var", "bin", "lo", "hi", "data", "sqrt(greatest(data2, 0D)) as data_unc", "mc", "sqrt(greatest(mc2, 0D)) as mc_unc")
    over = lambda top: f"if(mc = 0, 0D, {top} / mc)"
    return by.selectExpr(
        "*", "greatest(mc - mc_unc, 0D) as mc_low", "mc + mc_unc as mc_high", f"{over('data')} as ratio", f"{over('data_unc')} as ratio_unc", f"1 - {over('mc_unc')} as ratio_low", f"1 + {over('mc_unc')} as ratio_high",
    )


def totals(hist: DataFrame) -> DataFrame:
    """Sums at every level: region, kind, process, and all of them (nulls mark what a row sums over)."""
    return hist.rollup("region", "kind", "process").agg(F.sum("sumw").alias("total"), F.sum("count").alias("entries"))


def normalisation(hist: DataFrame, lumi: float) -> DataFrame:
    """For each variable: OS and SS totals of data and simulation, and simulation over data, also per luminosity; null unless data is positive."""
    total = [F.sum(F.when((F.col("region") == r) & (F.col("kind") == k), F.col("sumw")).otherwise(0.0)).alias(f"{k}_{r.lower()}") for r in ("OS", "SS") for k in ("data", "mc")]
    by = hist.groupBy("var").agg(*total)
    fine = F.col("data_os") > 0
    return by.withColumn("mc_over_data", F.when(fine, F.col("mc_os") / F.col("data_os"))).withColumn("mc_over_data_lumi", F.when(fine, F.col("mc_os") / (F.col("data_os") / F.lit(float(lumi)))))
