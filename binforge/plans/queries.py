"""Every operator as a query over the driver's tables, with the SQL it must agree with."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from binforge.functions import binning, scalar
from binforge.functions.binning import Binning
from binforge.operators import agreement, display, fill, lookups, ordering, selection
from binforge.plans import virtual as v
from binforge.sources import catalog, csvs, heads, histograms
from binforge.sources.config import Sample
from binforge.sources.store import HistogramStore
from binforge.streaming.fill import fill_stream, store_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession, name: str) -> str:
    from binforge.sources.scratch import folder

    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- normalised events and histograms


def _normalised(spark: SparkSession, sf_dir: str, nations: DataFrame) -> DataFrame:
    e = v.events(spark, sf_dir, nations)
    return selection.select(e, v.CUTS).withColumn("region", selection.region(e.columns)).withColumn("trigger", selection.trigger(e.columns))


CONTROL = ["pt_1", "pt_2", "mt_tot", "eta_1", "iso_1"]
AGREED = ["pt_1", "mt_tot"]
_CONTROL_BINS = {("control", c): v.BINS[c] for c in CONTROL}
_AGREED_BINS = {("mc_data", c): v.BINS[c] for c in AGREED}


def _agreement(spark: SparkSession, sf_dir: str, exact_sums: bool = False) -> DataFrame:
    nations = v.regions(spark, sf_dir)
    hist = fill.histogram(fill.fills(_normalised(spark, sf_dir, nations), [], [], AGREED), _AGREED_BINS, exact_sums)
    kinds = F.broadcast(agreement.kinds_of(nations))  # five rows
    return agreement.with_kind(fill.densify(hist, _AGREED_BINS), kinds)


_AGREED_SQL = f"""
{v.EVENTS_SQL}, {v.bins_sql({c: v.BINS[c] for c in AGREED})},
sel AS (SELECT *, CASE os WHEN 1 THEN 'OS' WHEN 0 THEN 'SS' END AS region, weight * w_mc AS w, weight * w_mc * w_mc AS w2 FROM ev WHERE {v.CUTS_SQL} AND (trg_singlemuon = 1 OR trg_mt_cross = 1)),
v AS ({v.values_sql(AGREED, "process, kind, region, w, w2", "sel")}),
present AS (SELECT DISTINCT var, region, process, kind FROM v WHERE region IS NOT NULL),
filled AS (SELECT v.var, region, process, bin, count(*) AS n, sum(w) AS sumw, sum(w2) AS sumw2 FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL),
h AS (
  SELECT p.var, p.region, p.process, p.kind, b.bin, b.lo, b.hi, coalesce(n, 0) AS n, coalesce(sumw, 0) AS sumw, coalesce(sumw2, 0) AS sumw2
  FROM present p JOIN bins b ON b.var = p.var LEFT JOIN filled f ON f.var = p.var AND f.region = p.region AND f.process = p.process AND f.bin = b.bin
)"""
_QCD_SQL = """
q AS (
  SELECT var, bin, lo, hi, sum(CASE WHEN kind = 'data' THEN sumw ELSE -sumw END) AS ss, sum(sumw2) AS ss2 FROM h WHERE region = 'SS'
  GROUP BY ALL HAVING bool_or(kind = 'data') AND bool_or(kind <> 'data')
), a AS (SELECT var, region, process, kind, bin, lo, hi, sumw, sumw2 FROM h UNION ALL SELECT var, r, 'QCD', 'mc', bin, lo, hi, ss, ss2 FROM q, (VALUES ('OS'), ('SS')) t(r))"""


@query(f"WITH {v.EVENTS_SQL}, {v.bins_sql({c: v.BINS[c] for c in CONTROL})}, v AS ({v.values_sql(CONTROL)}) SELECT v.var, process, bin, count(*) AS count FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL")
def hist_control(spark, sf_dir):
    e = v.events(spark, sf_dir)
    return fill.histogram(fill.fills(e, CONTROL), _CONTROL_BINS).where("bin is not null").select("var", "process", "bin", "count")


@query(f"WITH {v.EVENTS_SQL}, {v.bins_sql({'pt_1': v.BINS['pt_1']})}, v AS ({v.values_sql(['pt_1'], 'process, scale')}) SELECT v.var, process, bin, round(sum(scale), 6) AS scaled FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL")
def hist_control_scaled(spark, sf_dir):
    hist = fill.histogram(fill.fills(v.events(spark, sf_dir), ["pt_1"]), {("control", "pt_1"): v.BINS["pt_1"]})
    return hist.where("bin is not null").select("var", "process", "bin", F.round("sumw", 6).alias("scaled"))


@query(f"""WITH {v.EVENTS_SQL}, {v.bins_sql({'pt_1': v.BINS['pt_1'], 'mt_tot': v.BINS['mt_tot']})}, sel AS (SELECT * FROM ev WHERE mt_tot > 150), v AS ({v.values_sql(['pt_1', 'mt_tot'], 'process', 'sel')}),
p AS (SELECT DISTINCT var, process FROM v), f AS (SELECT v.var, process, bin, count(*) AS n FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL)
SELECT p.var, p.process, b.bin, b.lo, b.hi, coalesce(n, 0) AS count FROM p JOIN bins b ON b.var = p.var LEFT JOIN f ON f.var = p.var AND f.process = p.process AND f.bin = b.bin""")
def hist_dense_zero_fill(spark, sf_dir):
    bins = {("control", c): v.BINS[c] for c in ("pt_1", "mt_tot")}
    hist = fill.histogram(fill.fills(v.events(spark, sf_dir).where("mt_tot > 150"), ["pt_1", "mt_tot"]), bins)
    return fill.densify(hist, bins).select("var", "process", "bin", "lo", "hi", "count")


@query(f"WITH {_AGREED_SQL} SELECT var, region, process, bin, n AS count, round(sumw, 6) AS sumw, round(sumw2, 6) AS sumw2 FROM h")
def hist_weighted_regions(spark, sf_dir):
    return _agreement(spark, sf_dir).select("var", "region", "process", "bin", "count", F.round("sumw", 6).alias("sumw"), F.round("sumw2", 6).alias("sumw2"))


# Whole numbers of 2^-80 in SQL, and not rounded on either side.
_UNIT = "CAST(pow(2.0, 80) AS DOUBLE)"


@query(f"""WITH {_AGREED_SQL}, e AS (SELECT v.var, region, process, bin, count(*) AS count, sum(CAST(w * {_UNIT} AS HUGEINT)) AS sumw, sum(CAST(w2 * {_UNIT} AS HUGEINT)) AS sumw2 FROM v JOIN bins b ON {v.IN_BIN} WHERE region IS NOT NULL GROUP BY ALL)
SELECT var, region, process, bin, count, CAST(sumw AS DOUBLE) / {_UNIT} AS sumw, CAST(sumw2 AS DOUBLE) / {_UNIT} AS sumw2 FROM e""")
def hist_exact_sums(spark, sf_dir):
    """Sums that are the same in every bit in any order, so they need no rounding to be compared."""
    return _agreement(spark, sf_dir, exact_sums=True).where("count > 0").select("var", "region", "process", "bin", "count", "sumw", "sumw2")


@query(f"WITH {_AGREED_SQL}, {_QCD_SQL} SELECT var, region, process, bin, round(sumw, 6) + 0.0 AS sumw, round(sumw2, 6) + 0.0 AS sumw2 FROM a WHERE process = 'QCD'")
def qcd_from_ss(spark, sf_dir):
    return agreement.qcd(_agreement(spark, sf_dir)).select("var", "region", "process", "bin", (F.round("sumw", 6) + 0.0).alias("sumw"), (F.round("sumw2", 6) + 0.0).alias("sumw2"))


@query(f"""WITH {_AGREED_SQL}, {_QCD_SQL}, t AS (
  SELECT var, bin, lo, hi, sum(CASE WHEN kind = 'data' THEN sumw ELSE 0 END) AS data, sqrt(greatest(sum(CASE WHEN kind = 'data' THEN sumw2 ELSE 0 END), 0)) AS data_unc,
    sum(CASE WHEN kind <> 'data' THEN sumw ELSE 0 END) AS mc, sqrt(greatest(sum(CASE WHEN kind <> 'data' THEN sumw2 ELSE 0 END), 0)) AS mc_unc FROM a WHERE region = 'OS' GROUP BY ALL)
SELECT var, bin, lo, hi, round(data, 6) + 0.0 AS data, round(data_unc, 6) + 0.0 AS data_unc, round(mc, 6) + 0.0 AS mc, round(mc_unc, 6) + 0.0 AS mc_unc, round(greatest(mc - mc_unc, 0), 6) + 0.0 AS mc_low, round(mc + mc_unc, 6) + 0.0 AS mc_high,
  round(CASE WHEN round(mc, 6) = 0 THEN 0 ELSE data / mc END, 4) + 0.0 AS ratio, round(CASE WHEN round(mc, 6) = 0 THEN 0 ELSE data_unc / mc END, 4) + 0.0 AS ratio_unc,
  round(CASE WHEN round(mc, 6) = 0 THEN 1 ELSE 1 - mc_unc / mc END, 4) + 0.0 AS ratio_low, round(CASE WHEN round(mc, 6) = 0 THEN 1 ELSE 1 + mc_unc / mc END, 4) + 0.0 AS ratio_high FROM t""")
def data_mc_ratio(spark, sf_dir):
    d = agreement.data_mc(agreement.with_qcd(_agreement(spark, sf_dir)))
    near_zero = F.round("mc", 6) == 0
    return d.select("var", "bin", "lo", "hi", *[(F.round(c, 6) + 0.0).alias(c) for c in ("data", "data_unc", "mc", "mc_unc", "mc_low", "mc_high")], *[(F.round(F.when(near_zero, none).otherwise(F.col(c)), 4) + 0.0).alias(c) for c, none in (("ratio", 0.0), ("ratio_unc", 0.0), ("ratio_low", 1.0), ("ratio_high", 1.0))])


@query(f"""WITH {_AGREED_SQL}, t AS (SELECT var, sum(CASE WHEN region = 'OS' AND kind = 'data' THEN sumw ELSE 0 END) AS data_os, sum(CASE WHEN region = 'OS' AND kind <> 'data' THEN sumw ELSE 0 END) AS mc_os FROM h GROUP BY var)
SELECT var, round(data_os, 4) AS data_os, round(mc_os, 4) AS mc_os, round(CASE WHEN data_os > 0 THEN mc_os / data_os END, 8) AS mc_over_data, round(CASE WHEN data_os > 0 THEN mc_os / (data_os / {v.number(59.7)}) END, 6) AS mc_over_data_lumi FROM t""")
def norm_check(spark, sf_dir):
    n = agreement.normalisation(_agreement(spark, sf_dir), 59.7)
    return n.select("var", F.round("data_os", 4).alias("data_os"), F.round("mc_os", 4).alias("mc_os"), F.round("mc_over_data", 8).alias("mc_over_data"), F.round("mc_over_data_lumi", 6).alias("mc_over_data_lumi"))


@query(f"WITH {_AGREED_SQL} SELECT region, kind, process, round(sum(sumw), 4) AS total, CAST(sum(n) AS BIGINT) AS entries FROM h GROUP BY ROLLUP (region, kind, process)")
def totals_rollup(spark, sf_dir):
    return agreement.totals(_agreement(spark, sf_dir)).select("region", "kind", "process", F.round("total", 4).alias("total"), "entries")


_ORDER = ["europe", "AFRICA", "Asia"]
_POSITION = "CASE process WHEN 'EUROPE' THEN 0 WHEN 'AFRICA' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END"


@query(f"""WITH {_AGREED_SQL}, d AS (SELECT process, row_number() OVER (ORDER BY {_POSITION}, process) - 1 AS draw_idx FROM (SELECT DISTINCT process FROM h)),
s AS (SELECT h.*, draw_idx, sum(sumw) OVER (PARTITION BY var, bin ORDER BY draw_idx) AS top FROM h JOIN d USING (process) WHERE region = 'OS')
SELECT var, bin, process, draw_idx, round(top - sumw, 6) + 0.0 AS bottom, round(top, 6) AS top FROM s""")
def stack_bottoms(spark, sf_dir):
    hist = _agreement(spark, sf_dir).where("region = 'OS'")
    order = ordering.ordered(_regions(spark, sf_dir), _ORDER).select(F.col("process").alias("_p"), F.col("draw_idx").cast("long").alias("draw_idx"))
    s = ordering.stacked(hist.join(F.broadcast(order), F.col("process") == F.col("_p")))
    return s.select("var", "bin", "process", "draw_idx", (F.round("bottom", 6) + 0.0).alias("bottom"), F.round("top", 6).alias("top"))


def _regions(spark, sf_dir):
    r = v.table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("process"), F.row_number().over(Window.orderBy("r_name")).alias("position"))


@query(f"SELECT r_name AS process, row_number() OVER (ORDER BY {_POSITION.replace('process', 'r_name', 1)}, r_name) - 1 AS draw_idx FROM region")
def draw_order_ci(spark, sf_dir):
    return ordering.ordered(_regions(spark, sf_dir), _ORDER).select("process", F.col("draw_idx").cast("long").alias("draw_idx"))


@query("SELECT r_name AS process, row_number() OVER (ORDER BY r_name DESC) - 1 AS draw_idx FROM region WHERE r_name IN ('EUROPE', 'AFRICA')")
def render_strict_order(spark, sf_dir):
    return ordering.ordered(_regions(spark, sf_dir), ["EUROPE", "africa", "AFRICA"], listed_only=True).select("process", F.col("draw_idx").cast("long").alias("draw_idx"))


@query("SELECT n_name AS process, list_element(['tab:blue', 'tab:orange', 'tab:green', 'tab:red', 'tab:purple', 'tab:brown', 'tab:pink', 'tab:gray'], (row_number() OVER (ORDER BY n_name) - 1) % 8 + 1) AS color FROM nation")
def palette_by_rank(spark, sf_dir):
    return ordering.coloured(v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("process")))


# ---- selection


def _cut(name: str, cuts: dict[str, float], where: str, sql_columns: str = ""):
    def run(spark, sf_dir):
        return selection.select(v.events(spark, sf_dir), cuts).select("l_orderkey", "l_linenumber", F.round("pt_1", 6).alias("pt_1"))

    run.__name__ = name
    query(f"WITH {v.EVENTS_SQL} SELECT l_orderkey, l_linenumber, round(pt_1, 6) AS pt_1 FROM ev WHERE {where}")(run)


_ALL = v.CUTS | {"decayModePNet_2_eq": 1, "idDeepTau2018v2p5VSjet_2_min": 1, "idDeepTau2018v2p5VSe_2_min": 1, "idDeepTau2018v2p5VSmu_2_min": 1, "ip_LengthSig_1_abs_min": 1.5}
_cut("select_all_cuts", _ALL, f"{v.CUTS_SQL} AND l_linenumber = 1 AND (ip > {v.number(1.5)} OR ip < {v.number(-1.5)})")
_cut("eta_window_cut", {"eta_1_abs_max": 2.4, "eta_2_abs_max": 2.3}, f"eta_1 < {v.number(2.4)} AND eta_1 > {v.number(-2.4)} AND eta_2 < {v.number(2.3)} AND eta_2 > {v.number(-2.3)}")
_cut("abs_min_cut", {"ip_LengthSig_1_abs_min": 1.5}, f"ip > {v.number(1.5)} OR ip < {v.number(-1.5)}")
_cut("equality_cut", {"decayModePNet_2_eq": 3}, "l_linenumber = 3")
_cut("id_min_cuts", {"idDeepTau2018v2p5VSjet_2_min": 3, "idDeepTau2018v2p5VSe_2_min": 4, "idDeepTau2018v2p5VSmu_2_min": 2}, "l_linenumber >= 4")


@query(f"WITH {v.EVENTS_SQL} SELECT l_orderkey, l_linenumber FROM ev WHERE pt_1 > 25 AND iso_1 < {v.number(0.05)}")
def select_missing_column(spark, sf_dir):
    e = v.events(spark, sf_dir).drop("pt_2", "eta_1", "eta_2", "ip_LengthSig_1")
    return selection.select(e, v.CUTS | {"iso_1_max": 0.05, "ip_LengthSig_1_abs_min": 1.5}).select("l_orderkey", "l_linenumber")


@query(f"WITH {v.EVENTS_SQL} SELECT process, CAST(sum(CASE WHEN trg_singlemuon = 1 OR trg_mt_cross = 1 THEN 1 ELSE 0 END) AS BIGINT) AS either, CAST(sum(trg_singlemuon) AS BIGINT) AS one, count(*) AS none FROM ev GROUP BY process")
def trigger_or(spark, sf_dir):
    e = v.events(spark, sf_dir)
    passed = [F.sum(selection.trigger(c).cast("int")).alias(name) for name, c in (("either", e.columns), ("one", ["trg_singlemuon"]), ("none", []))]
    return e.groupBy("process").agg(*passed)


# ---- resolution, angles, asymmetry


@query(f"""WITH {v.EVENTS_SQL}, {v.bins_sql({'r': v.RES})}, v AS (SELECT 'r' AS var, process, scale, (pt_1 - pt_2) / pt_2 AS x FROM ev WHERE pt_2 <> 0)
SELECT process, bin, count(*) AS count, round(sum(scale), 6) AS sumw FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL""")
def resolution_relative(spark, sf_dir):
    pair = fill.Pair("pt_2", "pt_1")
    hist = fill.histogram(fill.fills(v.events(spark, sf_dir), [], [pair]), {("resolution", pair.name): v.RES})
    return hist.where("bin is not null").select("process", "bin", "count", F.round("sumw", 6).alias("sumw"))


@query(f"""WITH {v.PHASES_SQL}, {v.bins_sql({'r': v.ANGLE})}, d AS (SELECT event_type, phi_1 - phi_2 + {v.number(math.pi)} AS s FROM ph WHERE phi_2 <> 0),
v AS (SELECT 'r' AS var, event_type AS process, s - {v.number(2 * math.pi)} * floor(s / {v.number(2 * math.pi)}) - {v.number(math.pi)} AS x FROM d)
SELECT process, bin, count(*) AS count FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL""")
def resolution_angle_wrap(spark, sf_dir):
    pair = fill.Pair("phi_2", "phi_1", angle=True)
    e = v.phases(spark, sf_dir).withColumn("process", F.col("event_type")).withColumn("scale", F.lit(1.0))
    hist = fill.histogram(fill.fills(e, [], [pair]), {("resolution", pair.name): v.ANGLE})
    return hist.where("bin is not null").select("process", "bin", "count")


_ASYM_SQL = f"""WITH {v.PHASES_SQL}, {v.bins_sql({'r': v.PHASE})}, v AS (SELECT 'r' AS var, phi_1 AS x, abs(value) AS w, CASE event_type WHEN 'click' THEN 2 ELSE 1 END * abs(value) AS u FROM ph),
h AS (SELECT bin, sum(w) AS even, sum(u) AS odd FROM v JOIN bins b ON {v.IN_BIN} GROUP BY bin)"""
_ASYM_EXACT_SQL = _ASYM_SQL.replace("sum(w)", f"sum(CAST(w * {_UNIT} AS HUGEINT))").replace("sum(u)", f"sum(CAST(u * {_UNIT} AS HUGEINT))")


def _asymmetry(spark, sf_dir, exact_sums=False):
    e = v.phases(spark, sf_dir)
    return fill.filled(e, "phi_1", v.PHASE, {"even": F.abs("value"), "odd": F.when(F.col("event_type") == "click", 2).otherwise(1) * F.abs("value")}, exact_sums)


@query(f"{_ASYM_EXACT_SQL} SELECT bin, CAST(even AS DOUBLE) / {_UNIT} AS even, CAST(odd AS DOUBLE) / {_UNIT} AS odd FROM h")
def asymmetry_exact_sums(spark, sf_dir):
    return _asymmetry(spark, sf_dir, exact_sums=True)


@query(f"{_ASYM_SQL} SELECT bin, round(even, 6) AS even, round(odd, 6) AS odd FROM h")
def asymmetry_hist(spark, sf_dir):
    return _asymmetry(spark, sf_dir).select("bin", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


@query(f"{_ASYM_SQL} SELECT round(coalesce(CASE WHEN sum(odd + even) > 0 THEN sum(abs(odd - even)) / sum(odd + even) END, 0), 9) AS asymmetry FROM h")
def asymmetry_value(spark, sf_dir):
    return fill.asymmetry(_asymmetry(spark, sf_dir)).select(F.round("asymmetry", 9).alias("asymmetry"))


# ---- dimension lookups

_PROCESSES = [("first", ["FRANCE", "GERMANY", "CHINA"], "red", "First", 0), ("second", ["CHINA", "INDIA"], "blue", None, 1), ("data", ["JAPAN"], None, None, 2)]


def _processes(spark):
    return spark.createDataFrame(_PROCESSES, "process string, samples array<string>, color string, label string, draw_idx int")


_MAP = "CASE n_name WHEN 'FRANCE' THEN 'first' WHEN 'GERMANY' THEN 'first' WHEN 'CHINA' THEN 'second' WHEN 'INDIA' THEN 'second' WHEN 'JAPAN' THEN 'data' ELSE 'unknown' END"


@query(f"SELECT n_name AS sample, {_MAP} AS process FROM nation")
def sample_process_left_join(spark, sf_dir):
    samples = v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample"))
    return lookups.with_process(samples, lookups.bridge(_processes(spark)))


@query(f"WITH p AS (SELECT n_name AS sample, {_MAP} AS process FROM nation) SELECT sample, process, CASE process WHEN 'first' THEN 'red' WHEN 'second' THEN 'blue' WHEN 'data' THEN 'black' ELSE '#999999' END AS color, CASE process WHEN 'first' THEN 'First' ELSE process END AS label FROM p")
def process_style_join(spark, sf_dir):
    return ordering.styled(sample_process_left_join(spark, sf_dir), _processes(spark))


@query("WITH t AS (SELECT r_name AS process, CASE WHEN n_nationkey % 10 = 3 THEN 'data' ELSE 'mc' END AS kind FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT process, CASE WHEN bool_or(kind = 'data') THEN 'data' ELSE 'mc' END AS kind FROM t GROUP BY process")
def kind_of_process(spark, sf_dir):
    r = v.regions(spark, sf_dir)
    return agreement.kinds_of(r.select("process", F.when(F.pmod("n_nationkey", F.lit(10)) == 3, "data").otherwise("mc").alias("kind")))


#: Cross sections and numbers of generated events of a few samples, and the luminosity.
PARAMS = [("DYto2Tau", 1664.6841730883225, 394163979.0, 1.0), ("TTto2L2Nu", 98.04387875606875, 466316813.0, 1.0), ("WtoMuNu", 21141.699999999997, 364382686.0, 1.0), ("ZZ", 19.431, 4800000.0, 1.0), ("none", 1.0, 0.0, 1.0)]
LUMI = 109948.2


@query(f"""WITH p(k, xs, eff, fe) AS (VALUES {', '.join(f"('{k}', {v.number(x)}, {v.number(e)}, {v.number(f)})" for k, x, e, f in PARAMS)}),
s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'DYto2Tau-2Jets_Bin-0J' WHEN 1 THEN 'TTto2L2Nu_ext' WHEN 2 THEN 'WtoMuNu-2Jets' WHEN 3 THEN 'ZZ' WHEN 4 THEN 'none' WHEN 5 THEN 'Muon0' ELSE 'other_x' END AS sample FROM part)
SELECT p_partkey, sample, round(CASE WHEN sample = 'Muon0' THEN 1 WHEN k IS NULL THEN 1 WHEN eff = 0 THEN 0 ELSE xs * {v.number(LUMI)} * fe / eff END, 9) AS w_mc
FROM s LEFT JOIN p ON split_part(split_part(sample, '-', 1), '_', 1) = k""")
def mc_weight(spark, sf_dir):
    names = ["DYto2Tau-2Jets_Bin-0J", "TTto2L2Nu_ext", "WtoMuNu-2Jets", "ZZ", "none", "Muon0", "other_x"]
    sample = F.element_at(F.array(*map(F.lit, names)), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    rows = v.table(spark, sf_dir, "part").select("p_partkey", sample.alias("sample")).withColumn("kind", F.when(F.col("sample") == "Muon0", "data").otherwise("mc"))
    params = spark.createDataFrame(PARAMS, "params_key string, xs double, eff double, filter_efficiency double")
    return lookups.with_weight(rows, params, LUMI).select("p_partkey", "sample", F.round("w_mc", 9).alias("w_mc"))


@query("WITH p(name, s, color, i) AS (VALUES ('green ones', 'green', 'g', 0), ('steel', 'STEEL', 's', 1), ('blue ones', 'blue', 'b', 2), ('green ones', 'lime', 'g', 3)), f AS (SELECT p_partkey, p_name, p_type, min(i) AS i FROM part LEFT JOIN p ON contains(p_name || ' ' || p_type, s) GROUP BY ALL) SELECT p_partkey, coalesce(p.name, 'unknown') AS process, coalesce(color, 'white') AS color FROM f LEFT JOIN p USING (i)")
def substring_theta_join(spark, sf_dir):
    rows = [("green ones", ["green"], "g", 0), ("steel", ["STEEL"], "s", 1), ("blue ones", ["blue"], "b", 2), ("green ones", ["lime"], "g", 3)]
    processes = spark.createDataFrame(rows, "process string, samples array<string>, color string, draw_idx int")
    parts = v.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return lookups.by_substring(parts, processes).select("p_partkey", "process", "color")


_CODES_SQL = """n AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 7 + l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS name FROM lineitem),
p AS (SELECT CAST(o_custkey * 10 + 7 AS VARCHAR) AS s, o_orderkey AS i, 'p' || (o_orderkey % 50) AS process, o_orderpriority AS color FROM orders),
q AS (SELECT s, min(i) AS i, arg_min(process, i) AS process, arg_min(color, i) AS color FROM p GROUP BY s)"""


def _codes(spark, sf_dir):
    names = v.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat(cast(l_orderkey * 7 + l_partkey as string), '_', cast(l_suppkey as string)) as name")
    listed = v.table(spark, sf_dir, "orders").selectExpr("concat('p', cast(o_orderkey % 50 as string)) as process", "array(cast(o_custkey * 10 + 7 as string)) as samples", "o_orderpriority as color", "o_orderkey as draw_idx")
    return names, listed


def _substrings(name: str, **how: int) -> None:
    def run(spark, sf_dir):
        return lookups.by_substring(*_codes(spark, sf_dir), **how).groupBy("process", "color").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))

    run.__name__ = name
    # Patterns are of few lengths here, so SQL looks each piece of a name up.
    query(f"""WITH {_CODES_SQL}, k AS (SELECT DISTINCT name FROM n), z AS (SELECT DISTINCT length(s) AS z FROM q),
c AS (SELECT DISTINCT name, substr(name, CAST(i AS BIGINT), z) AS s FROM (SELECT name, z, unnest(range(1, length(name) - z + 2)) AS i FROM k, z)), f AS (SELECT name, arg_min(process, i) AS process, arg_min(color, i) AS color FROM c JOIN q USING (s) GROUP BY name)
SELECT coalesce(process, 'unknown') AS process, coalesce(color, 'white') AS color, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM n LEFT JOIN f USING (name) GROUP BY ALL""")(run)


_substrings("substring_many_patterns")
_substrings("substring_joined_patterns", told=0)


_NAMES = ["Muon0", "DYto2L-4Jets", "TTto4Q", "TWminus", "TbarWplus", "TBbarQ", "Wto2Q", "WZ", "Muon"]


@query(f"""WITH s AS (SELECT s_suppkey, list_element({_NAMES!r}, CAST(s_suppkey % 9 + 1 AS INT)) AS sample FROM supplier)
SELECT s_suppkey, sample, CASE WHEN regexp_matches(sample, '^Muon\\d+$') THEN 'data' WHEN regexp_matches(sample, '^DYto') THEN 'DY' WHEN regexp_matches(sample, '^(TT|TW|TbarW|TBbar|TbarB)') THEN 'tt' WHEN regexp_matches(sample, '^Wto') THEN 'W+jets' ELSE 'others' END AS process FROM s""")
def regex_group(spark, sf_dir):
    sample = F.element_at(F.array(*map(F.lit, _NAMES)), (F.pmod("s_suppkey", F.lit(9)) + 1).cast("int"))
    return v.table(spark, sf_dir, "supplier").select("s_suppkey", sample.alias("sample")).withColumn("process", scalar.group_of(F.col("sample")))


@query(f"SELECT sample, regexp_replace(sample, '[^\\w.-]', '_', 'g') AS file, CASE WHEN contains(sample, '_') THEN regexp_replace(sample, '^[^_]*_', '') ELSE sample END AS suffix FROM (SELECT s_name || ' ' || s_suppkey || '_x/y' AS sample FROM supplier)")
def name_functions(spark, sf_dir):
    name = v.table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" "), "s_suppkey", F.lit("_x/y")).alias("sample"))
    return name.select("sample", scalar.file_name_of(F.col("sample")).alias("file"), scalar.after_first(F.col("sample")).alias("suffix"))


@query("""WITH c AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'gen_' || p_name WHEN 1 THEN 'true' || p_type WHEN 2 THEN p_name || '_' || p_size ELSE p_brand END AS t FROM part),
r AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'reco_' || p_name WHEN 1 THEN p_type ELSE p_brand || '_' || p_size END AS r FROM part)
SELECT DISTINCT t AS truth, r AS reco FROM c JOIN r ON t <> r AND ((contains(t, '_') AND contains(r, '_') AND substr(t, strpos(t, '_') + 1) = substr(r, strpos(r, '_') + 1)) OR (starts_with(t, 'true') AND substr(t, 5) = r))""")
def pair_matching(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    control = part.selectExpr("case p_partkey % 4 when 0 then concat('gen_', p_name) when 1 then concat('true', p_type) when 2 then concat(p_name, '_', p_size) else p_brand end as name").distinct()
    reco = part.selectExpr("case p_partkey % 3 when 0 then concat('reco_', p_name) when 1 then p_type else concat(p_brand, '_', p_size) end as name").distinct()
    return lookups.pairs(control, reco)


# ---- bins


@query(f"WITH {v.EVENTS_SQL}, {v.bins_sql({'eta_1': v.BINS['eta_1'], 'iso_1': v.BINS['iso_1']})}, v AS ({v.values_sql(['eta_1', 'iso_1'])}) SELECT v.var, bin, count(*) AS count FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL")
def bin_range_join(spark, sf_dir):
    bins = binning.bins_table(spark, {c: v.BINS[c] for c in ("eta_1", "iso_1")})
    values = v.events(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).alias("x")) for c in ("eta_1", "iso_1")])).alias("f")).select("f.*")
    return binning.range_joined(values, bins).groupBy("var", "bin").agg(F.count(F.lit(1)).alias("count"))


@query("""WITH e AS (SELECT c_mktsegment AS var, c_acctbal AS lo, lead(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS hi, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS bin FROM (SELECT DISTINCT c_mktsegment, c_acctbal FROM customer)),
b AS (SELECT var, bin, lo, hi FROM e WHERE hi IS NOT NULL), x AS (SELECT o_orderpriority, c_mktsegment AS var, o_totalprice / 40 AS x FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT x.var, bin, count(*) AS count, round(min(x), 6) AS least FROM x ASOF JOIN (SELECT var, lo, bin, hi FROM b) b ON x.var = b.var AND x.x >= b.lo WHERE x < hi GROUP BY ALL""")
def bin_interval_join(spark, sf_dir):
    """Bins that are data: between neighbouring balances of a market segment, of very unequal widths, as many as customers."""
    customer = v.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("var"), F.col("c_acctbal").alias("lo"))
    order = Window.partitionBy("var").orderBy("lo")
    bins = customer.select("var", "lo").distinct().select("var", "lo", F.lead("lo").over(order).alias("hi"), F.row_number().over(order).cast("long").alias("bin"), F.lit(False).alias("last")).where("hi is not null")
    values = v.table(spark, sf_dir, "orders").join(customer.select("c_custkey", "var"), F.col("o_custkey") == F.col("c_custkey")).select("var", (F.col("o_totalprice") / 40).alias("x"))
    return binning.range_joined(values, bins).groupBy("var", "bin").agg(F.count(F.lit(1)).alias("count"), F.round(F.min("x"), 6).alias("least"))


@query("""WITH b AS (SELECT p_brand AS var, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1 HAVING max(p_retailprice) > min(p_retailprice)),
e AS (SELECT var, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 10) AS lo, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS hi FROM b, range(10) t(i))
SELECT var, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round((lo + hi) / 2, 6) AS centre, round(hi - lo, 6) AS width FROM e""")
def bin_edges_centres(spark, sf_dir):
    """Ten bins over the prices of each brand (brands are a fixed few)."""
    found = v.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).where("hi > lo").collect()
    bins = binning.bins_table(spark, {r["p_brand"]: Binning(r["lo"], r["hi"], 10) for r in found})
    return bins.select("var", "bin", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "centre", "width")])


# ---- vectors

_XYZ_SQL = """u AS (SELECT vec_id, embedding[1] * 100.0 AS pt, greatest(-6, least(6, embedding[2] * 20.0)) AS eta, embedding[3] * 10.0 AS phi FROM embeddings),
c AS (SELECT vec_id, pt * cos(phi) AS x, pt * sin(phi) AS y, pt * (exp(eta) - exp(-eta)) / 2 AS z FROM u), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM c)"""


def _direction(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    return e.select("vec_id", scalar.direction(at(0) * 100, at(1) * 20, at(2) * 10).alias("d"))


@query(f"WITH {_XYZ_SQL} SELECT vec_id, round(x / n, 6) + 0.0 AS x, round(y / n, 6) + 0.0 AS y, round(z / n, 6) + 0.0 AS z, round(0.4 * x / n, 6) + 0.0 AS vx FROM n WHERE n > 0".replace("embedding[", "CAST(embedding[").replace("] *", "] AS DOUBLE) *"))
def event_unit_vectors(spark, sf_dir):
    d = _direction(spark, sf_dir)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])
    d = d.withColumn("v", scalar.vertex(zero, F.col("d")))
    return d.select("vec_id", *[(F.round(f"d.{k}", 6) + 0.0).alias(k) for k in "xyz"], (F.round("v.x", 6) + 0.0).alias("vx"))


@query("""WITH p AS (SELECT vec_id, unnest([1, 2, 3, 4]) AS i, unnest(['pi', 'pi2', 'pi3', 'pi0']) AS type, unnest([embedding[1], embedding[2], embedding[3], embedding[4]]) AS pt FROM embeddings),
k AS (SELECT vec_id, count(*) AS n, string_agg(type, ',' ORDER BY i) AS types FROM p WHERE pt > 0 GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n, coalesce(types, '') AS types, CASE WHEN n IS NULL THEN 'muon' ELSE 'tau' END AS leg FROM embeddings LEFT JOIN k USING (vec_id)""")
def pion_extract(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    flat = e.select("vec_id", *[F.get("embedding", i).cast("double").alias(name) for i, name in enumerate(("pi_pt_1", "pi2_pt1", "pi3_pt_1", "pi0_pt_1"))])
    pions = lookups.pion_list(flat.columns, "1")
    return flat.select("vec_id", F.size(pions).cast("long").alias("n"), F.array_join(F.transform(pions, lambda p: p["type"]), ",").alias("types"), lookups.leg_kind(pions).alias("leg"))


@query("""WITH p AS (SELECT vec_id, unnest([1, 2]) AS leg, unnest([embedding[1] * 100.0, embedding[4] * 100.0]) AS pt, unnest([embedding[2] * 20.0, embedding[5] * 20.0]) AS eta, unnest([embedding[3] * 10.0, embedding[6] * 10.0]) AS phi, embedding[7] AS q FROM embeddings),
c AS (SELECT vec_id, leg, q, pt * cos(phi) AS x, pt * sin(phi) AS y, pt * (exp(greatest(-6, least(6, eta))) - exp(-greatest(-6, least(6, eta)))) / 2 AS z FROM p), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM c)
SELECT vec_id, CAST(leg AS VARCHAR) AS leg, CASE WHEN leg = 1 AND q > 0 THEN 'tau' ELSE 'muon' END AS kind, round(2 * x / n, 5) + 0.0 AS x, round(0.4 * z / n, 5) + 0.0 AS vz, CASE WHEN leg = 1 AND q > 0 THEN 'magenta' ELSE '' END AS colors FROM n WHERE n > 0""".replace("embedding[7]", "CAST(embedding[7] AS DOUBLE)").replace("embedding[", "CAST(embedding[").replace("] *", "] AS DOUBLE) *").replace("CAST(CAST(", "CAST(", 1))
def event_display(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    scales = {"pt_1": (0, 100), "eta_1": (1, 20), "phi_1": (2, 10), "pt_2": (3, 100), "eta_2": (4, 20), "phi_2": (5, 10), "pi0_pt_1": (6, 1)}
    flat = e.select("vec_id", *[(F.get("embedding", i).cast("double") * k).alias(name) for name, (i, k) in scales.items()])
    out = display.legs(flat, ["vec_id"], length=2.0)
    return out.select("vec_id", "leg", "kind", (F.round("end.x", 5) + 0.0).alias("x"), (F.round("vertex.z", 5) + 0.0).alias("vz"), F.array_join(F.transform("pions", lambda p: p["color"]), ",").alias("colors"))


# Vertices of cones: a muon's or a tau's from the origin, and of neutral pions where the tau decays.
_CONES_SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (
  SELECT vec_id, '1' AS leg, CASE WHEN e[7] > 0 THEN 'tau' ELSE 'muon' END AS part, e[1] * 100 AS pt, e[2] * 20 AS eta, e[3] * 10 AS phi, 0 AS later FROM e
  UNION ALL SELECT vec_id, '2', 'muon', e[4] * 100, e[5] * 20, e[6] * 10, 0 FROM e
  UNION ALL SELECT vec_id, '1', 'pi0', e[7], e[8] * 20, e[9] * 10, 1 FROM e WHERE e[7] > 0
), w AS (SELECT *, pt * cos(phi) AS a, pt * sin(phi) AS b, pt * (exp(greatest(-6, least(6, eta))) - exp(-greatest(-6, least(6, eta)))) / 2 AS c FROM p),
d AS (SELECT vec_id, leg, part, later, a / sqrt(a * a + b * b + c * c) AS dx, b / sqrt(a * a + b * b + c * c) AS dy, c / sqrt(a * a + b * b + c * c) AS dz FROM w WHERE a * a + b * b + c * c > 0),
t AS (SELECT d.*, coalesce(o.dx, 0) * 0.4 * d.later AS ox, coalesce(o.dy, 0) * 0.4 * d.later AS oy, coalesce(o.dz, 0) * 0.4 * d.later AS oz, CASE d.part WHEN 'muon' THEN 1.8 WHEN 'tau' THEN 0.4 ELSE 1.2 END AS length,
  CASE d.part WHEN 'muon' THEN 0.05 WHEN 'tau' THEN 0.08 ELSE 0.15 END AS radius FROM d LEFT JOIN (SELECT * FROM d WHERE part = 'tau') o USING (vec_id, leg)),
g AS (SELECT *, radius * i / 5 * cos(j * {v.number(2 * math.pi / 5)}) AS gx, radius * i / 5 * sin(j * {v.number(2 * math.pi / 5)}) AS gy, CAST(length AS DOUBLE) * i / 5 AS gz FROM t, range(6) a(i), range(6) b(j)),
r AS (SELECT *, gx * dx + gy * dy AS s FROM g)
SELECT vec_id, leg, part, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(ox + gx + dx * gz - dx * s / (1 + dz), 5) + 0.0 AS x, round(oy + gy + dy * gz - dy * s / (1 + dz), 5) + 0.0 AS y, round(oz + gz - s - (dx * dx + dy * dy) * gz / (1 + dz), 5) + 0.0 AS z FROM r"""


@query(_CONES_SQL)
def event_meshes(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    scales = {"pt_1": (0, 100), "eta_1": (1, 20), "phi_1": (2, 10), "pt_2": (3, 100), "eta_2": (4, 20), "phi_2": (5, 10), "pi0_pt_1": (6, 1), "pi0_eta_1": (7, 20), "pi0_phi_1": (8, 10)}
    flat = e.select("vec_id", *[(F.get("embedding", i).cast("double") * k).alias(name) for name, (i, k) in scales.items()])
    return display.meshes(flat, ["vec_id"], n=6).select("vec_id", "leg", "part", "i", "j", *[(F.round(k, 5) + 0.0).alias(k) for k in "xyz"])


# ---- heads, unions, sets


@query("""WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE k <= 3""")
def head_n_per_sample(spark, sf_dir):
    return ordering.head_of_each(v.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", ["l_orderkey", "l_linenumber"], 3)


@query("WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE k <= 5 ORDER BY l_returnflag, l_orderkey, l_linenumber LIMIT 5")
def head_events(spark, sf_dir):
    return ordering.head(v.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", ["l_orderkey", "l_linenumber"], 5)


#: Rows that a task sorts, about.
SORTED_ROWS = 1_000_000


def _ranges(table: DataFrame) -> int:
    """Partitions for a sort: so many that each is of a bounded size, whatever the table's."""
    return -(-table.count() // SORTED_ROWS) or 1


@query("SELECT l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def head_of_files(spark, sf_dir):
    path = _scratch(spark, "files")
    line = v.table(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber")
    line.write.partitionBy("l_linestatus").parquet(path)  # several files a folder, so no task has a whole one
    first = catalog.head_of_files(spark.read.parquet(path), ["l_orderkey", "l_linenumber"], 2).select("l_linestatus", "l_orderkey", "l_linenumber")
    return ordering.head_of_each(first, "l_linestatus", ["l_orderkey", "l_linenumber"], 2)


@query("WITH r AS (SELECT l_returnflag AS sample, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT sample, l_orderkey, l_linenumber FROM r WHERE k <= 4")
def head_in_file_order(spark, sf_dir):
    """The first rows of each sample in the order of its files, read without the others."""
    path = _scratch(spark, "sorted")
    line = v.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    order = ["l_returnflag", "l_orderkey", "l_linenumber"]
    line.repartitionByRange(_ranges(line), *order).sortWithinPartitions(*order).write.partitionBy("l_returnflag").parquet(path)  # files of ascending keys
    folders = sorted({r["path"].split("/")[-2] for r in catalog.listing(spark, path).select("path").collect()})
    samples = tuple(Sample(f.rpartition("=")[2], dirs=(f"{path}/{f}",)) for f in folders)
    return heads.head_of_samples(spark, samples, 4).select("sample", "l_orderkey", "l_linenumber")


@query("SELECT 'customer' AS sample, count(*) AS n, round(sum(c_acctbal), 2) AS total, 0 AS named FROM customer UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2), 0 FROM supplier UNION ALL SELECT 'nation', count(*), NULL, count(*) FROM nation")
def union_missing_columns(spark, sf_dir):
    parts = [v.table(spark, sf_dir, "customer").select(F.lit("customer").alias("sample"), F.col("c_acctbal").alias("x")), v.table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("sample"), F.col("s_acctbal").alias("x")), v.table(spark, sf_dir, "nation").select(F.lit("nation").alias("sample"), F.col("n_name").alias("name"))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("total"), F.count("name").cast("int").alias("named"))


@query("""WITH s AS (SELECT p_type, p_brand, bool_or(p_size <= 5) AS a, bool_or(p_size > 45) AS b FROM part WHERE p_size <= 5 OR p_size > 45 GROUP BY ALL),
k AS (SELECT *, unnest(['union', 'common', 'left']) AS what FROM s)
SELECT p_type, what, coalesce(string_agg(p_brand, ',' ORDER BY p_brand) FILTER (WHERE what = 'union' OR (what = 'common' AND a AND b) OR (what = 'left' AND a AND NOT b)), '') AS columns FROM k GROUP BY ALL""")
def column_set_ops(spark, sf_dir):
    """Union, intersection and difference of two sets of names: brands of small and of large parts, by type."""
    part = v.table(spark, sf_dir, "part").where("p_size <= 5 or p_size > 45")
    sets = part.groupBy("p_type").agg(F.collect_set(F.when(F.col("p_size") <= 5, F.col("p_brand"))).alias("a"), F.collect_set(F.when(F.col("p_size") > 45, F.col("p_brand"))).alias("b"))
    kinds = F.array(*[F.struct(F.lit(k).alias("what"), F.array_join(F.array_sort(f("a", "b")), ",").alias("columns")) for k, f in (("union", F.array_union), ("common", F.array_intersect), ("left", F.array_except))])
    return sets.select("p_type", F.explode(kinds).alias("k")).select("p_type", "k.*")


_FILES_SQL = "f AS (SELECT 's' || (o_custkey % 50) AS sample, CASE o_orderkey % 3 WHEN 0 THEN '/d/' || (o_custkey % 50) || '/merged.parquet' ELSE '/d/' || (o_custkey % 50) || '/job_' || (o_orderkey % 5) || '.parquet' END AS path, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 2 = 0)"


def _files(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0 or o_custkey % 2 = 0")
    k = F.expr("cast(o_custkey % 50 as string)")
    path = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("/d/"), k, F.lit("/merged.parquet"))).otherwise(F.concat(F.lit("/d/"), k, F.lit("/job_"), F.expr("cast(o_orderkey % 5 as string)"), F.lit(".parquet")))
    return o.select(F.concat(F.lit("s"), k).alias("sample"), path.alias("path"), F.col("o_orderkey").alias("pos"))


@query(f"WITH {_FILES_SQL} SELECT sample, path, min(pos) AS pos FROM f GROUP BY ALL")
def dedupe_paths(spark, sf_dir):
    return catalog.deduplicated(_files(spark, sf_dir))


@query(f"WITH {_FILES_SQL}, d AS (SELECT sample, path, min(pos) AS pos FROM f GROUP BY ALL), m AS (SELECT *, bool_or(path LIKE '%/merged.parquet') OVER (PARTITION BY sample) AS has FROM d) SELECT sample, path FROM m WHERE NOT has OR path LIKE '%/merged.parquet'")
def merged_preference(spark, sf_dir):
    return catalog.merged_first(catalog.deduplicated(_files(spark, sf_dir))).select("sample", "path")


@query(f"WITH {_FILES_SQL}, d AS (SELECT DISTINCT sample, '/b/2022/mt/' || sample || path AS path FROM f), m AS (SELECT *, bool_or(path LIKE '%/merged.parquet') OVER (PARTITION BY sample) AS has FROM d) SELECT sample, string_agg(path, ',' ORDER BY path) AS files FROM m WHERE NOT has OR path LIKE '%/merged.parquet' GROUP BY sample")
def sample_catalogue(spark, sf_dir):
    files = _files(spark, sf_dir).select(F.concat(F.lit("/b/2022/mt/"), "sample", "path").alias("path")).distinct()
    return catalog.sample_catalogue(files, "/b", "2022", "mt").select("sample", F.array_join("files", ",").alias("files"))


@query(f"""WITH s AS (SELECT list_element({_NAMES!r}, CAST(s_suppkey % 9 + 1 AS INT)) || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '-' || s_nationkey END AS n FROM supplier)
SELECT CASE WHEN regexp_matches(n, '^Muon\\d+$') THEN 'data' WHEN regexp_matches(n, '^DYto') THEN 'DY' WHEN regexp_matches(n, '^(TT|TW|TbarW|TBbar|TbarB)') THEN 'tt' WHEN regexp_matches(n, '^Wto') THEN 'W+jets' ELSE 'others' END AS process, string_agg(n, ',' ORDER BY n) AS samples FROM s GROUP BY 1""")
def process_map(spark, sf_dir):
    sample = F.element_at(F.array(*map(F.lit, _NAMES)), (F.pmod("s_suppkey", F.lit(9)) + 1).cast("int"))
    end = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("-"), F.col("s_nationkey").cast("string")))
    names = v.table(spark, sf_dir, "supplier").select(F.concat(sample, end).alias("sample"))
    return catalog.process_map(names).select("process", F.array_join("samples", ",").alias("samples"))


# ---- store, compaction, CSV, metrics, streaming

_STORE_SQL = f"""WITH {v.EVENTS_SQL}, {v.bins_sql({'pt_1': v.BINS['pt_1']})}, v AS ({v.values_sql(['pt_1'], 'process, scale')}), p AS (SELECT DISTINCT process FROM v),
f AS (SELECT process, bin, sum(scale) AS s FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL),
h AS (SELECT p.process, b.bin, b.lo, b.hi, coalesce(s, 0) AS s FROM p CROSS JOIN bins b LEFT JOIN f ON f.process = p.process AND f.bin = b.bin)"""


def _stored(spark, sf_dir) -> str:
    bins = {("control", "pt_1"): v.BINS["pt_1"]}
    hist = fill.densify(fill.histogram(fill.fills(v.events(spark, sf_dir), ["pt_1"]), bins), bins)
    path = _scratch(spark, "histograms")
    histograms.write(histograms.dense(hist), path)
    return path


@query(f"{_STORE_SQL} SELECT 'control' AS plot_type, 'pt_1' AS variable, process AS sample, bin, lo, hi, round(s, 6) AS count FROM h")
def sidecar_roundtrip(spark, sf_dir):
    back = histograms.long(histograms.read(spark, _stored(spark, sf_dir)))
    return back.select("plot_type", "variable", "sample", "bin", "lo", "hi", F.round("count", 6).alias("count"))


@query(f"{_STORE_SQL}, o AS (SELECT process, row_number() OVER (ORDER BY process DESC) - 1 AS draw_idx FROM p WHERE process IN ('EUROPE', 'AFRICA')), t AS (SELECT h.*, draw_idx, sum(s) OVER (PARTITION BY bin ORDER BY draw_idx) AS top FROM h JOIN o USING (process)) SELECT process, bin, draw_idx, round(top, 6) AS top, round(top - s, 6) + 0.0 AS bottom FROM t")
def sidecar_rerender(spark, sf_dir):
    back = histograms.long(histograms.read(spark, _stored(spark, sf_dir))).withColumnRenamed("sample", "process").withColumnRenamed("variable", "var")
    order = ordering.ordered(back.select("process").distinct(), ["EUROPE", "AFRICA"], listed_only=True).select(F.col("process").alias("_p"), F.col("draw_idx").cast("long").alias("draw_idx"))
    s = ordering.stacked(back.join(F.broadcast(order), F.col("process") == F.col("_p")), "count")
    return s.select("process", "bin", "draw_idx", F.round("top", 6).alias("top"), (F.round("bottom", 6) + 0.0).alias("bottom"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def compact_parquet(spark, sf_dir):
    parts, out = _scratch(spark, "parts"), _scratch(spark, "compacted")
    v.table(spark, sf_dir, "orders").repartition(6, "o_orderkey").write.parquet(f"{parts}/deep")
    return catalog.compact(spark, parts, out).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def compact_in_order(spark, sf_dir):
    """Files of ascending keys, compacted: the place of each row in the new files."""
    parts, out = _scratch(spark, "parts"), _scratch(spark, "compacted")
    orders = v.table(spark, sf_dir, "orders")
    orders.repartitionByRange(max(9, _ranges(orders)), "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(parts)
    rows = catalog.compact(spark, parts, out, files=3).select("o_orderkey", "o_orderpriority", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("file").alias("_file"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), F.col("file") == F.col("_file")).select("o_orderkey", "o_orderpriority", (F.col("before") + F.col("i")).alias("place"))


@query("""SELECT 'rows' AS what, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'left out', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = 3""")
def csv_quarantine(spark, sf_dir):
    """CSV files of two headers, some of which have rows that don't fit: those are left out as whole files, and listed."""
    path = _scratch(spark, "csv")
    c = v.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    c.where("nation <> 3").write.option("header", True).csv(f"{path}/a")
    c.select("c_acctbal", "c_custkey", "nation").where("nation = 1 and false").write.option("header", True).csv(f"{path}/b")
    lines = c.where("nation = 3").select(F.concat_ws(",", "c_custkey", "c_acctbal", "nation", F.lit("more")).alias("value"))
    lines.repartition(2).select(F.concat(F.lit("c_custkey,c_acctbal,nation\n"), "value").alias("value")).write.text(f"{path}/c")
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path not like '%/\\_SUCCESS'").select("path").collect()]
    good, bad = csvs.read_csv(spark, files)
    out = spark.read.text(f"{path}/c").where("value like '%,more'").select(F.split("value", ",")[1].cast("double").alias("x"), F.col("_metadata.file_path").alias("path")).join(bad, "path", "left_semi")
    total = lambda what, x: (F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 2).alias("total"))
    return good.agg(*total("rows", "c_acctbal")).union(out.agg(*total("left out", "x")))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 25 GROUP BY 1")
def csv_scan_filter(spark, sf_dir):
    path = _scratch(spark, "csv")
    v.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("pt_1"), "c_mktsegment").write.option("header", True).csv(path)
    df = selection.select(catalog.read(spark, [path], "csv"), {"pt_1_min": 25, "pt_2_min": 5})
    return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pt_1"), 2).alias("total"))


@query("SELECT count(*) AS rows_read, count(*) FILTER (WHERE l_quantity > 25) AS rows_kept FROM lineitem")
def scan_metrics(spark, sf_dir):
    read, kept = Observation("read"), Observation("kept")
    df = v.table(spark, sf_dir, "lineitem").select("l_quantity").observe(read, F.count(F.lit(1)).alias("rows")).where("l_quantity > 25").observe(kept, F.count(F.lit(1)).alias("rows"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(read.get["rows"], kept.get["rows"])], "rows_read long, rows_kept long")


@query(f"WITH {v.PHASES_SQL}, {v.bins_sql({'r': v.PHASE})}, v AS (SELECT 'r' AS var, event_type, phi_1 AS x FROM ph) SELECT event_type, bin, count(*) AS count FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL")
def streaming_fill(spark, sf_dir):
    source, name = _scratch(spark, "stream"), f"fill_{uuid.uuid4().hex}"
    e = v.phases(spark, sf_dir)
    e.repartition(4).write.parquet(source)
    plan = lambda df: df.withColumn("bin", binning.bin_index(F.col("phi_1"), v.PHASE)).where("bin is not null").groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("count"))
    fill_stream(spark, source, e.schema, plan, name=name, checkpoint=_scratch(spark, "offsets"), files_per_trigger=2).awaitTermination()
    return spark.table(name)


@query(f"""WITH {v.PHASES_SQL}, {v.bins_sql({'r': v.PHASE})}, v AS (SELECT 'r' AS var, event_type, abs(value) AS w, phi_1 AS x FROM ph),
e AS (SELECT event_type AS process, bin, count(*) AS count, sum(CAST(w * {_UNIT} AS HUGEINT)) AS s FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL) SELECT process, bin, count, CAST(s AS DOUBLE) / {_UNIT} AS sumw FROM e""")
def stored_stream(spark, sf_dir):
    """A stream into a store, started anew without its checkpoint when more files have come: all files come twice and count once."""
    source, store = _scratch(spark, "stream"), HistogramStore(spark, _scratch(spark, "store"))
    plan = lambda df: fill.partial(fill.fills(df, ["phi_1"]), {("control", "phi_1"): v.PHASE})
    for i, part in enumerate(("event_id % 3 = 0", "event_id % 3 <> 0")):
        e = v.phases(spark, sf_dir).where(part).select(F.col("event_type").alias("process"), F.abs("value").alias("scale"), "phi_1")
        e.repartition(3).write.mode("append").parquet(source)
        store_stream(spark, source, e.schema, store, plan, checkpoint=_scratch(spark, f"offsets{i}"), files_per_trigger=2).awaitTermination()
    store.compact()
    return store.histogram().where("bin is not null").select("process", "bin", "count", "sumw")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data against simulation with QCD from the same-sign region."""
    return data_mc_ratio(spark, sf_dir)
