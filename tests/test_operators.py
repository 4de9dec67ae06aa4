import math

import pytest
from pyspark.sql import functions as F

from binforge.functions import binning
from binforge.functions.binning import Binning
from binforge.operators import agreement, fill, lookups, ordering, selection


def col(spark, xs, c="pt_1", kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"{c} {kind}")


@pytest.mark.parametrize("cuts, column, xs, kept", [
    ({"pt_1_min": 25}, "pt_1", [25.0, 25.1, math.nan, None], [25.1]),
    ({"eta_1_abs_max": 2.4}, "eta_1", [-2.4, -2.39, 2.39, 2.4, math.nan, None], [-2.39, 2.39]),
    ({"ip_LengthSig_1_abs_min": 1.5}, "ip_LengthSig_1", [-2.0, -1.5, 0.0, 1.5, 2.0, math.nan], [-2.0, 2.0]),
    ({"iso_1_max": 0.15}, "iso_1", [0.1, 0.15, math.nan, None], [0.1]),
    ({"pt_2_min": 10}, "pt_1", [1.0, None], [1.0, None]),
    ({}, "pt_1", [1.0], [1.0]),
])
def test_cuts(spark, cuts, column, xs, kept):
    assert [r[0] for r in col(spark, xs, column).transform(selection.selector(cuts)).collect()] == kept


def test_integer_cuts(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (None, 7)], "decayModePNet_2 int, idDeepTau2018v2p5VSjet_2 int")
    assert selection.select(df, {"decayModePNet_2_eq": 1, "idDeepTau2018v2p5VSjet_2_min": 4}).count() == 1
    assert selection.columns_used({"pt_1_min": 1, "iso_1_max": None, "else": 3}) == ["pt_1"]


def test_cuts_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("double").alias("pt_1"), F.col("id").cast("double").alias("eta_1"), F.lit(1).alias("unused")).write.parquet(path)
    df = selection.select(spark.read.parquet(path), {"pt_1_min": 3, "eta_1_abs_max": 8}).select("pt_1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(pt_1,3.0)" in plan and "LessThan(eta_1,8.0)" in plan and "unused" not in plan


def test_regions_and_triggers(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 1), (-1, 0, 0), (None, 1, None)], "os int, trg_singlemuon int, trg_mt_cross int")
    r = df.select(selection.region(df.columns), selection.trigger(df.columns), selection.trigger(["trg_mt_cross"]), selection.region([]), selection.trigger([])).collect()
    assert [tuple(x) for x in r] == [("OS", True, False, "OS", True), ("SS", True, True, "OS", True), (None, False, False, "OS", True), (None, True, False, "OS", True)]


def events(spark, rows):
    return spark.createDataFrame(rows, "process string, x double, y double, weight double, w_mc double, scale double, region string, trigger boolean")


def test_weights_and_presence(spark):
    rows = [("a", 1.0, 2.0, 0.5, 2.0, 3.0, "OS", True), ("a", 1.2, 0.0, 1.5, 2.0, 3.0, "OS", True), ("a", 9.0, 1.0, 1.0, 2.0, 3.0, "SS", True), ("b", math.nan, 1.0, 1.0, 1.0, 1.0, "OS", True), ("c", 99.0, 1.0, 1.0, 1.0, 1.0, "OS", False)]
    bins = {("mc_data", "x"): Binning(0.0, 10.0, 2), ("control", "x"): Binning(0.0, 10.0, 2)}
    hist = fill.densify(fill.histogram(fill.fills(events(spark, rows), ["x"], [], ["x"]), bins), bins).collect()
    at = {(r["family"], r["region"], r["process"], r["bin"]): r for r in hist}
    assert at["mc_data", "OS", "a", 0]["sumw"] == 4 and at["mc_data", "OS", "a", 0]["sumw2"] == 8
    assert at["control", None, "a", 0]["sumw"] == 6 and at["control", None, "a", 1]["count"] == 1
    assert at["control", None, "c", 0]["sumw"] == at["control", None, "c", 1]["sumw"] == 0  # present out of range
    assert not any(k[2] == "b" for k in at) and ("mc_data", "OS", "c", 0) not in at


def test_resolution(spark):
    df = spark.createDataFrame([(50.0, 55.0), (0.0, 1.0), (-10.0, -5.0), (math.inf, 1.0), (None, 1.0)], "c double, r double")
    assert [r[0] for r in df.select(fill.resolution(fill.Pair("c", "r"))).collect()] == pytest.approx([0.1, None, -0.5, None, None])
    assert [r[0] for r in df.select(fill.resolution(fill.Pair("c", "r", relative=False))).collect()][2] == pytest.approx(5 - 2 * math.pi)


def test_asymmetry(spark):
    hist = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0)], "even double, odd double")
    assert fill.asymmetry(hist).first()[0] == pytest.approx(3 / 11)
    assert fill.asymmetry(hist.where("even > 9")).first()[0] == 0


def _ss(spark):
    rows = [("mc_data", "x", "SS", p, i, float(i), i + 1.0, 1, float(w), float(w), k) for p, k, ws in (("data", "data", (10, 5)), ("a", "mc", (3, 1)), ("b", "mc", (2, 6))) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "family string, var string, region string, process string, bin int, lo double, hi double, count long, sumw double, sumw2 double, kind string")


@pytest.mark.parametrize("ff, os, os2", [(1.0, [5, -2], [15, 12]), (2.0, [10, -4], [60, 48])])
def test_qcd(spark, ff, os, os2):
    rows = {(r["region"], r["bin"]): (r["sumw"], r["sumw2"]) for r in agreement.qcd(_ss(spark), ff).collect()}
    assert [rows["OS", i] for i in (0, 1)] == list(zip(os, os2)) and [rows["SS", i] for i in (0, 1)] == [(5, 15), (-2, 12)]


def test_qcd_needs_both_kinds(spark):
    assert agreement.qcd(_ss(spark).where("kind = 'mc'")).count() == 0 and agreement.qcd(_ss(spark).where("kind = 'data'")).count() == 0
    assert agreement.with_qcd(_ss(spark), enabled=False).count() == 6


def test_data_mc(spark):
    rows = {r["bin"]: r for r in agreement.data_mc(_ss(spark), "SS").collect()}
    assert rows[0]["ratio"] == 2 and rows[0]["mc"] == 5 and rows[0]["ratio_unc"] == pytest.approx(math.sqrt(10) / 5)
    assert rows[1]["mc_low"] == pytest.approx(7 - math.sqrt(7))


def test_orders(spark):
    rows = spark.createDataFrame([("b", 0), ("QCD", 1), ("A", 2)], "process string, position int")
    order = lambda df: [r["process"] for r in df.orderBy("draw_idx").collect()]
    assert order(ordering.ordered(rows, ["a", "B"])) == ["A", "b", "QCD"]
    assert order(ordering.ordered(rows, ["a", "B"], listed_only=True)) == []
    assert order(ordering.ordered(rows, [])) == ["b", "QCD", "A"]


def test_kinds_and_styles(spark):
    samples = spark.createDataFrame([("p", "mc"), ("p", "data"), ("p", "mc"), ("q", "mc")], "process string, kind string")
    assert {tuple(r) for r in agreement.kinds_of(samples).collect()} == {("p", "data"), ("q", "mc")}
    assert ordering.without_data(samples).count() == 3


def test_pairs(spark):
    names = [spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["trueMETx", "gen_pt"], ["METx", "reco_pt"])]
    assert {tuple(r) for r in lookups.pairs(*names).collect()} == {("trueMETx", "METx"), ("gen_pt", "reco_pt")}


def test_first_existing_column_wins_even_if_null(spark):
    df = spark.createDataFrame([(None, 5.0)], "pi_pt1 double, pi_pt_1 double")
    assert df.select(lookups.first_existing(df.columns, "pi_pt", "1")).first()[0] is None
    assert df.select(lookups.first_existing(df.columns, "none", "1")).first()[0] == 0


def test_weight_lookup(spark):
    samples = spark.createDataFrame([("ZZ_x", "mc", None), ("none-1", "mc", None), ("other", "mc", None), ("Muon0", "data", None), ("odd", "mc", "ZZ")], "sample string, kind string, params_key string")
    params = spark.createDataFrame([("ZZ", 19.431, 4800000.0, 1.0), ("none", 1.0, 0.0, 1.0)], "params_key string, xs double, eff double, filter_efficiency double")
    w = {r["sample"]: r["w_mc"] for r in lookups.with_weight(samples, params, 109948.2).collect()}
    assert w == {"ZZ_x": pytest.approx(0.445084057125), "none-1": 0.0, "other": 1.0, "Muon0": 1.0, "odd": pytest.approx(0.445084057125)}


def test_last_mapping_wins(spark):
    p = spark.createDataFrame([("a", ["s", "t"], 0), ("b", ["s"], 1)], "process string, samples array<string>, draw_idx int")
    assert {tuple(r) for r in lookups.bridge(p).collect()} == {("s", "b"), ("t", "a")}


def test_events_are_scanned_once(spark, tmp_path):
    rows = [("data", 1.0, 1.0, 1.0, region, True, float(i)) for i in range(20) for region in ("OS", "SS")] + [("a", 1.0, 0.5, 1.0, "SS", True, 3.0)]
    spark.createDataFrame(rows, "process string, scale double, w_mc double, weight double, region string, trigger boolean, x double").write.parquet(str(tmp_path / "e"))
    bins = {("mc_data", "x"): Binning(0, 20, 10)}
    hist = fill.densify(fill.histogram(fill.fills(spark.read.parquet(str(tmp_path / "e")), [], [], ["x"]), bins), bins)
    kinds = spark.createDataFrame([("data", "data"), ("a", "mc")], "process string, kind string")
    out = agreement.data_mc(agreement.with_qcd(agreement.with_kind(hist, kinds)))
    assert {r["bin"]: (r["data"], r["mc"]) for r in out.collect()} == {i: (2.0, 1.5 if i == 1 else 2.0) for i in range(10)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 1


def test_dimension_tables_are_broadcast_by_size(spark, monkeypatch):
    table = spark.range(10)
    hints = lambda: binning.few(table)._jdf.queryExecution().logical().toString().count("Hint")
    assert hints() == 1
    monkeypatch.setattr(binning, "FEW", 9)
    assert hints() == 0
    with pytest.raises(ValueError):
        binning.few(table, must=True)


def test_unwrapped_difference(spark):
    df = spark.createDataFrame([(1.0, 9.0)], "t double, r double")
    pair = lambda **k: df.select(fill.resolution(fill.Pair("t", "r", relative=False, **k))).first()[0]
    assert pair(wrap_all=False) == 8.0 and abs(pair() - (8.0 - 2 * math.pi)) < 1e-12
