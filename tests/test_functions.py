import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binforge.functions import binning, scalar
from binforge.functions.binning import Binning


def values(spark, xs, c="x"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], f"i int, {c} double")


def test_bins_agree_with_numpy_at_every_edge(spark):
    rng = np.random.default_rng(3)
    for b in (Binning(20.0, 120.0, 40), Binning(-2.5, 2.5, 50), Binning(0.0, 0.2, 20), Binning(-math.pi, math.pi, 7)):
        edges = np.array(b.edges)
        assert np.array_equal(edges, np.linspace(b.lo, b.hi, b.n + 1))
        xs = np.concatenate([edges, np.nextafter(edges, -np.inf), np.nextafter(edges, np.inf), rng.uniform(b.lo - 1, b.hi + 1, 500), [np.nan, np.inf, -np.inf, 1e300]])
        out = values(spark, [*xs.tolist(), None]).select(binning.bin_index(F.col("x"), b).alias("bin")).toPandas()["bin"]
        found = np.bincount(out.dropna().astype(int), minlength=b.n)
        assert np.array_equal(found, np.histogram(xs[np.isfinite(xs)], bins=edges)[0])


def test_hand_counted_bins(spark):
    xs = [20, 22.4999, 22.5, np.nextafter(120, 0), 120, 120.0001, 19.9, math.nan, math.inf, None]
    out = [r[0] for r in values(spark, xs).select(binning.bin_index(F.col("x"), Binning(20.0, 120.0, 40))).collect()]
    assert out == [0, 0, 1, 39, 39, None, None, None, None, None]


def test_range_join_is_the_same(spark):
    b = Binning(-2.5, 2.5, 50)
    df = values(spark, [*b.edges, 0.1, 0.3]).withColumn("var", F.lit("v"))
    joined = {r["i"]: r["bin"] for r in binning.range_joined(df, binning.bins_table(spark, {"v": b})).collect()}
    direct = {r["i"]: r["bin"] for r in df.withColumn("bin", binning.bin_index(F.col("x"), b)).collect()}
    assert joined == direct


@pytest.mark.parametrize("delta, expected", [(0.5, 0.5), (3.5, -2.78318530718), (-3.5, 2.78318530718), (math.pi, -math.pi), (-math.pi, -math.pi), (7.0, 0.716814692820)])
def test_wrapped(spark, delta, expected):
    assert spark.range(1).select(scalar.wrapped(F.lit(delta))).first()[0] == pytest.approx(expected)


def test_direction(spark):
    rows = spark.createDataFrame([(30.0, 0.0, 0.0), (30.0, 1.0, math.pi / 2), (30.0, 10.0, 0.0), (0.0, 1.0, 1.0), (math.nan, 1.0, 1.0)], "pt double, eta double, phi double")
    out = [tuple(r[0]) for r in rows.select(scalar.direction(F.col("pt"), F.col("eta"), F.col("phi"))).collect()]
    for found, expected in zip(out, [(1, 0, 0), (0, 0.648054, 0.761594), (0.004957, 0, 0.999988), (0, 0, 0), (0, 0, 0)]):
        assert found == pytest.approx(expected, abs=1e-6)


def test_vertex_and_track(spark):
    way = F.struct(F.lit(0.0).alias("x"), F.lit(3.0).alias("y"), F.lit(4.0).alias("z"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])
    r = spark.range(1).select(scalar.vertex(zero, way).alias("v"), scalar.along(zero, way, 2.0).alias("e")).first()
    assert tuple(r["v"]) == pytest.approx((0, 0.24, 0.32)) and tuple(r["e"]) == (0, 6, 8)


def test_ratio_and_uncertainty(spark):
    r = spark.range(1).select(scalar.ratio(F.lit(10.0), F.lit(5.0)), scalar.ratio(F.lit(1.0), F.lit(0.0)), scalar.uncertainty(F.lit(-4.0)), scalar.clean(F.lit(math.nan)), scalar.clean(F.lit(None).cast("double"))).first()
    assert tuple(r) == (2, 0, 0, 0, 0)


def test_groups_and_keys(spark):
    names = {"Muon0": "data", "DYto2L": "DY", "TTto4Q": "tt", "TWminus": "tt", "TbarWplus": "tt", "TBbarQ": "tt", "Wto": "W+jets", "WZ": "others", "Muon": "others"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", scalar.group_of(F.col("n"))).collect()} == names
    assert spark.range(1).select(scalar.params_key(F.lit("DYto2Tau-2Jets_Bin"))).first()[0] == "DYto2Tau"


def test_resolve():
    variables = {"pt": {"x_min": 20, "x_max": 120, "bin_width": 2.5}, "res_pt": {"x_min": -1, "x_max": 1, "bin_width": 0.1}}
    assert binning.resolve("pt", variables) == Binning(20.0, 120.0, 40)
    assert binning.resolve("pt", variables, resolution=True).n == 20
    assert binning.resolve("other", variables) == Binning(-100.0, 100.0, 20)
    assert binning.resolve("other", variables, xlim=50, bins=10) == Binning(-50.0, 50.0, 10)
    assert binning.resolve("other", variables, xlim=[0, 5], bin_width=0.5) == Binning(0.0, 5.0, 10)
