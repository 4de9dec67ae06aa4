"""Meshes of the event display: cones along any direction, and the detector."""

import math

import pytest
from pyspark.sql import functions as F

from binforge.operators import display

XYZ = "x double, y double, z double"


def unit(x, y, z):
    n = math.sqrt(x * x + y * y + z * z)
    return (x / n, y / n, z / n)


@pytest.mark.parametrize("way", [(0, 0, 1), (0, 0, -1), (1, 0, 0), (0, -1, 0), unit(1, 2, 3), unit(-1, 0.5, -2), unit(1e-7, 0, -1), unit(1e-3, 1e-3, 1), unit(0, 1e-5, 1)])
def test_cones(spark, way):
    df = spark.createDataFrame([((1.0, 2.0, 3.0), tuple(map(float, way)), 2.0, 0.5)], f"origin struct<{XYZ.replace(' double', ': double')}>, way struct<{XYZ.replace(' double', ': double')}>, length double, radius double")
    rows = display.cones(df, 7).collect()
    assert len(rows) == 49
    for r in rows:
        p = [r[k] - o for k, o in zip("xyz", (1.0, 2.0, 3.0))]
        up, wide = 2.0 * r["i"] / 6, 0.5 * r["i"] / 6
        # A rotation: the part along the way and the distance from it are kept.
        assert sum(a * b for a, b in zip(p, way)) == pytest.approx(up, abs=1e-6)
        assert math.dist(p, [up * w for w in way]) == pytest.approx(wide, abs=1e-6)
    at = {(r["i"], r["j"]): (r["x"], r["y"], r["z"]) for r in rows}
    assert at[6, 0] == pytest.approx(at[6, 6]) and at[0, 3] == pytest.approx((1, 2, 3))
    # Around the way by equal angles.
    assert math.dist(at[6, 0], at[6, 1]) == pytest.approx(2 * 0.5 * math.sin(math.pi / 6))


def test_meshes(spark):
    columns = "event int, pt_1 double, eta_1 double, phi_1 double, pt_2 double, eta_2 double, phi_2 double, pi_pt_1 double, pi_eta_1 double, pi_phi_1 double, pi0_pt_1 double"
    rows = [(1, 10.0, 0.0, 0.0, 5.0, 1.0, 1.0, 3.0, 0.5, 0.1, 2.0), (2, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, -1.0), (3, None, 0.0, 0.0, math.nan, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = display.meshes(spark.createDataFrame(rows, columns), ["event"], n=4)
    parts = sorted(map(tuple, got.groupBy("event", "leg", "part", "color").count().fillna("").collect()))
    assert parts == [(1, "1", "pi", "lime", 16), (1, "1", "pi0", "magenta", 16), (1, "1", "tau", "white", 16), (1, "2", "muon", "#00FFFF", 16), (2, "1", "muon", "#00FFFF", 16)]
    tip = got.where("event = 1 and part = 'pi' and i = 0").select("x", "y", "z").first()
    assert tuple(tip) == pytest.approx((0.4, 0, 0))  # where the tau decays


def test_cylinder(spark):
    rows = display.cylinder(spark).collect()
    assert len(rows) == 5000 and all(math.hypot(r["x"], r["y"]) == pytest.approx(2.0) for r in rows)
    assert {round(r["z"], 9) for r in rows if r["i"] in (0, 49)} == {-2.0, 2.0} and display.cylinder(spark, 1.0, 2.0, 3, 5).agg(F.max("x")).first()[0] == 1.0
