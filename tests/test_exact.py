"""Exact sums: equal in every bit whatever the partitions, and equal to the sum rounded once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from binforge.functions import exact


def numbers(seed, n):
    rng = random.Random(seed)
    x = [rng.uniform(-1, 1) * 10 ** rng.uniform(-6, 12) for _ in range(n)]
    return x + [-y for y in x[: n // 2]] + [0.1] * 50 + [2.0**59, -(2.0**59), 1e-20, -0.0]


@pytest.mark.parametrize("xs", [numbers(1, 400), numbers(2, 50), [0.1] * 1000, [-0.1, -0.2], [-(2.0**-60)], [1.5, -1.5], [0.0], [2.0**59] * 64, [1e17, 1.0, -1e17], [-1e15, -0.3, 5e-7]])
def test_rounded_once(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(5)
    got = df.agg(exact.value(exact.exact_sum(F.col("x")))).first()[0]
    if all(x == 0 or abs(x) >= 2.0**-27 for x in xs):  # no bit is cut off
        assert got == math.fsum(xs)
    assert got == pytest.approx(math.fsum(xs), rel=2.3e-16, abs=len(xs) * 2.0**-80)


def test_ties_and_carries(spark):
    """Sums of two or three numbers, which are often half way between two doubles."""
    rng = random.Random(9)
    rows = [(i, rng.choice((1, -1)) * rng.randrange(1 << 53) * 2.0 ** rng.randrange(-79, 6)) for i in range(1500) for _ in range(rng.randrange(1, 4))]
    got = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(exact.exact_sum(F.col("x")).alias("s")).select("k", exact.value(F.col("s"))).collect()
    assert all(s == math.fsum(x for i, x in rows if i == k) for k, s in got)


def test_equal_bits_for_any_partitions(spark):
    rows = [(i % 7, x) for i, x in enumerate(numbers(3, 3000))] + [(7, None), (8, math.nan), (8, 1.0), (9, math.inf), (9, 2.0), (10, None), (10, 1.0), (11, 1e300), (11, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    found = []
    for n in (1, 4, 64):
        part = df.repartition(n, F.rand(n)).groupBy("k", F.spark_partition_id()).agg(exact.exact_sum(F.col("x")).alias("s"))  # partial sums merge
        for sums in (part.groupBy("k").agg(exact.merged("s").alias("s")), df.repartition(n).groupBy("k").agg(exact.exact_sum(F.col("x")).alias("s"))):
            found.append({r["k"]: r["v"] for r in sums.select("k", exact.value(F.col("s")).alias("v")).collect()})
    assert found[0][7] is None and math.isnan(found[0][8]) and found[0][9] == math.inf and found[0][10] == 1.0 and found[0][11] == 1e300
    assert all(repr(f) == repr({k: f[k] for k in f}) and {k: repr(x) for k, x in f.items()} == {k: repr(x) for k, x in found[0].items()} for f in found)
    for k in range(7):
        assert found[0][k] == pytest.approx(math.fsum(x for i, x in rows if i == k), rel=2.3e-16)


def test_histograms(spark):
    from binforge.functions.binning import Binning
    from binforge.operators import fill

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.uniform(-1, 11), rng.uniform(0, 1) if i % 97 else math.nan, 0.1, 1.0, "OS", True) for i in range(2000)]
    events = spark.createDataFrame(rows, "process string, x double, weight double, w_mc double, scale double, region string, trigger boolean")
    bins = {("mc_data", "x"): Binning(0.0, 10.0, 5)}
    found = [sorted(map(tuple, fill.densify(fill.histogram(fill.fills(events.repartition(n), [], [], ["x"]), bins, exact_sums=True), bins).collect()), key=repr) for n in (1, 4, 64)]
    assert [list(map(repr, f)) for f in found] == [list(map(repr, found[0]))] * 3
    plain = sorted(map(tuple, fill.densify(fill.histogram(fill.fills(events, [], [], ["x"]), bins), bins).collect()), key=repr)
    assert len(plain) == len(found[0]) and all(a == pytest.approx(b, rel=1e-12, nan_ok=True) for x, y in zip(plain, found[0]) for a, b in zip(x[5:], y[5:]))
    nan = [r for r in found[0] if math.isnan(r[-2])]
    assert 0 < len(nan) <= len(found[0])
