"""Joins that are no plain equi-joins: substrings and intervals."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from binforge.functions import binning
from binforge.operators import lookups

PROCESSES = "process string, samples array<string>, color string, draw_idx int"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def first_match(name, processes):
    if name is not None:
        for process, samples, color, _ in sorted(processes, key=lambda p: p[3]):
            if any(s is not None and s in name for s in samples or []):
                return process or "unknown", color or "white"
    return "unknown", "white"


@pytest.mark.parametrize("how", [{"literal": 1000}, {"literal": 0}, {"told": 0}], ids=["literal", "automaton", "joined"])
@pytest.mark.parametrize("empty", [False, True])
def test_substrings(spark, how, empty):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abÉ_") for _ in range(n))
    processes = [(f"p{i}", [word(rng.randrange(1, 9)) for _ in range(3)] + [None], None if i % 4 == 0 else f"c{i}", 200 - 2 * i) for i in range(20)] + [("none", None, "c", 501), (None, ["zzz"], "d", 3)]
    if empty:
        processes.append(("any", ["", "zz"], "e", 191))
    names = [(word(rng.randrange(0, 14)), i % 3) for i in range(200)] + [(None, 1), ("", 1), ("xzzzx", 1), ("plain", 2)]
    names += names[:20]
    df = spark.createDataFrame(names, "name string, k int").repartition(3)
    got = lookups.by_substring(df, spark.createDataFrame(processes, PROCESSES), **how)
    assert got.columns == ["name", "k", "process", "color"]
    assert Counter(map(tuple, got.collect())) == Counter((n, k, *first_match(n, processes)) for n, k in names)


def test_hundred_thousand_patterns(spark):
    listed = spark.range(100_000).selectExpr("concat('p', id % 9) as process", "array(concat('<', id, '>')) as samples", "cast(null as string) as color", "cast(id as int) as draw_idx")
    names = spark.range(5000).selectExpr("id", "concat('a<', id * 41, '> and <', id, '>') as name")
    got = lookups.by_substring(names, listed)
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Exchange" not in plan and "CartesianProduct" not in plan
    rows = got.collect()
    assert len(rows) == 5000 and all(r["process"] == f"p{r['id'] % 9}" for r in rows)
    joined = lookups.by_substring(names, listed, told=0)
    assert "NestedLoop" not in plan_of(joined) and Counter(map(tuple, joined.collect())) == Counter(map(tuple, rows))


def test_no_patterns(spark):
    names, none = spark.createDataFrame([("a",), (None,)], "name string"), spark.createDataFrame([], PROCESSES)
    for how in ({}, {"literal": -1}, {"told": -1}):
        assert Counter(map(tuple, lookups.by_substring(names, none, **how).collect())) == Counter([("a", "unknown", "white"), (None, "unknown", "white")])


BINS = "var string, bin int, lo double, hi double, last boolean"


def brute_bins(values, bins):
    return Counter((var, x, b) for var, x in values for bv, b, lo, hi, last in bins if x is not None and not math.isnan(x) and var == bv and lo <= x and (x < hi or (last and x == hi)))


@pytest.mark.parametrize("small", [True, False])
def test_intervals(spark, small, monkeypatch):
    """Equal, unequal, overlapping and infinite bins, and values at every edge and next to it."""
    if not small:
        monkeypatch.setattr(binning, "FEW", 3)
    inf = math.inf
    edges = {"equal": [i * 0.1 for i in range(30)], "log": [2.0**i for i in range(-20, 21)], "odd": [-1000.0, -3.0, -2.999, 0.0, 1e-9, 1.0, 1e6, 1e12], "open": [-inf, 0.0, 1.0, inf]}
    bins = [(k, i, a, b, i == len(e) - 2) for k, e in edges.items() for i, (a, b) in enumerate(zip(e, e[1:]))]
    bins += [("over", 0, 0.0, 10.0, False), ("over", 1, 5.0, 6.0, True), ("over", 2, 0.0, 1000.0, False), ("over", 3, 7.0, 7.0, True), ("over", 4, 9.0, 8.0, True)]
    values = [(k, x) for k, e in edges.items() for y in e if math.isfinite(y) for x in (y, math.nextafter(y, inf), math.nextafter(y, -inf))]
    values += [("over", float(x)) for x in range(-1, 12)] + [(k, x) for k in edges for x in (None, math.nan, inf, -inf, 1e300, -1e300)] + [("none", 1.0), ("over", 5.0)]
    got = binning.range_joined(spark.createDataFrame(values, "var string, x double"), spark.createDataFrame(bins, BINS))
    assert Counter(map(tuple, got.select("var", "x", "bin").collect())) == brute_bins(values, bins)


def test_few_bins_are_compared(spark):
    """Whatever the number of bins of a variable, a value is compared with three at most where they are disjoint."""
    rng = random.Random(2)
    cuts = sorted({rng.random() ** 8 * 1e6 for _ in range(3000)})
    bins = [("x", i, a, b, False) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    equal = [("y", i, float(i), float(i + 1), False) for i in range(2000)]
    values = spark.range(2000).selectExpr("'y' as var", "id * 0.999 as x").union(spark.createDataFrame([("x", rng.random() ** 8 * 1e6) for _ in range(2000)], "var string, x double"))
    compared = binning.range_candidates(values, spark.createDataFrame(bins + equal, BINS)).groupBy("var").count().collect()
    assert {r["var"]: r["count"] / 2000 for r in compared}["y"] <= 2 and {r["var"]: r["count"] / 2000 for r in compared}["x"] <= 3
    assert "NestedLoop" not in plan_of(binning.range_joined(values, spark.createDataFrame(bins, BINS)))


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("how", [{"told": 0}, {"told": 0, "keys": 0}], ids=["keys", "pieces"])
def test_long_and_short_patterns(spark, how, empty):
    """Patterns of 1 to 40 characters, longer than a key or not, that share pieces, with NUL and four-byte characters."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\0😀") for _ in range(n))
    whole = [word(60) for _ in range(30)]
    cut = lambda t, n: t[(i := rng.randrange(len(t) - n)) : i + n]
    listed = [cut(rng.choice(whole), rng.choice((5, 7, 8, 9, 12, 15, 16, 17, 20, 40))) for _ in range(150)] + ["a" * 16 + "b" * i for i in range(5)] + ([""] if empty else [])
    processes = [(f"p{i}", [t], f"c{i % 7}", 1000 - i if t else 900) for i, t in enumerate(listed)]
    names = [(t,) for t in whole] + [(word(rng.randrange(30)),) for _ in range(200)] + [("a" * 16 + "bb",), (None,), ("",), (whole[0],)]
    df = spark.createDataFrame(names, "name string").repartition(3)
    got = lookups.by_substring(df, spark.createDataFrame(processes, PROCESSES), **how).collect()
    assert Counter(map(tuple, got)) == Counter((n, *first_match(n, processes)) for n, in names)


def test_names_are_sent_once_where_patterns_are_joined(spark):
    """Pieces of names stay in their tasks: no row is exploded for them, and names are sent to the patterns once at most."""
    listed = spark.range(50_000).selectExpr("concat('p', id % 9) as process", "array(cast(id * 10 + 7 as string)) as samples", "cast(null as string) as color", "cast(id as int) as draw_idx")
    names = spark.range(2000).selectExpr("concat(id * 7919, '_', id) as name")
    plan = plan_of(lookups.by_substring(names, listed, told=0).groupBy("process").count())
    assert "Generate" not in plan and plan.count("Range (") == 1


def test_more_patterns_than_are_told_take_no_exchange_of_pieces(spark, monkeypatch):
    """What decides between ways is the size of the patterns once each, not of the rows that list them."""
    seen = []
    original = lookups._by_key
    monkeypatch.setattr(lookups, "_by_key", lambda *a: seen.append(original(*a)) or seen[-1])
    listed = spark.range(6000).selectExpr("concat('p', id % 3) as process", "array(concat('<', id % 100, '>')) as samples", "'c' as color", "cast(id as int) as draw_idx")
    names = spark.range(500).selectExpr("concat('a<', id, '>') as name")
    few_ = lookups.by_substring(names, listed, literal=0, told=20_000).collect()
    assert not seen
    many = lookups.by_substring(names, listed, literal=0, told=5000)
    assert len(seen) == 1 and "Generate" not in plan_of(many) and Counter(map(tuple, many.collect())) == Counter(map(tuple, few_))


@pytest.mark.parametrize("long", [False, True])
def test_names_stay_where_they_are(spark, long, monkeypatch):
    """With no broadcast by Spark, no name is sent to the patterns; with too many styles to tell the result is the same."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    listed = spark.range(5000).selectExpr("if(id % 5 = 0, null, concat('p', id % 9)) as process", f"array(concat('<', id, '>'{", if(id % 2 = 0, ' a longer one than a key', '')" if long else ""})) as samples", "if(id % 7 = 0, null, 'c') as color", "cast(9000 - id as int) as draw_idx")
    names = spark.range(0, 12000, 1, 4).selectExpr("if(id = 7, null, concat('a<', id % 6000, '> a longer one than a key<', id, '>')) as name", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookups.by_substring(names, listed, told=0)
        assert long or "Exchange" not in plan_of(got) and "Join" not in plan_of(got)
        rows = Counter(map(tuple, got.collect()))
        monkeypatch.setattr(lookups, "TOLD_STYLES", 0)
        joined = lookups.by_substring(names, listed, told=0)
        assert "Join" in plan_of(joined) and Counter(map(tuple, joined.collect())) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert rows == Counter(map(tuple, lookups.by_substring(names, listed).collect()))
