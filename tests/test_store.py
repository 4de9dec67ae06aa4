"""Stored partial histograms: a file counts once, whatever happens to the batches it comes in."""

import random

import pytest
from pyspark.sql import functions as F

from binforge.functions.binning import Binning
from binforge.operators import fill
from binforge.sources.store import HistogramStore, file_of
from binforge.streaming.fill import store_stream

BINS = {("control", "x"): Binning(0.0, 10.0, 5)}
SCHEMA = "process string, x double, scale double"


def plan(df):
    return fill.partial(fill.fills(df, ["x"]), BINS)


def write(spark, folder, seed, parts):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.uniform(-1, 11), rng.uniform(0, 1)) for _ in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(folder)


def events(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder).select("*", file_of())


def rows(df):
    return sorted(map(repr, df.collect()))


def batch(spark, folder):
    return rows(fill.histogram(fill.fills(spark.read.schema(SCHEMA).parquet(folder), ["x"]), BINS, exact_sums=True))


@pytest.fixture
def folder(spark, tmp_path):
    write(spark, str(tmp_path / "in"), 1, 5)
    return str(tmp_path / "in")


def test_stream_is_stopped_and_started_anew(spark, folder, tmp_path):
    store = HistogramStore(spark, str(tmp_path / "store"))
    run = lambda at: store_stream(spark, folder, events(spark, folder).drop("_file").schema, store, plan, checkpoint=str(tmp_path / at), files_per_trigger=2).awaitTermination()
    run("a")
    assert rows(store.histogram()) == batch(spark, folder) and store.files().count() == 5
    write(spark, folder, 2, 3)
    run("a")
    assert rows(store.histogram()) == batch(spark, folder) and store.files().count() == 8
    run("lost")  # all files come again, in other batches
    assert rows(store.histogram()) == batch(spark, folder) and store.files().count() == 8


def test_batches_come_twice_and_are_cut_short(spark, folder, tmp_path):
    store = HistogramStore(spark, str(tmp_path / "store"))
    assert rows(store.histogram()) == [] and store.files().count() == 0
    assert store.add(events(spark, folder), plan) == 5 and store.add(events(spark, folder), plan) == 0
    want = batch(spark, folder)
    assert rows(store.histogram()) == want
    write(spark, folder, 3, 4)
    with pytest.raises(RuntimeError):
        own, store._write = store._write, lambda *a: (_ for _ in ()).throw(RuntimeError())
        store.add(events(spark, folder), plan)
    store._write = own
    # A part whose files were never listed doesn't count, and is replaced or deleted.
    plan(events(spark, folder)).write.parquet(str(tmp_path / "store" / "parts" / "part=unfinished"))
    assert rows(store.histogram()) == want
    assert store.add(events(spark, folder), plan) == 4 and rows(store.histogram()) == batch(spark, folder)
    assert store.vacuum() == ["parts/part=unfinished"]


def test_only_new_files_are_filled(spark, folder, tmp_path):
    store, filled = HistogramStore(spark, str(tmp_path / "store")), []

    def counted(df):
        filled.append(df.select("_file.path").distinct().count())
        return plan(df)

    store.add(events(spark, folder), counted)
    write(spark, folder, 4, 2)
    store.add(events(spark, folder), counted)
    assert filled == [5, 2]


def test_compaction(spark, folder, tmp_path):
    store = HistogramStore(spark, str(tmp_path / "store"))
    for seed in (5, 6):
        store.add(events(spark, folder), plan)
        write(spark, folder, seed, 2)
    store.add(events(spark, folder), plan)
    want = rows(store.histogram())
    store.compact()
    assert rows(store.histogram()) == want == batch(spark, folder)
    assert len(store.vacuum()) == 6 and rows(store.histogram()) == want and store.files().count() == 9
    store.compact()
    assert store.vacuum() == [] and store.add(events(spark, folder), plan) == 0
    write(spark, folder, 7, 1)
    assert store.add(events(spark, folder), plan) == 1 and rows(store.histogram()) == batch(spark, folder)
    store.compact()
    assert rows(store.histogram()) == batch(spark, folder)


def test_changed_files_and_setups_are_errors(spark, folder, tmp_path):
    store = HistogramStore(spark, str(tmp_path / "store"), "one")
    store.add(events(spark, folder), plan)
    with pytest.raises(ValueError, match="setup"):
        HistogramStore(spark, str(tmp_path / "store"), "two").add(events(spark, folder), plan)
    later = events(spark, folder).withColumn("_file", F.col("_file").withField("length", F.col("_file.length") + 1))
    with pytest.raises(ValueError, match="has changed"):
        store.add(later, plan)
