"""Progress of samples, and that an engine reads its files once."""

import json
import time

import pytest
from pyspark.sql import functions as F

from binforge.plans.engine import HistogramEngine
from binforge.sources import config, histograms
from binforge.sources.progress import Progress


@pytest.fixture
def engine(spark, tmp_path):
    for name, n in (("a", 1000), ("b", 300)):
        spark.range(n).select((F.col("id") * 0.1).alias("pt_1"), F.lit(1).alias("os")).repartition(3).write.parquet(str(tmp_path / name))
    (tmp_path / "cfg").mkdir()
    save = lambda name, x: (tmp_path / "cfg" / name).write_text(json.dumps(x))
    save("files.json", {"samples": {"A": {"dirs": ["a"]}, "B": {"kind": "data", "dirs": ["b"]}}})
    save("process.json", {"sig": {"samples": ["A"], "color": "red"}, "data": ["B"]})
    save("variables.json", {"pt_1": {"x_min": 0, "x_max": 100, "bin_width": 10}})
    save("plotter.yaml", {"plotting": {"control": ["pt_1"]}})
    save("selection.yaml", {"pt_1_min": 25})
    return HistogramEngine(spark, config.load(tmp_path / "cfg", root=tmp_path))


def test_events_of_a_run(spark, engine):
    heard = []
    progress = Progress(spark, interval_s=0.05, on_event=heard.append)
    hist = engine.fill(progress)
    rows = progress.run(hist.collect)
    assert len(rows) > 0
    events = progress.events().collect()
    assert [(e["sample"], e["files"]) for e in events if e["event"] == "start"] == [("A", 3), ("B", 3)]
    assert [(e["sample"], e["rows"], e["batches"]) for e in events if e["event"] == "done"] == [("A", 749, 1), ("B", 49, 1)]
    assert all(e["elapsed_s"] >= 0 for e in events) and len(heard) == len(events) and len({e["run"] for e in events}) == 1
    plan = hist._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(pt_1,25.0)" in plan  # cuts still reach the scan


def test_failures_and_progress_are_noted(spark):
    progress = Progress(spark, interval_s=0.02)
    with pytest.raises(RuntimeError):
        progress.run(lambda: time.sleep(0.2) or (_ for _ in ()).throw(RuntimeError()))
    kinds = [e["event"] for e in progress.events().collect()]
    assert kinds[-1] == "failed" and "progress" in kinds


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().toString().count("parquet")


def test_a_stack_reads_events_once(engine):
    hist = engine.fill()
    assert scans(engine.stack(hist)) == scans(hist) == 2
    got = {(r["process"], r["bin"]): (r["bottom"], r["top"], r["color"]) for r in engine.stack(hist.where("family = 'control'")).collect()}
    assert got["sig", 5] == (0.0, 100.0, "red") and got["data", 2][2] == "black"


def test_update_opens_only_new_files(spark, engine, tmp_path):
    store = engine.store(str(tmp_path / "store"))
    assert engine.update(store) == 6 and engine.update(store) == 0
    spark.range(5).select((F.col("id") * 10.0).alias("pt_1"), F.lit(1).alias("os")).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    opened = []
    original = engine.events
    engine.events = lambda **more: opened.append(original(**more)) or opened[-1]
    assert engine.update(store) == 1 and len(opened[-1].inputFiles()) == 1
    del engine.events
    want = sorted(map(repr, engine.fill().drop("sumw", "sumw2").collect()))
    assert sorted(map(repr, engine.stored(store).drop("sumw", "sumw2").collect())) == want


def test_broken_histogram_files_are_left_out(spark, tmp_path):
    row = [("control", "v", "s", [1.0, 2.0], [0.0, 0.0], [0.0, 1.0, 2.0])]
    histograms.write(spark.createDataFrame(row, histograms.SCHEMA).coalesce(1), str(tmp_path / "store"))
    (tmp_path / "store" / "part-broken +1.parquet").write_bytes(b"PAR1 no such thing")
    assert [tuple(r) for r in histograms.read(spark, str(tmp_path / "store")).collect()] == row
    assert [r["path"].rpartition("/")[2] for r in histograms.left_out(spark, str(tmp_path / "store")).collect()] == ["part-broken +1.parquet"]
