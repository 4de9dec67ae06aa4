import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from binforge.plans.engine import HistogramEngine
from binforge.sources import catalog, config, histograms


def test_files(tmp_path):
    for name in ("s/job_1.parquet", "s/merged.parquet", "s/job_2.parquet", "t/a.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    found = catalog.scan_dirs(tmp_path, ("s", "missing"))
    assert [p.name for p in found] == ["job_1.parquet", "job_2.parquet", "merged.parquet"]
    assert [p.name for p in catalog.prefer_merged(found)] == ["merged.parquet"]
    assert len(catalog.resolve_files(tmp_path, ("s/job_1.parquet", "s/job_1.parquet"))) == 1
    assert catalog.format_of([]) == "unknown" and catalog.format_of([tmp_path / "t/a.csv"]) == "csv"
    with pytest.raises(ValueError):
        catalog.format_of([tmp_path / "t/a.csv", *found])
    assert catalog.format_path(tmp_path / "t/a.csv", tmp_path) == "t/a.csv" and catalog.format_path("/x/y", tmp_path) == "/x/y"
    with pytest.raises(ValueError):
        catalog.format_path("/x/y", tmp_path, "relative")


def test_config_defaults(tmp_path):
    (tmp_path / "files.json").write_text("{broken")
    c = config.load(tmp_path)
    assert c.samples == () and c.lumi == 1.0 and c.selection == {}


def _write(folder, spark):
    (folder / "cfg").mkdir()
    save = lambda name, x: (folder / "cfg" / name).write_text(json.dumps(x))
    a = [(30.0, 1.0, 1, 1, 0.5), (26.0, math.nan, 0, 1, 1.0), (10.0, 1.0, 1, 1, 1.0), (50.0, 2.0, 1, 0, 1.0)]
    spark.createDataFrame(a, "pt_1 double, eta_1 double, os int, trg_singlemuon int, weight double").write.parquet(str(folder / "a.parquet"))
    spark.createDataFrame([(40.0, 7), (90.0, 8)], "pt_1 double, `odd.name` int").write.parquet(str(folder / "d.parquet"))
    save("files.json", {"samples": {"A_x": {"files": ["a.parquet"], "scale": 2}, "D": {"kind": "data", "files": "d.parquet"}, "gone": {"files": ["no.parquet"]}}})
    save("process.json", {"sig": {"samples": ["A_x"], "color": "red"}, "data": ["D"]})
    save("params.yaml", {"A": {"xs": 2.0, "eff": 4.0, "filter_efficiency": 1.0}, "lumi": 10.0})
    save("variables.json", {"pt_1": {"x_min": 0, "x_max": 100, "bin_width": 50}})
    save("plotter.yaml", {"plotting": {"control": ["pt_1", "odd.name", "absent"], "resolution": [["pt_1", "eta_1"], "bad"]}, "plotter_runtime": {"xlim_resolution": 1}})
    save("selection.yaml", {"pt_1_min": 25, "iso_1_max": 0.1, "nonsense": 1})
    return config.load(folder / "cfg", root=folder)


def test_engine(spark, tmp_path):
    c = _write(tmp_path, spark)
    assert [s.name for s in c.samples] == ["A_x", "D", "gone"] and c.selection == {"pt_1_min": 25.0, "iso_1_max": 0.1}
    engine = HistogramEngine(spark, c)
    hist = engine.fill().cache()
    at = {(r["family"], r["var"], r["region"], r["process"], r["bin"]): r for r in hist.collect()}
    assert at["control", "pt_1", None, "sig", 0]["sumw"] == 4 and at["control", "pt_1", None, "sig", 1]["sumw"] == 2  # two and one rows, scale 2
    assert at["mc_data", "pt_1", "OS", "sig", 0]["sumw"] == 0.5 * 5 and at["mc_data", "pt_1", "SS", "sig", 0]["sumw"] == 5
    assert at["mc_data", "pt_1", "OS", "data", 1]["sumw"] == 1  # no os, trigger or weight column
    assert at["control", "odd.name", None, "data", 10]["count"] == 2
    assert not any(k[1] == "absent" for k in at)
    ratio = agreement_rows = engine.agreement(hist)
    assert agreement_rows.where("process = 'QCD'").count() == 0  # no data in SS
    assert engine.stack(hist.where("family = 'control'")).where("process = 'sig' and color = 'red'").count() > 0
    assert ratio.count() > 0
    path = str(tmp_path / "store")
    histograms.write(histograms.dense(hist.where("family = 'control'")), path)
    back = {(r["variable"], r["sample"], r["bin"]): r["count"] for r in histograms.long(histograms.read(spark, path)).collect()}
    assert back["pt_1", "sig", 0] == 4


def test_store_cleans(spark, tmp_path):
    df = spark.createDataFrame([("control", "v", "s", [1.0, math.nan], [0.0, 0.0], [0.0, 1.0, 2.0]), ("control", "v", "t", [], [], [0.0, 1.0, 2.0])], "plot_type string, variable string, sample string, counts array<double>, sumw2 array<double>, bin_edges array<double>")
    assert sorted((r["sample"], r["bin"], r["count"]) for r in histograms.long(df).collect()) == [("s", 0, 1.0), ("s", 1, 0.0), ("t", 0, 0.0), ("t", 1, 0.0)]


def test_listing_and_compaction(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "in/deep"))
    assert catalog.listing(spark, str(tmp_path / "in"), "*.parquet").count() == 3
    assert catalog.compact(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 10
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    with pytest.raises(Exception):
        catalog.compact(spark, str(tmp_path / "nothing"), str(tmp_path / "out2"))


def test_csv_projection(spark, tmp_path):
    (tmp_path / "a.csv").write_text("H.m,H.pt\n1,2\n3,x\n")
    df = catalog.read(spark, [tmp_path / "a.csv"], "csv")
    assert df.columns == ["H.m", "H.pt"] and df.select(F.col("`H.m`")).count() == 2


def test_convenience_readers(spark, tmp_path):
    c = _write(tmp_path, spark)
    assert catalog.select_file(spark, tmp_path / "a.parquet", {"pt_1_min": 25}).count() == 3
    both = catalog.read_processes(spark, c.samples, {p.name: p.samples for p in c.processes}, tmp_path)
    assert both.count() == 6 and both.where("process = 'data' and os is null").count() == 2
    assert {(r["kind"], r["sample"]) for r in catalog.inspect(spark, c.samples, tmp_path).collect()} == {("mc", "A_x"), ("data", "D")}
    assert [catalog.next_folder(tmp_path / "p").name for _ in range(2)] == ["Plots-0", "Plots-1"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import sys

    from binforge import __main__ as cli

    _write(tmp_path, spark)
    for args in (["fill", f"{tmp_path}/cfg", "--out", f"{tmp_path}/plots"], ["render", f"{tmp_path}/cfg", f"{tmp_path}/plots/Plots-0/histograms", "--out", f"{tmp_path}/plots"]):
        monkeypatch.setattr(sys, "argv", ["binforge", "--root", str(tmp_path), *args])
        cli.main()
    assert spark.read.parquet(f"{tmp_path}/plots/Plots-1/stacks").count() > 0
    assert spark.read.parquet(f"{tmp_path}/plots/Plots-0/agreement").count() > 0
    (tmp_path / "b/2022/mt/DYto2L").mkdir(parents=True)
    (tmp_path / "b/2022/mt/DYto2L/x.parquet").write_text("not empty, which a listing would leave out")
    monkeypatch.setattr(sys, "argv", ["binforge", "--root", str(tmp_path), "catalogue", f"{tmp_path}/b", "2022", "mt", "--out", f"{tmp_path}/cat"])
    cli.main()
    assert json.loads((tmp_path / "cat/files.json").read_text())["samples"]["DYto2L"]["files"] == ["b/2022/mt/DYto2L/x.parquet"]


def test_large_folders_are_compacted_to_several_files(spark, tmp_path):
    spark.range(3000).repartition(5).write.parquet(str(tmp_path / "in"))
    size = sum(p.stat().st_size for p in (tmp_path / "in").glob("*.parquet"))
    out = catalog.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_bytes=size // 3)
    assert sorted(r[0] for r in out.collect()) == list(range(3000)) and len(list((tmp_path / "out").glob("part-*"))) in (3, 4)


def test_csv_files_of_other_types_and_orders(spark, tmp_path):
    texts = {"a": "pt,H.m,note\n1,2,\n", "b": "pt,H.m,note\n12.5,3,\n", "c": "H.m,pt,note\n4,5,7\n", "d": "pt,new\n6.5,x\n", "e": "H.m,pt\nodd,8\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    read = lambda names: catalog.read(spark, [tmp_path / f"{n}.csv" for n in names], "csv")
    assert sorted((r["pt"], r["H.m"]) for r in read("ab").collect()) == [(1.0, 2), (12.5, 3)]
    df = read("abcd")
    assert df.columns == ["pt", "H.m", "note", "new"] and dict(df.dtypes)["note"] == "int"
    assert Counter(map(tuple, df.collect())) == Counter([(1.0, 2, None, None), (12.5, 3, None, None), (5.0, 4, 7, None), (6.5, None, None, "x")])
    assert sorted((r["pt"], r["H.m"]) for r in read("ae").collect()) == [(1, "2"), (8, "odd")]


def test_pairs_take_the_settings_of_the_reconstructed_column():
    own = {"phi_reco": {"type": "angle"}, "x_gen": {"type": "angle"}, "x_reco": {"relative_resolution": False}}
    found = config.pairs_of([["phi_gen", "phi_reco"], ["x_gen", "x_reco"], ["a"], "b"], own, "angle_only")
    assert [(p.name, p.angle, p.relative, p.wrap_all) for p in found] == [("phi_reco_vs_phi_gen", True, True, False), ("x_reco_vs_x_gen", False, False, False)]


def test_csv_files_can_stay_uncut(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pt_1,os\n10,1\n50,1\n")
    (tmp_path / "files.json").write_text(json.dumps({"A": {"files": ["a.csv"]}}))
    (tmp_path / "selection.yaml").write_text("pt_1_min: 25\n")
    for flag, n in (("true", 1), ("false", 2)):
        (tmp_path / "plotter.yaml").write_text(f"plotting: {{control: [pt_1]}}\nplotter_runtime: {{csv_apply_selection: {flag}}}\n")
        assert HistogramEngine(spark, config.load(tmp_path, root=tmp_path)).events().count() == n


def test_samples_of_any_store(spark, tmp_path):
    for name in ("s/job_1.parquet", "s/deep/job_2.parquet"):
        spark.range(3).toDF("pt_1").write.parquet(str(tmp_path / name))
    sample = config.Sample("A", dirs=("s", "no"))
    ((_, files, fmt),) = catalog.index((sample, config.Sample("gone", dirs=("no",))), f"file://{tmp_path}", spark)
    assert fmt == "parquet" and all(f.startswith("file:") for f in files) and catalog.read(spark, files, fmt).count() == 6


def test_the_last_stored_histogram_wins(spark, tmp_path):
    kinds = "plot_type string, variable string, sample string, counts array<double>, sumw2 array<double>, bin_edges array<double>"
    for i in range(3):
        spark.createDataFrame([("c", "x", "s", [float(i)], None, [0.0, 1.0])], kinds).coalesce(1).write.parquet(f"{tmp_path}/h{i}")
    assert histograms.read(spark, f"{tmp_path}/h*").first()["counts"] == [2.0]
