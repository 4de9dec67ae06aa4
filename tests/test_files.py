"""Files: compaction in order, heads that stop, and CSV files among which some are bad."""

import gzip
import logging
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from binforge.sources import catalog, compaction, csvs, heads
from binforge.sources.config import Sample


def written(out):
    return sorted(Path(out).rglob("part-*.parquet"), key=lambda p: (p.parent.name, p.name))


def test_packs():
    rng = random.Random(1)
    for _ in range(300):
        files = [(f"f{i:04d}", rng.choice((1, 5, 20, 90, 400)) * rng.randrange(1, 10)) for i in range(rng.randrange(1, 60))]
        size, target = dict(files), rng.choice((100, 500, 2000))
        made = compaction.packs(files, target)
        assert [p for own in made for p in own] == [p for p, _ in files]
        for own in made[:-1]:
            assert sum(size[p] for p in own) >= target // 2
        for own in made:  # above 2 x the target only by one large file
            assert sum(size[p] for p in own) <= 2 * target or max(size[p] for p in own) > target * 0.75


def test_compaction_keeps_the_order(spark, tmp_path, monkeypatch):
    for i in range(12):
        spark.range(i * 1000, i * 1000 + 1000, 1, 1).withColumn("x", F.rand(i)).coalesce(1).write.parquet(str(tmp_path / f"in/d{i:02d}"))
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.parquet"))
    for together in (256, 2):
        monkeypatch.setattr(compaction, "TOGETHER", together)
        out = tmp_path / f"out{together}"
        catalog.compact(spark, str(tmp_path / "in"), str(out), file_bytes=size // 4)
        files = written(out)
        assert len(files) == 4 and all(size / 8 < f.stat().st_size < size / 2 for f in files)
        ids = [r[0] for f in files for r in spark.read.parquet(str(f)).select("id", F.col("_metadata.row_index").alias("i")).orderBy("i").collect()]
        assert ids == list(range(12_000))


def test_compaction_has_no_exchange_and_cuts_large_files(spark, tmp_path):
    spark.range(20_000).withColumn("x", F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.range(20_000, 20_500).withColumn("more", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.parquet"))
    seen = []
    original = compaction.reduce
    compaction.reduce = lambda f, x: seen.append(original(f, x)) or seen[-1]
    try:
        out = catalog.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_bytes=size // 5)
    finally:
        compaction.reduce = original
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    files = written(tmp_path / "out")
    assert len(files) >= 3 and all(f.stat().st_size < 2 * size / 5 for f in files)
    assert sorted(r[0] for r in out.select("id").collect()) == list(range(20_500)) and out.where("more = 'x'").count() == 500
    with pytest.raises(FileNotFoundError):
        catalog.compact(spark, str(tmp_path / "out" / "none"), str(tmp_path / "out2")) if (tmp_path / "out" / "none").mkdir() is None else None


def rows_scanned(df) -> int:
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_heads(spark, tmp_path):
    for name, n in (("a", 40_000), ("b", 2), ("c", 30_000)):
        spark.range(n).select(F.col("id"), F.lit(name).alias("s"), *([F.lit(1).alias("only_b")] if name == "b" else [])).coalesce(1).write.parquet(str(tmp_path / name))
    spark.range(100, 105).select("id", F.lit("b").alias("s")).coalesce(1).write.parquet(str(tmp_path / "b2"))
    samples = (Sample("a", dirs=("a",)), Sample("b", dirs=("b", "b2")), Sample("gone", dirs=("none",)), Sample("c", dirs=("c",)))
    got = heads.head_of_samples(spark, samples, 4, str(tmp_path))
    assert sorted((r["sample"], r["id"], r["only_b"]) for r in got.collect() if r["sample"] != "b") == [(s, i, None) for s in "ac" for i in range(4)]
    assert [(r["id"], r["only_b"]) for r in got.where("sample = 'b'").collect()] == [(0, 1), (1, 1), (100, None), (101, None)]
    assert [(r["sample"], r["id"]) for r in heads.head(spark, samples, 5, str(tmp_path)).collect()] == [("a", i) for i in range(5)]
    heads_ = heads.head(spark, samples, 5, str(tmp_path), lambda df: df.where("id > 39990 or s = 'b'")).collect()
    assert [(r["sample"], r["id"]) for r in heads_] == [("a", i) for i in range(39_991, 39_996)]
    files = [str(next((tmp_path / x).glob("*.parquet"))) for x in "ac"]
    assert sorted((r["s"], r["id"]) for r in heads.head_of_files(spark, files, "parquet", 2).collect()) == [("a", 0), ("a", 1), ("c", 0), ("c", 1)]
    with pytest.raises(ValueError):
        heads.head(spark, (Sample("gone", dirs=("none",)),), 5, str(tmp_path))


def test_heads_stop_reading(spark, tmp_path, monkeypatch):
    """The scan of a head gives a batch of rows, not those of the file."""
    spark.range(300_000).coalesce(1).write.parquet(str(tmp_path / "big"))
    seen = []
    original = catalog.read
    monkeypatch.setattr(catalog, "read", lambda *a: seen.append(original(*a)) or seen[-1])
    limited = []

    def plan(df):
        class Spy:
            schema, columns = df.schema, df.columns

            def limit(self, n):
                limited.append(df.limit(n))
                return limited[-1]

        return Spy()

    got = heads.head_of_samples(spark, (Sample("big", dirs=("big",)),), 3, str(tmp_path), plan)
    assert got.count() == 3 and rows_scanned(limited[0]) <= 3 * 4096


def test_bad_csv_files(spark, tmp_path, caplog):
    (tmp_path / "a.csv").write_text("x,y,name\n1,0.5,a\n2,,b\n3\n")
    (tmp_path / "b.csv").write_text("﻿name,x\n\"q, r\",7000000000\n")
    (tmp_path / "c.csv").write_text("x,y,name\n1,2,3,4\n5,6,7\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n  \n")
    (tmp_path / "broken.csv.gz").write_bytes(gzip.compress(b"x,y\n" + b"1,2\n" * 5000)[:60])
    (tmp_path / "whole.csv.gz").write_bytes(gzip.compress(b"x\n") + gzip.compress(b"9\n"))
    (tmp_path / "only_header.csv").write_text("x,z\n")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    with caplog.at_level(logging.WARNING):
        good, bad = csvs.read_csv(spark, paths)
    assert dict(good.dtypes) == {"x": "bigint", "y": "double", "name": "string", "z": "string"}
    assert sorted((r["x"], r["y"], r["name"]) for r in good.fillna({"y": -1.0, "name": "none"}).collect()) == [(1, 0.5, "a"), (2, -1.0, "b"), (3, -1.0, "none"), (9, -1.0, "none"), (7_000_000_000, -1.0, "q, r")]
    reasons = {Path(r["path"]).name: r["reason"] for r in bad.collect()}
    assert set(reasons) == {"c.csv", "empty.csv", "blank.csv", "broken.csv.gz"} and "1 rows have more values" in reasons["c.csv"] and len(caplog.messages) == 4
    assert csvs.read_csv(spark, paths[:1], {"x": "double"})[0].dtypes == [("x", "double"), ("y", "string"), ("name", "string")]
    with pytest.raises(ValueError, match="no CSV file"):
        csvs.read_csv(spark, [str(tmp_path / "empty.csv")])


def test_csv_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(paths):
        group = f"csv{len(paths)}"
        spark.sparkContext.setJobGroup(group, "")
        csvs.read_csv(spark, paths)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    for i in range(30):
        (tmp_path / f"{i}.csv").write_text(f"x,y\n{i},1\n")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    assert jobs(paths) == jobs(paths[:3])
    assert csvs.read_csv(spark, paths)[0].count() == 30
    assert csvs.names_of('a,,"b ""c""",a\r') == ["a", "_c1", 'b "c"', "a3"]


def test_heads_of_files_sort_few_rows(spark, tmp_path):
    """Ties, nulls and NaN first or last as Spark orders them; rows above the bound don't reach the sort."""
    rows = spark.range(30_000).select(F.expr("case when id = 29000 then null when id % 5000 = 7 then double('nan') else cast((id * 7919) % 30011 as double) end").alias("x"), "id", (F.col("id") % 3).alias("k"))
    rows.repartition(1).write.partitionBy("k").parquet(str(tmp_path / "in"))
    rows.where("id < 2").select("x", "id", F.lit(9).alias("k")).coalesce(1).write.mode("append").partitionBy("k").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    got = catalog.head_of_files(df, ["x", "id"], 3)
    found = sorted((r["k"], r["id"]) for r in got.collect())
    order = lambda r: (r[0] is not None, (r[0] != r[0], 0 if r[0] != r[0] else r[0]) if r[0] is not None else 0, r[1])
    own = [tuple(r) for r in rows.collect()]
    assert found == sorted((k, r[1]) for k in range(3) for r in sorted((r for r in own if r[2] == k), key=order)[:3]) + [(9, 0), (9, 1)]
    bounded = plan(got)
    assert bounded.index("Sort [") < bounded.index("BroadcastHashJoin")  # the join with the bound is below the sort


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_compaction_sorts_small_files_only(spark, tmp_path, monkeypatch):
    """Files above the bound of a run are read as they are, in the order of their names and never sorted, small ones in runs."""
    sizes = [40_000, 10, 20, 30_000, 5, 50_000, 7, 8]
    start = 0
    for i, n in enumerate(sizes):
        spark.range(start, start + n, 1, 1).withColumn("x", F.rand(i)).coalesce(1).write.parquet(str(tmp_path / f"in/d{i}"))
        start += n
    monkeypatch.setattr(compaction, "RUN_BYTES", 20_000)
    seen = []
    original = compaction.reduce
    monkeypatch.setattr(compaction, "reduce", lambda f, x: seen.append(original(f, list(x))) or seen[-1])
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.parquet"))
    for how, n in (({"files": 2}, 2), ({"file_bytes": size}, 1), ({"files": 1}, 1)):
        out = tmp_path / f"out{len(seen)}"
        catalog.compact(spark, str(tmp_path / "in"), str(out), **how)
        text = plan(seen[-1])
        assert "Exchange" not in text and text.count("Sort [") == 2 and len(written(out)) == n
        ids = [r[0] for f in written(out) for r in spark.read.parquet(str(f)).select("id", F.col("_metadata.row_index").alias("i")).orderBy("i").collect()]
        assert ids == list(range(start))


def test_compaction_reads_a_large_file_in_pieces(spark, tmp_path):
    """A file of many row groups that is larger than a pack is written by several tasks, in order."""
    spark.range(0, 200_000, 1, 1).withColumn("x", F.rand(1)).write.option("parquet.block.size", 100_000).parquet(str(tmp_path / "in/a"))
    spark.range(200_000, 200_100, 1, 1).withColumn("x", F.rand(2)).write.parquet(str(tmp_path / "in/b"))
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.parquet"))
    catalog.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_bytes=size // 8)
    files = written(tmp_path / "out")
    assert len({f.name[:10] for f in files}) >= 4  # tasks, not only files of one task
    assert [r[0] for f in files for r in spark.read.parquet(str(f)).select("id", F.col("_metadata.row_index").alias("i")).orderBy("i").collect()] == list(range(200_100))
