"""Command line: fill histograms from a configuration, render tables from stored ones, make catalogues, compact files."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from binforge.operators import ordering
from binforge.plans.engine import HistogramEngine
from binforge.sources import catalog, config, histograms


def fill(spark: SparkSession, args: argparse.Namespace) -> None:
    engine = HistogramEngine(spark, config.load(args.config, root=args.root))
    hist = engine.fill().cache()  # a few thousand rows
    out = catalog.next_folder(args.out)
    histograms.write(histograms.dense(hist.where("family <> 'mc_data'")), f"{out}/histograms")
    agreed = engine.agreement(hist).cache()
    from binforge.operators.agreement import data_mc, normalisation

    data_mc(agreed).write.parquet(f"{out}/agreement")
    engine.stack(hist.where("family = 'control'")).write.parquet(f"{out}/stacks")
    if engine.config.asymmetry:
        from binforge.operators.fill import asymmetry

        even_odd = engine.asymmetry_histogram().cache()
        even_odd.write.parquet(f"{out}/asymmetry")
        asymmetry(even_odd).show()
    normalisation(agreed, engine.config.lumi).show()
    print(out)


def render(spark: SparkSession, args: argparse.Namespace) -> None:
    """Stacks from stored histograms; processes that the configuration doesn't list come last."""
    c = config.load(args.config, root=args.root)
    rows = histograms.long(histograms.read(spark, args.store)).withColumnRenamed("sample", "process").withColumnRenamed("variable", "var")
    order = ordering.ordered(rows.groupBy("process").count().selectExpr("process", "0 as position"), [p.name for p in c.processes]).drop("position")
    ordering.stacked(rows.join(order, "process"), "count").write.parquet(str(catalog.next_folder(args.out) / "stacks"))


def catalogue(spark: SparkSession, args: argparse.Namespace) -> None:
    files = catalog.listing(spark, args.base).select("path")
    from pyspark.sql import functions as F

    found = catalog.sample_catalogue(files.select(F.regexp_replace("path", "^file:/*", "/").alias("path")), args.base, args.year, args.channel).cache()
    samples = {r["sample"]: {"kind": "data" if r["sample"].startswith("Muon") else "mc", "files": [catalog.format_path(f, args.root, args.path_mode) for f in r["files"]]} for r in found.collect()}
    config.save_json({"samples": samples}, Path(args.out) / "files.json")
    config.save_json({r["process"]: {"samples": r["samples"], "color": r["color"]} for r in catalog.process_map(found).collect()}, Path(args.out) / "process.json")


def main() -> None:
    p = argparse.ArgumentParser(prog="binforge", description=__doc__)
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(required=True)
    for name, run, options in (
        ("fill", fill, (("config",), ("--out", "plots"))), ("render", render, (("config",), ("store",), ("--out", "plots"))),
        ("catalogue", catalogue, (("base",), ("year",), ("channel",), ("--path-mode", "auto"), ("--out", "."))), ("compact", lambda s, a: catalog.compact(s, a.folder, a.out), (("folder",), ("out",))),
        ("inspect", lambda s, a: catalog.inspect(s, config.load(a.config, root=a.root).samples, a.root).show(1000, False), (("config",),)),
    ):
        own = sub.add_parser(name)
        own.set_defaults(run=run)
        for option in options:
            own.add_argument(option[0], **({"default": option[1]} if len(option) > 1 else {}))
    args = p.parse_args()
    args.run(SparkSession.builder.appName("binforge").getOrCreate(), args)


if __name__ == "__main__":
    main()
