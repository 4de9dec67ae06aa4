"""Queries over files: what the engine, its configuration and the catalogue make of tables written as samples."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions import binning
from binforge.functions.binning import Binning, local
from binforge.operators import agreement, fill, ordering, selection
from binforge.plans import virtual as v
from binforge.plans.engine import HistogramEngine
from binforge.plans.queries import _regions, _scratch, query
from binforge.sources import catalog, config
from binforge.sources.progress import Progress
from binforge.sources.config import Asymmetry, Config, Process, Sample

BARE = "AFRICA"  # the sample whose files have no region, triggers or weight
_SAMPLES = {"AFRICA": ("mc", 0.5), "AMERICA": ("mc", 1.5), "ASIA": ("data", 1.0), "EUROPE": ("mc", 2.0), "MIDDLE EAST": ("mc", 1.0)}
_XS = {"AFRICA": (2.0, 100.0, 0.5), "EUROPE": (3.0, 40.0, 1.0)}
_LUMI = 10.0
_BINS = {"pt_1": (20, 120, 2.5), "mt_tot": (0, 200, 5)}


def _write_samples(spark: SparkSession, sf_dir: str) -> str:
    """A folder a region, one of them without some columns; returns the root."""
    root = _scratch(spark, "samples")
    names = ["pt_1", "pt_2", "eta_1", "eta_2", "iso_1", "mt_tot", "os", "trg_singlemuon", "trg_mt_cross", "weight"]
    e = v.events(spark, sf_dir).select("process", *names)
    e.where(F.col("process") != BARE).write.partitionBy("process").parquet(f"{root}/full")
    e.where(F.col("process") == BARE).select(*names[:6]).write.parquet(f"{root}/bare")
    return root


def _engine(spark: SparkSession, sf_dir: str, **more) -> HistogramEngine:
    samples = tuple(Sample(k, kind, scale, dirs=("bare" if k == BARE else f"full/process={k}",)) for k, (kind, scale) in _SAMPLES.items())
    samples += (Sample("gone", dirs=("no such folder",)),)
    params = {k: dict(zip(("xs", "eff", "filter_efficiency"), x)) for k, x in _XS.items()}
    variables = {k: dict(zip(("x_min", "x_max", "bin_width"), x)) for k, x in _BINS.items()}
    processes = (Process("first", ("EUROPE", "AFRICA")), Process("data", ("ASIA",)))
    settings = {"control": ("pt_1", "mt_tot", "nothing"), "pairs": (fill.Pair("pt_2", "pt_1"), fill.Pair("pt_2", "nothing")), "selection": v.CUTS, "runtime": {"xlim_resolution": 1, "bins": 20}} | more
    return HistogramEngine(spark, Config(samples, processes, params, _LUMI, variables, root=_write_samples(spark, sf_dir), **settings))


_PROCESS = "CASE process WHEN 'EUROPE' THEN 'first' WHEN 'AFRICA' THEN 'first' WHEN 'ASIA' THEN 'data' ELSE 'unknown' END"
_CASE = lambda x: "CASE process " + " ".join(f"WHEN '{k}' THEN {v.number(y)}" for k, y in x.items()) + f" ELSE {v.number(1)} END"
_ENGINE_SQL = f"""{v.EVENTS_SQL}, {v.bins_sql({k: Binning.of_width(*x) for k, x in _BINS.items()} | {'pt_1_vs_pt_2': v.RES})},
own AS (
  SELECT {_PROCESS} AS process, pt_1, pt_2, mt_tot, {_CASE({k: s for k, (_, s) in _SAMPLES.items()})} AS scale, {_CASE({k: x * _LUMI * f / e for k, (x, e, f) in _XS.items()})} AS w_mc,
    CASE WHEN process = '{BARE}' OR os = 1 THEN 'OS' ELSE 'SS' END AS region, process = '{BARE}' OR trg_singlemuon = 1 OR trg_mt_cross = 1 AS fired, CASE WHEN process = '{BARE}' THEN 1 ELSE weight END AS weight
  FROM ev WHERE {v.CUTS_SQL}
), v AS (
  SELECT 'control' AS family, var, CAST(NULL AS VARCHAR) AS region, process, x, scale AS w, scale * scale AS w2 FROM (SELECT *, unnest(['pt_1', 'mt_tot']) AS var, unnest([pt_1, mt_tot]) AS x FROM own)
  UNION ALL SELECT 'resolution', 'pt_1_vs_pt_2', NULL, process, (pt_1 - pt_2) / pt_2, scale, scale * scale FROM own WHERE pt_2 <> 0
  UNION ALL SELECT 'mc_data', var, region, process, x, weight * w_mc, weight * w_mc * w_mc FROM (SELECT *, unnest(['pt_1', 'mt_tot']) AS var, unnest([pt_1, mt_tot]) AS x FROM own) WHERE fired
), p AS (SELECT DISTINCT family, var, region, process FROM v),
f AS (SELECT family, v.var, region, process, bin, count(*) AS n, sum(w) AS sumw, sum(w2) AS sumw2 FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL),
h AS (
  SELECT p.*, b.bin, b.lo, b.hi, coalesce(n, 0) AS n, coalesce(sumw, 0) AS sumw, coalesce(sumw2, 0) AS sumw2, CASE WHEN p.process = 'data' THEN 'data' ELSE 'mc' END AS kind
  FROM p JOIN bins b ON b.var = p.var LEFT JOIN f ON f.family = p.family AND f.var = p.var AND f.region IS NOT DISTINCT FROM p.region AND f.process = p.process AND f.bin = b.bin
)"""


@query(f"WITH {_ENGINE_SQL} SELECT family, var, region, process, kind, bin, n AS count, round(sumw, 6) AS sumw, round(sumw2, 6) AS sumw2 FROM h")
def engine_fill(spark, sf_dir):
    """All families of one configuration, from files: index, needed columns, defaults, union, fills."""
    hist = _engine(spark, sf_dir).fill()
    return hist.select("family", "var", "region", "process", "kind", "bin", "count", F.round("sumw", 6).alias("sumw"), F.round("sumw2", 6).alias("sumw2"))


@query(f"WITH {_ENGINE_SQL} SELECT family, var, region, process, kind, bin, n AS count, round(sumw, 6) AS sumw, round(sumw2, 6) AS sumw2 FROM h")
def engine_update(spark, sf_dir):
    """The same from a store that got its files in three steps: some samples, all of them, and once more the same."""
    whole = _engine(spark, sf_dir)
    some = HistogramEngine(spark, replace(whole.config, samples=tuple(s for s in whole.config.samples if s.name not in ("EUROPE", BARE))))
    store = whole.store(_scratch(spark, "store"))
    for engine in (some, whole, whole):
        engine.update(store)
    hist = whole.stored(store)
    return hist.select("family", "var", "region", "process", "kind", "bin", "count", F.round("sumw", 6).alias("sumw"), F.round("sumw2", 6).alias("sumw2"))


@query(f"WITH {v.EVENTS_SQL} SELECT process AS sample, 'done' AS event, count(*) AS rows, (count(*) + 131071) // 131072 AS batches FROM ev WHERE {v.CUTS_SQL} GROUP BY process UNION ALL SELECT DISTINCT process, 'start', 0, 0 FROM ev")
def sample_progress(spark, sf_dir):
    """What one fill of all samples has read of each, from the metrics of its plan."""
    engine, progress = _engine(spark, sf_dir), Progress(spark)
    progress.run(engine.fill(progress).write.format("noop").mode("overwrite").save)
    return progress.events().where("event <> 'progress'").select("sample", "event", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "batches")])


@query(f"""WITH {_ENGINE_SQL}, q AS (SELECT var, bin, lo, hi, sum(CASE WHEN kind = 'data' THEN sumw ELSE -sumw END) AS ss FROM h WHERE family = 'mc_data' AND region = 'SS' GROUP BY ALL),
o AS (SELECT var, bin, sum(CASE WHEN kind = 'data' THEN sumw ELSE 0 END) AS data, sum(CASE WHEN kind = 'mc' THEN sumw ELSE 0 END) AS mc FROM h WHERE family = 'mc_data' AND region = 'OS' GROUP BY ALL)
SELECT o.var, o.bin, round(data, 6) + 0.0 AS data, round(mc + {v.number(0.25)} * ss, 6) + 0.0 AS mc FROM o JOIN q USING (var, bin)""")
def engine_agreement(spark, sf_dir):
    """Data against simulation with the configured factor for QCD."""
    engine = _engine(spark, sf_dir, fake_factor=0.25)
    return agreement.data_mc(engine.agreement(engine.fill())).select("var", "bin", (F.round("data", 6) + 0.0).alias("data"), (F.round("mc", 6) + 0.0).alias("mc"))


@query(f"""WITH {_ENGINE_SQL}, s AS (SELECT h.*, CASE process WHEN 'first' THEN 0 WHEN 'data' THEN 1 ELSE 2 END AS draw_idx FROM h WHERE family = 'control')
SELECT var, bin, process, draw_idx, CASE process WHEN 'data' THEN 'black' ELSE '#999999' END AS color, process AS label, round(sum(sumw) OVER (PARTITION BY var, bin ORDER BY draw_idx), 6) AS top FROM s""")
def engine_stack(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    s = engine.stack(engine.fill().where("family = 'control'"))
    return s.select("var", "bin", "process", F.col("draw_idx").cast("long").alias("draw_idx"), "color", "label", F.round("top", 6).alias("top"))


@query(f"""WITH {v.EVENTS_SQL}, {v.bins_sql({'m': Binning(0, 200, 8)})}, v AS (SELECT 'm' AS var, mt_tot AS x, CASE WHEN process <> '{BARE}' THEN weight END AS w FROM ev WHERE {v.CUTS_SQL})
SELECT bin, round(sum(w), 6) AS even, CAST(count(*) AS DOUBLE) AS odd FROM v JOIN bins b ON {v.IN_BIN} GROUP BY bin""")
def engine_asymmetry(spark, sf_dir):
    engine = _engine(spark, sf_dir, asymmetry=Asymmetry("mt_tot", 8, (0.0, 200.0), ("weight_even", None)), pairs=(), control=("pt_1",))
    events = engine.events
    # The weight is one of the event's own columns, under another name.
    engine.events = lambda: events().withColumn("weight_even", F.when(F.col("sample") != BARE, F.col("weight")))
    return engine.asymmetry_histogram().select("bin", F.round("even", 6).alias("even"), "odd")


@query(f"""WITH {v.EVENTS_SQL}, own AS (SELECT *, process = '{BARE}' AS bare FROM ev WHERE {v.CUTS_SQL})
SELECT unnest(['control', 'control', 'pairs', 'cut on', 'cut on', 'cut on', 'cut on', 'cut on', 'kept', 'kept', 'kept', 'kept']) AS what, unnest(['pt_1', 'mt_tot', 'pt_1_vs_pt_2', 'pt_1', 'pt_2', 'eta_1', 'eta_2', 'iso_1', 'region', 'trigger', 'weight', 'w_mc']) AS "column",
  unnest([count(pt_1), count(mt_tot), count(*) FILTER (WHERE pt_2 <> 0), 0, 0, 0, 0, 0, count(*), count(*) FILTER (WHERE bare OR trg_singlemuon = 1 OR trg_mt_cross = 1), count(*) FILTER (WHERE bare OR weight IS NOT NULL), count(*)]) AS n FROM own""")
def needed_columns(spark, sf_dir):
    """Configured variables that exist in any sample, pairs with both members, columns cut on, and how many events have a value of each."""
    engine = _engine(spark, sf_dir)
    events = engine.events()
    counts = {("control", c): F.count(c) for c in engine.control} | {("pairs", p.name): F.count(fill.resolution(p)) for p in engine.pairs}
    counts |= {("cut on", c): F.lit(0) for c in selection.columns_used(v.CUTS)} | {("kept", "trigger"): F.count_if("trigger"), **{("kept", c): F.count(c) for c in ("region", "weight", "w_mc")}}
    row = F.array(*[F.struct(F.lit(what).alias("what"), F.lit(c).alias("column"), n.cast("long").alias("n")) for (what, c), n in counts.items()])
    return events.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("SELECT r_name AS sample, 'parquet' AS format, count(*) AS events FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def sample_index(spark, sf_dir):
    """Each sample with files, their format, and the events in them."""
    engine = _engine(spark, sf_dir)
    found = catalog.index(engine.config.samples, engine.config.root, spark)
    rows = [catalog.read(spark, files, fmt).select(F.lit(s.name).alias("sample"), F.lit(fmt).alias("format")) for s, files, fmt in found]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("sample", "format").agg(F.count(F.lit(1)).alias("events"))


@query(f"""WITH {v.EVENTS_SQL}, n AS (SELECT process, count(*) AS n FROM ev WHERE process IN ('{BARE}', 'ASIA') GROUP BY 1), c AS (SELECT unnest(['eta_1', 'eta_2', 'iso_1', 'mt_tot', 'pt_1', 'pt_2']) AS "column", 'double' AS type),
d AS (SELECT * FROM c UNION ALL SELECT 'weight', 'double' UNION ALL SELECT unnest(['os', 'trg_singlemuon', 'trg_mt_cross']), 'int')
SELECT 'mc' AS kind, process AS sample, "column", type, n FROM n, c WHERE process = '{BARE}' UNION ALL SELECT 'data', process, "column", type, n FROM n, d WHERE process = 'ASIA'""")
def schema_inspect(spark, sf_dir):
    """Columns and types of the first simulated and the first data sample, and how many values its files have."""
    c = _engine(spark, sf_dir).config
    found = catalog.inspect(spark, c.samples, c.root)
    own = [catalog.read(spark, files, fmt).select(F.lit(s.name).alias("_sample"), F.explode(F.array(*[F.struct(F.lit(x).alias("_column"), F.col(x).isNotNull().alias("there")) for x in catalog.schema_names(spark, files, fmt)])).alias("v")) for s, files, fmt in catalog.index(c.samples, c.root, spark)]
    counts = reduce(DataFrame.union, own).select("_sample", "v.*").groupBy("_sample", "_column").agg(F.count_if("there").alias("n"))
    return found.join(counts, (F.col("sample") == F.col("_sample")) & (F.col("column") == F.col("_column"))).select("kind", "sample", "column", "type", "n")


@query(f"SELECT CASE WHEN r_name = 'ASIA' THEN 'data' ELSE 'first' END AS process, r_name AS sample, count(*) AS events, CASE WHEN r_name = '{BARE}' THEN 0 ELSE count(*) END AS weighted FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY r_name")
def read_all_processes(spark, sf_dir):
    c = _engine(spark, sf_dir).config
    df = catalog.read_processes(spark, c.samples, {p.name: p.samples for p in c.processes}, c.root)
    return df.groupBy("process", "sample").agg(F.count(F.lit(1)).alias("events"), F.count("weight").alias("weighted"))


#: Rows of one CSV file, about.
CSV_ROWS = 4_000_000


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = _scratch(spark, "rows")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query(f"WITH {v.EVENTS_SQL} SELECT count(*) AS events, round(sum(pt_1), 2) AS total FROM ev WHERE process = '{BARE}' AND pt_1 > 25 AND eta_1 < 1 AND eta_1 > -1")
def select_single_file(spark, sf_dir):
    """A CSV file read and cut by itself, one after another of those a sample has; a cut on a column that it lacks is left out."""
    path = _scratch(spark, "one")
    rows = v.events(spark, sf_dir).where(F.col("process") == BARE).select("pt_1", "eta_1")
    # The joins stay in as many tasks as they take; what they give is gathered into files of some size.
    rows = _stored(spark, rows)
    rows.coalesce(-(-rows.count() // CSV_ROWS) or 1).write.option("header", True).csv(path)
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect()]
    found = reduce(DataFrame.union, [catalog.select_file(spark, f, {"pt_1_min": 25, "eta_1_abs_max": 1, "pt_2_min": 99}) for f in files])
    return found.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("pt_1"), 2).alias("total"))


# ---- configuration, on the driver, from dimension tables of a fixed size


_RESOLVED = "SELECT p_brand AS brand, min(p_size) AS lo, max(p_size) AS hi, min(p_partkey) % 4 AS kind FROM part GROUP BY p_brand HAVING max(p_size) > min(p_size)"


@query(f"""WITH b AS ({_RESOLVED})
SELECT brand AS var, round(CASE kind WHEN 2 THEN -CAST(hi AS DOUBLE) WHEN 3 THEN -100 ELSE lo END, 6) AS lo, round(CASE kind WHEN 3 THEN 100 ELSE CAST(hi AS DOUBLE) END, 6) AS hi, CAST(CASE kind WHEN 0 THEN trunc((hi - lo) / 2.5) WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 20 END AS INTEGER) AS n FROM b
UNION ALL SELECT 'res ' || brand, CASE kind WHEN 1 THEN lo WHEN 2 THEN -CAST(hi AS DOUBLE) ELSE -1 END, CASE kind WHEN 1 THEN hi WHEN 2 THEN CAST(hi AS DOUBLE) ELSE 1 END, CASE kind WHEN 1 THEN CAST(trunc((hi - lo) / 0.5) AS INTEGER) WHEN 2 THEN CAST(trunc(2 * hi / 0.5) AS INTEGER) ELSE 20 END FROM b""")
def binning_resolution(spark, sf_dir):
    """The binning of a variable: configured with a width or without, from limits, and by default; and of its resolution."""
    found = v.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), (F.min("p_partkey") % 4).alias("kind")).where("hi > lo").collect()
    own = {}
    for r in found:
        edges = {"x_min": r["lo"], "x_max": r["hi"]}
        own |= {0: {r["p_brand"]: edges | {"bin_width": 2.5}}, 1: {r["p_brand"]: edges, f"res_{r['p_brand']}": edges | {"bin_width": 0.5}}}.get(r["kind"], {})
    limits = lambda r: {"xlim": r["hi"]} if r["kind"] == 2 else {}
    rows = [(r["p_brand"], binning.resolve(r["p_brand"], own, **limits(r), bins=10 if r["kind"] == 2 else 20)) for r in found]
    rows += [(f"res {r['p_brand']}", binning.resolve(r["p_brand"], own, resolution=True, **limits(r), bin_width=0.5 if r["kind"] == 2 else None)) for r in found]
    return local(spark, [(k, float(b.lo), float(b.hi), b.n) for k, b in rows], "var string, lo double, hi double, n int")


def _folder(spark: SparkSession, name: str) -> Path | None:
    """A folder for small files that the driver itself writes, if it can."""
    at = urlparse(_scratch(spark, name))
    return Path(unquote(at.path)) if at.scheme in ("", "file") else None


@query("""SELECT n_name AS sample, CASE WHEN n_nationkey % 5 = 0 THEN 'data' ELSE 'mc' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN 0.5 * n_nationkey ELSE 1.0 END AS scale, r_name AS process, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.25 END AS xs,
  (SELECT 10.0 * count(*) FROM region) AS lumi, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_nationkey < 3) AS control, 'none' AS broken FROM nation JOIN region ON n_regionkey = r_regionkey""")
def config_folder(spark, sf_dir):
    """A configuration made of nations and regions, written and loaded; files that the folder lacks come from the fallback, broken ones give defaults."""
    own, other = _folder(spark, "config"), _folder(spark, "fallback")
    if own is None:
        raise ValueError("configurations are small local files; spark.checkpoint.dir is in another store")
    nations = v.table(spark, sf_dir, "nation").join(v.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_name").collect()
    regions = sorted({r["r_name"] for r in nations})
    config.save_json({"samples": {r["n_name"]: ({"kind": "data"} if r["n_nationkey"] % 5 == 0 else {}) | ({"scale": 0.5 * r["n_nationkey"]} if r["n_nationkey"] % 3 == 0 else {}) for r in nations}}, own / "files.json")
    config.save_json({x: {"samples": [r["n_name"] for r in nations if r["r_name"] == x]} for x in regions}, other / "process.json")
    (own / "params.yaml").write_text(f"lumi: {10.0 * v.table(spark, sf_dir, 'region').count()}\n" + "".join(f"{r['n_name']}: {{xs: {r['n_nationkey'] + 0.25}}}\n" for r in nations if r["n_nationkey"] % 2 == 0))
    (own / "plotter.yaml").write_text(f"plotting:\n  control: [{', '.join(r['n_name'] for r in nations if r['n_nationkey'] < 3)}]\n")
    (own / "broken.json").write_text("{")
    c = config.load(own, other)
    process = {s: p.name for p in c.processes for s in p.samples}
    broken = str(config.load_json(own / "broken.json", "none"))
    rows = [(s.name, s.kind, float(s.scale), process[s.name], c.params.get(s.name, {}).get("xs"), float(c.lumi), ",".join(sorted(c.control)), broken) for s in c.samples]
    return local(spark, rows, "sample string, kind string, scale double, process string, xs double, lumi double, control string, broken string")


@query("""SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN n_name || '/x.parquet' WHEN 1 THEN '/else/' || n_name || '/x.parquet' WHEN 2 THEN '/base/' || n_name || '/x.parquet' ELSE n_name || '/x.parquet' END AS shown FROM nation""")
def path_formats(spark, sf_dir):
    """Paths of nations below a base folder or not, as automatic, absolute or relative ones."""
    kinds = [("/base", "auto"), ("/else", "auto"), ("/base", "absolute"), ("/base", "relative")]
    nations = v.table(spark, sf_dir, "nation").collect()
    return local(spark, [(r["n_name"], catalog.format_path(f"{kinds[r['n_nationkey'] % 4][0]}/{r['n_name']}/x.parquet", "/base", kinds[r["n_nationkey"] % 4][1])) for r in nations], "name string, shown string")


@query("SELECT r_name AS region, 'Plots-' || (row_number() OVER (ORDER BY r_name) - 1) AS folder FROM region")
def output_folders(spark, sf_dir):
    """A new folder for each region."""
    parent = _folder(spark, "plots")
    if parent is None:
        raise ValueError("output folders are numbered on a local disk; spark.checkpoint.dir is in another store")
    return local(spark, [(r["r_name"], catalog.next_folder(parent).name) for r in v.table(spark, sf_dir, "region").orderBy("r_name").collect()], "region string, folder string")


# ---- the rest


@query(f"WITH {v.EVENTS_SQL} SELECT process, count(*) AS events, count(*) FILTER (WHERE mt_tot > 100) AS high FROM ev WHERE {v.CUTS_SQL} GROUP BY process")
def selector_closure(spark, sf_dir):
    """A selection as a function for ``transform``, chained with one of the user's own."""
    own = lambda df: df.withColumn("high", F.col("mt_tot") > 100)
    e = v.events(spark, sf_dir).transform(selection.selector(v.CUTS)).transform(own)
    return e.groupBy("process").agg(F.count(F.lit(1)).alias("events"), F.count_if("high").alias("high"))


@query("SELECT r_name AS process, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'AFRICA' THEN 1 ELSE 2 END, r_name) - 1 AS draw_idx FROM region WHERE r_name <> 'ASIA'")
def draw_order_without_data(spark, sf_dir):
    rows = ordering.without_data(_regions(spark, sf_dir).withColumn("kind", F.when(F.col("process") == "ASIA", "data").otherwise("mc")))
    return ordering.ordered(rows, ["Europe", "Asia", "africa"]).select("process", F.col("draw_idx").cast("long").alias("draw_idx"))


@query("SELECT n_name AS sample, CASE n_name WHEN 'FRANCE' THEN 'tab:red' ELSE 'tab:blue' END AS color FROM nation")
def sample_colours(spark, sf_dir):
    samples = v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample"))
    return ordering.sample_coloured(samples, local(spark, [("FRANCE", "tab:red"), ("JAPAN", None)], "sample string, color string"))


def _difference(name: str, pair: fill.Pair, x: str) -> None:
    def run(spark, sf_dir):
        e = v.phases(spark, sf_dir).withColumn("process", F.col("event_type")).withColumn("scale", F.lit(1.0))
        hist = fill.histogram(fill.fills(e, [], [pair]), {("resolution", pair.name): v.ANGLE})
        return hist.where("bin is not null").select("process", "bin", "count")

    run.__name__ = name
    query(f"""WITH {v.PHASES_SQL}, {v.bins_sql({'r': v.ANGLE})}, d AS (SELECT event_type, phi_1 - phi_2 AS d, phi_1 - phi_2 + {v.number(math.pi)} AS s FROM ph WHERE phi_2 <> 0),
v AS (SELECT 'r' AS var, event_type AS process, {x} AS x FROM d) SELECT process, bin, count(*) AS count FROM v JOIN bins b ON {v.IN_BIN} GROUP BY ALL""")(run)


_difference("resolution_difference", fill.Pair("phi_2", "phi_1", relative=False), f"s - {v.number(2 * math.pi)} * floor(s / {v.number(2 * math.pi)}) - {v.number(math.pi)}")
_difference("resolution_unwrapped", fill.Pair("phi_2", "phi_1", relative=False, wrap_all=False), "d")
