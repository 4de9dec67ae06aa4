"""From a configuration to histograms: scan, normalise, union, fill."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions.binning import Binning, few, local, resolve
from binforge.functions.scalar import quoted
from binforge.operators import agreement, fill, lookups, ordering
from binforge.operators.selection import region, select, trigger
from binforge.sources import catalog
from binforge.sources.config import Config, Sample
from binforge.sources.progress import Progress
from binforge.sources.store import HistogramStore, plain_path


class NoFiles(ValueError):
    """There is nothing to read."""


class HistogramEngine:
    """One analysis. All histograms of all samples come from one pass over the events and one shuffle."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def samples(self) -> DataFrame:
        """The dimension table: sample, kind, scale, params_key, process and w_mc."""
        c = self.config
        rows = [(s.name, s.kind, s.scale, s.params_key) for s in c.samples]
        samples = local(self.spark, rows, "sample string, kind string, scale double, params_key string")
        params = local(self.spark, [(k, *(None if v.get(f) is None else float(v[f]) for f in ("xs", "eff", "filter_efficiency"))) for k, v in c.params.items()], "params_key string, xs double, eff double, filter_efficiency double")
        return lookups.with_process(lookups.with_weight(samples, params, c.lumi), lookups.bridge(self.processes()))

    def processes(self) -> DataFrame:
        rows = [(p.name, list(p.samples), p.color, p.label, i) for i, p in enumerate(self.config.processes)]
        return local(self.spark, rows, "process string, samples array<string>, color string, label string, draw_idx int")

    def normalised(self, df: DataFrame, sample: Sample, variables: list[str], cut: bool = True, files: bool = False, watch: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """One sample's events after its cuts, with every default filled in while its own columns are known; with ``files`` also ``_file``.

        After the union a missing column is null, and a null means a value that is missing from a row.
        """
        names = df.columns
        df = watch(select(df, self.config.selection) if cut else df)
        columns = [F.lit(sample.name).alias("sample"), region(names).alias("region"), trigger(names).alias("trigger")]
        columns.append((quoted("weight").cast("double") if "weight" in names else F.lit(1.0)).alias("weight"))
        columns += ["_file"] if files else []
        return df.select(*columns, *[(quoted(v).cast("double") if v in names else F.lit(None).cast("double")).alias(v) for v in variables])

    def events(self, files: bool = False, without: frozenset[str] = frozenset(), progress: Progress | None = None) -> DataFrame:
        """All samples' events with their sample's columns; with ``files`` also ``_file``, and of files other than ``without``."""
        c = self.config
        listed = [(s, [f for f in own if plain_path(str(f)) not in without], fmt) for s, own, fmt in catalog.index(c.samples, c.root, self.spark)]
        found = [(s, catalog.read(self.spark, own, fmt, files), fmt == "parquet" or c.csv_apply_selection) for s, own, fmt in listed if own]
        if not found:
            raise NoFiles("no sample has files")
        there = set().union(*(df.columns for _, df, _ in found))
        self.control = [v for v in c.control if v in there] or sorted(there)[:2]  # something to look at if nothing configured is there
        self.pairs = [p for p in c.pairs if p.truth in there and p.reco in there]
        extra = [c.asymmetry.column, *c.asymmetry.weights] if c.asymmetry and c.asymmetry.column in there else []
        names = list(dict.fromkeys([*self.control, *(x for p in self.pairs for x in (p.truth, p.reco)), *(x for x in extra if x in there)]))
        number = {s.name: len(own) for s, own, _ in listed}
        watch = lambda s: partial(progress.watch, sample=s.name, files=number[s.name]) if progress else lambda df: df
        events = reduce(DataFrame.unionByName, [self.normalised(df, s, names, cut, files, watch(s)) for s, df, cut in found])
        dim = few(self.samples().select(F.col("sample").alias("_s"), "process", "kind", "scale", "w_mc"))
        return events.join(dim, F.col("sample") == F.col("_s")).drop("_s")

    def binnings(self) -> dict[tuple[str, str], Binning]:
        c, run = self.config, self.config.runtime
        out = {}
        for v in self.control:
            out["control", v] = out["mc_data", v] = resolve(v, c.variables, xlim=run.get("xlim_control"), bins=int(run.get("bins", 20)))
        for p in self.pairs:
            out["resolution", p.name] = resolve(p.truth, c.variables, resolution=True, xlim=run.get("xlim_resolution"), bins=int(run.get("bins", 20)), bin_width=run.get("bin_width_resolution"))
        return out

    def fill(self, progress: Progress | None = None) -> DataFrame:
        """The dense histograms of all families, with kind; ``exact_sums`` of the runtime settings makes sums independent of order."""
        events = self.events(progress=progress)
        rows = fill.fills(events, self.control, self.pairs, self.control)
        hist = fill.densify(fill.histogram(rows, self.binnings(), bool(self.config.runtime.get("exact_sums"))), self.binnings())
        return agreement.with_kind(hist, agreement.kinds_of(self.samples()))

    def store(self, path: str) -> HistogramStore:
        """The store of this analysis at ``path``: one filled with other cuts, variables or weights is refused. Samples may be added."""
        c = self.config
        return HistogramStore(self.spark, path, repr((c.selection, c.variables, c.params, c.lumi, c.control, c.pairs, sorted(c.runtime.items(), key=str), c.csv_apply_selection)))

    def update(self, store: HistogramStore) -> int:
        """Fill those files of all samples that ``store`` doesn't have yet; how many. Others are not read."""
        known = frozenset(plain_path(r["path"]) for r in store.files().select("path").collect())
        try:
            events = self.events(files=True, without=known)
        except NoFiles:
            return 0
        binnings = self.binnings()
        return store.add(events, lambda df: fill.partial(fill.fills(df, self.control, self.pairs, self.control), binnings))

    def stored(self, store: HistogramStore) -> DataFrame:
        """The dense histograms of all files of ``store``: what ``fill`` makes of them in one pass, with exact sums."""
        self.events()  # which variables there are
        return agreement.with_kind(fill.densify(store.histogram(), self.binnings()), agreement.kinds_of(self.samples()))

    def agreement(self, hist: DataFrame) -> DataFrame:
        return agreement.with_qcd(hist.where("family = 'mc_data'"), self.config.fake_factor, self.config.qcd)

    def stack(self, hist: DataFrame) -> DataFrame:
        """Stack bottoms and tops with colours, labels and draw order."""
        own = self.samples().select("process").distinct().withColumn("position", F.lit(0))  # not from the histogram, which would be filled twice
        order = ordering.ordered(own, [p.name for p in self.config.processes]).drop("position")
        return ordering.styled(ordering.stacked(hist.join(few(order), "process")), self.processes())

    def asymmetry_histogram(self) -> DataFrame:
        """bin, even and odd of the configured asymmetry; a weight that no sample has counts as 1."""
        a = self.config.asymmetry
        events = self.events()
        if a.column not in events.columns:
            raise ValueError(f"no sample has {a.column}")
        even, odd = (quoted(w) if w in events.columns else F.lit(1.0) for w in a.weights)
        return fill.filled(events, a.column, Binning(*a.range, a.bins), {"even": even, "odd": odd}, bool(self.config.runtime.get("exact_sums")))
