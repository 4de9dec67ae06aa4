"""Joins of samples, processes and variables: small dimension tables against facts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binforge.functions.binning import few
from binforge.functions.scalar import after_first, mc_weight, params_key
from binforge.sources.scratch import folder

UNKNOWN = "unknown"


def bridge(processes: DataFrame) -> DataFrame:
    """sample and process from process, samples (array) and draw_idx; a sample listed twice goes to the last process."""
    rows = processes.select("process", "draw_idx", F.posexplode("samples").alias("_pos", "sample"))
    return rows.groupBy("sample").agg(F.max_by("process", F.struct("draw_idx", "_pos")).alias("process"))


def with_process(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    b = few(bridge.select(F.col("sample").alias("_s"), F.col("process").alias("_p")))
    return rows.join(b, F.col("sample") == F.col("_s"), "left").withColumn("process", F.coalesce("_p", F.lit(UNKNOWN))).drop("_s", "_p")


def with_weight(samples: DataFrame, params: DataFrame, lumi: float) -> DataFrame:
    """w_mc of each sample by its params_key or its name's prefix; 1 for data and for samples without params."""
    p = few(params.select(F.col("params_key").alias("_k"), "xs", "eff", "filter_efficiency"))
    key = params_key(F.col("sample"), F.col("params_key") if "params_key" in samples.columns else None)
    rows = samples.withColumn("_key", key).join(p, F.col("_key") == F.col("_k"), "left")
    weight = mc_weight(*[F.when(F.col("_k").isNotNull(), F.coalesce(c, F.lit(1.0))) for c in ("xs", "eff", "filter_efficiency")], lumi)
    return rows.withColumn("w_mc", F.when(F.col("kind") == "data", 1.0).otherwise(weight)).drop("_key", "_k", "xs", "eff", "filter_efficiency")


#: Patterns up to which they are written into the expression itself, bytes up to which they are told to all tasks, and
#: patterns up to which their keys and ranks alone are, with the different pairs of process and color up to so many bytes.
LITERAL_PATTERNS = 64
TOLD_BYTES = 64 << 20
TOLD_KEYS = 6_000_000
TOLD_STYLES = 16 << 20
#: Bytes of a pattern's key, and characters of the piece that names are joined on where there are too many keys to tell.
KEY = 16
PIECE = 8


def _listed(processes: DataFrame) -> DataFrame:
    return processes.select("process", "color", "draw_idx", F.posexplode("samples").alias("_i", "pattern")).where(F.col("pattern").isNotNull())


def _patterns(processes: DataFrame) -> DataFrame:
    """pattern, rank (from 0, by draw_idx and place in the list), process and color; each pattern once, at its first rank."""
    first = _listed(processes).groupBy("pattern").agg(F.min(F.struct("draw_idx", "_i", "process", "color")).alias("f"))
    return first.select("pattern", F.struct("f.draw_idx", "f._i").alias("rank"), "f.process", "f.color")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matcher(patterns: list[tuple[str, str | None, str | None]]):
    """A function from names to the process and color of the first of ``patterns`` (in order) that each contains."""
    import ahocorasick

    automaton, first, last = ahocorasick.Automaton(ahocorasick.STORE_INTS), len(patterns), len(patterns)
    for rank, (pattern, _, _) in enumerate(patterns):
        if pattern:
            automaton.add_word(pattern, rank)
        else:
            first = min(first, rank)  # the empty pattern is in every name
    automaton.make_automaton()
    filled = len(automaton) > 0
    styles = pa.array([(p, c) for _, p, c in patterns] + [(UNKNOWN, "white")], pa.struct([("process", pa.string()), ("color", pa.string())]))

    def match(names: pa.Array) -> pa.Array:
        found = []
        for name in names.to_pylist():
            ranks = (rank for _, rank in automaton.iter(name)) if name and filled else ()
            found.append(last if name is None else min((first, *ranks)))
        return styles.take(pa.array(found, pa.int64()))

    return match


_MATCHERS: dict[str, object] = {}


def by_substring(names: DataFrame, processes: DataFrame, name: str = "name", literal: int = LITERAL_PATTERNS, told: int = TOLD_BYTES, keys: int = TOLD_KEYS) -> DataFrame:
    """``names`` with process and color of the first listed sample that the name contains, else unknown and white.

    First is by draw_idx and then by place in ``samples``. Rows stay as they are, repeated ones too; a null name contains
    nothing, a null pattern is in no name, the empty one in all. How patterns and names meet depends on their number:

    * a few stand in the expression;
    * more, up to ``told`` bytes, are an automaton in each Python worker that reads a name once whatever their number;
    * beyond that, up to ``keys`` patterns, tasks are told each pattern's key and place in the order: itself, or the rarest
      of its pieces of ``KEY`` bytes if it is longer. A name looks its own pieces up, and ``contains`` decides about longer
      patterns, for names that may have one. Tasks are told the process and color of each place, too, so names are not sent;
      only with more different ones than ``TOLD_STYLES`` bytes are they joined by place, and names sent without their text;
    * beyond that both sides are joined by key: a pattern by the rarest of its pieces of ``PIECE`` characters, a name by all
      of its of the lengths that occur, and ``contains`` decides.
    """
    spark = names.sparkSession
    patterns = _patterns(processes)
    bytes_of = F.coalesce(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("process"), F.lit(0)) + 80), F.lit(0))
    if _listed(processes).agg(bytes_of).first()[0] > told:
        patterns = _stored(patterns.orderBy("rank").withColumn("at", F.monotonically_increasing_id()), "patterns")  # ascends with the rank
        count, size = patterns.agg(F.count(F.lit(1)), bytes_of).first()
        if size > told:
            return _by_key(names, patterns, name) if count <= keys else _by_piece(names, patterns, name)
    unknown = F.struct(F.lit(UNKNOWN).alias("process"), F.lit("white").alias("color"))
    rows = [(r["pattern"], r["process"], r["color"]) for r in patterns.orderBy("rank").collect()]
    if len(rows) <= literal:
        style = lambda p, c: F.struct(F.lit(p).cast("string").alias("process"), F.lit(c).cast("string").alias("color"))
        found = unknown
        for pattern, process, color in reversed(rows):
            found = F.when(F.contains(F.col(name), F.lit(pattern)), style(process, color)).otherwise(found)
    else:
        one, known = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def match(x: pa.Array) -> pa.Array:
            if known not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[known] = _matcher(one.value)
            return _MATCHERS[known](x)

        found = F.arrow_udf(match, "struct<process: string, color: string>")(F.col(name))
    out = names.withColumn("_f", found)
    return out.select(*names.columns, F.coalesce("_f.process", F.lit(UNKNOWN)).alias("process"), F.coalesce("_f.color", F.lit("white")).alias("color"))


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Pieces:
    """All pieces of the texts that lie after each other in ``data``, by where they begin."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(2 * KEY, np.uint8)))
        self.eight = np.ndarray(len(data) + KEY, "<u8", self.data, strides=(1,)).copy()

    def slots(self, size: int, bits: int) -> np.ndarray:
        """A number of ``bits`` for the piece of ``size`` bytes at each place."""
        n = len(self.data) - 2 * KEY
        if size <= 8:
            code = self.eight[:n] & np.uint64((1 << 8 * size) - 1)
        else:
            code = self.eight[:n] * _SPREAD ^ self.eight[size - 8 : n + size - 8]
        code = (code ^ (code >> np.uint64(32))) * _SPREAD
        return (code ^ np.uint64(size) * (_SPREAD << np.uint64(1))) >> np.uint64(64 - bits)

    def exact(self, size: int, at: np.ndarray) -> np.ndarray:
        """The pieces at some places, as what can be compared and sorted."""
        if size <= 8:
            return self.eight[at] & np.uint64((1 << 8 * size) - 1)
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(size)]).view(f"S{size}").ravel()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, and where each begins, and the end."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary())
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[begin[0] : begin[-1]], begin - begin[0]


def _told(keyed: pa.Table) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Size, whether they are whole patterns, sorted keys and their places in the order, for keys of each size."""
    data, begin = _bytes(keyed["key"])
    place, whole, size = keyed["at"].to_numpy(), keyed["whole"].to_numpy(), np.diff(begin)
    out, pieces = [], _Pieces(data)
    for z, w in sorted({(int(z), bool(w)) for z, w in np.unique(np.stack((size, whole)), axis=1).T}):
        own = np.flatnonzero((size == z) & (whole == w))
        keys = pieces.exact(z, begin[own]) if z else np.zeros(len(own), np.uint64)
        order = np.lexsort((place[own], keys))
        out.append((z, w, keys[order], place[own][order]))
    return out


def _finder(told: list[tuple[int, bool, np.ndarray, np.ndarray]]):
    """A function from names to the first place of a key that is a pattern (sure), and those before it of keys of longer patterns (maybe)."""
    last, count = np.iinfo(np.int64).max, sum(len(k) for _, _, k, _ in told)
    bits = min(25, max(10, (16 * count).bit_length()))
    known = np.zeros(1 << bits, bool)
    for z, _, keys, _ in told:
        if z:
            flat = keys.view(np.uint8) if z <= 8 else keys.astype(f"S{z}").view(np.uint8)
            known[_Pieces(flat).slots(z, bits)[:: 8 if z <= 8 else z]] = True
    empty = min((int(p[0]) for z, _, _, p in told if z == 0), default=last)

    def find(names: pa.Array) -> pa.Array:
        data, begin = _bytes(names)
        of = np.repeat(np.arange(len(names)), np.diff(begin))
        left, pieces = begin[1:][of] - np.arange(len(data)), _Pieces(data)
        sure, more = np.full(len(names), empty), []
        for z, whole, keys, place in told:
            if not z:
                continue
            at = np.flatnonzero(known[pieces.slots(z, bits)] & (left >= z))
            own = pieces.exact(z, at)
            first, end = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            if whole:
                fine = np.flatnonzero(end > first)
                np.minimum.at(sure, of[at[fine]], place[first[fine]])
            else:
                n = end - first
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                more.append(np.stack((np.repeat(of[at], n), place[np.repeat(first, n) + step])))
        pairs = np.unique(np.concatenate(more, axis=1), axis=1) if more else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[1] < sure[pairs[0]]]
        ends = np.searchsorted(pairs[0], np.arange(len(names) + 1)).astype(np.int32)
        none = names.is_null().to_numpy(zero_copy_only=False) | (sure == last)
        return pa.StructArray.from_arrays([pa.array(sure, mask=none), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[1]))], ["sure", "maybe"])

    return find


def _styles(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple[str | None, str | None]]] | None:
    """Places in ascending order, the number of the style of each, and the styles; nothing if the styles are too large."""
    styles = patterns.select("process", "color").distinct()
    size = F.sum(F.coalesce(F.octet_length("process"), F.lit(0)) + F.coalesce(F.octet_length("color"), F.lit(0)) + 40)
    if (styles.agg(size).first()[0] or 0) > TOLD_STYLES:
        return None
    rows = [tuple(r) for r in styles.collect()]
    numbers = patterns.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], "_process string, _color string, _number int")
    same = F.col("process").eqNullSafe(F.col("_process")) & F.col("color").eqNullSafe(F.col("_color"))
    found = patterns.join(F.broadcast(numbers), same).select("at", "_number").toArrow()
    at, number = found["at"].to_numpy(), found["_number"].to_numpy()
    order = np.argsort(at)
    return at[order], number[order], rows


def _styler(at: np.ndarray, number: np.ndarray, rows: list[tuple[str | None, str | None]]):
    """A function from places, or nulls, to process and color."""
    none = np.iinfo(np.int64).max
    at, number = np.append(at, none), np.append(number, len(rows))
    styles = pa.array([*rows, (UNKNOWN, "white")], pa.struct([("process", pa.string()), ("color", pa.string())]))

    def style(places: pa.Array) -> pa.Array:
        return styles.take(pa.array(number[np.searchsorted(at, places.fill_null(none).to_numpy(zero_copy_only=False))]))

    return style


def _by_key(names: DataFrame, patterns: DataFrame, name: str) -> DataFrame:
    spark = names.sparkSession
    text = F.col("pattern").cast("binary")
    keyed = patterns.select("at", text.alias("key"), F.lit(True).alias("whole")).where(F.length("key") <= KEY)
    long = patterns.select("at", text.alias("_text")).where(F.length("_text") > KEY)
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text") - KEY + 1), lambda i: F.substring("_text", i, F.lit(KEY))))
    pieces = long.select("at", F.explode(own).alias("key"))
    often = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(often, "key").groupBy("at").agg(F.min(F.struct("_n", "key")).alias("_k")).select("at", "_k.key", F.lit(False).alias("whole"))
    told = _told(keyed.union(rarest).toArrow())
    one, known, styled = spark.sparkContext.broadcast((told, _styles(patterns))), uuid.uuid4().hex, "struct<process: string, color: string>"

    def made(which: int):
        if known not in _MATCHERS:
            _MATCHERS.clear()
            keys, styles = one.value
            _MATCHERS[known] = _finder(keys), _styler(*styles) if styles else None
        return _MATCHERS[known][which]

    find = F.arrow_udf(lambda x: made(0)(x), "struct<sure: bigint, maybe: array<bigint>>")
    style, whole = F.col("_f"), all(whole for _, whole, _, _ in told)
    if whole and one.value[1]:
        rows = names.withColumn("_f", F.arrow_udf(lambda x: made(1)(made(0)(x).field("sure")), styled)(F.col(name)))
        return rows.select(*names.columns, F.coalesce(style["process"], F.lit(UNKNOWN)).alias("process"), F.coalesce(style["color"], F.lit("white")).alias("color"))
    rows = names.withColumn("_p", find(F.col(name))).withColumn("_at", F.col("_p.sure"))
    if not whole:
        asked = names.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).withColumn("_to", F.explode(find(F.col("_name"))["maybe"]))
        found = asked.join(patterns.select("at", "pattern"), F.col("_to") == F.col("at")).where(F.contains("_name", "pattern"))
        found = _stored(found.groupBy("_name").agg(F.min("_to").alias("_other")), "found")
        rows = rows.join(found, F.col(name) == F.col("_name"), "left").withColumn("_at", F.least("_at", "_other"))
    if one.value[1]:
        rows = rows.withColumn("_f", F.arrow_udf(lambda x: made(1)(x), styled)("_at"))
    else:
        # Names without a pattern get places of their own, so that they don't meet in one task.
        rows = rows.select(*names.columns, F.coalesce("_at", -1 - F.pmod(F.xxhash64(F.lit(1), *[F.col(name)]), F.lit(1 << 40))).alias("_at"))
        rows = rows.join(patterns.select(F.col("at").alias("_place"), F.struct("process", "color").alias("_f")), F.col("_at") == F.col("_place"), "left")
    return rows.select(*names.columns, F.coalesce(style["process"], F.lit(UNKNOWN)).alias("process"), F.coalesce(style["color"], F.lit("white")).alias("color"))


def _pieces(text: Column, size: Column) -> Column:
    """All pieces of ``size`` characters of a text that has so many, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, size)))


def _by_piece(names: DataFrame, patterns: DataFrame, name: str) -> DataFrame:
    patterns = patterns.withColumn("_size", F.least(F.char_length("pattern"), F.lit(PIECE)))
    pieces = patterns.where("_size > 0").withColumn("piece", F.explode(_pieces(F.col("pattern"), F.col("_size"))))
    often = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(often, "piece").groupBy("pattern").agg(F.min_by("piece", F.struct("_n", "piece")).alias("piece"))
    keyed = patterns.join(rarest, "pattern").select("piece", "pattern", "rank", "process", "color")
    # A name meets pieces of its own of the lengths that occur; equal names are looked up once.
    distinct = names.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    sizes = [r["_size"] for r in keyed.select(F.char_length("piece").alias("_size")).distinct().collect()]  # PIECE at most
    lengths = F.filter(F.array(*[F.lit(i) for i in sizes]).cast("array<int>"), lambda i: i <= F.char_length("_name"))
    own = distinct.withColumn("piece", F.explode(F.array_distinct(F.flatten(F.transform(lengths, lambda i: _pieces(F.col("_name"), i))))))
    first = F.min_by(F.struct("process", "color"), "rank")
    found = own.join(keyed, "piece").where(F.contains("_name", "pattern")).groupBy("_name").agg(first.alias("_f"), F.min("rank").alias("_rank"))
    e = patterns.where("_size = 0").agg(first.alias("_e"), F.min("rank").alias("_none")).first()  # the empty pattern, or nulls
    path = f"{folder(names.sparkSession)}/found-{uuid.uuid4().hex}"
    found.write.parquet(path)  # both sides of the join are plain exchanges then, so Spark can split a hot name
    out = names.join(names.sparkSession.read.parquet(path), F.col(name) == F.col("_name"), "left")
    style = F.col("_f")
    if e["_none"] is not None:
        whole = F.struct(F.lit(e["_e"]["process"]).cast("string").alias("process"), F.lit(e["_e"]["color"]).cast("string").alias("color"))
        before = F.col("_rank") < F.struct(F.lit(e["_none"]["draw_idx"]).alias("draw_idx"), F.lit(e["_none"]["_i"]).alias("_i"))
        style = F.when(F.col(name).isNull(), F.lit(None)).when(before, F.col("_f")).otherwise(whole)
    out = out.withColumn("_f", style)
    return out.select(*names.columns, F.coalesce("_f.process", F.lit(UNKNOWN)).alias("process"), F.coalesce("_f.color", F.lit("white")).alias("color"))


def pairs(control: DataFrame, reco: DataFrame) -> DataFrame:
    """truth and reco names that belong together, each pair once.

    By what follows the first underscore, and trueX with X; both inputs are lists of names (name).
    """
    left, right = control.select(F.col("name").alias("truth")), few(reco.select(F.col("name").alias("reco")))
    marked = left.where(F.contains("truth", F.lit("_"))).join(right.where(F.contains("reco", F.lit("_"))), after_first(F.col("truth")) == after_first(F.col("reco")))
    true = left.where(F.startswith("truth", F.lit("true"))).join(right, F.substring("truth", 5, 1000) == F.col("reco"))
    return marked.union(true).where("truth <> reco").distinct()


def first_existing(columns: list[str], base: str, suffix: str) -> Column:
    """The column base+suffix, base_suffix or either in lower case, whichever exists first; 0 if none does."""
    for name in (f"{base}{suffix}", f"{base}_{suffix}", f"{base}{suffix}".lower(), f"{base}_{suffix}".lower()):
        if name in columns:
            return F.col(f"`{name}`").cast("double")
    return F.lit(0.0)


#: Names of the particles of one leg, in order.
PIONS = ["pi", "pi2", "pi3", "pi0"]


def pion_list(columns: list[str], suffix: str) -> Column:
    """array<struct<type, pt, eta, phi, energy, charge>> of one leg's pions with a positive momentum."""
    def one(name: str) -> Column:
        part = {k: first_existing(columns, f"{name}_{v}", suffix) for k, v in (("pt", "pt"), ("eta", "eta"), ("phi", "phi"), ("energy", "Energy"), ("charge", "charge"))}
        return F.struct(F.lit(name).alias("type"), *[v.alias(k) for k, v in part.items()])

    return F.filter(F.array(*map(one, PIONS)), lambda p: F.coalesce((p["pt"] > 0) & ~F.isnan(p["pt"]), F.lit(False)))


def leg_kind(pions: Column) -> Column:
    return F.when(F.size(pions) == 0, "muon").otherwise("tau")
