"""Quality rules: text statistics of each document, then line frequency across documents.

Lines are normalised (lower case, digit runs as 0, white space runs as one space) and hashed to 128 bits. For each host
(``source``) and line the different documents with it are counted; exact copies are one document, since telling copies
apart is left to the near-duplicate operators. A line above the limit is boilerplate: it stays only in the first
document of the host that has it (smallest doc_id). Documents left with too few of their words are rejected, and
``clean`` takes the line, each time it occurs, out of the texts of all others.

Null text has no words and fails the base rules. Rows that share an id are judged each by its own text; repeated rows
get equal results. A null source is a host of its own. Texts are read whole however long. Other columns are dropped.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from binforge.llm.common import BROADCAST_ROWS, pieces_of, stage, text_key

#: A line in more different documents of one host is boilerplate.
LINE_LIMIT = 20
#: Rejected if fewer words than this, or than this part of its words, are left.
LEAST_WORDS = 10
LEAST_PART = 0.3
WINDOW = 5
_SYMBOLS = re.compile(r"[^#*$%&|<>]+")
_DIGITS = re.compile(r"[0-9]+")


def _repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    key = ids[:n]
    for j in range(1, width):  # dense numbers of the prefixes, so equal keys are equal windows
        if key.max() >= (1 << 62) // len(number):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_hash(words: list[bytes]) -> bytes:
    """The hash of a line, normalised, from its words."""
    return xxhash.xxh3_128_digest(_DIGITS.sub("0", b" ".join(words).decode().lower()).encode())


def statistics(text: str) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and words by normalised line hash."""
    data = text.encode()
    words = data.split()
    lines: Counter[bytes] = Counter()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            dup += line in seen
            seen.add(line)
            lines[line_hash(own)] += len(own)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    return len(words), chars, len(_SYMBOLS.sub("", text)), dup, _repeated(words), lines


def measure(docs: DataFrame) -> DataFrame:
    """A row for each document: key, host, its statistics, and its lines' hashes (two longs each) and words."""
    schema = (
        "doc_id long, key long, text_hash binary, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " lines array<struct<hi: long, lo: long, words: int>>"
    )
    line = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [statistics(t) for t in texts]
            flat = np.frombuffer(b"".join(k for x in found for k in x[5]), "<i8").reshape(-1, 2)
            sizes = np.cumsum([0] + [len(x[5]) for x in found])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array([v for x in found for v in x[5].values()], pa.int32())], fields=list(line.value_type))
            columns = [batch.column("doc_id"), batch.column("key"), pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary()), batch.column("host")]
            columns += [pa.array([x[i] for x in found], pa.int64()) for i in range(5)]
            columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs))
            names = ["doc_id", "key", "text_hash", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(), F.lit(0)).alias("key"), F.col("source").cast("string").alias("host"), F.col("text")).mapInArrow(run, schema)


def judge(docs: DataFrame, *, line_limit: int = LINE_LIMIT, least_words: int = LEAST_WORDS, least_part: float = LEAST_PART) -> DataFrame:
    """doc_id, key, text_hash, host, the statistics, gone (hashes of lines to take out), base_failed, boilerplate_words and kept for each row of ``docs``."""
    docs = stage(measure(docs), "quality")
    lines = docs.select("doc_id", "text_hash", "host", F.explode("lines").alias("l")).select("doc_id", "text_hash", "host", "l.*")
    apart = lines.groupBy("host", "hi", "lo", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    common = apart.groupBy("host", "hi", "lo").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first")).where(F.col("_n") > line_limit)
    # A common line can be in a third of all rows. The common lines are a stored table, so both sides of the join are
    # plain exchanges, and Spark splits a partition with very many rows of one line into as many tasks as it needs.
    common = stage(common.select(F.col("host").alias("_host"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "_first"), "common-lines")
    hits = lines.join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
    hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["host", "hi", "lo", "doc_id", "text_hash"])
    lost = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("host").alias("_own")).agg(F.sum("words").alias("_lost"), F.collect_list(F.struct("hi", "lo")).alias("gone"))
    rows = docs.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & F.col("host").eqNullSafe(F.col("_own")), "left")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("boilerplate_words")
    rows = rows.withColumn("boilerplate_words", F.coalesce("_lost", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (left >= least_words) & (left >= F.lit(least_part) * F.col("n_words"))
    return rows.withColumn("kept", kept).drop("_doc", "_hash", "_own", "_lost")


def _without_lines(text: Column, gone: Column) -> Column:
    """A text without the lines of the hashes ``gone``; null where the text is."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hashes in batches:
            out = []
            for t, own in zip(texts, hashes):
                if t.is_valid:
                    out_of = {struct.pack("<qq", h["hi"], h["lo"]) for h in own.as_py()}
                    out.append("\n".join(x for x in t.as_py().split("\n") if not (w := x.encode().split()) or line_hash(w) not in out_of))
                else:
                    out.append(None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(text, gone)


def clean(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns; text (and n_chars with it) is without its lines above the limit."""
    found = judge(docs, **limits).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("host").alias("_host"), F.col("kept").alias("_kept"), F.col("gone").alias("_gone"))
    found = stage(found.where("not _kept or _gone is not null").dropDuplicates(["_doc", "_key", "_host"]), "lines")
    few = (found.agg(F.sum(1 + F.coalesce(F.size("_gone"), F.lit(0)))).first()[0] or 0) <= BROADCAST_ROWS  # rows and hashes
    found = F.broadcast(found) if few else found
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.coalesce(F.xxhash64("row.text"), F.lit(0)) == F.col("_key")) & F.col("row.source").cast("string").eqNullSafe(F.col("_host"))
    rows = row.join(found, same, "left").where(F.coalesce("_kept", F.lit(True)))
    # Only texts with a line to lose go to Python.
    rows = rows.withColumn("_new", _without_lines(F.when(F.col("_gone").isNotNull(), F.col("row.text")), F.col("_gone")))
    new = {"text": F.coalesce("_new", "row.text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_new").isNotNull(), F.char_length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key", "text_hash", "host", "gone")
