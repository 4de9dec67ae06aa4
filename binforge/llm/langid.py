"""Language identification: cosine to several centroids per language, with rejection by distance.

A text is lower-cased, everything but letters becomes one space, and its byte n-grams (1 to 4) are hashed into a fixed
number of features, weighted by 1 + log(count) and inverse document frequency, and normalised. Spherical k-means
gives each language several centroids. A text gets the language of the nearest; it is rejected if its cosine is below
``reject`` times a low quantile of what the language's own training texts reach, a quantile taken per text length.

Fitting uses at most ``per_lang`` labelled rows of each language, those with the smallest hash of the id (of the text
for rows without one), and learns every label (256 KB of model each); all else reads every row and whole texts. Rows to learn from are
chosen by the caller. Null labels teach nothing. Null texts and texts without a letter are ``und``, score 0, rejected;
without a label to learn all are ``und``, score 0, and only those without a letter are rejected.
Repeated rows get equal results; other columns are dropped. Long texts are counted whole, in blocks. Of centroids equally
near the first in the order of language names decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binforge.llm.common import give_back, pieces_of, stage

FEATURES = 1 << 14
PER_LANG = 600
#: Languages up to which their thresholds are broadcast.
BROADCAST_ROWS = 1_000_000
CENTROIDS = 4
ROUNDS = 8
REJECT = 0.5
QUANTILE = 0.01
_OTHERS = re.compile(r"[\W\d_]+")
BLOCK = 1 << 16  # bytes counted at once
_MIX = np.uint32(2654435761)
#: Texts are compared with training texts cut to these many bytes, since short ones lie farther off.
LENGTHS = (20, 60, 200, 1000)


def counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features, their weights before idf, and the bytes of letters in the text."""
    words = _OTHERS.sub(" ", text.lower()).strip(" ")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0
    data = np.frombuffer(f" {words} ".encode(), np.uint8)
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(data), BLOCK):
        before = min(at, 3)  # bytes that n-grams across the block's beginning need
        block = data[at - before : at + BLOCK]
        gram = np.zeros(len(block), np.uint32)
        for n in range(1, min(4, len(block)) + 1):
            gram = (gram[: len(block) - n + 1] << np.uint32(8)) | block[n - 1 :]
            total += np.bincount(((gram[max(0, before - n + 1) :] ^ np.uint32(n)) * _MIX) >> np.uint32(18), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, (1 + np.log(total[at])).astype(np.float32), len(data)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def vectors(texts: Iterable[str], idf: np.ndarray, n: int | None = None) -> np.ndarray:
    """The unit vectors of ``n`` texts, in one array that is filled row by row."""
    out = np.zeros((len(texts) if n is None else n, FEATURES), np.float32)
    for v, text in zip(out, texts):
        at, w, _ = counts(text)
        v[at] = w * idf[at]
        v[:] = _unit(v[None])[0]
    return out


def mean_of(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The mean of some rows, a sixteenth of the columns at once, so that the rows aren't copied whole."""
    step = -(-rows.shape[1] // 16)
    return np.concatenate([rows[own, at : at + step].mean(axis=0) for at in range(0, rows.shape[1], step)])


def _sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """At most per_lang rows of each language, those with the smallest hash of their id.

    Rows are counted by language first, and only those below a hash that some twice as many rows as wanted have are
    ranked, so no language's rows meet in one task.
    """
    whole = F.xxhash64("doc_id").cast("double") + F.lit(2.0**63)  # from 0 to 2^64
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_u", F.when(F.col("doc_id").isNull(), F.xxhash64("text").cast("double") + F.lit(2.0**63)).otherwise(whole))
    below = F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * per_lang + 100) / F.count(F.lit(1)))
    wanted = stage(docs.groupBy(F.col("lang").alias("_lang")).agg(below.alias("_below")), "langs")  # a row for each language
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    near = docs.join(wanted, (F.col("lang") == F.col("_lang")) & (F.col("_u") <= F.col("_below"))).withColumn("_h", F.xxhash64("doc_id", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "_h"))
    return near.withColumn("_r", rank).where(F.col("_r") <= per_lang).drop("_lang", "_below", "_r", "_u")


def fit(docs: DataFrame, *, per_lang: int = PER_LANG, k: int = CENTROIDS) -> dict:
    """A model of plain arrays from ``docs`` (doc_id, text, lang): bounded by languages, centroids and features."""
    sample = stage(_sample(docs.select("doc_id", "text", "lang"), per_lang).select("lang", "_h", "text"), "langid")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"f": np.append(at, -1), "n": np.append(df[at], n)})

    df = dict(sample.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n")).collect())
    idf = np.zeros(FEATURES, np.float32)
    n = df.pop(-1, 0)
    for f, c in df.items():
        idf[f] = np.log((1 + n) / (1 + c)) + 1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h")  # at most per_lang rows
        rows = vectors(pdf["text"], idf)
        middle = _unit(rows.mean(axis=0))
        chosen = [int(np.argmax(rows @ middle))]
        while len(chosen) < min(k, len(rows)):  # farthest first, among the half nearest to the middle
            near = (rows @ middle) >= np.median(rows @ middle)
            chosen.append(int(np.argmin(np.where(near, (rows @ rows[chosen].T).max(axis=1), 2))))
        centres = rows[chosen]
        for _ in range(ROUNDS):
            own = np.argmax(rows @ centres.T, axis=1)
            centres = _unit(np.stack([mean_of(rows, own == c) if (own == c).any() else centres[c] for c in range(len(centres))]))
        del rows
        floors = []
        for size in LENGTHS:
            floors.append(float(np.quantile((vectors((t[:size] for t in pdf["text"]), idf, len(pdf)) @ centres.T).max(axis=1), QUANTILE)))
        give_back()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(centres), "centre": [c.astype(np.float32).tobytes() for c in centres], "floors": [floors] * len(centres)})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, floors array<double>").orderBy("lang").collect()
    return {"idf": idf, "langs": [r["lang"] for r in found], "centres": np.frombuffer(b"".join(r["centre"] for r in found), np.float32).reshape(-1, FEATURES).T.copy(), "floors": np.array([r["floors"] for r in found]).reshape(-1, len(LENGTHS))}


def predict(docs: DataFrame, model: dict, *, reject: float = REJECT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score (cosine, 0 to 1) and rejected, from text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features times centroids
    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces_of(batches, "_text"):
            langs, scores, rejected = [], [], []
            for text in batch.column("_text").to_pylist():
                at, w, size = counts(text or "")
                if not size or not m["langs"]:
                    langs.append("und"), scores.append(0.0), rejected.append(not size)
                    continue
                v = w * m["idf"][at]
                cos = v @ m["centres"][at] / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cos))
                score = min(1.0, max(0.0, float(cos[best])))
                langs.append(m["langs"][best]), scores.append(score)
                rejected.append(score < reject * np.interp(size, LENGTHS, m["floors"][best]))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{columns}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
