"""Language ID against a plain version: dictionaries of n-grams, one vector at a time."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from binforge.llm import langid
from tests.llm.util import SCHEMA

WORDS = {
    "en": "the of and that there with house water over people small think great where through".split(),
    "fr": "le la être avec pour dans maison eau petit où été très même année français".split(),
    "de": "der die und nicht haus wasser über menschen klein denken groß durch schön für".split(),
    "xx": "qz zq qqz zzq qzq".split(),
}


def grams(text: str) -> dict[int, int]:
    """How often each bucket of 1 to 4 bytes occurs in the letters of a text, words apart by one space."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out: dict[int, int] = {}
    if words:
        data = f" {' '.join(words)} ".encode()
        for n in range(1, 5):
            for i in range(len(data) - n + 1):
                number = int.from_bytes(data[i : i + n], "big")
                bucket = (((number ^ n) * 2654435761) & 0xFFFFFFFF) >> 18
                out[bucket] = out.get(bucket, 0) + 1
    return out


def unit(v: dict[int, float]) -> dict[int, float]:
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def dot(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def mean(vs: list[dict[int, float]]) -> dict[int, float]:
    out: dict[int, float] = {}
    for v in vs:
        for k, x in v.items():
            out[k] = out.get(k, 0.0) + x / len(vs)
    return out


def quantile(xs: list[float], q: float) -> float:
    xs, at = sorted(xs), q * (len(xs) - 1)
    low = int(at)
    return xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low])


def plain_fit(rows, order):
    """idf, and centroids and floors of each language. ``order`` gives the rows of a language as the model takes them."""
    df: dict[int, int] = {}
    for _, text, _ in rows:
        for k in grams(text):
            df[k] = df.get(k, 0) + 1
    idf = {k: math.log((1 + len(rows)) / (1 + c)) + 1 for k, c in df.items()}
    vector = lambda t: unit({k: (1 + math.log(c)) * idf.get(k, 0.0) for k, c in grams(t).items()})
    model = {}
    for lang in sorted({r[2] for r in rows}):
        texts = order(lang)
        vs = [vector(t) for t in texts]
        middle = unit(mean(vs))
        near = [dot(v, middle) for v in vs]
        half = quantile(near, 0.5)
        chosen = [max(range(len(vs)), key=lambda i: (near[i], -i))]
        while len(chosen) < min(langid.CENTROIDS, len(vs)):
            far = [max(dot(v, vs[c]) for c in chosen) if near[i] >= half - 1e-7 else 2.0 for i, v in enumerate(vs)]
            chosen.append(min(range(len(vs)), key=lambda i: (far[i], i)))
        centres = [vs[c] for c in chosen]
        for _ in range(langid.ROUNDS):
            own = [max(range(len(centres)), key=lambda c: (dot(v, centres[c]), -c)) for v in vs]
            centres = [unit(mean([v for v, o in zip(vs, own) if o == c])) if c in own else centres[c] for c in range(len(centres))]
        floors = [quantile([max(dot(vector(t[:size]), c) for c in centres) for t in texts], langid.QUANTILE) for size in langid.LENGTHS]
        model[lang] = centres, floors
    return vector, model


def plain_predict(text, vector, model):
    size = len(" ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode())
    if not size:
        return "und", 0.0, True
    size += 2
    best, lang = max(((dot(vector(text), c), lang) for lang, (centres, _) in model.items() for c in centres), key=lambda x: x[0])
    floors = model[lang][1]
    at = sum(size >= s for s in langid.LENGTHS)
    if at == 0 or at == len(langid.LENGTHS):
        floor = floors[min(at, len(floors) - 1)]
    else:
        a, b = langid.LENGTHS[at - 1 : at + 1]
        floor = floors[at - 1] + (size - a) / (b - a) * (floors[at] - floors[at - 1])
    return lang, best, best < langid.REJECT * floor


@pytest.mark.parametrize("seed", [1, 2])
def test_predictions_are_those_of_a_plain_version(spark, seed):
    rng = random.Random(seed)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + (rng.choice(["", ",", ". ", " 12 "])) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(90))]
    asked = [(1000 + i, text(lang, rng.randrange(1, 40)), None) for i, lang in enumerate(list(WORDS) * 8)]
    asked += [(2000, None, None), (2001, "", None), (2002, "12 !? 34", None), (2003, "Привет мир, как дела", None), (2004, "q", None), (2005, "the der le " * 300, None), (2006, "日本語", None)]
    frame = lambda xs: spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in xs], SCHEMA)
    hashed = {r["doc_id"]: r["h"] for r in frame(rows).select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    vector, model = plain_fit(rows, lambda lang: [t for i, t, own in sorted(rows, key=lambda r: hashed[r[0]]) if own == lang])
    got = {r["doc_id"]: r for r in langid.predict(frame(asked), langid.fit(frame(rows))).collect()}
    assert len(got) == len(asked)
    for i, t, _ in asked:
        lang, score, rejected = plain_predict(t, vector, model)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4) and got[i]["rejected"] == rejected, (i, t)
