"""Searches (hard negatives, exact top k, ranked lexical search) against brute force, with nulls, ties and repeated rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binforge.llm import blocks, lexical, negatives, topk
from tests.llm.util import counted, frame

VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ["block", "at", "shard", "score", "place", "rank", "x", "ids", "size"]


def vectors(seed: int, n: int, size: int = 8) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(size) / 3).astype(np.float32).tolist(), None if i % 13 == 0 else i % 3) for i in range(n)]
    rows += [(n + i, list(rows[0][1]), 1) for i in range(6)]  # ties
    rows += [rows[5], rows[5], (20, rows[3][1], 2), (20, rows[4][1], 2), rows[100 % n], (None, rows[1][1], 1)]
    bad = [None, [None] * size, [float("nan")] * size, [float("inf")] + [0.0] * (size - 1), []]
    return rows + [(1000 + 20 * i, v, 1) for i, v in enumerate(bad)] + [(2000, [0.0] * size, 1), (2020, [0.5, -0.5], 1), (2021, [0.25, 0.5], 2), (2022, [0.75, 0.5], None)]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, VECTORS).repartition(parts).withColumns({c: F.lit("clash") for c in CLASH})


def usable(rows, scale):
    fine = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in fine]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every):
    own = usable(rows, topk.SCALE)
    out = []
    for i, q, _ in own:
        if i % every == 0:
            found = sorted((-dot(q, v), j) for j, v, _ in own if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("shard,block", [(16_384, 128), (16, 3)])
def test_top_k(spark, shard, block):
    rows = vectors(1, 150)
    got = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=7, shard=shard, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and counted(got.collect()) == brute_top(rows, 7, 20)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0], None), (20, [2.0, 1.0], 1)]
    assert counted(topk.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect()) == brute_top(rows, 20, 20)
    assert topk.search(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        topk.search(table(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)]), F.col("vec_id") % 20 == 0).collect()


def test_top_k_stops_on_proof():
    """A query leaves postings unread, and no row that belongs to the result is left out, ties included."""
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.standard_normal((4000, 64)) / 8).astype(np.int16)
    x[100:140] = x[7]
    made = {"members": np.arange(4000), "rows": x, **topk.segments(x)}
    row = {"width": 64, "bits": 16} | {c: np.ascontiguousarray(v).tobytes() for c, v in made.items()}
    shard, read = topk.Shard(row), 0
    for i in range(0, 4000, 200):
        q = x[i].astype(np.int64)
        want = x.astype(np.int64) @ q
        want[i] = np.iinfo(np.int64).min
        rows, score, n = shard.possible(q, 20, np.iinfo(np.int64).min, np.array([i]))
        least = np.sort(want)[-20]
        assert set(np.flatnonzero(want >= least)) <= set(rows) and (want[rows] == score).all()
        read += n
    assert read < 0.7 * 20 * 4000 * 64


def brute_negatives(rows, every):
    own = [r for r in usable(rows, negatives.SCALE) if r[2] is not None]
    out = []
    for i, q, label in own:
        if i % every:
            continue
        score = [(-dot(q, v), j, b) for j, v, b in own if len(v) == len(q)]
        for p, j, _ in sorted(s for s in score if s[2] == label and s[1] != i)[:5]:
            found = sorted((s, x) for s, x, b in score if b != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, r, x, -p, -s) for r, (s, x) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("shard,leaf,block", [(16_384, 64, 256), (40, 4, 3)])
def test_negatives(spark, shard, leaf, block):
    rows = vectors(2, 200)
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, shard=shard, leaf=leaf, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert counted(got.collect()) == brute_negatives(rows, 10)


def test_negatives_of_none_and_named_labels(spark):
    assert negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    rows = vectors(4, 60)
    named = table(spark, rows).withColumn("label", F.concat(F.lit("of "), F.col("label").cast("string")))
    assert counted(negatives.mine(named, F.col("vec_id") % 10 == 0).collect()) == brute_negatives(rows, 10)


def test_negatives_prune():
    """In clustered vectors most nodes are left out by their bounds."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((40, 32)) / 5
    x = np.floor(256 * (centre[np.arange(8000) % 40] + rng.standard_normal((8000, 32)) / 100)).astype(np.int64)
    labels = np.arange(8000) // 40 % 2
    made = negatives.forest(np.arange(8000), labels, x)
    row = {c: np.ascontiguousarray(v).tobytes() for c, v in made.items()} | {"width": 32, "bits": 16}
    at = np.arange(50)
    wanted = negatives.Wanted(at, labels[at], x[at], at, np.full(50, -(1 << 60)), np.full(50, 1 << 60), True, 5)
    wanted.visit(row)
    score = x @ x[:50].T
    for i in range(50):
        own = [(-int(score[j, i]), j) for j in range(8000) if labels[j] == labels[i] and j != i]
        assert [(-s, j) for s, j in sorted(own)[:5]] == list(zip(wanted.best.score[i].tolist(), wanted.best.id[i].tolist()))
    assert wanted.scored < 0.3 * 50 * 4000


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(d, Counter(w), len(w)) for d, t, *_ in docs if (w := terms(t))]
    n, total = len(held), sum(s for *_, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        own = set(terms(text))
        found = []
        for d, c, size in held:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def documents(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Élan", "Über-Maß", "a_b", "x1Y2", "ß", "the", "THE"]
    texts = [" ".join(rng.choice(words[: rng.randrange(3, 47)]) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    texts += texts[:5] + [None, "", " .,;!\x00\n", "the " * 5000, "w1 " * 3 + "rare", "x" * 5000, " w1 w2"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return rows + [(None, texts[3], "en", "s", 1), (7, texts[9], "en", "s", 1), rows[3], rows[3]]


@pytest.mark.parametrize("shard,run,block", [(24_000_000, 1024, 256), (1500, 4, 2)])
def test_lexical_search(spark, shard, run, block):
    docs = documents(1)
    items = [(i, d[1]) for i, d in enumerate(docs[:12])] + [(50, None), (51, ""), (52, "unknown words only"), (53, "the THE rare"), (3, "w1 w2"), (3, "w1 w2"), (None, "rare")]
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2).withColumns({c: F.lit("clash") for c in ("doc_id", "score", "item", "term", "df")})
    got = lexical.search(frame(spark, docs), table, shard=shard, run=run, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and counted(got.collect()) == brute_search(docs, items, lexical.K)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(frame(spark, []), items).collect() == [] and lexical.search(frame(spark, documents(2)), none).collect() == []


def test_top_k_of_large_components(spark):
    """Sums that doubles don't hold are taken in whole numbers."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) * 2e6).astype(np.float32).tolist(), 1) for i in range(90)]
    assert counted(topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()) == brute_top(rows, 5, 20)


def test_numbers_come_back():
    x = np.array([0, 1, 127, 128, 300, 16_383, 16_384, 2**28, 2**34, 5], np.int64)
    data, begin = lexical.packed(x)
    assert (lexical.unpacked(data) == x).all() and (lexical.unpacked(data[begin[4] :]) == x[4:]).all() and len(lexical.packed(x[:0])[0]) == 0


def test_a_shard_is_not_sent_for_each_block(spark):
    """All blocks meet all shards once, and rows that go to Python are few: not one with a shard's bytes for each pair."""
    shards = spark.range(30, numPartitions=5).selectExpr("id * 7 as shard", "cast(repeat('s', 50) as binary) as bytes")
    asked = spark.range(400, numPartitions=3).selectExpr("id * 5 as block", "cast('q' as binary) as x")
    rows = blocks.gathered(asked, shards, 400, 30)
    sent = rows.groupBy(F.col("block").isNull().alias("of_shard")).count().collect()
    assert {r["of_shard"]: r["count"] for r in sent}[True] <= 30 * 2 and {r["of_shard"]: r["count"] for r in sent}[False] <= 400 * 8

    def run(batches):
        def end(state):
            yield pa.RecordBatch.from_pydict({"block": [state[0]] * len(state[1]), "shard": state[1]}, pa.schema([("block", pa.int64()), ("shard", pa.int64())]))

        return blocks.met(batches, lambda row: (row["block"], []), lambda state, row: state[1].append(row["shard"]), end)

    found = rows.mapInArrow(run, "block long, shard long").collect()
    assert Counter(map(tuple, found)) == Counter((5 * b, 7 * s) for b in range(400) for s in range(30))
