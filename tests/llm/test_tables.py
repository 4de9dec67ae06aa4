"""Chat formatting, WARC archives, embeddings and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binforge.llm import chat, embeddings, langid, packing, quality, registry, warc
from tests.llm import util

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

# ---- chat

TEXTS = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant ok", r"<\|im_end\|> <\\| <| <<||", "two\nlines <|im_end|>\n", "\\", "äöü 🙂", r"a\nb"]


def chats():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole\\n<|", "tool"]), rng.choice(TEXTS), "clash") for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(90, 1, "assistant", "b", "clash"), (90, 0, "user", "a", "clash"), (90, 0, "user", "a", "clash"), (None, 1, "user", "no id", "clash"), (91, None, "system", "first", "clash"), (91, 0, "user", "then", "clash"), (91, 1, "assistant", "last", "clash")]
    return rows


def test_chat_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(out) == len(by)
    for r in out:
        turns = sorted(by[r["conv_id"]])
        assert [(x["role"], x["text"]) for x in r["back"]] == [(role, text) for _, role, text in turns]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        learnt = [s for s in r["segments"] if s["loss"]]
        assert [s["role"] for s in learnt] == ["assistant"] * sum(role == "assistant" for _, role, _ in turns)
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == len(turns)
        state, breaches = "", 0
        for i, (_, role, _) in enumerate(turns):
            breaches += role not in (chat.CHATML.follows.get(state, ()) if state or not i else ())
            state = role
        assert (r["n_breaches"], r["valid"]) == (breaches, breaches == 0 and state == "assistant")
    assert {r["conv_id"]: r["valid"] for r in out}[91] and chat.format_chats(df.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string, segments string")
    plan = chat.format_chats(df.select("conv_id", "turn", "role", "text")).withColumn("b", chat.read_back(F.col("formatted")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_other_template(spark):
    own = chat.Template("[", ":", "]", ("bot",), {"": ("me",), "me": ("bot",), "bot": ()}, ("bot",))
    df = spark.createDataFrame([(1, 0, "me", "hi"), (1, 1, "bot", "yo")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df, own).first()
    assert r["formatted"] == "[me:hi][bot:yo]" and r["valid"]


# ---- WARC


def pages():
    rows = [(i, f"http://h/{i}?a b=\r\nü", f"<html>page {i} é</html>") for i in range(40)]
    return rows + [(50, "http://x", "<html>page 3 é</html>"), (51, None, "<html>page 3 é</html>"), (52, "http://e", ""), (53, "http://n", None), (None, "http://nil", "<html>page 3 é</html>"), (51, None, "<html>page 3 é</html>"), (None, None, "only"), (60, "http://nl", "a\r\n\r\nWARC/1.1\r\n" * 9), (61, "http://long", "z" * 300_000)]


def test_warc(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash")).repartition(3)
    root = f"file://{tmp_path}/w"
    index = warc.write(warc.with_types(df), root, most_bytes=2000)
    out = warc.read(index, root).collect()
    last = {}
    for p, _, html in rows:
        if p is not None:
            last[html or ""] = max(p, last.get(html or "", -1))
    expected = Counter()
    for p, _, html in rows:
        data, top = (html or "").encode(), last.get(html or "")
        expected[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == top else "revisit", None if p == top else top] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == expected
    for r in out:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() in {h or "" for p, _, h in rows if p == r["page_id"]}
    # The index finds each record by itself, and archives are plain WARC.
    for r in index.collect()[:10]:
        with open(r["path"], "rb") as f:
            f.seek(r["offset"])
            data = gzip.decompress(f.read(r["length"]))
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n") and f"sha1:{r['digest']}".encode() in data
    assert len({r["path"] for r in index.collect()}) > 3
    some = index.where("page_id in (7, 61)")
    assert {r["page_id"] for r in warc.read(some, root, gap=0, most=1000).collect()} == {7, 61}
    assert warc.read(warc.write(warc.with_types(df.limit(0)), root), root).count() == 0


# ---- embeddings


def vectors():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2, None):
        for _ in range(25):
            v = rng.standard_normal(20)
            for noise in (0, 0, 0.02, 0.05, 0.07)[: rng.integers(1, 6)]:
                rows.append((n, (v * rng.uniform(0.5, 2) + noise * rng.standard_normal(20)).astype(np.float32).tolist(), label))
                n += 1
    chain = rng.standard_normal(20)
    for i in range(40):  # linked only to what is near in the chain
        chain = chain + 0.11 * rng.standard_normal(20)
        rows.append((n + i, chain.astype(np.float32).tolist(), 1))
    n += 40
    bad = [None, [], [0.0] * 20, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19, [None] + [1.0] * 19]
    rows += [(n + i, v, 0) for i, v in enumerate([*bad, *bad])]
    n += 2 * len(bad)
    rows += [(n, [1.0, 2.0], 0), (n + 1, [2.0, 4.0], 0), (n + 2, [1.0], 0), (n + 3, [3.0], 0), (n + 4, [-1.0], 0), (None, [1.0, 2.0], 0), rows[0], rows[0], (n + 5, [-0.0, 1.0], 2), (n + 6, [0.0, 1.0], 2)]
    return rows


def _near(rows, cosine=0.98):
    fine = [label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links.append((i, j))
    n = Counter(x for p in links for x in p)
    of = util.groups(len(rows), links)
    ids = defaultdict(list)
    for i, g in enumerate(of):
        if rows[i][0] is not None:
            ids[g].append(rows[i][0])
    return Counter((r[0], n[i], min(ids[of[i]], default=None)) for i, r in enumerate(rows)), len(links)


@pytest.mark.parametrize("together", [4096, 8])
def test_embeddings(spark, monkeypatch, together):
    monkeypatch.setattr(embeddings, "TOGETHER", together)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("point", "cell", "n", "kept")}).repartition(3)
    expected, links = _near([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    out = embeddings.near_duplicates(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == expected and links > 100
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- pipeline


def _pipeline(rows, model_predictions):
    """The stages by brute force; languages as the fitted model predicts them."""
    from tests.llm.test_text_operators import _base, _lines

    texts, first = defaultdict(set), {}
    for r in rows:
        for k in _lines(r[1] or ""):
            texts[r[3], k].add(r[1])
            if r[0] is not None:
                first[r[3], k] = min(r[0], first.get((r[3], k), 1 << 60))
    kept = []
    for r in rows:
        b = _base(r[1])
        gone = {k for k in _lines(r[1] or "") if len(texts[r[3], k]) > quality.LINE_LIMIT and first.get((r[3], k)) != r[0]}
        lost = sum(n for k, n in _lines(r[1] or "").items() if k in gone)
        if not b[5] and b[0] - lost >= quality.LEAST_WORDS and b[0] - lost >= quality.LEAST_PART * b[0]:
            text = "\n".join(x for x in r[1].split("\n") if not gone & set(_lines(x)))
            kept.append((r[0], text, *r[2:4], len(text) if gone else r[4]))
    yield kept
    kept = [r for r in kept if not model_predictions(kept)[r[0], r[1]]]
    yield kept
    sets = util.shingle_sets(kept)
    links = [(i, j) for i in range(len(kept)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    of, best = util.groups(len(kept), links), {}
    for i in sorted(range(len(kept)), key=lambda i: util.order(kept[i][0])):
        best.setdefault(of[i], kept[i])
    kept = [best[of[i]] for i in range(len(kept)) if of[i] == i]
    yield kept
    kept = [(*r[:1], x[4] if x[2] else r[1], *r[2:4], len(x[4] if x[2] else r[1])) for r, x in zip(kept, util.substrings(kept)) if x[4] or not x[1]]
    yield kept


def test_pipeline(spark):
    rows = util.corpus(11, 150)
    docs = util.frame(spark, rows)
    found = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, packing.stage(f(spark, docs, ""), "test")
        assert docs.columns == before.columns
        found.append(Counter(tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()))

    def rejected(kept):
        df = util.frame(spark, kept)
        model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))))
        return {(r["doc_id"], r["text"]): r["rejected"] for r in langid.predict(df, model, keep=("doc_id", "text")).collect()}

    made = {}
    stages = list(_pipeline(rows, lambda kept: made.setdefault(len(kept), rejected(kept)) if len(kept) not in made else made[len(kept)]))
    for own, brute in zip(found, stages):
        assert own == Counter(brute)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    by = defaultdict(int)
    for r in packed:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= packing.SEQUENCE
    assert sum(r["length"] for r in packed if r["start"] == 0) <= sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(by.values())


def test_pipeline_of_nothing(spark):
    docs = util.frame(spark, [])
    for _, f in corpus_pipeline.STAGES:
        docs = packing.stage(f(spark, docs, ""), "test")
    assert docs.count() == 0


# ---- registry


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found, expected = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    rows = lambda df: Counter(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs_whole_table(spark, name):
    table = {"op7_warc": "pages", "op8_chat_formatting": None, "op9_embedding_near_dedup": "embeddings", "op2_packing": None, "op11_hard_negatives": None, "op12_exact_top_k": None, "op13_ranked_lexical_search": None}.get(name, "documents")
    n = registry.QUERIES[name](spark, SF).count()
    if table:
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert n > 0


def test_staged_tables_can_be_released(spark, tmp_path):
    from binforge.llm import common

    df = common.stage(spark.range(3), "test")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.release()
    assert not os.path.exists(path) and not common._STAGED


@needs_data
def test_few_pairs_of_embeddings_are_verified(spark):
    own = [(i, v, label) for i, v, label in vectors()[:100] if label is not None]
    rows = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").union(spark.createDataFrame(own, "vec_id long, embedding array<float>, label int"))
    points = embeddings._points(rows).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight")).withColumn("point", F.xxhash64("label", "embedding"))
    pairs = embeddings.candidates(embeddings._visits(points, embeddings.COSINE), embeddings.COSINE).agg(F.sum("pairs") / 2).first()[0]
    all_pairs = points.groupBy("label", F.size("embedding")).count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert 0 < pairs < all_pairs / 100
