import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from binforge.llm import bpe, jaccard, langid, licenses, packing, quality, substrings
from tests.llm import util

ROWS = util.corpus()
EMPTY = []


# ---- byte-level BPE

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return bpe.encoding(MULTI, public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 50])
def test_tree_encoding_is_whole_encoding(encoding, leaf):
    texts = [r[1] for r in ROWS if r[1]][:40] + ["it's we're  \n\n x'll 's", "   ", "a" * 300, " 　\x1c'd", "don't\tdo'nt  end  ", "日本語 12ab34 !!?? \r\n\r\n  z", "🙂🙂 é é"]
    for t in texts:
        t = t[:1500]
        ids = bpe.encode_tree(encoding.encode_ordinary, t, leaf_chars=leaf)[2]
        assert ids == encoding.encode_ordinary(t)
        assert bpe.decode_tree(encoding.decode_bytes, ids, 3) == t.encode()


def test_bpe_rows(spark, encoding):
    df = util.frame(spark, ROWS)
    out = util.counted(bpe.encode(df, MULTI, public_tokenizers.PATTERN, leaf_chars=500, digests=True).collect())
    expected = []
    for r in ROWS:
        ids = encoding.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert out == util.counted(expected)
    back = bpe.decode(bpe.encode(df, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["data"]).decode()) for r in back.collect()) == Counter((r[0], r[1] or "") for r in ROWS)
    assert bpe.encode(util.frame(spark, EMPTY), MULTI, public_tokenizers.PATTERN).count() == 0


# ---- packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def _plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(spark):
    pieces = packing.stage(packing.tokenize(util.frame(spark, ROWS), WORD, most=64), "test")
    packed = packing.pack(pieces, 64)
    rows = packed.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and {r["padded_to"] for r in own} == {at if at & (at - 1) == 0 else 64}
    assert set(by) == set(range(len(by)))
    # Every id in exactly one piece, repeated rows included.
    found = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    expected = Counter()
    for d in ROWS:
        ids = _plain_ids(d[1])
        for s in range(0, len(ids), 64):
            expected[d[0], s, len(ids[s : s + 64]), zlib.crc32(np.asarray(ids[s : s + 64], "<u4").tobytes()), len(ids)] += 1
    assert found == expected
    used = sum(r["length"] for r in rows)
    assert used / (64 * len(by)) > 0.95
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert all(len(whole[s]) == 4 * sum(r["length"] for r in own) for s, own in by.items())
    assert packing.pack(packing.stage(packing.tokenize(util.frame(spark, EMPTY), WORD), "test")).count() == 0


def test_ids_of_odd_texts():
    pool = ["It's", "İstanbul", "ΣΑΣ", "don't!!", "x\x1cy", " ", "<|endoftext|>", "½²3", "é", "🙂.", "ǅ", "日本語", "#,", "a,b", "ÉÉ!", "'s,", "\x00"]
    for t in [*pool, " ".join(pool), "\t".join(pool) + "\n\r"]:
        assert np.frombuffer(packing._ids([t], WORD)[0], "<u4").tolist() == _plain_ids(t)[:-1]


def test_patterns_fill_and_use_each_length():
    histogram = {2048: 5, 1500: 10, 600: 7, 548: 9, 100: 300, 1: 40}
    found, used = packing.patterns(histogram), Counter()
    for count, lengths in found:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += count
    assert used == histogram


# ---- quality rules


def _base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            repeated.update(range(i, i + 5))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_quality(spark):
    limit, least, part = 4, 10, 0.5
    out = util.counted(quality.judge(util.frame(spark, ROWS), line_limit=limit, least_words=least, least_part=part).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "boilerplate_words", "kept").collect())
    lines = lambda t: Counter({k: len(k.split()) for k in ()}) if not t else _lines(t)
    texts, first = defaultdict(set), {}
    for r in ROWS:
        for k in lines(r[1]):
            texts[r[3], k].add(r[1])
            if r[0] is not None:
                first[r[3], k] = min(r[0], first.get((r[3], k), 1 << 60))
    expected = []
    for r in ROWS:
        b = _base(r[1])
        lost = sum(n for k, n in lines(r[1]).items() if len(texts[r[3], k]) > limit and first.get((r[3], k)) != r[0])
        expected.append((r[0], *b[:5], b[5], lost, not b[5] and b[0] - lost >= least and b[0] - lost >= part * b[0]))
    assert out == util.counted(expected)
    assert sum(x[7] > 0 for x in expected) > 3 and 0 < sum(x[8] for x in expected) < len(ROWS)
    assert quality.judge(util.frame(spark, EMPTY)).count() == 0


def _lines(text):
    out = Counter()
    for line in text.split("\n"):
        if own := line.encode().split():
            out[re.sub("[0-9]+", "0", b" ".join(own).decode().lower())] += len(own)
    return out


# ---- language ID


def test_languages(spark):
    rows = util.corpus(5, 160)
    df = util.frame(spark, rows)
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))), per_lang=60, k=2)
    assert set(model["langs"]) == {"en", "fr"}
    out = langid.predict(df, model).collect()
    assert len(out) == len(rows)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    right = total = 0
    for r in out:
        own = next(iter(texts[r["doc_id"]]))
        assert 0 <= r["score"] <= 1
        if len(texts[r["doc_id"]]) == 1 and not any(c.isalpha() for c in own or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        if r["doc_id"] is not None and r["doc_id"] < 160 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            total += 1
            right += r["lang_pred"] == ("fr" if r["doc_id"] % 3 == 0 else "en")
            assert not r["rejected"]
    assert total > 20 and right / total > 0.95
    none = langid.fit(util.frame(spark, EMPTY))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(util.frame(spark, EMPTY), model).count() == 0


# ---- substring dedup


@pytest.mark.parametrize("rows", [ROWS, util.corpus(9, 40), ROWS[:1]])
def test_substrings(spark, rows):
    found = substrings.dedup(util.frame(spark, rows)).collect()
    out = Counter((r["row"]["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest(), r["kept"]) for r in found)
    assert out == util.counted(util.substrings(rows))
    assert all(r["row"]["kept"] == "clash" for r in found)


def test_substrings_of_nothing(spark):
    assert substrings.dedup(util.frame(spark, EMPTY)).count() == 0


def test_hot_prefixes_do_not_change_results(spark):
    rows = [(i, "the the the " + util.sentence(__import__("random").Random(i % 7), 30), None, None, None) for i in range(40)]
    found = substrings.dedup(util.frame(spark, rows)).collect()
    assert Counter((r["row"]["doc_id"], r["kept"]) for r in found) == Counter((x[0], x[4]) for x in util.substrings(rows))


# ---- n-gram Jaccard join


def _join(spark, rows):
    return util.counted(jaccard.join(util.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("rows", [ROWS, util.corpus(4, 30)])
def test_jaccard(spark, rows):
    expected = util.jaccard(rows)
    assert _join(spark, rows) == util.counted(expected)
    assert len({x[2] for x in expected}) < len(rows) - 5


def test_jaccard_of_small_sets(spark):
    base = "a b c d e f g h i j k l m n o p".split()
    rows = [(n * 100 + k, " ".join(base[:n] if k == 0 else [*base[: n - 1], f"x{k}"] if k < 3 else base[1:n]), None, None, None) for n in range(1, 17) for k in range(4)]
    assert _join(spark, rows) == util.counted(util.jaccard(rows))


def test_jaccard_of_one_large_group(spark, monkeypatch):
    """Copies of one text whose changes keep many apart from each other, but not from it: heavy lists and both rounds."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(130):
        w = list(base)
        if i != 57:
            for at in rng.sample(range(5, 95, 6), 2 if i % 2 else 3):
                w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w), None, None, None))
    rows += [(1000 + i, " ".join(f"u{i}v{j}" for j in range(60)), None, None, None) for i in range(5)]
    rows.append((2000, " ".join([*base[:97], "end", "of", "it"]), None, None, None))
    monkeypatch.setattr(jaccard, "TOGETHER", 3000)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    expected = util.jaccard(rows)
    assert _join(spark, rows) == util.counted(expected)
    assert max(Counter(x[2] for x in expected).values()) > 60


def test_jaccard_of_nothing(spark):
    assert jaccard.join(util.frame(spark, EMPTY)).count() == 0


# ---- licences


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nOther text. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    rows = [
        (1, f"intro\n{apache}\nmore", None, None, None), (2, "Released under the MIT License.", None, None, None), (3, None, None, None, None), (4, "", None, None, None), (5, "nothing here", None, None, None),
        (6, "x. Licensed under CC BY-NC 4.0. Released under the MIT License.\n", None, None, None), (6, "Released under the MIT License", None, None, None), (2, "Released under the MIT License.", None, None, None), (None, "All rights reserved!", None, None, None),
    ]
    out = Counter((r["doc_id"], r["licence"], r["n_known"]) for r in licenses.scan(util.frame(spark, rows)).collect())
    assert out == Counter([(1, "Apache-2.0", 3), (2, "MIT", 1), (2, "MIT", 1), (3, None, 0), (4, None, 0), (5, None, 0), (6, "CC-BY-NC-4.0", 2), (6, "MIT", 1), (None, "all-rights-reserved", 1)])
    full = [r["rules"] for r in licenses.scan(util.frame(spark, rows[:1])).collect()]
    assert full[0][0] == 0
    assert licenses.scan(util.frame(spark, EMPTY)).count() == 0
