"""Findings of the first review: each test failed before its fix."""

import random

from binforge.llm import quality
from tests.llm import util


def test_lines_above_the_limit_are_taken_out(spark):
    import corpus_pipeline

    rng = random.Random(3)
    line = "Sign up to our letter 99 today for much more"
    rows = [(i, "\n".join([util.sentence(rng, 25), line.replace("99", str(i)), "", util.sentence(rng, 25), line]), "en", "a" if i < 30 else "b", 1) for i in range(45)]
    rows += [rows[4], (None, rows[5][1] + " end", "en", "a", 1), (5, util.sentence(rng, 30), "en", "a", 7)]
    df = util.frame(spark, rows)
    out = util.counted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in corpus_pipeline.quality_rules(spark, df, "").collect())
    assert corpus_pipeline.quality_rules(spark, df, "").columns == df.columns
    expected = []
    for r in rows:
        text = r[1]
        if r[3] == "a" and r[0] != 0:  # b is below the limit, 0 is the first
            text = "\n".join(x for x in text.split("\n") if not x.startswith("Sign up") or x.endswith(" end"))
        expected.append((r[0], text, r[3], r[4] if text == r[1] else len(text)))
    assert out == util.counted(expected)
    left = {(r["doc_id"], r["host"], r["n_words"]): r["n_words"] - r["boilerplate_words"] for r in quality.judge(df).collect()}
    assert all(left[r[0], r[3], len(r[1].split())] == len(e[1].split()) for r, e in zip(rows, expected))
    assert quality.clean(util.frame(spark, [])).count() == 0


GPL = """    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU {}General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version."""
GENUINE = {
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "MPL-2.0": """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0-or-later": GPL.format(":", "", ",", 3),
    "LGPL-3.0-or-later": GPL.format(":", "Lesser ", ",", 3),
    "GPL-2.0-or-later": GPL.format(";", "", ";", 2),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
}


def test_genuine_licences_wrapped_and_unwrapped(spark):
    import re

    from binforge.llm import licenses

    rows, expected = [], {}
    for i, (name, text) in enumerate(GENUINE.items()):
        joined = re.sub(r"\n(#?) *(?=\S)", " ", text.replace("\n#", "\n"))
        for j, t in enumerate((text, joined, text.replace("\n", "\r\n"), f"some words\n{text}\nmore words")):
            rows.append((10 * i + j, t, None, None, None))
            expected[10 * i + j] = name
    rows.append((999, "one line\nReleased under the MIT License\nthe next line", None, None, None))
    found = {r["doc_id"]: r for r in licenses.scan(util.frame(spark, rows)).collect()}
    assert {k: r["licence"] for k, r in found.items()} == expected | {999: "MIT"}
    rules = [licenses.RULES[r["rules"][0]].sequence for k, r in found.items() if k < 999]
    assert min(map(len, rules)) == 1 and sum(len(x) > 1 for x in rules) >= 4 * 6


def test_ids_of_batches_are_dealt_out(spark, monkeypatch):
    from binforge.llm import substrings

    seen = []
    kept = substrings.TABLES
    assert kept > 1 << 20
    rng = random.Random(5)
    rows = [(i, util.sentence(rng, 40), None, None, None) for i in range(60)]
    rows += [(100 + i, rows[i][1], None, None, None) for i in range(10)]
    for tables in (1, kept):  # one group for all, and many: equal results
        monkeypatch.setattr(substrings, "TABLES", tables)
        seen.append(util.counted((r["row"]["doc_id"], r["kept"]) for r in substrings.dedup(util.frame(spark, rows, parts=6)).collect()))
    assert seen[0] == seen[1] == util.counted((x[0], x[4]) for x in util.substrings(rows))


def test_every_language_is_learnt(spark):
    from binforge.llm import langid

    rng = random.Random(6)
    rows = []
    for i in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(10 * i + j, " ".join(rng.choice(own) for _ in range(30)), f"l{i:02}", None, None) for j in range(3)]
    df = util.frame(spark, rows)
    model = langid.fit(df)
    assert len(set(model["langs"])) == 70
    labels = {r[0]: r[2] for r in rows}
    assert all(labels[r["doc_id"]] == r["lang_pred"] for r in langid.predict(df, model).collect())


def test_nothing_to_learn_rejects_no_text(spark):
    import corpus_pipeline

    rows = [(1, "words of a text", None, None, 1), (2, "123 ...", None, None, 1), (3, None, None, None, None)]
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, util.frame(spark, rows), "").collect()] == [1]


def test_links_of_one_node_can_be_split(spark, monkeypatch):
    from binforge.llm import common

    rng = random.Random(8)
    links = [(0, i) for i in range(1, 60)] + [(rng.randrange(60, 200), rng.randrange(60, 200)) for _ in range(90)]
    of = util.groups(200, links)
    expected = {x: of[x] for x in {x for a, b in links if a != b for x in (a, b)}}
    for most in (common.HOT_LINKS, 10):
        monkeypatch.setattr(common, "HOT_LINKS", most)
        found = common.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len(expected) and {r["node"]: r["component"] for r in found} == expected
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packs_of_production_length():
    from binforge.llm import packing

    rng = random.Random(2)
    histogram = {2048: 40, **{n: rng.randrange(1, 50) for n in rng.sample(range(1, 2048), 300)}}
    found = packing.patterns(histogram)
    assert all(sum(p) <= 2048 and list(p) == sorted(p, reverse=True) for _, p in found)
    assert {n: sum(c * p.count(n) for c, p in found) for n in histogram} == histogram
    one = []  # the same, piece by piece
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = min((s for s in one if s + n <= 2048), default=None)
            one.append(n if fit is None else one.pop(one.index(fit)) + n)
    assert sorted(one) == sorted(x for c, p in found for x in [sum(p)] * c)


def test_remembered_words_are_bounded(monkeypatch):
    import public_tokenizers

    from binforge.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Word{i} a{i}b, C'est déjà {i * 7919}. the The THE. é{i}! ##{i}" for i in range(300)]
    whole = packing._ids(texts, path)
    known = packing._tokenizer(path)
    assert whole == [__import__("numpy").asarray(known.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "_KNOWN_BYTES", 4000)
    packing._tokenizer.cache_clear()
    assert packing._ids(texts, path) == whole and packing._tokenizer(path).size < 4000
    packing._tokenizer.cache_clear()


def test_words_of_texts_longer_than_a_block():
    from binforge.llm import common, langid

    rng = random.Random(6)
    text = util.sentence(rng, 30_000) + "\n" + "y" * 70_000 + " " + util.sentence(rng, 9_000, util.FR)
    words = text.encode().split()
    one = {w: int(common.hash_text(w)[0]) for w in set(words)}
    assert common.hash_text(text.encode()).tolist() == [one[w] for w in words]
    at, weight, size = langid.counts(text)
    monkey, langid.BLOCK = langid.BLOCK, 1 << 30
    try:
        assert all((x == y).all() for x, y in zip((at, weight), langid.counts(text)[:2])) and langid.counts(text)[2] == size
    finally:
        langid.BLOCK = monkey


def test_texts_far_from_all_languages_are_rejected(spark):
    from binforge.llm import langid

    rng = random.Random(4)
    rows = [(i, util.sentence(rng, 40, util.FR if i % 2 else util.EN), "fr" if i % 2 else "en", "s", 1) for i in range(60)]
    odd = [(100, "zzxqj qqzzk xjqzk " * 20, None, "s", 1), (101, "12 34", None, "s", 1), (102, util.sentence(rng, 40), None, "s", 1), (103, None, None, "s", 1)]
    df = util.frame(spark, rows + odd)
    found = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.predict(df, langid.fit(df)).collect()}
    assert found[100][1] and found[101] == ("und", True) == found[103] and found[102] == ("en", False)
    assert not any(found[i][1] for i in range(60)) and all(found[i][0] == ("fr" if i % 2 else "en") for i in range(60))
    # Two languages with the same texts: the first by name.
    both = util.frame(spark, [(i, "same words here again and again", "ab"[i % 2], "s", 1) for i in range(8)])
    assert {r["lang_pred"] for r in langid.predict(both, langid.fit(both)).collect()} == {"a"}
    # At most per_lang rows of a language, whatever their ids.
    many = util.frame(spark, [(None if i < 50 else 7, util.sentence(rng, 9), "en", "s", 1) for i in range(100)])
    assert langid._sample(many, 10).count() == 10


def test_long_conversation(spark):
    from pyspark.sql import functions as F

    from binforge.llm import chat

    rows = [(1, i, "assistant" if i % 2 else "user", f"<|im_end|> turn {i} " * 50) for i in range(2000)]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(x["role"], x["text"]) for x in r["back"]] == [x[2:] for x in rows] and r["valid"]


def test_batches_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from binforge.llm import common

    common.bounded_batches(spark)
    sizes = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 5000).alias("text")).mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert len(sizes) > 4 and max(r["n"] for r in sizes) < 4_000_000
    spark.conf.set(common._BATCH, "123456")
    common.bounded_batches(spark)
    assert spark.conf.get(common._BATCH) == "123456"
    spark.conf.unset(common._BATCH)
