"""Word hashes: words and windows that a sum of powers can't tell apart."""

from __future__ import annotations

import random

import pytest

from binforge.llm import jaccard, substrings
from binforge.llm.common import hash_text, hash_texts
from tests.llm.util import SCHEMA

_SWAP = str.maketrans("ab", "ba")


def thue_morse(n: int) -> tuple[str, str]:
    a = "a"
    while len(a) < n:
        a += a.translate(_SWAP)
    return a, a.translate(_SWAP)


@pytest.mark.parametrize("n", [1, 2, 8, 16, 32, 64, 256, 1024, 4096])
def test_thue_morse_words_differ(n):
    a, b = thue_morse(n)
    h = hash_text(f"{a} {b}\n{a}".encode())
    assert h[0] == h[2] != h[1]


def test_hashes_follow_the_word_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 80))) for _ in range(20_000)]
    h = hash_text(" ".join(words).encode()).tolist()
    own = dict(zip(words, h))
    assert [own[w] for w in words] == h and len(set(h)) == len(own)
    texts = [" ".join(words[:99]).encode(), b"", b" \n", "\t".join(words[99:]).encode()]
    both, sizes = hash_texts(texts)
    assert both.tolist() == h and sizes.tolist() == [99, 0, 0, 19_901]


@pytest.mark.parametrize("n", [1024, 4096])
def test_unrepeated_windows_stay(spark, n):
    a, b = thue_morse(n)
    lead = " ".join(f"w{i}" for i in range(12))
    turn = thue_morse(16)  # windows of two words in orders that cancel out in a sum
    rows = [(0, f"{lead} {a}"), (1, f"{lead} {b}"), (2, " ".join(turn[0])), (3, " ".join(turn[1])), (4, f"{lead} {a}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    gone = {r.doc_id: len(r.spans) for r in substrings.dedup(docs).select("row.doc_id", "spans").collect()}
    assert gone == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}


@pytest.mark.parametrize("n", [1024, 4096])
def test_disjoint_texts_stay_apart(spark, n):
    a, b = thue_morse(n)
    rows = [(0, f"{a} x y z v"), (1, f"{b} x y z v"), (2, f"{a} x y z v"), (3, "p q r s t"), (4, "q p r s t"), (5, "p q"), (6, "q p")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    found = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}
