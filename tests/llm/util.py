"""Small tables with planted cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a table may have besides, with names the operators use inside.
CLASH = ["key", "node", "bin", "n_words", "kept", "row", "spans", "length", "offset", "_k", "component", "host", "lines", "rejected", "lang_pred", "score"]

EN = "the of and that there with house water over people small think great where through much before line right move".split()
FR = "le la les être avec pour dans maison eau petit où été très même année heure déjà français".split()


def sentence(rng: random.Random, n: int, words=EN) -> str:
    return " ".join(rng.choice(words) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, shared passages, repeated lines, nulls, empty and long texts, and repeated ids."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 60), "Common line 7 of many documents here today"
    texts: list[str | None] = []
    for i in range(n):
        body = "\n".join(sentence(rng, rng.randrange(8, 40), FR if i % 3 == 0 else EN) for _ in range(rng.randrange(1, 6)))
        if i % 5 == 0:
            body = f"{body}\n{passage} {sentence(rng, 5)}"
        if i % 2 == 0:
            body += f"\n{line}"
        texts.append(body)
    texts += texts[3:6]  # exact copies
    for i in (7, 7, 8):  # near copies
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, None, "", " \n\t ", "short", "four words are here", "four words are here", "##### $$$ %%% 123", "x" * 5000, "Ünïcödé wörds ünd　mehr " * 20, "the the the the the " * 30, "a\x1cb\x1cc " * 20, sentence(rng, 4000)]
    rows = [(i, t, None if i % 11 == 0 else "fr" if i % 3 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((2, "another text under an id that is taken " + sentence(rng, 30), "en", "src0", 1))
    rows.append((None, texts[4], "en", "src1", 1))
    rows.append((None, "without an id " + sentence(rng, 30), None, None, None))
    rows += [rows[9], rows[9], rows[-1]]  # repeated rows
    return rows


def frame(spark, rows: list[tuple], clash: bool = True, parts: int = 3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return df


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def counted(rows) -> Counter:
    return Counter(map(tuple, rows))


def order(doc_id) -> float:
    return float("inf") if doc_id is None else doc_id


def substrings(rows: list[tuple], width: int = 13) -> list[tuple]:
    first: dict[tuple, float] = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(order(r[0]), first.get(k, float("inf")))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(r[0]):
                gone[i : i + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    return out


def shingle_sets(rows: list[tuple], width: int = 5) -> list[frozenset]:
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def groups(n: int, links) -> list[int]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def jaccard(rows: list[tuple], percent: int = 75) -> list[tuple]:
    sets = shingle_sets(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = groups(len(rows), links)
    ids: dict[int, list] = {}
    for i, g in enumerate(of):
        if rows[i][0] is not None:
            ids.setdefault(g, []).append(rows[i][0])
    return [(r[0], len(s), (min(ids.get(g, [None])) if s else r[0])) for r, s, g in zip(rows, sets, of)]
