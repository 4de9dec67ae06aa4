"""What Python workers hold: they outlive their tasks, and several share an executor's memory."""

import os
import random
import tracemalloc

import numpy as np
import psutil
import pyarrow as pa

from binforge.llm import langid
from binforge.llm.common import pieces_of
from tests.llm.util import sentence


def test_freed_memory_is_given_back():
    """Between batches: freed arrays below one that is still used would stay with the process."""
    used = psutil.Process(os.getpid()).memory_info
    held = [np.ones(12_000) for _ in range(2000)]  # 96 KB each, so none is a mapping of its own
    last = held[-1]
    del held
    before = used().rss
    assert [b.num_rows for b in pieces_of(iter([pa.record_batch({"text": ["a", "b"]})]), "text")] == [2]
    assert last[0] == 1 and before - used().rss > 100_000_000


def test_vectors_are_made_once():
    rng = random.Random(1)
    texts, idf = [sentence(rng, 30) for _ in range(200)] + [""], np.linspace(1, 5, langid.FEATURES).astype(np.float32)
    tracemalloc.start()
    rows = langid.vectors(texts, idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.3 * rows.nbytes
    plain = np.zeros((len(texts), langid.FEATURES), np.float32)
    for v, t in zip(plain, texts):
        at, w, _ = langid.counts(t)
        v[at] = w * idf[at]
    assert np.array_equal(rows, langid._unit(plain)) and np.array_equal(rows[:50], langid.vectors((t for t in texts), idf, 50))
    own = np.arange(len(rows)) % 3 > 0
    tracemalloc.start()
    mean = langid.mean_of(rows, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.2 * rows.nbytes and np.array_equal(mean, rows[own].mean(axis=0))
