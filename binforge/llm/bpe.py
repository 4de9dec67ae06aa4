"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its pieces are short; each leaf is encoded alone, and neighbours are joined bottom-up. A join
keeps all tokens but those of a window around the seam. The window grows on either side until it ends where a
non-space character is followed by a space or line feed. No match of the splitting pattern spans such a place and the
pattern never looks back, so the tokens outside the window are proven to be those of the joined text. Decoding
concatenates the bytes of the leaves up the same tree.

Nulls count as empty text and give no tokens. Repeated rows and ids are encoded row by row; other columns are dropped.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.common import bounded_batches, pieces_of

LEAF_CHARS = 32_768
FIRST_WINDOW = 64


@functools.lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _is_cut(text: str, p: int) -> bool:
    return text[p] in " \n" and not text[p - 1].isspace()


def _cut_before(text: str, lo: int, mid: int) -> int:
    """The start of the left window: the last proven cut in (lo, mid), or lo."""
    width = FIRST_WINDOW
    end = mid
    while end > lo + 1:
        start = max(lo + 1, mid - width)
        for p in range(end - 1, start - 1, -1):
            if _is_cut(text, p):
                return p
        end, width = start, 2 * width
    return lo


def _cut_after(text: str, mid: int, hi: int) -> int:
    """The end of the right window: the first proven cut in (mid, hi), or hi."""
    width, start = FIRST_WINDOW, mid + 1
    while start < hi:
        end = min(hi, mid + width)
        for q in range(start, end):
            if _is_cut(text, q):
                return q
        start, width = max(start, end), 2 * width
    return hi


def join(encode, text: str, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]]) -> tuple[int, int, list[int]]:
    """The monoid's operation on two neighbouring nodes (start, end, tokens) of ``text``."""
    (lo, mid, a), (_, hi, b) = left, right
    p, q = _cut_before(text, lo, mid), _cut_after(text, mid, hi)
    keep = len(a) - len(encode(text[p:mid])) if p > lo else 0
    skip = len(encode(text[mid:q])) if q < hi else len(b)
    return lo, hi, a[:keep] + encode(text[p:q]) + b[skip:]


def encode_tree(encode, text: str, lo: int = 0, hi: int | None = None, leaf_chars: int = LEAF_CHARS) -> tuple[int, int, list[int]]:
    hi = len(text) if hi is None else hi
    if hi - lo <= max(1, leaf_chars):
        return lo, hi, encode(text[lo:hi])
    mid = (lo + hi) // 2
    return join(encode, text, encode_tree(encode, text, lo, mid, leaf_chars), encode_tree(encode, text, mid, hi, leaf_chars))


def decode_tree(decode, ids: list[int], leaf: int = LEAF_CHARS) -> bytes:
    if len(ids) <= leaf:
        return decode(ids)
    mid = len(ids) // 2
    return decode_tree(decode, ids[:mid], leaf) + decode_tree(decode, ids[mid:], leaf)


def encode(docs: DataFrame, path: str, pattern: str, *, leaf_chars: int = LEAF_CHARS, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array<int>), or with ``digests`` their ids_sha256 and, decoded again, decoded_sha256."""
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path, pattern)
        names = [str(i) for i in range(e.max_token_value + 1)] if digests else []
        for batch in pieces_of(batches, "text"):
            ids = [encode_tree(e.encode_ordinary, t or "", leaf_chars=leaf_chars)[2] for t in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(map(len, ids), pa.int64())}
            if digests:
                out["ids_sha256"] = [hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(decode_tree(e.decode_bytes, x)).hexdigest() for x in ids]
            else:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary) from doc_id and ids; null ids give empty data. Text is ``decode(data, 'UTF-8')``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "data": pa.array([decode_tree(e.decode_bytes, x or []) for x in batch.column(1).to_pylist()], pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
