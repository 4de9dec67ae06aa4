"""Packing token sequences shortest-pack-first over the length histogram.

Documents are tokenised and cut into full pieces and one remainder. The histogram of piece lengths has as many bins as
a sequence has tokens, so it and the packing patterns made from it are bounded whatever the corpus. Lengths are placed
longest first, each into the shortest packs that still have room, which changes counts of patterns, not single packs.
A piece finds its pattern by its rank among the pieces of its length; ranks are taken within salted groups of bounded
size, as many as the commonest length needs, so none is numbered by one task.

Null text counts as empty: a document of the end token alone. Repeated rows and ids are packed row by row. A sequence
is padded to the full length unless what it holds is a power of two (``padded_to``).
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binforge.llm.common import give_back, parts, pieces_of, stage

SEQUENCE = 2048
END_ID = 1
#: Pieces that one salted group should hold.
GROUP = 100_000
_KNOWN_BYTES = 96 << 20  # what a task remembers of words and chunks, about
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?])?")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class _Ids(dict):
    """The ids, as bytes, of a word as the vocabulary's model splits it, or of a chunk between spaces.

    Most chunks are Latin letters and one mark, or ASCII: their words are cut here as the tokenizer's own pattern cuts
    them, and remembered in lower case. The tokenizer itself encodes all others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.tokenizer.model
        self.before: dict[str, bytes] = {}  # what was remembered in the time before
        self.size = 0

    def put(self, key: str, ids: bytes) -> bytes:
        """Remember; at half of the limit a new time begins, and what is not met in it is forgotten after it."""
        if self.size > _KNOWN_BYTES // 2:
            self.before = dict(self)
            self.clear()
            self.size = 0
        self[key] = ids
        self.size += 2 * len(key) + len(ids) + 160  # with the objects' heads and their places in the table
        return ids

    def forget(self) -> None:
        """A worker outlives its task; what the next stage runs in it needs the memory."""
        self.clear()
        self.before, self.size = {}, 0
        give_back()

    def word(self, word: str) -> bytes:
        found = self.get(word)
        if found is None:
            found = self.before.get(word)
            if found is None:
                own = word if word.isascii() else self.level.pre_tokenize_str(word)[0][0]
                found = struct.pack(f"<{len(ids := [x.id for x in self.model.tokenize(own)])}I", *ids)
            self.put(word, found)
        return found

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        low = chunk.lower()
        if m := _PLAIN.fullmatch(low):
            return self.word(m[1]) + (self.word(m[2]) if m[2] else b"")
        if (found := self.before.get(chunk)) is not None:
            return self.put(chunk, found)
        if low.isascii() and low.isprintable():
            return self.put(chunk, b"".join(map(self.word, _ASCII.findall(low))))
        return self.put(chunk, np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes())


@functools.lru_cache(2)
def _tokenizer(path: str) -> _Ids:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Ids(path)


def _ids(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and never merges across it, so each chunk between spaces is encoded once.
    """
    known = _tokenizer(path)
    return [b"".join(map(known.__getitem__, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


def tokenize(docs: DataFrame, path: str, *, most: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``most`` tokens: doc_id, start, length, ids_crc32, doc_tokens, and ids (binary) if kept."""
    end = np.asarray([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            out = defaultdict(list)
            for doc, ids in zip(batch.column(0).to_pylist(), _ids([t or "" for t in batch.column(1).to_pylist()], path)):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, most):
                    piece = ids[4 * at : 4 * (at + most)]
                    for k, v in (("doc_id", doc), ("start", at), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", n), ("ids", piece)):
                        out[k].append(v)
            if not keep_ids:
                del out["ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))
        _tokenizer(path).forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def patterns(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths): longest lengths first, each piece to the shortest pack of those with room.

    Equal packs are moved together. A piece that no pack has room for opens one, which is then the only pack with room
    for the next pieces of its length: so new packs are filled with that length one after the other.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in room.items() if packs), default=0)
            if space >= length:
                count, pack = room[space].pop()
                used = min(left, count)
                if used < count:
                    room[space].append((count - used, pack))
                room[space - length].append((used, pack + (length,)))
                left -= used
            else:
                fit = most // length
                if left >= fit:
                    room[most - fit * length].append((left // fit, (length,) * fit))
                if left % fit:
                    room[most - left % fit * length].append((1, (length,) * (left % fit)))
                left = 0
    return [x for s in sorted(room) for x in room[s]]


def pack(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """``pieces`` (a stored table with doc_id, start, length) with sequence_id, offset and padded_to."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``most`` rows
    salts = max(parts(spark), -(-max(histogram.values(), default=0) // GROUP))
    slots, used, base = [], defaultdict(int), 0
    for count, lengths in patterns(histogram, most):
        offset, total = 0, sum(lengths)
        full = total if total & (total - 1) == 0 else most
        for length in lengths:
            slots.append((length, used[length], used[length] + count, base - used[length], offset, full))
            used[length] += count
            offset += length
        base += count
    slots = spark.createDataFrame(slots, "length long, _from long, _to long, _shift long, offset long, padded_to long")
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")).cast("long") - 1)
    # How many pieces of a length the groups before a salted one hold: a row for each group, joined where the ranks were taken.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = pieces.groupBy(F.col("length").alias("_length"), F.col("_salt").alias("_group")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    ranked = ranked.join(before, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_group"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # Patterns are made of ``most`` lengths at most, so their slots are few whatever the corpus.
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (ranked["_rank"] >= slots["_from"]) & (ranked["_rank"] < slots["_to"])).drop(slots["length"])
    return placed.withColumn("sequence_id", F.col("_rank") + F.col("_shift")).select(*[c for c in pieces.columns if c != "_salt"], "sequence_id", "offset", "padded_to")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence: sequence_id, length, padded_to, ids (binary) and the doc_ids in it. Needs kept ids."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.max("padded_to").alias("padded_to"), F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("_p"))
    return rows.select("sequence_id", "length", "padded_to", F.aggregate("_p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("_p.doc_id").alias("doc_ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(stage(tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False), "pieces"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
