"""Removal of repeated word sequences by prefix-partitioned suffix trees.

Every suffix of a document that has ``width`` words or more is a leaf, cut at depth ``width``. A census over all
documents finds the first words that begin too many suffixes for one group; their prefixes grow by a word, up to
``LEVELS`` words and then the whole window, until they are small enough. Prefixes are dealt to groups of bounded size,
and each group is one subtree: its leaves in the order of their codes, where leaves of one code lie below one internal
node of depth ``width`` or more. A node's label is its smallest doc_id; leaves of larger ids are repeats, and repeats
that follow each other in a document make its maximal repeated spans.

Edges are 64-bit codes of words and windows, since shipping words would cost many times the input. Each task sends a
node's leaves to the group only from its first document of the batch: later ones are known repeats already, so a
passage in a third of all documents arrives once a batch.

A row is known by its id and a hash of its text. Null text has no words; rows of equal id do not count as earlier than
each other; a null id comes after all others. Repeated rows get equal results. Texts are read whole however long: a long
one is a batch of its own, and its leaves are dealt over all groups. Other columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.common import folded, give_back, hash_text, hash_texts, parts, pieces_of, stage, text_key

WIDTH = 13
LEVELS = 4
#: Suffixes that one group should hold.
GROUP = 1_500_000
TABLES = 1 << 30  # the ids and keys of batches are dealt over this many groups of negative numbers, some one to a group
LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefixes(h: np.ndarray, n: int, most: int) -> Iterator[np.ndarray]:
    """Codes of the first 1, 2, ... most words of each of the n first suffixes."""
    code = np.zeros(n, np.uint64)
    for j in range(most):
        code = folded(code, h[j : j + n])
        yield code


def _within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def groups(h: np.ndarray, n: int, hot: list[np.ndarray], count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The group and the window's code of each of the n suffixes."""
    key, left = np.zeros(n, np.uint64), np.ones(n, bool)
    for level, code in enumerate(prefixes(h, n, width)):
        if level < len(hot):
            now = left & ~_within(code, hot[level])
            key[now] = code[now]
            left &= ~now
    code = _mix(code)
    key[left] = code[left]
    return (_mix(key) % np.uint64(count)).astype(np.int32), code


def _census(docs: DataFrame, width: int) -> tuple[int, list[np.ndarray]]:
    """Number of groups, and the codes of the prefixes, by level, that begin too many suffixes for one."""
    levels = min(LEVELS, width)
    spark = docs.sparkSession
    # Two bytes a word at least: more groups than there will be, so that no prefix above the limit below stays out.
    most = max(parts(spark), (docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // (2 * GROUP) + 1)
    share = max(2000, 8 * most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            # One array for the batch: suffixes may run on into the next text here, which only shifts the balance.
            h = hash_text(b" ".join((t or "").encode() for t in batch.column("text").to_pylist()))
            n = max(0, len(h) - levels + 1)
            rows = [(-1, 0, n)]
            within = np.arange(n)
            for level, code in enumerate(prefixes(h, n, levels)):
                found, c = np.unique(code[within], return_counts=True)
                often = c * share >= n  # what is common in all is common in some batches; rows are few
                rows += [(level, int(k), int(v)) for k, v in zip(found[often].view(np.int64), c[often])]
                within = within[_within(code[within], found[often])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["level", "code", "n"])

    found = stage(docs.mapInArrow(run, "level long, code long, n long").groupBy("level", "code").agg(F.sum("n").alias("n")), "prefixes")
    total = found.where("level = -1").agg(F.sum("n")).first()[0] or 0
    count = max(parts(spark), -(-total // GROUP), 1)
    limit = max(1, total // (4 * count))
    hot: list[list[int]] = [[] for _ in range(levels)]
    for level, code, _ in found.where((F.col("level") >= 0) & (F.col("n") > limit)).collect():  # at most 4 * count a level
        hot[level].append(code)
    return int(count), [np.sort(np.array(x, np.int64).view(np.uint64)) for x in hot]


def repeats(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, dict]:
    """doc_id (null ids as the largest), key and found: by group, which of the row's suffixes there are repeats."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), F.coalesce(text_key(), F.lit(0)).alias("key"), "text")
    count, hot = _census(rows.select("text"), width)
    spec = {"count": count, "hot": hot, "width": width}

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
            texts = batch.column("text").to_pylist()
            order = np.argsort(ids, kind="stable")
            h, sizes = hash_texts([(texts[i] or "").encode() for i in order])
            n = len(h) - width + 1
            if n <= 0:
                continue
            of, end = np.repeat(order, sizes)[:n], np.repeat(np.cumsum(sizes), sizes)[:n]
            group, code = groups(h, n, hot, count, width)
            whole = np.arange(width, n + width) <= end
            of, group, code = of[whole], group[whole], code[whole]
            if not len(of):
                continue
            order = np.argsort(code, kind="stable")
            first = np.concatenate(([True], code[order[1:]] != code[order[:-1]]))
            smallest = ids[of[order[np.flatnonzero(first)]]][np.cumsum(first) - 1]
            known = np.empty(len(of), bool)
            known[order] = ids[of[order]] > smallest
            order = np.argsort(group.astype(np.uint16) if count < 1 << 16 else group, kind="stable")
            of, group, code, known = of[order], group[order], code[order], known[order]
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
            number = xxhash.xxh3_64_intdigest(ids.tobytes() + keys.tobytes()) - (1 << 63)
            out, start = [(number, -1 - number % TABLES, ids.tobytes(), keys.tobytes(), b"", b"", b"")], 0
            for end in ends:
                own = of[start:end]
                at = np.append(0, np.flatnonzero(np.diff(own)) + 1)
                k = known[start:end]
                docs_ = own[at]
                out.append((number, int(group[start]), ids[docs_].tobytes(), docs_.astype(np.int32).tobytes(), np.diff(np.append(at, end - start)).astype(np.int32).tobytes(), np.packbits(k).tobytes(), code[start:end][~k].tobytes()))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(x, (pa.int64(), pa.int32(), pa.binary())[min(i, 2)]) for i, x in enumerate(zip(*out))], names=["batch", "group", "ids", "rows", "counts", "known", "codes"])

    def subtree(table: pa.Table) -> pa.Table:
        """Of each batch, the rows with repeats in this group: rows (places in the batch), counts and bits."""
        give_back()  # of the group before
        columns = [table.column(c).to_pylist() for c in ("batch", "ids", "rows", "counts", "known", "codes")]
        group = table.column("group")[0].as_py()
        if group < 0:
            return pa.table({"batch": columns[0], "group": pa.array([group] * table.num_rows, pa.int32()), "rows": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary()), "bits": pa.array([b""] * table.num_rows, pa.binary())})
        code, label, blobs = [], [], []
        for batch, ids, own, counts, known, codes in zip(*columns):
            counts = np.frombuffer(counts, np.int32)
            known = np.unpackbits(np.frombuffer(known, np.uint8), count=int(counts.sum())).astype(bool)
            blobs.append((batch, np.frombuffer(own, np.int32), counts, known))
            code.append(np.frombuffer(codes, np.uint64)), label.append(np.repeat(np.frombuffer(ids, np.int64), counts)[~known])
        code, label = np.concatenate(code), np.concatenate(label)
        order = np.argsort(code, kind="stable")
        nodes = np.flatnonzero(np.concatenate(([True], code[order[1:]] != code[order[:-1]]))) if len(code) else np.zeros(0, int)
        smallest = np.minimum.reduceat(label[order], nodes) if len(nodes) else label
        repeated = np.empty(len(code), bool)
        repeated[order] = label[order] > np.repeat(smallest, np.diff(np.append(nodes, len(code))))
        out, at = [], 0
        for batch, own, counts, known in blobs:
            bits = known.copy()
            n = int((~known).sum())
            bits[~known] = repeated[at : at + n]
            at += n
            any_ = np.add.reduceat(bits, np.append(0, np.cumsum(counts))[:-1], dtype=np.int64) > 0
            if any_.any():
                out.append((batch, group, own[any_].tobytes(), counts[any_].tobytes(), np.packbits(bits[np.repeat(any_, counts)]).tobytes()))
        x = list(zip(*out)) or [()] * 5
        return pa.table({"batch": pa.array(x[0], pa.int64()), "group": pa.array(x[1], pa.int32()), "rows": pa.array(x[2], pa.binary()), "counts": pa.array(x[3], pa.binary()), "bits": pa.array(x[4], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """What all groups found for the rows of one batch: for each row, group after group, its repeated suffixes as bits."""
        give_back()
        found: dict[int, list[bytes]] = {}
        ids = keys = np.zeros(0, np.int64)
        for group, own, counts, bits in zip(*(table.column(c).to_pylist() for c in ("group", "rows", "counts", "bits"))):
            if group < 0:
                ids, keys = np.frombuffer(own, np.int64), np.frombuffer(counts, np.int64)
                continue
            counts = np.frombuffer(counts, np.int32)
            bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(counts.sum()))
            at = 0
            for row, n in zip(np.frombuffer(own, np.int32).tolist(), counts.tolist()):
                found.setdefault(row, []).append(struct.pack("<ii", group, n) + np.packbits(bits[at : at + n]).tobytes())
                at += n
        rows = np.fromiter(found, np.int64, len(found))
        return pa.table({"doc_id": pa.array(ids[rows], pa.int64()), "key": pa.array(keys[rows], pa.int64()), "found": pa.array([b"".join(x) for x in found.values()], pa.binary())})

    sent = rows.mapInArrow(leaves, "batch long, group int, ids binary, rows binary, counts binary, known binary, codes binary")
    trees = sent.groupBy("group").applyInArrow(subtree, "batch long, group int, rows binary, counts binary, bits binary")
    found = trees.groupBy("batch").applyInArrow(gather, "doc_id long, key long, found binary")
    # Rows that are equal found the same, in one batch or several.
    return found.groupBy("doc_id", "key").agg(F.first("found").alias("found")), spec


def unpacked(found: bytes) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while at < len(found):
        group, n = struct.unpack_from("<ii", found, at)
        at += 8
        end = at + (n + 7) // 8
        yield group, np.unpackbits(np.frombuffer(found[at:end], np.uint8), count=n).astype(bool)
        at = end


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """row (a struct of all columns of ``docs``), n_words, spans (array of start and end in words) and kept.

    Spans are the maximal runs of words covered by windows that also start in a document of smaller id; ``kept`` is
    the words left, joined by one space.
    """
    found, spec = repeats(docs, width)
    hot, count = spec["hot"], spec["count"]
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_own"), F.col("found").alias("_found"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(int(LAST))).alias("_d"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("_k"))
    joined = rows.join(found, (F.col("_d") == F.col("_id")) & (F.col("_k") == F.col("_own")), "left").select("row", "_found")
    kinds = f"row {joined.schema['row'].dataType.simpleString()}"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "row.text"):
            sizes, spans, kept = [], [], []
            for text, pieces in zip(pc.struct_field(batch.column("row"), "text").to_pylist(), batch.column("_found").to_pylist()):
                words, own = (text or "").encode().split(), []
                sizes.append(len(words))
                if pieces:
                    h = hash_text((text or "").encode())
                    group, _ = groups(h, len(h) - width + 1, hot, count, width)
                    edge = np.zeros(len(words) + 1, np.int32)
                    for number, bits in unpacked(pieces):
                        at = np.flatnonzero(group == number)[bits]
                        edge[at] += 1
                        edge[at + width] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
                    own = [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                spans.append(own), kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["row", "n_words", "spans", "kept"])

    return joined.mapInArrow(run, f"{kinds}, n_words long, spans array<struct<start: int, end: int>>, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("row.doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
