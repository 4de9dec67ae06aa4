"""N-gram Jaccard join: size-aware, heavy and light, and exact.

Documents are sets of hashed word n-grams; equal sets are one node. All n-grams are put in one order: those in many
sets last, otherwise by hash. Two sets that reach the threshold share at least l of their first
n - ceil(threshold * n) + l n-grams, which are the keys two sets can meet by:

* small sets enumerate all 2-subsets of that prefix (l = 2), so one common n-gram brings nobody together;
* large sets use its n-grams one by one (l = 1) and meet in inverted lists. Sets just below the boundary do both.

The boundary is where enumerating subsets costs as much as the list entries a key would meet, from a census of all sets.
A list is light if it has at most ``LIGHT`` nodes: all its pairs are counted, and those whose shared keys cannot add up
to the threshold are dropped by that bound. A heavy list only ties its nodes together. Nodes that hang together by
pairs or heavy lists form a cluster; its whole sets are shipped once to one task, which scans their inverted lists and
verifies exactly. A cluster of more than ``TOGETHER`` n-grams is cut into blocks, and each pair of blocks is a task.
The frequent n-grams told to all tasks are ``MOST_FREQUENT`` at most, and only the order depends on them, not the
result.

n-grams and sets are compared by 64-bit hashes. Null texts and texts without a word are empty sets and link with
nothing. Rows that share an id are sets of their own; rows without an id take part, and a component's id is the
smallest id in it. Repeated rows get equal results. Texts are read whole however long: a long one is a large set, shipped
whole only to the tasks of its cluster. Other columns are dropped.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.common import BROADCAST_ROWS, components, folded, give_back, hash_texts, parts, pieces_of, stage, text_key

WIDTH = 5
PERCENT = 75
LIGHT = 48
MOST_FREQUENT = 1 << 20
#: Entries that one list group, and n-grams that one block of a cluster, should hold.
GROUP = 1_000_000
TOGETHER = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_SUBSET = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of hashed n-grams of each text."""
    h, sizes = hash_texts([(t or "").encode().lower() for t in texts])
    code = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        code = folded(code, h[j : j + len(code)])
    code = _mix(code + np.uint64(width))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(code[at : at + n - width + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for x in h[at : at + n]:
                one = folded(one, x)
            out.append(_mix(one + np.uint64(n)))
        else:
            out.append(h[:0])
        at += n
    return out


def node_of(codes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63)


def least_shared(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def _within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _dealt(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bucket, and where each bucket starts (count + 1 numbers)."""
    bucket = (_mix(keys) % np.uint64(count)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if count < 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(count + 1))


def census_groups(bytes_: int, least: int) -> int:
    """Groups that n-grams are counted in: six bytes a word or more, of whose n-grams a half is counted."""
    return max(least, -(-bytes_ // (12 * GROUP)), 1)


def _census(rows: DataFrame, width: int) -> tuple[np.ndarray, float, int]:
    """Upper halves of the most frequent n-grams, mean length of a light list, and number of n-grams.

    Counts n-grams in the lower half of the hash range, which is where prefixes lie, by the upper half of their bits.
    """
    count = census_groups(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0, parts(rows.sparkSession))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            sets = {node_of(c): c for c in shingle_sets(batch.column("text").to_pylist(), width)}
            if codes := [c[: np.searchsorted(c, np.uint64(1 << 63))] for c in sets.values()]:
                codes, n = np.unique((np.concatenate(codes) >> np.uint64(32)).astype(np.uint32), return_counts=True)
                order, at = _dealt(codes.astype(np.uint64), count)
                once = n[order] == 1
                codes, n = codes[order], n[order]
                cut = [(i, slice(at[i], at[i + 1])) for i in range(count) if at[i] < at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in cut], pa.int32()), pa.array([codes[s][once[s]].tobytes() for _, s in cut], pa.binary()),
                        pa.array([codes[s][~once[s]].tobytes() for _, s in cut], pa.binary()), pa.array([n[s][~once[s]].astype(np.int32).tobytes() for _, s in cut], pa.binary()),
                    ],
                    names=["bucket", "once", "more", "counts"],
                )

    def tally(table: pa.Table) -> pa.Table:
        give_back()  # of the group before
        once, more, counts = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("once", np.uint32), ("more", np.uint32), ("counts", np.int32)))
        codes = np.concatenate((once, more))
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], codes[order[1:]] != codes[order[:-1]])))
        n = np.add.reduceat(np.concatenate((np.ones(len(once), np.int64), counts))[order], first)
        often, light = n > LIGHT // 2, n[n <= LIGHT]
        return pa.table({"code": np.concatenate((codes[order[first]][often].astype(np.int64), [-1, -2])), "n": np.concatenate((n[often], [light.sum(), (light * light).sum()]))})

    sent = rows.select("text").mapInArrow(send, "bucket int, once binary, more binary, counts binary")
    found = stage(sent.groupBy("bucket").applyInArrow(tally, "code long, n long"), "ngrams")
    total = dict(found.where("code < 0").groupBy("code").agg(F.sum("n")).collect())
    top = found.where("code >= 0").orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).select("code").toPandas()["code"]
    entries = total.get(-1, 0)
    return np.sort(top.to_numpy(np.int64).astype(np.uint32)), (total.get(-2, 0) / entries if entries else 1.0), 2 * entries


def boundary(light_length: float, percent: int = PERCENT) -> int:
    """The largest small set: its 2-subsets cost no more than its single keys and the entries these meet."""
    n = 1
    while (p := n + 1 - least_shared(n + 1, percent) + 1) * (p + 1) / 2 <= p * (1 + light_length):
        n += 1
    return n


def keys_of(codes: np.ndarray, frequent: np.ndarray, small: int, percent: int = PERCENT) -> np.ndarray:
    """Keys of one set that isn't empty."""
    n = len(codes)
    p = n - least_shared(n, percent) + 1
    half = int(np.searchsorted(codes, np.uint64(1 << 63)))
    for look in (min(half, 2 * p + 8), half):  # most sets have their prefix within the first codes
        late = _within((codes[:look] >> np.uint64(32)).astype(np.uint32), frequent)
        if look - int(late.sum()) > p:
            break
    first = codes[:look][~late][: p + 1]
    if len(first) <= p:
        first = np.concatenate((first, codes[half:], codes[:half][late]))[: p + 1]
    keys = []
    if n <= small and n > 1:
        i, j = np.triu_indices(len(first), 1)
        keys.append(_mix((first[i] * _M + first[j]) ^ _SUBSET))
    if 100 * n > percent * small or n > small:
        keys.append(first[:p])
    return np.concatenate(keys) if keys else first[:0]


def _compatible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _lists(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows' nodes (doc_id, key, node, n), what lists found (see ``meet``), and the largest small set."""
    frequent, light, total = _census(rows, width)
    small = boundary(light, percent)
    count = max(parts(rows.sparkSession), -(-total // (3 * GROUP)))
    told = rows.sparkSession.sparkContext.broadcast(frequent)  # MOST_FREQUENT numbers at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            nodes = [node_of(c) for c in sets]
            one = {node: c for node, c in zip(nodes, sets) if len(c)}
            made = [keys_of(c, told.value, small, percent) for c in one.values()]
            if one:
                size = np.fromiter(map(len, made), np.int64, len(made))
                keys = np.concatenate(made)
                of = np.repeat(np.arange(len(made)), size)
                order, at = _dealt(keys, count)
                keys, of = keys[order], of[order]
                about = [np.fromiter(x, t, len(one)) for x, t in ((one, np.int64), (map(len, one.values()), np.int32))]
                blobs = []
                for i in range(count):
                    if at[i] < at[i + 1]:
                        own = of[at[i] : at[i + 1]]
                        turn = np.append(0, np.flatnonzero(np.diff(own)) + 1)
                        blobs.append((i, keys[at[i] : at[i + 1]].tobytes(), *(x[own[turn]].tobytes() for x in about), np.diff(np.append(turn, len(own))).astype(np.int32).tobytes()))
            else:
                blobs = []
            k, m = len(nodes), len(blobs)
            b = list(zip(*blobs)) or [()] * 5
            none = [None] * k
            arrays = [pa.array([*batch.column("doc_id").to_pylist(), *[None] * m], pa.int64()), pa.array([*batch.column("key").to_pylist(), *[None] * m], pa.int64()), pa.array([*nodes, *[None] * m], pa.int64()), pa.array([*map(len, sets), *[None] * m], pa.int64()), pa.array([*none, *b[0]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([*none, *x], pa.binary()) for x in b[1:])], names=["doc_id", "key", "node", "n", "bucket", "keys", "nodes", "sizes", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        """Rows a, b, k: pairs of light lists with k shared keys, ties of heavy lists as k = 0, and a's number of heavy keys as -k."""
        give_back()  # of the list group before
        blob = [table.column(c).to_pylist() for c in ("keys", "nodes", "sizes", "counts")]
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in blob[0]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in blob[3]])
        node, size = (np.repeat(np.concatenate([np.frombuffer(x, t) for x in blob[i]]), counts) for i, t in ((1, np.int64), (2, np.int32)))
        order = np.lexsort((node, keys))
        keys, node, size = keys[order], node[order], size[order].astype(np.int64)
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])))
        keys, node, size = keys[new], node[new], size[new]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        length = np.diff(np.append(start, len(keys)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(length[(length > 1) & (length <= LIGHT)]):  # all lists of one length at once
            at = start[length == m][:, None]
            i, j = np.triu_indices(m, 1)
            i, j = (at + i).ravel(), (at + j).ravel()
            fine = _compatible(size[i], size[j], percent)
            a.append(node[i[fine]]), b.append(node[j[fine]])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, int)
        out = [(a[first], b[first], np.diff(np.append(first, len(a))))]
        heavy = defaultdict(int)
        for s, m in zip(start[length > LIGHT], length[length > LIGHT]):
            own = node[s : s + m]
            out.append((np.repeat(own[:1], m - 1), own[1:], np.zeros(m - 1, np.int64)))
            for x in own.tolist():
                heavy[x] += 1
        if heavy:
            x = np.fromiter(heavy, np.int64, len(heavy))
            out.append((x, x, -np.fromiter(heavy.values(), np.int64, len(heavy))))
        return pa.table({c: np.concatenate(x).astype(np.int64) for c, x in zip("abk", zip(*out))})

    sent = stage(rows.mapInArrow(send, "doc_id long, key long, node long, n long, bucket int, keys binary, nodes binary, sizes binary, counts binary"), "shingles")
    met = sent.where("bucket is not null").drop("doc_id", "key", "node", "n").groupBy("bucket").applyInArrow(meet, "a long, b long, k long")
    return sent.where("bucket is null").select("doc_id", "key", "node", "n"), stage(met, "lists"), small


def _verify(rows: DataFrame, nodes: DataFrame, edges: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars (a, b) with the components of all pairs, within the clusters of ``edges``, that reach the threshold."""
    cluster = components(edges)
    size = nodes.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "key")).alias("_r"))  # one row stands for each node
    own = stage(cluster.join(size, "node"), "clusters")
    whole = stage(own.groupBy("component").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("blocks")).withColumnRenamed("component", "_c"), "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = own.join(whole, F.col("component") == F.col("_c")).withColumn("block", block)
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.xxhash64("component", F.least(i, F.col("block")), F.greatest(i, F.col("block"))).alias("task"), (i != F.col("block")).alias("across")))
    wanted = stage(own.select(F.col("_r.doc_id").alias("_d"), F.col("_r.key").alias("_k"), "component", "node", "block", "blocks"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS  # rows of fixed width
    chosen = rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("text", "node", "block", tasks.alias("tasks"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            texts, node, block, tasks = (batch.column(c).to_pylist() for c in ("text", "node", "block", "tasks"))
            out = [(t["task"], t["across"], n, b, c) for n, b, ts, c in zip(node, block, tasks, map(np.ndarray.tobytes, shingle_sets(texts, width))) for t in ts]
            x = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.bool_()), pa.array(x[2], pa.int64()), pa.array(x[3], pa.int32()), pa.array(x[4], pa.binary())], names=["task", "across", "node", "block", "codes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for _, group in itertools.groupby((x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("task", "across", "node", "block", "codes")))), key=lambda x: x[0]):
            members = {x[2]: x for x in group}  # a repeated row of the documents sends its set again
            links += linked([(x[2], x[3], np.frombuffer(x[4], np.uint64)) for x in members.values()], next(iter(members.values()))[1], percent)
            if len(links) > 10_000:
                yield _pairs(links)
                links = []
        yield _pairs(links)
        give_back()

    sent = chosen.mapInArrow(send, "task long, across boolean, node long, block int, codes binary")
    return stage(sent.repartition("task").sortWithinPartitions("task").mapInArrow(check, "a long, b long"), "links")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked(members: list[tuple[int, int, np.ndarray]], across: bool, percent: int) -> list[tuple[int, int]]:
    """A star (node, smallest node) for each component of links among (node, block, codes), found by scanning inverted lists; ``across``: links of two blocks only."""
    size = np.fromiter((len(c) for _, _, c in members), np.int64, len(members))
    block = np.fromiter((b for _, b, _ in members), np.int64, len(members))
    code = np.unique(np.concatenate([c for _, _, c in members]), return_inverse=True)[1]
    of = np.repeat(np.arange(len(members)), size)
    order = np.argsort(code, kind="stable")
    lists, starts = of[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    at = np.append(0, np.cumsum(size))
    up = np.arange(len(members))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(members)):
        own = code[at[i] : at[i + 1]]
        first, n = starts[own], starts[own + 1] - starts[own]
        many = n > 1
        if not many.any():
            continue
        first, n = first[many], n[many]
        met = lists[np.repeat(first - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())]
        both = np.bincount(met, minlength=len(members))
        fits = (100 + percent) * both >= percent * (size[i] + size)
        fits[: i + 1] = False
        if across:
            fits &= block != block[i]
        for j in np.flatnonzero(fits).tolist():
            if (x := root(i)) != (y := root(j)):
                up[max(x, y)] = min(x, y)
    roots = [root(i) for i in range(len(members))]
    least: dict[int, int] = {}
    for (node, _, _), r in zip(members, roots):
        least[r] = min(node, least.get(r, node))
    return [(node, least[r]) for (node, _, _), r in zip(members, roots) if node != least[r]]


def join(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, node (id of the set), component (of nodes) and component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(), F.lit(0)).alias("key"), "text")
    nodes, met, small = _lists(rows, width, percent)
    size = nodes.groupBy("node").agg(F.first("n").alias("n"))
    heavy = met.where("k < 0").groupBy(F.col("a").alias("_h")).agg(F.sum(-F.col("k")).alias("heavy"))
    about = size.join(heavy, F.col("node") == F.col("_h"), "left").select("node", "n", F.coalesce("heavy", F.lit(0)).alias("heavy"))
    pairs = met.where("k > 0").groupBy("a", "b").agg(F.sum("k").alias("k"))
    for x in "ab":
        pairs = pairs.join(about.select(F.col("node").alias(f"_{x}"), F.col("n").alias(f"n{x}"), F.col("heavy").alias(f"h{x}")), F.col(x) == F.col(f"_{x}"))
    # Shared n-grams are at most those of the prefixes (counted, or in heavy lists) and what follows one of the prefixes.
    # Small sets meet by subsets, whose number bounds nothing: their pairs are all verified.
    most = F.col("k") + F.least("ha", "hb") + F.greatest(*[F.expr(f"(n{x} * {percent} + 99) div 100 - 1") for x in "ab"])
    possible = (F.least("na", "nb") <= small) | (most * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    edges = pairs.where(possible).select("a", "b").union(met.where("k = 0").select("a", "b"))
    found = components(_verify(rows, nodes, edges, width, percent))
    out = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = stage(out, "grouped")
    first = stage(out.where("n > 0").groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("_first")), "first")
    out = out.join(first, (F.col("component") == F.col("_c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "node", "component", F.when(F.col("n") > 0, F.col("_first")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
