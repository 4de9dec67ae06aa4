"""Ranked lexical search, document at a time over compressed postings.

Each task indexes the documents it reads, some ``SHARD`` bytes of text at a time: a term's postings are places of
documents in the order of doc_id, as gaps of variable length, and the term's occurrences there, in runs of ``RUN``
postings. Numbers of documents and terms, and how many documents hold a term, are sums over the index by Spark.

A query reads a shard by a k-way merge. A heap holds the end of the current run of each of its lists; the least of them
is a frontier up to which all lists are decoded, so all documents up to it get their whole scores, in order. Then lists
at the frontier decode their next run. A heap of bounded size keeps the best documents, keyed by score and then smaller
doc_id, and goes along from shard to shard; what groups of shards keep is merged by Spark.

Terms are runs of ASCII letters and digits and all characters beyond ASCII, with A-Z in lower case; their weights and
scores are those of ``search``, whole numbers throughout. Null and empty texts have no terms and are not counted.
Documents without an id count, and come after those with one in ties, with a null doc_id; documents that share an id
are documents of their own. Items that share an item_id, or repeat, have their own results. Items without a known term
have none. A long text is indexed whole; it is a shard of its own if it is larger than one. Other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.blocks import gathered, met, ranked
from binforge.llm.common import bounded_batches, pieces_of, stage

K = 10
SHARD = 24_000_000  # bytes of text
RUN = 1024  # postings of a run
BLOCK = 256  # items of a block
LAST = np.iinfo(np.int64).max
_UPPER, _TERM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(b + 32 if b in _UPPER else b if b in _TERM or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order; what separates them is ASCII, so bytes will do."""
    return (text or "").encode().translate(_PLAIN).split()


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^35 as 7 bits a byte, the last one below 128, and where each begins."""
    size = 1 + (x[:, None] >= 1 << np.array([7, 14, 21, 28])[None, :]).sum(axis=1) if len(x) else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[begin[own] + k] = (x[own] >> (7 * k) & 127) | np.where(k < size[own] - 1, 128, 0)
    return out, begin


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    end = np.flatnonzero(last) + 1
    begin = np.concatenate(([0], end[:-1]))
    at = np.arange(len(data)) - np.repeat(begin, end - begin)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), begin)


def shard_of(number: int, docs: list[tuple[int, np.ndarray]], vocabulary: list[bytes], run: int = RUN) -> dict:
    """The index of documents, given by id and numbers of their terms in order."""
    docs = sorted(docs, key=lambda d: d[0])
    size = np.array([len(t) for _, t in docs], np.int64)
    key = np.sort(np.concatenate([t for _, t in docs]).astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), size))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(first, len(key)))
    term, doc = np.divmod(key[first], len(docs))
    begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    df = np.diff(np.append(begin, len(term)))
    gap = np.diff(doc, prepend=-1)
    gap[begin] = doc[begin] + 1
    place = np.arange(len(term)) - np.repeat(begin, df)
    starts = np.flatnonzero(place % run == 0)
    gaps, gap_at = packed(gap - 1)
    more, more_at = packed(times - 1)
    return {
        "shard": number, "documents": len(docs), "total": int(size.sum()), "terms": vocabulary, "df": df.astype(np.int32),
        "ids": np.array([i for i, _ in docs], np.int64).tobytes(), "sizes": size.tobytes(), "first_run": np.append(0, np.cumsum(-(-df // run))).astype(np.int64).tobytes(),
        "ends": doc[np.append(starts[1:], len(doc)) - 1].tobytes(), "gap_at": np.append(gap_at[starts], len(gaps)).tobytes(), "gaps": gaps.tobytes(),
        "more_at": np.append(more_at[starts], len(more)).tobytes(), "more": more.tobytes(),
    }


_KINDS = {"shard": pa.int64(), "documents": pa.int64(), "total": pa.int64(), "terms": pa.list_(pa.binary()), "df": pa.list_(pa.int32()), **{c: pa.binary() for c in ("ids", "sizes", "first_run", "ends", "gap_at", "gaps", "more_at", "more")}}
_INDEX = "shard long, documents long, total long, terms array<binary>, df array<int>, " + ", ".join(f"{c} binary" for c in list(_KINDS)[5:])


def index(docs: DataFrame, most: int = SHARD, run: int = RUN) -> DataFrame:
    """A row for each shard. Every document with a term is in one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__

        def flushed() -> pa.RecordBatch:
            row = shard_of(number, held, list(known), run)
            return pa.RecordBatch.from_pydict({c: [x] for c, x in row.items()}, pa.schema(list(_KINDS.items())))

        for piece in pieces_of(batches, "text"):
            for i, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                if not (terms := terms_of(text)):
                    continue
                if held and size + len(text) > most:
                    yield flushed()
                    number, held, size = number + 1, [], 0
                    known.clear()
                held.append((LAST if i is None else i, np.fromiter(map(known.__getitem__, terms), np.int32, len(terms))))
                size += len(text)
        if held:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, _INDEX)


class Shard:
    """The lists of an index row that a block of items needs, decoded run by run."""

    def __init__(self, row: dict, slots: np.ndarray, documents: int, total: int):
        """``slots``: the number of each of the block's terms in the shard, -1 where it has none."""
        (self.ids, sizes, self.first_run, self.ends, self.gap_at, self.more_at) = (np.frombuffer(row[c], np.int64) for c in ("ids", "sizes", "first_run", "ends", "gap_at", "more_at"))
        self.gaps, self.more = (np.frombuffer(row[c], np.uint8) for c in ("gaps", "more"))
        self.slots = slots
        self.long = 8 * (10 + (90 * sizes * documents) // total)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(self, number: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a run, and what the term counts there before its weight."""
        if number not in self.kept:
            doc = np.cumsum(unpacked(self.gaps[self.gap_at[number] : self.gap_at[number + 1]]) + 1) + (-1 if first else self.ends[number - 1])
            times = unpacked(self.more[self.more_at[number] : self.more_at[number + 1]]) + 1
            self.kept[number] = doc, (1_000_000_000 * times) // (1000 * times + self.long[doc])
        return self.kept[number]

    def merge(self, lists: list[tuple[int, int]], best: list[tuple[int, int]], k: int) -> None:
        """Adds to ``best``, a heap of (score, -doc_id), the documents of (term, weight) ``lists`` in order."""
        cursors, heap = [], []
        for term, weight in lists:
            if (slot := int(self.slots[term])) >= 0 and weight > 0:
                run, end = int(self.first_run[slot]), int(self.first_run[slot + 1])
                heap.append((int(self.ends[run]), len(cursors)))
                cursors.append([run, end, weight, 0, *self.run(run, True)])
        heapq.heapify(heap)
        begin = 0
        while heap:
            frontier = heap[0][0]
            score = np.zeros(frontier + 1 - begin, np.int64)
            for _, cursor in heap:
                run, end, weight, at, doc, count = cursors[cursor]
                to = int(np.searchsorted(doc, frontier, "right"))
                score[doc[at:to] - begin] += weight * count[at:to]
                cursors[cursor][3] = to
            # Later documents have larger ids within a shard, but not across shards: equal scores are compared.
            for place in np.flatnonzero(score >= max(1, best[0][0] if len(best) == k else 1)).tolist():
                entry = (int(score[place]), -int(self.ids[begin + place]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            begin = frontier + 1
            while heap and heap[0][0] == frontier:
                cursor = heap[0][1]
                run, end, weight = cursors[cursor][0] + 1, *cursors[cursor][1:3]
                if run == end:
                    heapq.heappop(heap)
                else:
                    cursors[cursor] = [run, end, weight, 0, *self.run(run, False)]
                    heapq.heapreplace(heap, (int(self.ends[run]), cursor))


def _items(items: DataFrame) -> DataFrame:
    """item (number of the row), item_id and term, each once an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            found = [list(dict.fromkeys(terms_of(t))) for t in batch.column("text").to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(t) for t in found])
            yield pa.RecordBatch.from_arrays([batch.column("item").take(of), batch.column("item_id").take(of), pa.array([t for x in found for t in x], pa.binary())], names=["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item long, item_id long, term binary")


def search(docs: DataFrame, items: DataFrame, *, k: int = K, shard: int = SHARD, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (long): the k best documents with a score above 0 for each item.

    A term in df of N documents weighs floor(1000 ln((2N + 2) / (2df + 1))). With tf occurrences in a document of n of
    all L terms it counts (10^9 tf) div (1000 tf + 8 m) times that, where m = 10 + (90 n N) div L.
    """
    bounded_batches(docs.sparkSession)
    shards = stage(index(docs, shard, run), "postings")
    asked = stage(_items(items), "items")
    documents, total, count = shards.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count(F.lit(1))).first()
    held = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    held = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double")))
    weighted = asked.join(held.select("term", weight.alias("weight")), "term")
    lists = weighted.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("lists"))
    numbers = max(1, -(-(asked.agg(F.count_distinct("item")).first()[0]) // block))
    blocks = lists.groupBy(F.pmod(F.xxhash64("item"), F.lit(numbers)).alias("block")).agg(F.collect_list(F.struct("item", "item_id", "lists")).alias("items"))
    blocks = stage(blocks, "item-blocks")

    def begin(row: dict) -> tuple:
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        own = [(x["item"], x["item_id"], [(known[bytes(t["term"])], t["weight"]) for t in x["lists"]], []) for x in row["items"]]
        return row["block"], pa.array(list(known), pa.binary()), own

    def visit(state: tuple, row: dict) -> None:
        _, terms, own = state
        slots = pc.fill_null(pc.index_in(terms, value_set=row["terms"]), -1).to_numpy()
        one = Shard(row, slots, documents, total)
        for _, _, lists, best in own:
            one.merge(lists, best, k)

    def end(state: tuple) -> Iterator[pa.RecordBatch]:
        rows = [(item, item_id, -doc, score) for item, item_id, _, best in state[2] for score, doc in best]
        item, item_id, doc, score = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(item_id, pa.int64()), pa.array([None if d == LAST else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    groups = gathered(blocks, shards.drop("df", "documents", "total"), numbers, count)
    found = groups.mapInArrow(lambda b: met(b, begin, visit, end, keep=("terms",)), "item long, item_id long, doc_id long, score long")
    return ranked(found, ["item"], "score", "doc_id", k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Plain joins of all terms, for small tables.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS w FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT DISTINCT r AS item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS w FROM benchmark)),
c AS (
  SELECT item, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * big_n) // big_l AS BIGINT))))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN t USING (term), s GROUP BY ALL
), o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM o WHERE rank <= {K}
"""
