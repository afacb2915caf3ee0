"""Best-fit packing with vector capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths).  Pieces are placed from the longest to the shortest.
Each goes to the open sequence with room in every dimension that fits best: by
the largest weighted dot product of the piece with what the sequence already
holds, or by the smallest weighted norm of what would be left.  `by="fewest"` makes
both placements and takes that with fewer sequences.

The production capacities are 1024 tokens and what so many tokens can come to at
most: 1024 documents and a cost of 1024 squared.  Tighter ones would leave room
unused; the three residuals weigh alike in the choice.

Pieces of one length are alike, and so are sequences that hold the same lengths.
The placement is therefore computed exactly from the number of pieces of each
length (as many numbers as a sequence has tokens, however large the corpus), as
groups of alike sequences; only that histogram comes to the driver.  Pieces then
get their places by their rank among those of their length, which is a prefix
scan over partitions, and a search in the placement.

Documents of more than a sequence are cut into whole sequences after a first
piece with the remainder, so that one piece of each document has a choice.

Defined results: a null or empty text is one piece with the end token alone; a
null id is kept; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import NULL_ID
from loamline.llm.store import Scratch
from loamline.llm.token_ids import default_path, encoder

TOKENS, DOCUMENTS, COST = 1024, 1024, 1024 * 1024
WEIGHTS = (1.0, 1.0, 1.0)
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    tokens: int = TOKENS
    documents: int = DOCUMENTS
    cost: int = COST
    weights: tuple[float, float, float] = WEIGHTS
    by: str = "fewest"


def pieces(docs: DataFrame, capacity: Capacity, tokenizer: str, id_col: str, text_col: str, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's pieces; the first may be shorter than a sequence."""
    most = min(capacity.tokens, int(capacity.cost**0.5))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.ids(text.as_py() or "") + tail
                n = len(raw) // 4
                at, k, size = 0, 0, n % most or most
                while at < n:
                    own = raw[4 * at : 4 * (at + size)]
                    for col, x in zip(rows, (i, k, at, size, zlib.crc32(own), own), strict=True):
                        col.append(x)
                    at, k, size = at + size, k + 1, most
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(rows, kinds, names, strict=False)], names=names)
        enc.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


@dataclass
class Placement:
    """For each length, runs of pieces by rank: rank first[i] .. of a length go to sequences base[i] .. at offset[i]."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    step: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.first
        i = np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1
        inside = rank - self.first[i]
        return self.base[i] + inside // self.step[i], self.offset[i] + inside % self.step[i] * length


def fit(histogram: dict[int, int], c: Capacity = Capacity()) -> Placement:
    """Places the pieces counted by length.  Open sequences alike in all three residuals are one group."""
    if c.by == "fewest":
        return min((fit(histogram, replace(c, by=rule)) for rule in ("norm", "dot")), key=lambda p: p.sequences)
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    wt, wd, wc = c.weights[0] / c.tokens**2, c.weights[1] / c.documents**2, c.weights[2] / c.cost**2

    def merit(state: tuple[int, int, int], n: int) -> float:
        if c.by == "dot":
            return wt * n * (c.tokens - state[0]) + wd * (c.documents - state[1]) + wc * n * n * (c.cost - state[2])
        return -(wt * (state[0] - n) ** 2 + wd * (state[1] - 1) ** 2 + wc * (state[2] - n * n) ** 2)

    def fits(state: tuple[int, int, int], n: int) -> bool:
        return state[0] >= n and state[1] >= 1 and state[2] >= n * n

    def less(state: tuple[int, int, int], n: int, times: int = 1) -> tuple[int, int, int]:
        return state[0] - times * n, state[1] - times, state[2] - times * n * n

    fresh = (c.tokens, c.documents, c.cost)
    for n in sorted(histogram, reverse=True):
        left, rank = histogram[n], 0
        if left and not fits(fresh, n):
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        heap = [(-merit(s, n), s) for s in groups if fits(s, n)]
        heapq.heapify(heap)
        while left:
            while heap and heap[0][1] not in groups:
                heapq.heappop(heap)
            times = 1
            if heap:
                worth, s = heapq.heappop(heap)
                base, count = groups[s].pop()
                if groups[s]:
                    heapq.heappush(heap, (worth, s))
                else:
                    del groups[s]
                while fits(less(s, n, times), n) and merit(less(s, n, times), n) > -worth:
                    times += 1
            else:
                s, base = fresh, sequences
                while fits(less(s, n, times), n):
                    times += 1
                count = -(-left // times)
                sequences += count
            full = min(count, left // times)
            rest = left - full * times if full < count else 0
            for at, number, held in ((base, full, times), (base + full, int(rest > 0), rest)):
                if number:
                    runs.append((n, rank, at, c.tokens - s[0], held))
                    after = less(s, n, held)
                    groups.setdefault(after, []).append((at, number))
                    if fits(after, n):
                        heapq.heappush(heap, (-merit(after, n), after))
                    rank, left = rank + number * held, left - number * held
            used = full + int(rest > 0)
            if used < count:
                groups.setdefault(s, []).append((base + used, count - used))
    cols = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return Placement(*(cols[:, i] for i in range(5)), sequences)


def pack(docs: DataFrame, capacity: Capacity = Capacity(), tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there."""
    keep = Scratch(docs.sparkSession, "packing")
    made = keep.save(pieces(docs, capacity, tokenizer or default_path(), id_col, text_col))
    return place(made, capacity, keep)


def place(made: DataFrame, capacity: Capacity, keep: Scratch) -> DataFrame:
    """Sequences and offsets for written pieces.

    A piece's number among those of its length comes from its bucket (a hash of the row), the pieces of that length in
    the buckets before, and its number within the bucket.  Buckets hold a bounded number of rows, so a length that is
    as common as a third of all rows is spread like any other.
    """
    rows = made.count()
    buckets = max(1, rows // 20_000)
    dealt = made.select(*[x.split()[0] for x in PIECES.split(", ")]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keep.save(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    placement = fit(histogram, capacity)
    before = counts.selectExpr("length", "bucket", "coalesce(sum(n) over (partition by length order by bucket rows between unbounded preceding and 1 preceding), 0) as before")
    starts = before.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("starts"))

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        length = left.column("length").to_numpy()
        by = np.lexsort((left.column("doc_id").fill_null(NULL_ID).to_numpy(), left.column("ids_crc32").to_numpy(), left.column("piece").to_numpy(), length))
        left, length = left.take(by), length[by]
        first = np.append(True, length[1:] != length[:-1])
        at = np.flatnonzero(first)
        rank = np.arange(len(length)) - np.repeat(at, np.diff(np.append(at, len(length))))
        begin = dict(right.column("starts")[0].as_py())
        rank = rank + np.repeat([begin[n] for n in length[at].tolist()], np.diff(np.append(at, len(length))))
        seq, offset = placement.place(length, rank)
        return left.drop_columns(["bucket"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return dealt.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(number, PLACED)
