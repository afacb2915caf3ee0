"""Blocks of documents, and a packed exchange between blocks and shards of keys.

A block is some megabytes of whole texts with their ids, compressed into one
row.  Operators that must know something about every n-gram or every anchor of
the corpus send, from each block, one packed array of sorted keys to each shard
of the key space, and get one packed array of answers back in the same order.
A key costs a few bytes on the way and a block sends it once however often it
occurs, so a key that fills a third of all rows weighs no more than another.
Rows are addressed by block and place in it, never joined by ``doc_id``: null
and repeated ids are therefore harmless.
"""

from __future__ import annotations

import ctypes
import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, payload binary"
PART_SCHEMA = "shard int, block long, blob binary"
PART = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
#: Stands for a null id wherever ids are ordered: after all others.
NULL_ID = np.iinfo(np.int64).max


def dumps(obj: object, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(obj, protocol=5))


def loads(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(a: np.ndarray) -> tuple[str, int, bytes]:
    """An integer array as byte planes, which compress well when high bytes agree."""
    a = np.ascontiguousarray(a)
    return a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(x: tuple[str, int, bytes]) -> np.ndarray:
    kind, n, raw = x
    d = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(d.itemsize, n).T).view(d).reshape(n)


def pack_sorted(a: np.ndarray) -> tuple[str, int, bytes]:
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(x: tuple[str, int, bytes]) -> np.ndarray:
    d = unplanes(x)
    return np.cumsum(d, dtype=d.dtype)


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Places in sorted uint64 keys at which each of `shards` equal key ranges begins; one more at the end."""
    step = (1 << 64) // shards
    first = np.array([i * step for i in range(shards)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, first), len(keys))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives freed memory back to the system: a worker lives on and runs other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


class Block:
    """The rows of a block: ids (None where null), order (ids for comparing) and texts as bytes."""

    def __init__(self, ids: list, texts: list[bytes], extra: object = None, carry: list[list] | None = None):
        self.ids, self.texts, self.extra, self.carry = ids, texts, extra, carry or []

    @property
    def order(self) -> np.ndarray:
        return np.array([NULL_ID if i is None else i for i in self.ids], dtype=np.int64)

    def pack(self) -> bytes:
        lens = np.array([len(t) for t in self.texts], dtype=np.int64)
        return dumps((self.ids, lens, b"".join(self.texts), self.extra, self.carry), level=3)

    @staticmethod
    def unpack(blob: bytes) -> Block:
        ids, lens, joined, extra, carry = loads(blob)
        ends = np.cumsum(lens).tolist()
        return Block(ids, [joined[e - n : e] for e, n in zip(ends, lens.tolist(), strict=True)], extra, carry)


def to_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, extra: Callable[[Block], object] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Documents as rows (block, payload).

    A null text is an empty one; `extra` adds to a block what later stages need again; `carry` names further columns
    that travel with their rows.
    """
    carry = carry or []

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, ids, texts, held, more = TaskContext.get().partitionId() << 32, 0, [], [], 0, [[] for _ in carry]

        def out() -> pa.RecordBatch:
            b = Block(ids, texts, carry=more)
            if extra:
                b.extra = extra(b)
            return pa.RecordBatch.from_pydict({"block": pa.array([base + seq], pa.int64()), "payload": pa.array([b.pack()], pa.binary())})

        for batch in batches:
            others = [batch.column(2 + k).to_pylist() for k in range(len(carry))]
            for row, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                t = t.as_py() or b""
                ids.append(i)
                for own, other in zip(more, others, strict=True):
                    own.append(other[row])
                texts.append(t)
                held += len(t) + 64
                if held >= size:
                    yield out()
                    ids, texts, held, seq, more = [], [], 0, seq + 1, [[] for _ in carry]
        if ids:
            yield out()
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)))
    return rows.mapInArrow(build, BLOCK_SCHEMA)


def each_block(blocks: DataFrame, fn: Callable[[int, Block], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """For every block the rows (shard, block, blob) that fn yields as (shard, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = list(fn(n, Block.unpack(payload.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([n] * len(got), pa.int64()), pa.array([b for _, b in got], pa.binary())], schema=PART)
                release()

    return blocks.select("block", "payload").mapInArrow(run, PART_SCHEMA)


def each_shard(parts: DataFrame, fn: Callable[[list[int], list[bytes]], list[bytes | None]]) -> DataFrame:
    """fn gets a shard's block numbers and blobs, in order of block, and returns an answer for each or None.

    One answer more than blocks is about the shard itself and comes as block -1.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        blocks = t.column("block").to_pylist()
        answers = fn(blocks, t.column("blob").to_pylist())
        release()
        kept = [(b, a) for b, a in zip([*blocks, -1], answers, strict=False) if a is not None]
        return pa.Table.from_arrays([pa.array([t.column("shard")[0].as_py()] * len(kept), pa.int32()), pa.array([b for b, _ in kept], pa.int64()), pa.array([a for _, a in kept], pa.binary())], schema=PART)

    return parts.groupBy("shard").applyInArrow(run, PART_SCHEMA)


def meet(blocks: DataFrame, parts: DataFrame, fn: Callable[[int, Block, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """Each block with its answers, in order of shard, once."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        shards, blobs = t.column("shard").to_pylist(), t.column("blob")
        at = [i for i, s in enumerate(shards) if s == -1]
        out = fn(t.column("block")[0].as_py(), Block.unpack(blobs[at[0]].as_py()), [(s, blobs[i].as_py()) for i, s in enumerate(shards) if s != -1])
        release()
        return out

    own = blocks.select(F.lit(-1).cast("int").alias("shard"), "block", F.col("payload").alias("blob"))
    return own.unionByName(parts.select("shard", "block", "blob")).groupBy("block").applyInArrow(run, schema)


def shard_count(blocks: DataFrame, per: int = 2, least: int = 12) -> int:
    """A shard for every `per` blocks, so that what a shard holds doesn't grow with the input."""
    return max(least, -(-blocks.count() // per))
