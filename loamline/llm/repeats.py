"""Long repeats across a corpus: which windows of a fixed length also start earlier.

Both repeat operators (bytes by suffix arrays, words by suffix trees) share the
steps that bring equal windows together without moving every suffix:

1. *Anchors.*  In each window of ``length`` tokens the k-gram with the smallest
   hash is its anchor (the leftmost of equals).  Equal windows have equal
   anchors at equal offsets.  Neighbouring windows mostly share an anchor; the
   text of all windows of one anchor is a *snippet*, and the snippets of a
   document together hold each of its windows exactly once.
2. *Classes.*  Through the packed exchange each shard sees the anchors of a key
   range.  A snippet whose whole content starts earlier is covered, all of it.
   A snippet whose anchor no other content shares holds no repeat.  What is left
   are the first snippets of contents that share an anchor with others.
3. *Solving.*  Those snippets, and only those, travel with their tokens to the
   shard of their anchor, where the operator's own suffix structure finds which
   of their windows start earlier elsewhere.
4. *Hot anchors.*  An anchor that more than `HOT` different contents share (a line
   that a third of all documents hold, in other surroundings each) would gather
   them in one task.  Its windows go their ways by their whole prefix instead: each
   by the hash of all its tokens, so that equal ones still meet and others spread.
5. *Cover.*  Blocks get the covered ranges back and mark the tokens.

A block sends a content once however many of its documents hold it.  No window
is dropped, sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loamline.llm import blocks as B
from loamline.llm.store import Scratch

FACTOR = 0x9E3779B97F4A7C55
CHUNK = 1 << 18
COVER, LOW32 = -2, np.uint64(0xFFFFFFFF)
#: Contents of one anchor that one task takes.
HOT = 1 << 13


def kgram_hashes(v: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, by doubling."""
    h, m, acc, held = v, 1, None, 0
    while True:
        if k & m:
            acc = h if acc is None else acc[: len(h) - held] * np.uint64(pow(FACTOR, m, 1 << 64)) + h[held:]
            held += m
        if held == k:
            return acc[: len(v) - k + 1]
        h = h[:-m] * np.uint64(pow(FACTOR, m, 1 << 64)) + h[m:]
        m *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while m * 2 <= w:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return x if m == w else np.minimum(x[: len(x) - (w - m)], x[w - m :])


def winnow(values: np.ndarray, sizes: np.ndarray, k: int, length: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start and the anchor, as places in all the block's tokens.

    `table` gives a token's hash where values are small codes; it is looked up a chunk at a time.
    """
    n, w = len(values), length - k + 1
    valid = np.ones(n, bool)
    ends = np.cumsum(sizes)
    for e, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        valid[max(e - size, e - length + 1) : e] = False
    at = np.zeros(n, np.uint32)
    for a in range(0, n - length + 1, CHUNK):
        b = min(a + CHUNK, n - length + 1)
        v = values[a : b + length - 1]
        h = kgram_hashes(v if table is None else table[v], k)
        key = B.mix(h) & ~LOW32 | np.arange(a, a + len(h), dtype=np.uint64)
        at[a:b] = sliding_min(key, w)[: b - a] & LOW32
    change = at[1:] != at[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= change | ~valid[:-1]
    last[:-1] &= change | ~valid[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, at[lo].astype(np.int64)


@dataclass
class Tokens:
    """A block's tokens: raw bytes of `unit` each, a hash of each (or a code and the codes' table), and how many each document has."""

    raw: bytes
    values: np.ndarray
    sizes: np.ndarray
    table: np.ndarray | None = None


@dataclass
class Snippets:
    """A shard's unresolved snippets.  Snippet i has tokens raw[ends[i-1]:ends[i]] and its anchor at `offset`."""

    raw: np.ndarray
    sizes: np.ndarray
    offset: np.ndarray
    order: np.ndarray
    place: np.ndarray


@dataclass
class Task:
    """What an operator brings: its tokens, window length, k-gram length, rule for 'earlier' and suffix structure.

    solve gets snippets and gives (snippet, first window, last window) ranges of windows that start earlier elsewhere;
    `same_doc` says whether an earlier start in the same document counts.
    """

    name: str
    unit: int
    length: int
    k: int
    same_doc: bool
    tokens: Callable[[B.Block], Tokens]
    solve: Callable[[Snippets], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Entries:
    """A block's snippets, and their distinct contents in order of anchor."""

    def __init__(self, task: Task, b: B.Block):
        t = task.tokens(b)
        if b.extra is None:
            lo, hi, q = winnow(t.values, t.sizes, task.k, task.length, t.table)
        else:
            lo = B.unpack_sorted(b.extra[0]).astype(np.int64)
            hi, q = lo + B.unplanes(b.extra[1]), lo + B.unplanes(b.extra[2])
        self.raw, self.lo, self.hi, self.q, u, n = t.raw, lo, hi, q, task.unit, task.length
        raw, k = memoryview(t.raw), task.k * task.unit
        digest = xxhash.xxh64_intdigest
        starts = np.cumsum(t.sizes) - t.sizes
        self.doc = np.searchsorted(starts + t.sizes, lo, side="right")
        self.h = np.fromiter((digest(raw[i : i + k]) for i in (q * u).tolist()), np.uint64, len(q))
        self.w = np.fromiter((digest(raw[i:j], s) for i, j, s in zip((lo * u).tolist(), ((hi + n) * u).tolist(), (q - lo).tolist(), strict=True)), np.uint64, len(q))
        self.order = b.order[self.doc] if len(lo) else np.zeros(0, np.int64)
        self.place = lo - starts[self.doc] if task.same_doc else np.zeros(len(lo), np.int64)
        self.by = np.lexsort((self.place, self.order, self.w, self.h))
        first = np.ones(len(lo), bool)
        first[1:] = (self.h[self.by][1:] != self.h[self.by][:-1]) | (self.w[self.by][1:] != self.w[self.by][:-1])
        self.firsts = self.by[first]
        self.content = np.empty(len(lo), np.int64)
        self.content[self.by] = np.cumsum(first) - 1
        head = self.firsts[self.content] if len(lo) else self.content
        self.later = (self.order > self.order[head]) | (self.order == self.order[head]) & (self.place > self.place[head])


def remember(task: Task) -> Callable[[B.Block], object]:
    def run(b: B.Block) -> object:
        t = task.tokens(b)
        lo, hi, q = winnow(t.values, t.sizes, task.k, task.length, t.table)
        return B.pack_sorted(lo.astype(np.uint32)), B.planes(B.narrow(hi - lo)), B.planes(B.narrow(q - lo))

    return run


def classes(got: list[tuple], hot: int = HOT) -> list[np.ndarray]:
    """For each block's contents: 0 alone, 1 starts earlier elsewhere, 2 the first of its content and its anchor has others, 3 as 2 with more than `hot`."""
    sizes = [x[0][1] for x in got]
    h = np.concatenate([B.unpack_sorted(x[0]) for x in got])
    w, order, place = (np.concatenate([B.unplanes(x[i]).astype(d) for x in got]) for i, d in ((1, np.uint64), (2, np.int64), (3, np.int64)))
    by = np.lexsort((place, order, w, h))
    h, w, order, place = h[by], w[by], order[by], place[by]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= w[1:] != w[:-1]
    cls, grp = np.cumsum(new) - 1, np.cumsum(new_h) - 1
    head = np.flatnonzero(new)[cls]
    later = (order > order[head]) | (order == order[head]) & (place > place[head])
    many = np.bincount(grp, new)[grp]
    verdict = np.where(later, 1, np.where(many > hot, 3, np.where(many > 1, 2, 0))).astype(np.uint8)
    out = np.empty(len(h), np.uint8)
    out[by] = verdict
    return np.split(out, np.cumsum(sizes)[:-1])


def covered(docs: DataFrame, task: Task, id_col: str, text_col: str, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks, and parts with the ranges of tokens (in the block's own count) that repeat earlier ones."""
    keep = Scratch(docs.sparkSession, task.name)
    blocks = keep.save(B.to_blocks(docs, id_col, text_col, extra=remember(task), carry=carry), "none")
    shards = B.shard_count(blocks)

    def ask(_: int, b: B.Block) -> Iterator[tuple[int, bytes]]:
        e = Entries(task, b)
        f = e.firsts
        edges = B.shard_edges(e.h[f], shards)
        for s in range(shards):
            if edges[s] < edges[s + 1]:
                i = f[edges[s] : edges[s + 1]]
                yield s, B.dumps((B.pack_sorted(e.h[i]), B.planes(e.w[i]), B.planes(e.order[i]), B.planes(e.place[i].astype(np.uint32))))

    hot = HOT

    def answer(_: list[int], blobs: list[bytes]) -> list[bytes]:
        return [B.dumps(x.tobytes()) for x in classes([B.loads(x) for x in blobs], hot)]

    def sort_out(n: int, b: B.Block, got: list[tuple[int, bytes]]) -> pa.Table:
        e = Entries(task, b)
        verdict = np.frombuffer(b"".join(B.loads(x) for _, x in got), np.uint8)[e.content] if len(e.lo) else np.zeros(0, np.uint8)
        gone = e.later | (verdict == 1)
        rows = [(COVER, B.dumps((e.lo[gone], e.hi[gone] + task.length)))] if gone.any() else []
        need = np.flatnonzero(~gone & (verdict == 2))
        need = need[np.argsort(e.h[need], kind="stable")]
        edges = B.shard_edges(e.h[need], shards)
        for s in range(shards):
            i = need[edges[s] : edges[s + 1]]
            if len(i):
                lo, hi = e.lo[i] * task.unit, (e.hi[i] + task.length) * task.unit
                raw = b"".join(e.raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True))
                rows.append((s, B.dumps((raw, e.hi[i] + task.length - e.lo[i], e.q[i] - e.lo[i], e.order[i], e.place[i], e.lo[i], e.h[i]))))
        rows += hot_windows(task, e, np.flatnonzero(~gone & (verdict == 3)), shards)
        return pa.Table.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([n] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=B.PART)

    answers = B.each_shard(B.each_block(blocks, ask), answer)
    sorted_out = keep.save(B.meet(blocks, answers, sort_out, B.PART_SCHEMA), "none")

    def solve(_: list[int], blobs: list[bytes]) -> list[bytes | None]:
        got = [B.loads(x) for x in blobs]
        if isinstance(got[0], HotWindows):
            return [B.dumps((x.at[later], x.at[later] + task.length)) if later.any() else None for x, later in zip(got, earlier_elsewhere(got), strict=True)]
        kind = np.dtype(f"u{task.unit}")
        cols = [np.concatenate([x[i] for x in got]) for i in range(1, 7)]
        found = in_parts(task, np.frombuffer(b"".join(x[0] for x in got), kind), cols[0], cols[5], cols[1:4])
        snippet, first, last = found
        block = np.repeat(np.arange(len(got)), [len(x[1]) for x in got])[snippet]
        lo = cols[4][snippet]
        out: list[bytes | None] = []
        for i in range(len(got)):
            own = block == i
            out.append(B.dumps((lo[own] + first[own], lo[own] + last[own] + task.length)) if own.any() else None)
        return out

    solved = B.each_shard(sorted_out.filter(f"shard <> {COVER}"), solve)
    return blocks, sorted_out.filter(f"shard = {COVER}").unionByName(solved)


@dataclass
class HotWindows:
    """A block's windows of hot anchors: 128 bits of each one's tokens, its document's order, its place there and in the block."""

    h: np.ndarray
    w: np.ndarray
    order: np.ndarray
    place: np.ndarray
    at: np.ndarray


def hot_windows(task: Task, e: Entries, snippets: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """Rows (shard, blob) with the windows of some snippets, to shards of their own beyond those of anchors."""
    if not len(snippets):
        return []
    count = e.hi[snippets] - e.lo[snippets] + 1
    at = np.repeat(e.lo[snippets] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    own = np.repeat(snippets, count)
    raw, u, n, digest = memoryview(e.raw), task.unit, task.length * task.unit, xxhash.xxh64_intdigest
    h, w = (np.fromiter((digest(raw[i : i + n], seed) for i in (at * u).tolist()), np.uint64, len(at)) for seed in (0, 1))
    place = e.place[own] + (at - e.lo[own]) if task.same_doc else np.zeros(len(at), np.int64)
    by = np.argsort(h, kind="stable")
    edges = B.shard_edges(h[by], shards)
    return [(shards + s, B.dumps(HotWindows(*(x[by[edges[s] : edges[s + 1]]] for x in (h, w, e.order[own], place, at))))) for s in range(shards) if edges[s] < edges[s + 1]]


def earlier_elsewhere(got: list[HotWindows]) -> list[np.ndarray]:
    """For each block's windows whether an equal one starts earlier."""
    h, w, order, place = (np.concatenate([getattr(x, name) for x in got]) for name in ("h", "w", "order", "place"))
    by = np.lexsort((place, order, w, h))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (w[by][1:] != w[by][:-1])
    head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(by), bool)
    later[by] = (order[by] > order[head]) | (order[by] == order[head]) & (place[by] > place[head])
    return np.split(later, np.cumsum([len(x.h) for x in got])[:-1])


def in_parts(task: Task, raw: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, rest: list[np.ndarray], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's snippets, solved some anchors at a time: equal windows have equal anchors, so parts need not know each other."""
    by = np.argsort(anchors, kind="stable")
    held = np.cumsum(sizes[by]) * task.unit
    begin = np.flatnonzero(np.append(True, anchors[by][1:] != anchors[by][:-1]))
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(by):
        limit = (held[at - 1] if at else 0) + most
        k = int(np.searchsorted(held, limit, side="right"))
        fits = begin[(begin > at) & (begin <= k)]
        upto = len(by) if k >= len(by) else int(fits[-1]) if len(fits) else int(next(iter(begin[begin > at]), len(by)))
        own = by[at:upto]
        part = np.concatenate([raw[e - n : e] for e, n in zip(ends[own].tolist(), sizes[own].tolist(), strict=True)])
        snippet, first, last = task.solve(Snippets(part, sizes[own], *(x[own] for x in rest)))
        out.append((own[snippet], first, last))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def mask(n: int, got: list[tuple[int, bytes]]) -> np.ndarray:
    """Which of a block's n tokens are covered."""
    out = np.zeros(n, bool)
    for _, blob in got:
        for lo, hi in zip(*(x.tolist() for x in B.loads(blob)), strict=True):
            out[lo:hi] = True
    return out


def runs(snippet: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single covered windows as ranges of neighbouring ones."""
    by = np.lexsort((window, snippet))
    snippet, window = snippet[by], window[by]
    first = np.ones(len(by), bool)
    first[1:] = (snippet[1:] != snippet[:-1]) | (window[1:] > window[:-1] + 1)
    last = np.append(first[1:], True) if len(by) else first
    return snippet[first], window[first], window[last]
