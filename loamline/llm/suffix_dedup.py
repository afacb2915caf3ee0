"""Suffix-array dedup: removal of the bytes of long strings that start earlier.

The suffix arrays are built blockwise with a difference cover.  The suffixes
that start at the positions of a cover modulo v are ranked once, by prefix
doubling over the cover alone.  Then one bucket of suffixes (equal first two
bytes) is sorted at a time: by its first v bytes, and what ties there by the
ranks of the cover suffixes that both reach within v steps.  At no time are more
suffixes than a bucket's held as sort keys.

Texts reach the suffix arrays through :mod:`loamline.llm.repeats`.  Defined
results: a null text is empty; a null id orders after all others; rows with one
id are one document's for the rule of earlier starts; texts under the length
keep every byte; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamline.llm import blocks as B
from loamline.llm import repeats as R

LENGTH, KGRAM, PERIOD = 100, 32, 31
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SMALL = 24


@functools.cache
def difference_cover(v: int) -> tuple[int, ...]:
    """The first set, by size and then in order, whose differences modulo v are all residues."""

    def grow(have: list[int], seen: int, size: int) -> list[int] | None:
        if seen == (1 << v) - 1:
            return have
        missing = v - seen.bit_count()
        left = size - len(have)
        if not left or missing > left * (2 * len(have) + left - 1):
            return None
        for x in range(have[-1] + 1, v):
            more = seen
            for y in have:
                more |= 1 << (x - y) % v | 1 << (y - x) % v
            if found := grow([*have, x], more, size):
                return found
        return None

    size = 1
    while not (found := grow([0], 1, size)):
        size += 1
    return tuple(found)


@functools.cache
def meeting_steps(v: int) -> np.ndarray:
    """For residues a and b the least step after which both positions are in the cover."""
    inside = np.zeros(v, bool)
    inside[list(difference_cover(v))] = True
    out = np.empty((v, v), np.int64)
    r = np.arange(v)
    for a in range(v):
        both = inside[(a + r)[None, :] % v] & inside[(r[:, None] + r[None, :]) % v]
        out[a] = both.argmax(axis=1)
    return out


def _words_at(text: np.ndarray, n: int, room: int) -> np.ndarray:
    """The eight bytes from each position on, big-endian; zeros after the end."""
    padded = np.zeros(n + room + 8, np.uint8)
    padded[:n] = text
    out = np.zeros(n + room, np.uint64)
    for at in range(0, n + room, 1 << 19):
        part = out[at : at + (1 << 19)]
        for j in range(8):
            part |= padded[at + j : at + j + len(part)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _columns(eight: np.ndarray, at: np.ndarray, v: int) -> list[np.ndarray]:
    """The first v bytes from each position as columns, the first column first."""
    cols = []
    for j in range(0, v, 8):
        c = eight[at + j]
        if v - j < 8:
            c = c & ~np.uint64((1 << 8 * (8 - (v - j))) - 1)
        cols.append(c)
    return cols


def _breaks(cols: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


class CoverRanks:
    """Ranks, from 1, of the suffixes at cover positions, by at least `depth` bytes (all: None)."""

    def __init__(self, eight: np.ndarray, n: int, v: int, depth: int | None):
        self.v, self.n = v, n
        room = 2 * v
        at = (np.arange(0, n, v)[:, None] + np.array(difference_cover(v))[None, :]).ravel()
        at = at[at < n]
        cols = [*_columns(eight, at, v), np.minimum(n - at, v)]
        by = np.lexsort(cols[::-1])
        new = _breaks([c[by] for c in cols])
        self.rank = np.zeros(n + room, np.int32)
        self.rank[at[by]] = np.cumsum(new)
        reach = v
        while not new.all() and (depth is None or reach < depth):
            nxt = np.zeros(len(at), np.int64)
            inside = at + reach < n
            nxt[inside] = self.rank[at[inside] + reach]
            cols = [self.rank[at], nxt]
            by = np.lexsort(cols[::-1])
            new = _breaks([c[by] for c in cols])
            self.rank[at[by]] = np.cumsum(new)
            reach *= 2

    def order(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A permutation that sorts the suffixes of each group (ascending numbers, equal first v bytes)."""
        steps, v = meeting_steps(self.v), self.v
        res = at % v
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(at)))
        mixed = np.maximum.reduceat(res, starts) != np.minimum.reduceat(res, starts)
        key = self.rank[at + steps[res, res]]
        out = np.lexsort((key, group))
        for size in np.unique(sizes[mixed]).tolist():
            rows = starts[mixed & (sizes == size)]
            if size <= SMALL:
                for part in np.array_split(rows, max(1, len(rows) * size * size // 4_000_000)):
                    i = part[:, None] + np.arange(size)
                    p, r = at[i], res[i]
                    step = steps[r[:, :, None], r[:, None, :]]
                    a, b = self.rank[p[:, :, None] + step], self.rank[p[:, None, :] + step]
                    tie = np.arange(size)[:, None] > np.arange(size)[None, :]
                    np.put_along_axis(i, ((b < a) | (b == a) & tie).sum(axis=2), i.copy(), axis=1)
                    out[part[:, None] + np.arange(size)] = i
            else:
                for s in rows.tolist():
                    own = range(s, s + size)

                    def before(x: int, y: int) -> int:
                        step = steps[res[x], res[y]]
                        return int(self.rank[at[x] + step] - self.rank[at[y] + step])

                    out[s : s + size] = sorted(own, key=functools.cmp_to_key(before))
        return out


def buckets(text: np.ndarray, starts: np.ndarray | None = None, v: int = PERIOD, depth: int | None = None):
    """Sorted suffixes, one bucket at a time: those of `starts` (all: None), by at least `depth` bytes (all: None)."""
    n = len(text)
    if not n:
        return
    eight = _words_at(text, n, 3 * v + 8)
    ranks = CoverRanks(eight, n, v, depth)
    at = np.arange(n) if starts is None else starts
    two = (eight[at] >> np.uint64(48)).astype(np.uint16)
    by = np.argsort(two, kind="stable")
    edges = np.flatnonzero(np.append(True, two[by][1:] != two[by][:-1])) if len(by) else np.zeros(0, np.int64)
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True):
        own = at[by[s:e]]
        cols = [*_columns(eight, own, v), np.minimum(n - own, v)]
        o = np.lexsort(cols[::-1])
        new = _breaks([c[o] for c in cols])
        own = own[o]
        tied = ~new
        tied[:-1] |= ~new[1:]
        if tied.any():
            t = np.flatnonzero(tied)
            own[t] = own[t][ranks.order(own[t], np.cumsum(new)[t])]
        yield own, eight


def suffix_array(text: bytes, v: int = PERIOD) -> np.ndarray:
    """The suffix array of a text."""
    found = [own for own, _ in buckets(np.frombuffer(text, np.uint8), None, v)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def solve(x: R.Snippets, length: int = LENGTH, v: int = PERIOD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of snippets that start earlier in another, by suffix arrays of all the shard's snippets.

    Each snippet is laid out so that its anchor falls on a multiple of v.  Equal windows have equal anchors at equal
    offsets, so most long ties lie in one residue and are resolved by one rank each.
    """
    room = -(-(x.sizes + v) // v) * v
    base = np.cumsum(room) - room + (-x.offset) % v
    text = np.zeros(int(room.sum()) + v, np.uint8)
    src = np.cumsum(x.sizes) - x.sizes
    for b, s, n in zip(base.tolist(), src.tolist(), x.sizes.tolist(), strict=True):
        text[b : b + n] = x.raw[s : s + n]
    windows = x.sizes - length + 1
    snippet = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(snippet)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = base[snippet] + window
    owner = np.full(len(text), -1, np.int32)
    owner[starts] = snippet
    found = []
    for own, eight in buckets(text, starts, v, length):
        new = _breaks(_columns(eight, own, length)) if length <= v else _breaks(_columns_far(eight, own, length))
        if new.all():
            continue
        s = owner[own]
        cls = np.cumsum(new) - 1
        order, place = x.order[s], x.place[s] + own - base[s]
        by = np.lexsort((place, order, cls))
        head = by[np.flatnonzero(new)][cls]
        later = (order > order[head]) | (order == order[head]) & (place > place[head])
        found.append(own[later])
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    s = owner[at].astype(np.int64)
    return R.runs(s, at - base[s])


def _columns_far(eight: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    last = len(eight) - 1
    cols = []
    for j in range(0, length, 8):
        c = eight[np.minimum(at + j, last)]
        if length - j < 8:
            c = c & ~np.uint64((1 << 8 * (8 - (length - j))) - 1)
        cols.append(c)
    return cols


def rewrite(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, each text without the bytes that start earlier.

    Bytes of a character that loses only some of its own go with it.  Null texts stay null.
    """
    others = [f for f in docs.schema.fields if f.name != text_col]
    was_null = "_was_null"
    while was_null.lower() in {n.lower() for n in docs.columns}:
        was_null += "_"
    carry = [f.name for f in others] + [was_null]
    kinds = [to_arrow_type(f.dataType) for f in others]
    names = [f.name for f in docs.schema.fields]
    blocks, parts = R.covered(docs.withColumn(was_null, F.col(f"`{text_col}`").isNull()), task(length), id_col, text_col, carry)

    def finish(_: int, b: B.Block, got: list[tuple[int, bytes]]) -> pa.Table:
        m = R.mask(sum(len(t) for t in b.texts), got)
        kept, at = [], 0
        for t, null in zip(b.texts, b.carry[-1], strict=True):
            own = m[at : at + len(t)]
            at += len(t)
            rest = np.frombuffer(t, np.uint8)[~own].tobytes() if own.any() else t
            kept.append(None if null else rest.decode("utf-8", "ignore"))
        cols = {f.name: pa.array(c, k) for f, c, k in zip(others, b.carry, kinds, strict=False)} | {text_col: pa.array(kept, pa.string())}
        return pa.table({n: cols[n] for n in names})

    return B.meet(blocks, parts, finish, docs.schema)


def tokens(b: B.Block) -> R.Tokens:
    raw = b"".join(b.texts)
    table = B.mix(np.arange(1, 257, dtype=np.uint64))
    return R.Tokens(raw, np.frombuffer(raw, np.uint8), np.array([len(t) for t in b.texts], np.int64), table)


def task(length: int = LENGTH) -> R.Task:
    return R.Task("suffix-dedup", 1, length, min(KGRAM, length), True, tokens, functools.partial(solve, length=length))


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document what is removed and what stays; with `texts`, also the text that stays (`kept`).

    Removal is by bytes; a character that loses only some of its bytes shows as a replacement character in `kept`.
    """
    blocks, parts = R.covered(docs, task(length), id_col, text_col)

    def finish(_: int, b: B.Block, got: list[tuple[int, bytes]]) -> pa.Table:
        sizes = [len(t) for t in b.texts]
        m = R.mask(sum(sizes), got)
        removed, spans, sha, kept, at = [], [], [], [], 0
        for t, n in zip(b.texts, sizes, strict=True):
            own = m[at : at + n]
            gone = int(own.sum())
            at += n
            rest = np.frombuffer(t, np.uint8)[~own].tobytes() if gone else t
            removed.append(gone)
            spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if gone else 0)
            sha.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept.append(rest.decode("utf-8", "replace"))
        cols = {"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    return B.meet(blocks, parts, finish, SCHEMA + ", kept string" * texts)
