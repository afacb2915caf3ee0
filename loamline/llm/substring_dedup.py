"""Substring dedup with prefix-partitioned suffix trees, over words.

The suffixes to look at are split by prefixes of variable length: by the first
word, and where a part is still larger than a task should hold by one word
more, until it fits or the prefix is as long as a window.  For each part a
suffix tree is built from its sorted suffixes; an internal node of depth d and
its leaves say that a sequence of d words occurs once for each leaf, and the
deep nodes are the maximal repeats.  The suffixes are those of whole snippets, not
of windows: nodes have the depth that their texts have in common.  Of the nodes at
least a window deep the topmost ones hold all places of a window.

Texts reach the trees through :mod:`loamline.llm.repeats`: as runs of words around
an anchor, so a repeat that spans several anchors is the sum of its runs.  Defined results: a
null text has no words; a null id orders after all others; rows with one id are
one document; texts under a window keep every word; an empty table gives no
rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loamline.llm import blocks as B
from loamline.llm import repeats as R

WINDOW, KGRAM, PART_ROWS = 13, 6, 1 << 16
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def partitions(words: np.ndarray, at: np.ndarray, limit: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of the suffixes with one prefix each: (words in the prefix, suffixes).  A part over the limit has a prefix of `most` words."""
    held = [(0, at)]
    while held:
        depth, own = held.pop()
        if len(own) <= limit or depth == most:
            yield depth, own
            continue
        w = words[own + depth]
        by = np.argsort(w, kind="stable")
        edges = np.flatnonzero(w[by][1:] != w[by][:-1]) + 1
        fine, whole = [], 0
        for part in np.split(own[by], edges):
            if whole and whole + len(part) > limit:
                yield depth, np.concatenate(fine)
                fine, whole = [], 0
            if len(part) > limit:
                held.append((depth + 1, part))
            else:
                fine.append(part)
                whole += len(part)
        if fine:
            yield depth, np.concatenate(fine)


def sorted_with_lcp(words: np.ndarray, at: np.ndarray, room: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their words, each up to its room, and the common words of neighbours.  `skip` words are known to agree."""
    top = int(room.max()) if len(at) else 0
    cols = []
    for d in range(skip, top):
        inside = d < room
        cols.append(np.where(inside, words[np.minimum(at + d, len(words) - 1)] + 1, 0))
    by = np.lexsort(cols[::-1]) if cols else np.arange(len(at))
    lcp = np.full(max(0, len(at) - 1), skip)
    alive = np.ones(len(lcp), bool)
    for c in cols:
        c = c[by]
        alive &= (c[1:] == c[:-1]) & (c[1:] > 0)
        if not alive.any():
            break
        lcp[alive] += 1
    return by, lcp


def internal_nodes(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Internal nodes of at least `least` words in a tree over sorted suffixes: (depth, first leaf, last leaf), children before parents."""
    out, stack = [], []
    for i, d in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if d >= least and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return out


def topmost(nodes: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Of nodes, children before parents, those that are below no other."""
    at = None
    for node in reversed(nodes):
        if at is None or node[2] < at:
            yield node
            at = node[1]


def solve(x: R.Snippets, length: int = WINDOW, limit: int = PART_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of snippets that start in a document before, by the deep nodes of the shard's suffix trees."""
    _, words = np.unique(x.raw, return_inverse=True)
    ends = np.cumsum(x.sizes)
    windows = x.sizes - length + 1
    snippet = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(snippet)) - np.repeat(np.cumsum(windows) - windows, windows) + (ends - x.sizes)[snippet]
    owner = np.full(len(words), -1, np.int64)
    owner[at] = snippet
    found = []
    for depth, own in partitions(words, at, limit, length):
        s = owner[own]
        by, lcp = sorted_with_lcp(words, own, ends[s] - own, depth)
        order = x.order[s][by]
        own = own[by]
        for _, first, last in topmost(internal_nodes(lcp, length)):
            group = order[first : last + 1]
            found.append(own[first : last + 1][group > group.min()])
    hit = np.concatenate(found) if found else np.zeros(0, np.int64)
    s = owner[hit]
    return R.runs(s, hit - (ends - x.sizes)[s])


def maximal_repeats(text: list[str], least: int = 1, limit: int = PART_ROWS) -> set[tuple[tuple[str, ...], int]]:
    """Sequences of at least `least` words that occur more than once and that no longer one includes each time: (words, occurrences)."""
    kinds, words = np.unique(np.array(text, dtype=object), return_inverse=True) if text else (np.zeros(0, object), np.zeros(0, np.int64))
    at = np.arange(len(words))
    out = set()
    for depth, own in partitions(words, at[: max(0, len(at) - least + 1)], limit, least):
        by, lcp = sorted_with_lcp(words, own, len(words) - own, depth)
        own = own[by]
        for d, first, last in internal_nodes(lcp, least):
            group = own[first : last + 1]
            left = {int(words[p - 1]) if p else -1 - int(p) for p in group.tolist()}
            if len(left) > 1 or 0 in group:
                out.add((tuple(kinds[words[group[0] : group[0] + d]].tolist()), len(group)))
    return out


def tokens(b: B.Block) -> R.Tokens:
    words = [t.split() for t in b.texts]
    sizes = np.array([len(w) for w in words], np.int64)
    v = np.fromiter(map(xxhash.xxh64_intdigest, (w for ws in words for w in ws)), np.uint64, int(sizes.sum()))
    return R.Tokens(v.tobytes(), v, sizes)


def task(length: int = WINDOW) -> R.Task:
    return R.Task("substring-dedup", 8, length, min(KGRAM, length), False, tokens, functools.partial(solve, length=length))


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document its words, how many are removed and what stays; with `texts`, also the words that stay (`kept`)."""
    blocks, parts = R.covered(docs, task(window), id_col, text_col)

    def finish(_: int, b: B.Block, got: list[tuple[int, bytes]]) -> pa.Table:
        words = [t.split() for t in b.texts]
        sizes = [len(w) for w in words]
        m = R.mask(sum(sizes), got)
        removed, sha, kept, at = [], [], [], 0
        for w, n in zip(words, sizes, strict=True):
            own = m[at : at + n]
            at += n
            gone = int(own.sum())
            rest = b" ".join([x for x, g in zip(w, own.tolist(), strict=True) if not g] if gone else w)
            removed.append(gone)
            sha.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept.append(rest.decode("utf-8"))
        cols = {"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    return B.meet(blocks, parts, finish, SCHEMA + ", kept string" * texts)
