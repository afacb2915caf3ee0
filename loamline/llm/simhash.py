"""SimHash near-dedup by binary trie self-joins.

Fingerprints are the leaves of a binary trie.  The join walks pairs of trie
nodes of equal depth together, adds up the bits in which their paths differ, and
drops a pair as soon as that exceeds the error budget; a pair of few leaves, or
one that cannot exceed the budget any more, is resolved leaf by leaf.

The join is dealt out by the pigeonhole principle: of m bit fields of two
fingerprints within the budget at least m - budget are equal.  For each choice
of so many fields the fingerprints' bits are ordered with those fields on top,
and the walk begins at the nodes below them; m grows with the corpus, so that
few leaves lie below such a node.  Equal fingerprints are one leaf, whatever
number of documents they stand for.  A node with more than `limit` leaves is cut
into sub-tries, and their pairs are tasks of their own.  A task sends on a
spanning forest of its links, never all pairs.

For looser similarities (near copies of 0.8 and more by their shingles differ in
a seventh of their bits) fingerprints of several lanes are joined by `wide_links`:
choices of some of their bits are keys, as many choices as the wanted recall
takes; leaves that agree in a key are a trie of their own over further bits,
walked with a budget for those, and what is left is held to the whole
fingerprint's budget.  Those links are candidates only, as are shared shingles of
short texts (whose fingerprints are coarse), rare ones first: within each group that
they connect the links are found by the exact Jaccard similarity of the shingles.
Groups too large for a task are first cut by shared rare shingles of whole texts.

Defined results: a text without words has fingerprint zero and links like any
other; null texts are empty; rows with a null id have a fingerprint and no
component; repeated ids are one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import mix, release
from loamline.llm.components import components, local_forest
from loamline.llm.store import Scratch

BITS, BUDGET, SHINGLE, SEED, LIMIT = 64, 4, 4, 42, 1 << 13
#: Distinct shingles up to which texts meet by their shingles, and rows of groups that are settled together.
SHORT, GROUPED = 60, 2000
#: Sets of a group of candidates that one task compares; leaves below a key beyond which they are a star.
SETTLED, STAR = 1024, 2048


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """Of the words of a text, lower-cased in A-Z: bit i is set if it is in over half the shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(w) - words + 1)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = set_bits * 2 > len(h)
    return int(sum(1 << i for i in np.flatnonzero(over).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py() or b"", words, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def field_orders(budget: int, m: int, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """For each choice of m - budget fields, all fields (first bit, width) from the top down, the chosen ones first."""
    edges = [i * bits // m for i in range(m + 1)]
    field = [(a, b - a) for a, b in pairwise(edges)]
    return [[field[i] for i in (*c, *(j for j in range(m) if j not in c))] for c in combinations(range(m), m - budget)]


def reorder(v: np.ndarray, order: list[tuple[int, int]], back: bool = False) -> np.ndarray:
    out, at = np.zeros_like(v), sum(w for _, w in order)
    for first, w in order:
        at -= w
        src, dst = (at, first) if back else (first, at)
        out |= (v >> np.uint64(src) & np.uint64((1 << w) - 1)) << np.uint64(dst)
    return out


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int, bits: int = BITS, top: int = 0, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links as batches of index pairs between two sorted arrays of distinct fingerprints, or within one (right: None).

    A trie node is a range of a sorted array.  The stack holds batches of node pairs of one depth.  Only leaves whose
    first `top` bits are equal are compared.
    """
    self_join = right is None
    right = left if right is None else right
    if not len(left) or not len(right):
        return
    kl, kr = (x >> np.uint64(bits - top) if top else np.zeros(len(x), np.uint64) for x in (left, right))
    keys = np.intersect1d(kl, kr)
    a0, b0 = np.searchsorted(kl, keys), np.searchsorted(kr, keys)
    a1, b1 = np.searchsorted(kl, keys, "right"), np.searchsorted(kr, keys, "right")
    held = [(bits - top, a0, a1, b0, b1, np.zeros(len(keys), np.int64))]
    while held:
        depth, a0, a1, b0, b1, off = held.pop()
        leaf = (depth == 0) | (off + depth <= budget) | ((a1 - a0) * (b1 - b0) <= 8)
        if leaf.any():
            yield from _pairs(left, right, a0[leaf], a1[leaf], b0[leaf], b1[leaf], budget, self_join)
            a0, a1, b0, b1, off = (x[~leaf] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        bit = np.uint64(1 << (depth - 1))
        am, bm = _split(left, a0, a1, bit), _split(right, b0, b1, bit)
        parts = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            good = (x0 < x1) & (y0 < y1) & (off + more <= budget)
            if self_join:
                good &= x0 <= y0
            parts.append([z[good] for z in (x0, x1, y0, y1, off + more)])
        nxt = [np.concatenate(z) for z in zip(*parts, strict=True)]
        for i in range(0, len(nxt[0]), step):
            held.append((depth - 1, *(z[i : i + step] for z in nxt)))


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each range of a sorted array whose higher bits agree, the first place at which a bit is set: by binary search."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        up = (x[np.minimum(mid, len(x) - 1)] & bit) == 0
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def _pairs(left: np.ndarray, right: np.ndarray, a0, a1, b0, b1, budget: int, self_join: bool, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaves of small node pairs, one by one, with the exact distance."""
    count = (a1 - a0) * (b1 - b0)
    edge = np.cumsum(count)
    at = 0
    while at < len(count):
        upto = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + most, side="right")))
        c = count[at:upto]
        if int(c.sum()) > most and upto == at + 1:
            for row in range(int(a0[at]), int(a1[at])):
                j = np.arange(b0[at], b1[at])
                yield from _near(left, right, np.full(len(j), row), j, budget, self_join)
        else:
            k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            width = np.repeat((b1 - b0)[at:upto], c)
            yield from _near(left, right, np.repeat(a0[at:upto], c) + k // width, np.repeat(b0[at:upto], c) + k % width, budget, self_join)
        at = upto


def _near(left, right, i, j, budget: int, self_join: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    good = np.bitwise_count(left[i] ^ right[j]) <= budget
    if self_join:
        good &= i < j
    if good.any():
        yield i[good], j[good]


def _forest(values: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between values, as pairs (value, first value of its tree)."""
    root = np.arange(len(values))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def join(root: np.ndarray) -> np.ndarray:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        apart = root[i] != root[j]
        return local_forest(len(values), np.concatenate([np.arange(len(values)), i[apart]]), np.concatenate([root, j[apart]]))

    for i, j in found:
        held.append((i, j))
        if sum(len(x) for x, _ in held) > most:
            root, held = join(root), []
    if held:
        root = join(root)
    own = np.flatnonzero(root != np.arange(len(values)))
    return values[own], values[root[own]]


def links(fps: DataFrame, keep: Scratch, budget: int = BUDGET, limit: int = LIMIT, per_task: int = 1 << 15) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (column fp, signed)."""
    n, m = fps.count(), budget + 1
    while n >> (m - budget) * (BITS // m) > limit // 4:
        m += 1
    orders = field_orders(budget, m)
    tops = [sum(w for _, w in o[: m - budget]) for o in orders]
    spread = max(0, min(min(tops), (n // per_task).bit_length()))
    schema = "choice int, value long, task long, fp long"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for c, order in enumerate(orders):
                r = reorder(v, order)
                task = r >> np.uint64(BITS - spread) if spread else np.zeros(len(r), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), c, np.int32)), pa.array((r >> np.uint64(BITS - tops[c])).view(np.int64)), pa.array(task.view(np.int64)), pa.array(r.view(np.int64))], names=["choice", "value", "task", "fp"])

    keyed = keep.save(fps.select("fp").mapInArrow(key, schema))
    sizes = keyed.groupBy("choice", "value").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    sizes = keep.save(sizes.select("choice", "value", F.ceil(F.log2(F.col("n") / F.lit(limit / 2))).cast("int").alias("depth")))

    def out(c: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
        a, b = (reorder(x, orders[c], back=True).view(np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    def one(t: pa.Table) -> pa.Table:
        c, v = t.column("choice")[0].as_py(), np.sort(t.column("fp").to_numpy().view(np.uint64))
        return out(c, *_forest(v, trie_join(v, None, budget, top=tops[c])))

    if sizes.isEmpty():
        return keyed.select("choice", "task", "fp").groupBy("choice", "task").applyInArrow(one, "a long, b long")
    small = keyed.join(sizes, ["choice", "value"], "left_anti")
    cut = keyed.join(sizes, ["choice", "value"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each leaf once for each pair of sub-tries that its own is in; leaves are dealt to sub-tries evenly."""
        for b in batches:
            v, depth = b.column(3).to_numpy().view(np.uint64), b.column(2).to_numpy()
            node = ((v * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - depth.astype(np.uint64))).astype(np.int64)
            for d in np.unique(depth).tolist():
                own = np.flatnonzero(depth == d)
                i, x, y = np.repeat(own, 1 << d), np.repeat(node[own], 1 << d), np.tile(np.arange(1 << d), len(own))
                lo = np.minimum(x, y)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(v[i].view(np.int64)), pa.array(lo), pa.array(np.maximum(x, y)), pa.array(x == lo)], names=["choice", "value", "fp", "lo", "hi", "in_lo"])

    def two(t: pa.Table) -> pa.Table:
        v, c = t.column("fp").to_numpy().view(np.uint64), t.column("choice")[0].as_py()
        in_lo = t.column("in_lo").to_numpy()
        a, b = np.sort(v[in_lo]), np.sort(v[~in_lo])
        if t.column("lo")[0] == t.column("hi")[0]:
            return out(c, *_forest(a, trie_join(a, None, budget, top=tops[c])))
        return out(c, *_forest(np.concatenate([a, b]), ((i, j + len(a)) for i, j in trie_join(a, b, budget, top=tops[c]))))

    found = small.select("choice", "task", "fp").groupBy("choice", "task").applyInArrow(one, "a long, b long")
    dealt = cut.select("choice", "value", "depth", "fp").mapInArrow(nodes, "choice int, value long, fp long, lo long, hi long, in_lo boolean")
    return found.unionByName(dealt.groupBy("choice", "value", "lo", "hi").applyInArrow(two, "a long, b long"))


def shingles(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; of a shorter text the whole is one."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[min(words, len(w)) - 1 :].tolist(), strict=True)), np.uint64, n))


def lanes_of(h: np.ndarray, lanes: int) -> bytes:
    """A fingerprint of 64 bits a lane: the lanes are those of differently mixed hashes of the same shingles."""
    count = np.zeros((lanes, BITS), np.int64)
    salt = np.array([k * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(lanes)], np.uint64)[:, None]
    # 255 bits at most in a sum, which a byte holds.
    for at in range(0, len(h), 255):
        bits = np.unpackbits(mix(h[at : at + 255] + salt).view(np.uint8).reshape(lanes, -1, 8), axis=2, bitorder="little")
        count += np.add.reduce(bits, axis=1, dtype=np.uint8)
    return np.packbits(count.ravel() * 2 > len(h), bitorder="little").tobytes()


def least_common(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """How many of a set's n elements a set as similar as that must share."""
    return np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)


def wide_fingerprints(docs: DataFrame, similarity: float = 0.8, words: int = 5, lanes: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text doc_id, the fingerprint of `lanes` x 64 bits of its distinct shingles, their digest, a short text's
    shingles, and how many of those, in whatever order, another as similar must hold one of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, digest, short, first = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py() or b"", words)
                fp.append(lanes_of(h, lanes))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                # A partner of a text of SHORT shingles has at most SHORT / similarity.
                own = h if len(h) * similarity <= SHORT else h[:0]
                short.append(own.view(np.int64).tolist())
                first.append(len(own) - int(least_common(len(own), similarity)) + 1 if len(own) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary()), pa.array(digest, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(first, pa.int32())], names=["doc_id", "fp", "digest", "short", "first"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp binary, digest binary, short array<long>, first int")


def differing_share(similarity: float) -> float:
    """The share of bits in which fingerprints of two shingle sets of this Jaccard similarity differ on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_links(fps: DataFrame, keep: Scratch, similarity: float = 0.8, lanes: int = 8, recall: float = 0.99, per_task: int = 1 << 15) -> DataFrame:
    """A spanning forest (a, b) of the candidate links between distinct wide fingerprints (column fp, bytes).

    Two are linked if they differ in at most the bits that a pair of the given similarity differs in, plus 5 standard
    deviations of that number; `recall` is that of the keys for a pair 2 standard deviations off, nearer pairs have more.
    """
    n, bits, share = fps.count(), BITS * lanes, differing_share(similarity)
    spare = (bits * share * (1 - share)) ** 0.5
    budget, far = int(bits * share + 5 * spare), share + 2 * spare / bits
    # Below a key of a table there are 256 leaves at most on average; the number of tables stays as it is until then.
    top = max(16, min(40, n.bit_length() - 8))
    rest = 48
    rest_budget = int(rest * far + 3.3 * (rest * far * (1 - far)) ** 0.5)
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - far) ** top)))
    rng = np.random.default_rng(11)
    picks = [rng.permutation(bits)[: min(64, top + rest)] for _ in range(tables)]
    spread = max(0, min(top, (n // per_task).bit_length()))

    def keys(raw: np.ndarray, t: int) -> np.ndarray:
        """The chosen bits of a table, the key on top."""
        b = np.unpackbits(raw, axis=1, bitorder="little")[:, picks[t]]
        out = np.zeros(len(raw), np.uint64)
        for k in range(b.shape[1]):
            out |= b[:, k].astype(np.uint64) << np.uint64(63 - k)
        return out

    def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in col), np.uint8).reshape(-1, 8 * lanes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = matrix(b.column(0))
            for t in range(tables):
                task = (keys(raw, t) >> np.uint64(64 - spread)).astype(np.int32) if spread else np.zeros(len(raw), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), pa.array(task), b.column(0)], names=["choice", "task", "fp"])

    def near(raw: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in found:
            for at in range(0, len(i), 1 << 18):
                a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                good = np.bitwise_count(raw[a] ^ raw[b]).sum(axis=1) <= budget
                if good.any():
                    yield a[good], b[good]

    def one(t: pa.Table) -> pa.Table:
        raw = matrix(t.column("fp"))
        v = keys(raw, t.column("choice")[0].as_py())
        by = np.argsort(v, kind="stable")
        wide = np.ascontiguousarray(raw[by]).view(np.uint64)
        v = v[by]
        # So many leaves below one key are a group of near copies: a star of candidates, whose links are verified like all.
        key = v >> np.uint64(64 - top)
        _, begin, size = np.unique(key, return_index=True, return_counts=True)
        crowd = np.repeat(size > STAR, size)
        head = np.repeat(begin, size)
        own = np.flatnonzero(~crowd)
        found = ((own[i], own[j]) for i, j in near(wide[own], trie_join(v[own], None, rest_budget, top=top)))
        a, b = _forest(np.arange(len(v)), chain([(np.flatnonzero(crowd), head[crowd])], found))
        release()
        return pa.table({"a": pa.array([wide[k].tobytes() for k in a], pa.binary()), "b": pa.array([wide[k].tobytes() for k in b], pa.binary())})

    return fps.select("fp").mapInArrow(deal, "choice int, task int, fp binary").groupBy("choice", "task").applyInArrow(one, "a binary, b binary")


def rare_links(sets: DataFrame, keep: Scratch, *within: str) -> DataFrame:
    """(na, nb): stars over sets (node, short, first) that share one of their first shingles, rare ones before common ones.

    Any order of all shingles loses no link.  By this one a line that many texts hold is among the first of those only
    that are little else, so that it doesn't connect texts that merely hold it.  What one set alone has finds nobody,
    but takes its place.  Columns `within` are equal in sets that are looked at together.
    """
    by = [*within, "h"]
    all_ = sets.select("node", "first", F.size("short").alias("size"), *within, F.explode("short").alias("h"))
    common = all_.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    ranked = all_.join(common, by).groupBy("node", "first", "size", *within).agg(F.sort_array(F.collect_set(F.struct("n", "h"))).alias("at"))
    ranked = ranked.withColumn("left", F.col("first") - (F.col("size") - F.size("at"))).filter("left > 0")
    rows = keep.save(ranked.select("node", *within, F.explode(F.slice("at", F.lit(1), F.col("left"))).alias("x")).select("node", *within, "x.h"))
    return rows.join(rows.groupBy(*by).agg(F.min("node").alias("nb")), by).select(F.col("node").alias("na"), "nb").filter("na <> nb")


def refined(grouped: DataFrame, text: DataFrame, keep: Scratch, similarity: float, words: int, most: int = SETTLED) -> DataFrame:
    """Candidates (rep, node, digest, component), those of groups of more than `most` sets in finer groups: by shared rare shingles of all their texts, which loses no link."""
    large = keep.save(grouped.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("component"))
    if large.isEmpty():
        return grouped
    inside = keep.save(grouped.join(large, "component"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, short, first = [], [], []
            for k, (digest, t) in enumerate(zip(b.column("digest").to_pylist(), b.column("text"), strict=True)):
                h = shingles(t.as_py() or b"", words)
                if xxhash.xxh3_128_digest(h.tobytes()) == digest:
                    rows.append(k)
                    short.append(h.view(np.int64))
                    first.append(len(h) - int(least_common(len(h), similarity)) + 1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("node").take(at), b.column("component").take(at), pa.array(short, pa.list_(pa.int64())), pa.array(first, pa.int32())], names=["node", "component", "short", "first"])

    sets = inside.join(text, "rep").select("node", "component", "digest", "text").mapInArrow(own, "node long, component long, short array<long>, first int")
    finer = components(rare_links(sets, keep, "component").select(F.col("na").alias("a"), F.col("nb").alias("b")), keep)
    finer = inside.drop("component").join(finer.withColumnRenamed("id", "node"), "node").select("rep", "node", "digest", "component")
    return keep.save(grouped.join(large, "component", "left_anti").select(*finer.columns).unionByName(finer))


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one that links of at least this Jaccard similarity connect it with, by exact counts.

    A walk over the links: each set is compared with those that it hasn't reached yet.
    """
    group = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    kinds, vals = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.append(0, np.cumsum(size))
    left, own = np.arange(len(sets)), np.repeat(np.arange(len(sets)), size)
    rest = vals
    mark = np.zeros(len(kinds), bool)
    while len(left):
        first, front = int(left[0]), [int(left[0])]
        gone = np.zeros(len(sets), bool)
        gone[first] = True
        keep = ~gone[own]
        left, own, rest = left[1:], own[keep], rest[keep]
        while front and len(left):
            k = front.pop()
            mine = vals[at[k] : at[k + 1]]
            mark[mine] = True
            both = np.bincount(own[mark[rest]], minlength=len(sets))[left]
            mark[mine] = False
            near = left[both >= similarity * (size[k] + size[left] - both) - 1e-9]
            if len(near):
                group[near] = first
                front += near.tolist()
                gone[near] = True
                left, keep = left[~gone[left]], ~gone[own]
                own, rest = own[keep], rest[keep]
    return group


def settled(grouped: DataFrame, text: DataFrame, keep: Scratch, similarity: float, words: int, most: int = SETTLED) -> DataFrame:
    """(digest, component): of candidates (rep, node, digest, component) the groups that exact links make, named by their least document.

    Small groups are dealt to buckets.  A group of more than `most` sets is cut into blocks.  Links are looked for within
    each block, and between the heads of the blocks' largest parts; that joins most of a group of near copies.  What is
    not in the group's largest part by then is compared with all its blocks: of two sets with a link one is such, or both
    are in the largest part already.
    """

    def walk(t: pa.Table) -> tuple[list[int], np.ndarray]:
        """The table's distinct sets as rows in order of their documents, and for each the first that links connect it with."""
        got: dict[bytes, tuple[int, int, np.ndarray]] = {}
        for k, (rep, digest, raw) in enumerate(zip(t.column("rep").to_pylist(), t.column("digest").to_pylist(), t.column("text"), strict=True)):
            if digest not in got:
                h = shingles(raw.as_py() or b"", words)
                # A document's rows may hold other texts.
                if xxhash.xxh3_128_digest(h.tobytes()) == digest:
                    got[digest] = (rep, k, h)
        order = sorted(got.values(), key=lambda x: x[:2])
        return [k for _, k, _ in order], similar_groups([h for _, _, h in order], similarity) if order else np.zeros(0, np.int64)

    sizes = keep.save(grouped.groupBy("component").agg(F.count("*").alias("n")))
    big = sizes.filter(F.col("n") > most)
    small = grouped.join(big, "component", "left_anti")
    buckets = 1 + grouped.count() // GROUPED

    def whole(t: pa.Table) -> pa.Table:
        digests, linked = [], []
        comp = t.column("component").to_numpy()
        for c in np.unique(comp).tolist():
            part = t.take(pa.array(np.flatnonzero(comp == c)))
            rows, group = walk(part)
            rep, digest = part.column("rep").to_pylist(), part.column("digest").to_pylist()
            digests += [digest[k] for k in rows]
            linked += [rep[rows[g]] for g in group.tolist()]
        release()
        return pa.table({"digest": pa.array(digests, pa.binary()), "component": pa.array(linked, pa.int64())})

    near = small.join(text, "rep").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    out = near.drop("node").groupBy("bucket").applyInArrow(whole, "digest binary, component long")
    if big.isEmpty():
        return out

    def link(t: pa.Table) -> pa.Table:
        """(a, head, top): each set with the first one that it is connected with, and whether that heads the part's largest group."""
        rows, group = walk(t)
        node = t.column("node").to_numpy()[rows] if rows else np.zeros(0, np.int64)
        top = int(np.bincount(group).argmax()) if rows else 0
        release()
        return pa.table({"a": node, "b": node[group], "top": pa.array(group == top)})

    links = "a long, b long, top boolean"
    half = F.lit(most // 2)
    member = keep.save(grouped.join(big.select("component", F.ceil(F.col("n") / half).cast("int").alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")))
    texts = keep.save(member.join(text, "rep"))
    first = keep.save(texts.groupBy("component", "block").applyInArrow(link, links))
    heads = texts.join(first.filter("top and a = b").select(F.col("a").alias("node")), "node", "left_semi").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("blocks") / F.lit(most))))
    second = keep.save(heads.groupBy("component", "part").applyInArrow(link, links))
    found = first.unionByName(second).select("a", "b")
    label = keep.save(member.select("node", "component").join(components(found, keep).select(F.col("id").alias("node"), F.col("component").alias("label")), "node", "left").select("node", "component", F.coalesce("label", "node").alias("label")))
    parts = label.groupBy("component", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    rest = keep.save(label.join(largest, "component").filter("label <> largest").select("node", "component"))
    chunks = rest.groupBy("component").agg(F.ceil(F.count("*") / half).cast("int").alias("chunks"))
    inside = texts.join(chunks, "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    other = texts.join(rest.select("node"), "node", "left_semi").join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("digest", F.lit(7)), F.col("chunks")).cast("int"))
    other = other.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    third = inside.unionByName(other.select(*inside.columns)).groupBy("component", "block", "chunk").applyInArrow(link, links)
    found = found.unionByName(keep.save(third).select("a", "b"))
    ends = components(found, keep).select(F.col("id").alias("node"), F.col("component").alias("label"))
    named = keep.save(member.select("node", "rep", "digest").join(ends, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    return out.unionByName(named.join(least, "label").select("digest", "component"))


def dedup_similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents that links of this Jaccard similarity of their 5-word shingles, or more, connect."""
    keep = Scratch(docs.sparkSession, "simhash-similar")
    fps = keep.save(wide_fingerprints(docs, similarity, words, id_col=id_col, text_col=text_col).filter("doc_id is not null"))
    # A set of shingles is named by its smallest doc_id; digests tell apart sets that one document's rows hold.
    sets = keep.save(fps.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("short").alias("short"), F.first("first").alias("first")).withColumn("node", F.xxhash64("digest")))
    leaf = keep.save(sets.groupBy("fp").agg(F.min("node").alias("node")))
    forest = keep.save(wide_links(leaf, keep, similarity).distinct())
    wide = forest.join(leaf.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(leaf.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select("na", "nb")
    equal = sets.join(leaf.withColumnRenamed("node", "nb"), "fp").select(F.col("node").alias("na"), "nb")
    maybe = components(wide.unionByName(equal).unionByName(rare_links(sets, keep)).select(F.col("na").alias("a"), F.col("nb").alias("b")), keep)
    grouped = keep.save(sets.join(maybe.withColumnRenamed("id", "node"), "node").select("rep", "node", "digest", "component"))
    text = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text"))
    grouped = refined(grouped, text, keep, similarity, words, SETTLED)
    named = keep.save(settled(grouped, text, keep, similarity, words, SETTLED))
    named = sets.join(named, "digest", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return fps.select("doc_id", "digest").join(named, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def dedup(docs: DataFrame, budget: int = BUDGET, words: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint, component_id, and kept (doc_id = component_id)."""
    keep = Scratch(docs.sparkSession, "simhash")
    fps = keep.save(fingerprints(docs, id_col, text_col, words, seed))
    # A fingerprint stands for its smallest doc_id; links between fingerprints become links between those.
    leaf = keep.save(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    forest = keep.save(links(leaf, keep, budget))
    a = leaf.select(F.col("fp").alias("a"), F.col("rep").alias("ra"))
    b = leaf.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    joined = forest.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    repeated = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    same_doc = fps.join(repeated, "doc_id", "left_semi").join(leaf, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(joined.unionByName(same_doc), keep)
    named = leaf.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept")
    )
