"""Embedding near-dedup with a robust-pruned flat graph.

Vectors with one label are dealt to overlapping cluster shards: each has one
*home*, the cell of its nearest centre, and is a guest in the shards of the next
nearest ones.  Shards with more than `limit` members are dealt again, with centres
of their own; members that centres cannot part are parted by a hash.  A vector has
three copies and one more for each further level, so copies grow with the logarithm
of a label's size.

In each shard a flat proximity graph is built by inserting vectors in batches: a
greedy search from the shard's medoid finds candidates, robust pruning keeps a
short list of them that cover all directions, and reverse edges are added and
pruned likewise.  The adjacency lists that a vector has in its shards are united.
Then every vector is searched from the medoid of its home shard over the united
lists: greedily to its neighbourhood, and from there on through every vector in
range until no new one is found.  A vector that doesn't come across its own node
went astray and is searched again with a beam twice as wide.

From shard to shard the search goes on by cells: a vector *touches* each cell that
holds a link of it or a neighbour in its lists within `SLACK` of a link.  A pair of
cells with such a vector is verified, all their vectors in double precision.  Where
that finds links of a cell's vectors, the cells that those vectors' partners touch
are in range too, and their pairs come next, until a round brings no new pair.  So
a link counts once, in the pair of its ends' homes, and the pairs verified are as
many as clusters have, not as a label has.

The search is audited: for about `AUDIT` vectors of each label the links with all
vectors of the label are counted and compared with those found.  Where less than
`RECALL` of them was found, all pairs of the label's cells are verified.  The
result's column `recall` is the share found before that (null: no links there).

Only centres are fitted on a sample (`SAMPLE` vectors a shard at most); every
vector is indexed and searched.  Nothing is collected to the driver.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, links with nothing; vectors of different
length link with nothing; equal vectors are one node that stands for all of
them, so that copies cost nothing; a null vec_id counts as a link of others and
is its own component (null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import release
from loamline.llm.components import components, local_forest
from loamline.llm.store import Scratch

COSINE, DEGREE, BEAM, ALPHA = 0.93, 24, 48, 1.2
LIMIT, SAMPLE, AUDIT, RECALL = 2048, 4096, 64, 0.99
SLACK = 0.12
#: Pairs of a query and a node that are looked at together; it bounds memory.
STEP = 1 << 13
#: Vectors that one task deals to centres or compares with a sample.
ROWS = 20_000


def unit(x: list | None) -> bytes | None:
    """A vector of length one in double precision, as bytes; None where it has no direction."""
    if not x or any(v is None for v in x):
        return None
    v = np.asarray(x, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if not top:
        return None
    v = v / top
    return (v / np.sqrt(v @ v) + 0.0).tobytes()


class Graph:
    """A flat graph over unit vectors: up to `degree` neighbours each, and the medoid where searches begin."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM):
        self.x, self.x4, self.degree, self.alpha, self.beam = x, x.astype(np.float32), degree, alpha, beam
        self.adj = np.full((len(x), degree), -1, np.int64)
        self.medoid = int(np.argmax(x @ x.mean(axis=0))) if len(x) else 0

    def build(self, batch: int = 192, seed: int = 7) -> Graph:
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.medoid], order[order != self.medoid]]) if n else order
        first = order[:batch]
        sims = self.x4[first] @ self.x4[first].T
        np.fill_diagonal(sims, -np.inf)
        near = np.argsort(-sims, axis=1)[:, : self.beam]
        near = near[:, : max(0, len(first) - 1)]
        self._link(first, first[near])
        for at in range(batch, n, batch):
            own = order[at : at + batch]
            ids, _, _ = self.search(self.x4[own], self.beam)
            self._link(own, ids)
        return self.repair()

    def reachable(self) -> np.ndarray:
        """Which nodes a walk from the medoid can come to."""
        got = np.zeros(len(self.x) + 1, bool)
        got[[self.medoid, -1]] = True
        front = np.array([self.medoid])
        while len(front):
            nb = np.unique(self.adj[front])
            front = nb[~got[nb]]
            got[front] = True
        return got[:-1]

    def repair(self, batch: int = 6) -> Graph:
        """Links unreachable nodes from the least linked of the nearest nodes that a search for them finds, until every node can be reached.

        A ball of near copies fills its lists with itself; this is its door.
        """
        while len(self.x):
            away = np.flatnonzero(~self.reachable())
            if not len(away):
                break
            own = away[:: -(-len(away) // batch)]
            ids, _, _ = self.search(self.x4[own], self.beam)
            for near, u in zip(ids[:, :8], own.tolist(), strict=True):
                near = near[near >= 0]
                r = int(near[(self.adj[near] >= 0).sum(axis=1).argmin()])
                free = np.flatnonzero(self.adj[r] < 0)
                if not len(free):
                    self.adj = np.concatenate([self.adj, np.full((len(self.adj), 4), -1, np.int64)], axis=1)
                    free = [self.adj.shape[1] - 4]
                self.adj[r, free[0]] = u
        return self

    def _link(self, own: np.ndarray, cand: np.ndarray) -> None:
        self.adj[own] = self.prune(own, cand)
        src = np.repeat(own, self.degree)
        dst = self.adj[own].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max()) if len(nodes) else 0), -1, np.int64)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate([self.adj[nodes], wide], axis=1)
        for s in range(0, len(nodes), 256):
            part = slice(s, s + 256)
            self.adj[nodes[part]] = self.prune(nodes[part], both[part])

    def prune(self, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate is kept and drops those that it is `alpha` times nearer to than the vector is."""
        n, width = cand.shape
        out = np.full((n, self.degree), -1, np.int64)
        if not width:
            return out
        cand = np.where(cand == own[:, None], -1, cand)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x4[cand]
        sims = np.where(cand >= 0, np.matmul(v, self.x4[own][:, :, None])[:, :, 0], -np.inf)
        keep = min(width, 96)
        by = np.argsort(-sims, axis=1)[:, :keep]
        rows = np.arange(n)[:, None]
        cand, sims, v = cand[rows, by], sims[rows, by], v[rows, by]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        dist = 2 - 2 * sims
        alive = cand >= 0
        a2 = self.alpha**2
        for k in range(self.degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            pick = alive.argmax(axis=1)
            r = np.arange(n)
            out[has, k] = cand[r, pick][has]
            alive &= ~(a2 * between[r, pick] <= dist)
            alive[r, pick] = False
        return out

    def search(self, q: np.ndarray, beam: int, wide: int = 4, edge: float | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Greedy beam search from the medoid, all queries in step: ids, best first, and what was seen.

        With `edge`, also every (query, node, cosine) met whose cosine is at least that, in the beam or not.
        """
        met: list[tuple[np.ndarray, ...]] = []
        n, b = len(self.x), len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.medoid, q @ self.x4[self.medoid], False
        seen[:, self.medoid] = True
        if edge is not None:
            r = np.flatnonzero(sims[:, 0] >= edge)
            met.append((r, ids[r, 0], sims[r, 0]))
        while True:
            open_ = np.where(done, -np.inf, sims)
            pick = np.argsort(-open_, axis=1)[:, :wide]
            valid = open_[rows, pick] > -np.inf
            if not valid.any():
                return ids, seen[:, :n], met
            done[rows, pick] = True
            nb = self.adj[np.where(valid, ids[rows, pick], 0)]
            nb = np.where(valid[:, :, None], nb, -1).reshape(b, -1)
            nb = np.sort(nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb = np.where((nb >= 0) & ~seen[rows, nb], nb, -1)
            width = int((nb >= 0).sum(axis=1).max())
            if not width:
                continue
            nb = -np.sort(-nb, axis=1)[:, :width]
            seen[rows, nb] = True
            seen[:, n] = False
            s = np.where(nb >= 0, np.matmul(self.x4[nb], q[:, :, None])[:, :, 0], -np.inf)
            if edge is not None:
                r, c = np.nonzero(s >= edge)
                met.append((r, nb[r, c], s[r, c]))
            ids, sims = np.concatenate([ids, nb], axis=1), np.concatenate([sims, s], axis=1)
            done = np.concatenate([done, nb < 0], axis=1)
            by = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = ids[rows, by], sims[rows, by], done[rows, by]
            done |= ids < 0

    def in_range(self, own: np.ndarray, cosine: float, beam: int, batch: int = 192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, other) of indices whose cosine is at least `cosine`, by range-expanding search; verified in double precision.

        Also the queries whose own node the search did not come across: they looked in the wrong place.
        """
        found_q, found_x, lost = [], [], []
        for at in range(0, len(own), batch):
            q = own[at : at + batch]
            edge = np.float32(cosine - SLACK)
            _, seen, met = self.search(self.x4[q], min(beam, len(self.x)), edge=edge)
            lost.append(q[~seen[np.arange(len(q)), q]])
            r, node, s = (np.concatenate(m) for m in zip(*met, strict=True))
            while len(r):
                hit = s >= cosine - 1e-4
                found_q.append(q[r[hit]])
                found_x.append(node[hit])
                nxt = []
                for k in range(0, len(r), STEP):
                    nb = self.adj[node[k : k + STEP]]
                    rr, nn = np.repeat(r[k : k + STEP], nb.shape[1]), nb.ravel()
                    good = (nn >= 0) & ~seen[rr, nn]
                    key = np.unique(rr[good] * len(self.x) + nn[good])
                    rr, nn = key // len(self.x), key % len(self.x)
                    seen[rr, nn] = True
                    for c in range(0, len(rr), STEP):
                        r1, n1 = rr[c : c + STEP], nn[c : c + STEP]
                        s1 = np.einsum("kd,kd->k", self.x4[q[r1]], self.x4[n1])
                        near = s1 >= edge
                        nxt.append((r1[near], n1[near], s1[near]))
                r, node, s = (np.concatenate(x) for x in zip(*nxt, strict=True)) if nxt else (r[:0], node[:0], s[:0])
        i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_q, found_x))
        exact = np.empty(len(i))
        for k in range(0, len(i), 1 << 14):
            part = slice(k, k + (1 << 14))
            exact[part] = np.einsum("kd,kd->k", self.x[i[part]], self.x[j[part]])
        good = (exact >= cosine) & (i != j)
        return i[good], j[good], np.concatenate(lost) if lost else np.zeros(0, np.int64)


def centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means centres of a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = [np.frombuffer(v.as_py()) for v in col]
    return np.stack(rows) if rows else np.zeros((0, 1))


def _mixed(s: int, a: int, b: int) -> int:
    """The cell of a cell."""
    v = (s * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) % (1 << 64)
    return ((v ^ v >> 31) * 0xD6E8FEB86659FD93 + (1 << 63)) % (1 << 64) - (1 << 63)


def _salted(rows: DataFrame, sizes: DataFrame, key: str, other: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of a key dealt to salts of about ROWS, and the one row or few that each salt of the key needs."""
    salts = sizes.select(key, F.ceil(F.col("n") / F.lit(ROWS)).cast("int").alias("salts"))
    left = rows.join(salts, key).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    return left, keep.save(other.join(salts, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))


def shards(nodes: DataFrame, keep: Scratch, limit: int = LIMIT, most_levels: int = 12) -> DataFrame:
    """(id, x, cell, home): every node once at home and as a guest of other cells, no cell with more than `limit` members."""
    now = keep.save(nodes.select("id", "x", F.xxhash64("label", "dim").alias("cell"), F.lit(True).alias("home")))
    settled: DataFrame | None = None
    for step in range(64):
        sizes = keep.save(now.groupBy("cell").agg(F.count("*").alias("n")))
        big = sizes.filter(F.col("n") > limit)
        if big.isEmpty():
            break
        done = now.join(sizes.filter(F.col("n") <= limit).select("cell"), "cell", "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        pool = now.join(big, "cell").filter(F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1 << 20)) < F.lit(float(SAMPLE) / 2 * (1 << 20)) / F.col("n"))

        def split(t: pa.Table) -> pa.Table:
            n = t.column("n")[0].as_py()
            x = _matrix(t.column("x"))[:SAMPLE].astype(np.float32)
            k = max(4, min(64, -(-5 * n // limit)))
            c = centres(x, k, seed=step).astype(np.float32)
            parts = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)).max() <= len(x) / 2 and len(c) > 2 and step < most_levels
            return pa.table({"cell": t.column("cell").slice(0, 1), "c": [c.tobytes() if parts else b""], "k": pa.array([len(c) if parts else k], pa.int32())})

        found = pool.groupBy("cell").applyInArrow(split, "cell long, c binary, k int")
        # A cell without a row in the sample is parted by a hash.
        table = big.join(found, "cell", "left").select("cell", F.coalesce("c", F.lit(b"")).alias("c"), F.coalesce("k", F.lit(4)).alias("k"))
        left, right = _salted(now, big, "cell", table, keep)

        def deal(rows: pa.Table, about: pa.Table) -> pa.Table:
            schema = pa.schema([("id", pa.int64()), ("x", pa.binary()), ("cell", pa.int64()), ("home", pa.bool_())])
            if not rows.num_rows or not about.num_rows:
                return schema.empty_table()
            cell, k, raw = about.column("cell")[0].as_py(), about.column("k")[0].as_py(), about.column("c")[0].as_py()
            guests = 2 if step == 0 else 1
            if raw:
                sims = _matrix(rows.column("x")).astype(np.float32) @ np.frombuffer(raw, np.float32).reshape(k, -1).T
                order = np.argsort(-sims, axis=1, kind="stable")[:, : 1 + guests]
            else:
                ids = rows.column("id").to_numpy().view(np.uint64)
                first = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(k)
                order = np.stack([(first + (ids >> np.uint64(7)) % np.uint64(k - 1) * np.uint64(j > 0) + np.uint64(j)) % np.uint64(k) for j in range(1 + guests)], axis=1).astype(np.int64)
            home = rows.column("home").to_numpy()
            names = np.array([_mixed(cell, 1 + step, 1 + c) for c in range(k)], np.int64)
            take, cells, homes = [], [], []
            for j in range(order.shape[1]):
                own = np.arange(len(home)) if j == 0 else np.flatnonzero(home)
                take.append(own)
                cells.append(names[order[own, j]])
                homes.append(home[own] if j == 0 else np.zeros(len(own), bool))
            rows = rows.take(pa.array(np.concatenate(take)))
            return pa.Table.from_arrays([rows.column("id"), rows.column("x"), pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))], schema=schema)

        dealt = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(deal, "id long, x binary, cell long, home boolean")
        # A guest of its own cell is no second member.
        now = keep.save(dealt.groupBy("id", "cell").agg(F.first("x").alias("x"), F.max("home").alias("home")).select("id", "x", "cell", "home"))
    return now if settled is None else keep.save(settled.unionByName(now))


def compare(x: np.ndarray, y: np.ndarray, cosine: float, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of x and one of y whose cosine is at least that: batches of index pairs."""
    for at in range(0, len(x), step):
        s = x[at : at + step] @ y.T
        # What rounding could turn is decided as everywhere else.
        r, c = np.nonzero(np.abs(s - cosine) < 1e-9)
        s[r, c] = np.einsum("kd,kd->k", x[at + r], y[c])
        i, j = np.nonzero(s >= cosine)
        yield i + at, j


FOUND = "id long, n long, other long, a long, b long"


def verify(t: pa.Table, cosine: float) -> pa.Table:
    """A pair of cells: (id, n) links of each vector, (id, other) a spanning forest, and (a, b) pairs of cells that are in range through it."""
    mine, cell, pair = t.column("id").to_numpy(), t.column("cell").to_numpy(), t.column("a")[0].as_py()
    other = t.column("b")[0].as_py()
    x, mult = _matrix(t.column("x")), t.column("mult").to_numpy()
    p, q = np.flatnonzero(cell == pair), np.flatnonzero(cell == other)
    counts, root = np.zeros(len(mine), np.int64), np.arange(len(mine))
    for i, j in compare(x[p], x[q], cosine):
        i, j = p[i], q[j]
        if pair == other:
            i, j = i[i != j], j[i != j]
            counts += np.bincount(i, mult[j], len(mine)).astype(np.int64)
        else:
            counts += (np.bincount(i, mult[j], len(mine)) + np.bincount(j, mult[i], len(mine))).astype(np.int64)
        apart = root[i] != root[j]
        if apart.any():
            root = local_forest(len(mine), np.concatenate([np.arange(len(mine)), i[apart]]), np.concatenate([root, j[apart]]))
    tree, some = np.flatnonzero(root != np.arange(len(mine))), np.flatnonzero(counts)
    ahead = set()
    if pair != other:
        touches = t.column("touches")
        for k in some.tolist():
            far = other if cell[k] == pair else pair
            ahead |= {(min(far, c), max(far, c)) for c in touches[k].as_py() or ()}
    ahead = sorted(ahead - {(pair, other)})
    m, n, r = len(some), len(tree), len(ahead)
    release()
    cols = [
        np.concatenate([mine[some], mine[tree]]).tolist() + [None] * r,
        counts[some].tolist() + [0] * (n + r),
        [None] * m + mine[root[tree]].tolist() + [None] * r,
        [None] * (m + n) + [c for c, _ in ahead],
        [None] * (m + n) + [c for _, c in ahead],
    ]
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("id", "n", "other", "a", "b"), cols, strict=True)})


def search_shard(x: np.ndarray, ids: np.ndarray, near: list[list[int]], own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members in range: links of `own` that a search over the united lists finds, and neighbours in lists that are almost links."""
    g = Graph(x)
    by = np.argsort(ids)
    lists = []
    for some in near:
        a = np.asarray(some, np.int64)
        at = np.minimum(np.searchsorted(ids[by], a), len(ids) - 1)
        lists.append(by[at[ids[by][at] == a]])
    g.adj = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int64)
    for k, a in enumerate(lists):
        g.adj[k, : len(a)] = a
    g.repair()
    i, j = np.nonzero(g.adj >= 0)
    j = g.adj[i, j]
    close = np.concatenate([np.einsum("kd,kd->k", g.x4[i[k : k + STEP]], g.x4[j[k : k + STEP]]) for k in range(0, len(i), STEP)] or [np.zeros(0)]) >= cosine - SLACK
    key = [i[close] * len(x) + j[close]]
    pending, width = own, BEAM
    while len(pending):
        a, b, lost = g.in_range(pending, cosine, width)
        key.append(np.unique(a * len(x) + b))
        if width >= len(x):
            break
        pending, width = lost, 2 * width
    key = np.unique(np.concatenate(key))
    return key // len(x), key % len(x)


def audit(nodes: DataFrame, counted: DataFrame, cosine: float, keep: Scratch) -> DataFrame:
    """(label, dim, recall): the share of the links of sampled vectors with all of their label that was found; null without any."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    keyed = nodes.withColumn("k", F.xxhash64("label", "dim"))
    sizes = sizes.withColumn("k", F.xxhash64("label", "dim"))
    sample = keep.save(keyed.join(sizes.select("k", "n"), "k").filter(F.pmod(F.xxhash64("id", F.lit(-5)), F.lit(1 << 20)) < F.lit(float(AUDIT) * (1 << 20)) / F.col("n")))
    left, right = _salted(keyed.select("k", "id", "x", "mult"), sizes, "k", sample.select("k", F.col("id").alias("sid"), F.col("x").alias("sx")), keep)

    def exact(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not rows.num_rows or not some.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        ids, mult, sid = rows.column("id").to_numpy(), rows.column("mult").to_numpy(), some.column("sid").to_numpy()
        n = np.zeros(len(sid), np.int64)
        for i, j in compare(_matrix(some.column("sx")), _matrix(rows.column("x")), cosine):
            i, j = i[sid[i] != ids[j]], j[sid[i] != ids[j]]
            n += np.bincount(i, mult[j], len(sid)).astype(np.int64)
        return pa.table({"id": sid, "n": n})

    true = left.groupBy("k", "salt").cogroup(right.groupBy("k", "salt")).applyInArrow(exact, "id long, n long").groupBy("id").agg(F.sum("n").alias("true"))
    seen = sample.select("id", "label", "dim").join(true, "id").join(counted, "id", "left")
    share = F.sum(F.least("true", F.coalesce("n", F.lit(0)))) / F.sum("true")
    return seen.groupBy("label", "dim").agg(F.when(F.sum("true") > 0, share).alias("recall"))


def near_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: int = LIMIT) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept, recall (that of its label's audit)."""
    keep = Scratch(vectors.sparkSession, "flat-graph")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [unit(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(v) // 8 if v else 0 for v in x], pa.int32()), pa.array(x, pa.binary())], names=["vec_id", "label", "dim", "x"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = keep.save(rows.mapInArrow(units, "vec_id long, label string, dim int, x binary"))
    able = rows.filter("x is not null and label is not null")
    # A node is a direction: its id a hash of label and bytes, its name the smallest vec_id.
    node_id = F.xxhash64("label", "x")
    nodes = keep.save(able.groupBy("label", "dim", "x").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep")).withColumn("id", node_id))
    members = shards(nodes, keep, limit)
    homes = members.filter("home").select("id", F.col("cell").alias("at"))
    members = keep.save(members.join(homes, "id"))

    def build(t: pa.Table) -> pa.Table:
        g = Graph(_matrix(t.column("x"))).build()
        ids = t.column("id").to_numpy()
        return pa.table({"id": ids, "near": pa.array([ids[a[a >= 0]].tolist() for a in g.adj], pa.list_(pa.int64()))})

    lists = members.select("cell", "id", "x").groupBy("cell").applyInArrow(build, "id long, near array<long>")
    united = keep.save(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    def search(t: pa.Table) -> pa.Table:
        ids, at = t.column("id").to_numpy(), t.column("at").to_numpy()
        i, j = search_shard(_matrix(t.column("x")), ids, [v or [] for v in t.column("near").to_pylist()], np.flatnonzero(t.column("home").to_numpy()), cosine)
        cells, code = np.unique(at, return_inverse=True)
        both = np.unique(np.concatenate([i * len(cells) + code[j], j * len(cells) + code[i]]))
        i, c = both // len(cells), both % len(cells)
        away = code[i] != c
        release()
        return pa.table({"id": ids[i[away]], "at": at[i[away]], "cell": cells[c[away]]})

    near = keep.save(members.join(united, "id", "left").groupBy("cell").applyInArrow(search, "id long, at long, cell long").distinct())
    touches = near.groupBy("id").agg(F.collect_list("cell").alias("touches"))
    home = keep.save(members.filter("home").select("id", "x", "cell").join(nodes.select("id", "mult"), "id").join(touches, "id", "left"))

    def checked(pairs: DataFrame) -> DataFrame:
        sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("cell"))
        return keep.save(home.join(sides, "cell").groupBy("a", "b").applyInArrow(lambda t: verify(t, cosine), FOUND))

    every = home.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct()
    new = keep.save(every.unionByName(near.select(F.least("at", "cell").alias("a"), F.greatest("at", "cell").alias("b")).distinct()))
    known, found = new, checked(new)
    ahead = found
    while True:
        new = keep.save(ahead.filter("a is not null").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        ahead, known = checked(new), known.unionByName(new)
        found = found.unionByName(ahead)
    counts = lambda: found.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    recall = keep.save(audit(nodes, counts(), cosine, keep))
    short = recall.filter(F.col("recall") < RECALL).select("label", "dim")
    if not short.isEmpty():
        own = nodes.join(short, ["label", "dim"], "left_semi").select("id", F.xxhash64("label", "dim").alias("k")).join(home.select("id", "cell"), "id").select("k", "cell").distinct()
        pairs = own.withColumnRenamed("cell", "a").join(own.withColumnRenamed("cell", "b"), "k").filter("a < b").select("a", "b")
        found = found.unionByName(checked(keep.save(pairs.join(known, ["a", "b"], "left_anti"))))
    counted = counts()
    name = nodes.select("id", "rep")
    edges = found.filter("other is not null").select("id", "other").distinct()
    edges = edges.join(name, "id").join(name.select(F.col("id").alias("other"), F.col("rep").alias("rep2")), "other").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    comp = components(edges, keep).withColumnRenamed("id", "rep")
    about = nodes.join(counted, "id", "left").join(comp, "rep", "left").join(recall, ["label", "dim"], "left")
    about = about.select("label", "x", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "recall")
    out = rows.join(about, ["label", "x"], "left")
    linked = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), linked.alias("component_id"), (F.col("vec_id") == linked).alias("kept"), "recall")
