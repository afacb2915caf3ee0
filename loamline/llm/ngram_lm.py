"""LM scoring with a weighted backoff automaton.

The model is a Dirichlet-smoothed trigram model over words.  Its n-grams are the
states and arcs of an automaton: the root, a state for each word seen in training
and for the start of text, and a state for each bigram seen.  An arc for each
trigram seen leaves its bigram's state, weighted
``log10((c(u,v,w) + mu*p(w|v)) / (c(u,v) + mu))``; an arc for each bigram seen
leaves its word's state, weighted ``log10((c(v,w) + mu*p(w)) / (c(v) + mu))``; at
the root there is an arc for every word, weighted ``log10((c(w)+1) / (N+V+1))``.
A state that has no arc for a word fails: its failure arc, weighted
``log10(mu / (c + mu))``, leads from a bigram to its second word and from a word to
the root, and the word is tried again there.  So the weights of all words after a
state sum to one.  An arc leads to the longest suffix that is a state.

A text is read once from left to right: a state is carried from word to word, arcs
and failure arcs add up.  All texts of a block are read in step, long ones as lanes
of `LANE` words; a lane first reads the two words before it, after which the state
is that of a reading from the start, as no state remembers more.

The counts of all n-grams of all training texts are gathered by the packed
exchange of :mod:`loamline.llm.blocks`; each block then builds the part of the
automaton that its texts can reach and reads them with it.  Nothing is pruned,
capped or sampled, and nothing but two totals comes to the driver.

Defined results: a null or empty text has one token, the end; a null id counts
as training; repeated rows count each time; an empty table gives no rows; with
no training text N = V = 0, every count is zero and the model is the base.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm import blocks as B
from loamline.llm.store import Scratch

END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xD1B54A32D192ED03)
MU = 4.0
FOLDS, HELD_OUT = 7, 2
LANE = 1024
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold_of(doc_id: int | None, folds: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


class Grams:
    """The keys of the words, bigrams and trigrams of a block's texts, in reading order, and their distinct values.

    The first word of a text ends no trigram; `inner` are the places of the others.
    """

    def __init__(self, texts: list[bytes]):
        # A text's words are hashed before the next one is cut: at no time are more held than a text's.
        digest, each = xxhash.xxh64_intdigest, []
        for t in texts:
            words = t.lower().split()
            each.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        self.sizes = np.array([len(w) + 1 for w in each], dtype=np.int64)
        ends = np.cumsum(self.sizes) - 1
        tokens = np.full(int(self.sizes.sum()), END, np.uint64)
        is_word = np.ones(len(tokens), bool)
        is_word[ends] = False
        tokens[is_word] = np.concatenate([*each, np.zeros(0, np.uint64)])
        del each
        self.starts = ends - self.sizes + 1
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = START
        pairs = joined(before, tokens)
        del before, is_word
        inner = np.ones(len(tokens), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner).astype(np.int32)
        triples = joined(pairs[self.inner - 1], tokens[self.inner])
        self.uni, self.uni_at = _numbered(tokens)
        del tokens
        self.bi, self.bi_at = _numbered(pairs)
        del pairs
        self.tri, self.tri_at = _numbered(triples)

    def parents(self) -> tuple[np.ndarray, ...]:
        """Of each bigram its first and second word (the number of words for the start of text), of each trigram its first and second bigram."""
        before = np.empty(len(self.uni_at), np.int32)
        before[1:] = self.uni_at[:-1]
        before[self.starts] = len(self.uni)
        out = [np.empty(len(self.bi), np.int32), np.empty(len(self.bi), np.int32), np.empty(len(self.tri), np.int32), np.empty(len(self.tri), np.int32)]
        for own, at, x in ((out[0], self.bi_at, before), (out[1], self.bi_at, self.uni_at), (out[2], self.tri_at, self.bi_at[self.inner - 1]), (out[3], self.tri_at, self.bi_at[self.inner])):
            own[at] = x
        return tuple(out)

    def keys(self) -> list[np.ndarray]:
        return [self.uni, self.bi, self.tri]

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """How often each distinct n-gram ends at a token, by the tokens' weights."""
        pairs = ((self.uni_at, self.uni, weight), (self.bi_at, self.bi, weight), (self.tri_at, self.tri, weight[self.inner]))
        return [np.bincount(at, w, len(k)).astype(np.int64) for at, k, w in pairs]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them each is."""
    kinds, at = np.unique(x, return_inverse=True)
    return kinds, at.astype(np.int32)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of an n-gram from that of all but its last word, and that word's."""
    return B.mix(a + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9FB21C651E98DF25) ^ B.mix(b)


def in_training(ids: list, folds: int, held_out: int) -> np.ndarray:
    return np.array([fold_of(i, folds) != held_out for i in ids], dtype=bool)


class BackoffAutomaton:
    """The root (state 0), words (1 ..), the start of text and bigrams, with their arcs and failure arcs, over the n-grams of a block.

    An arc is found by the key of its n-gram, which comes from its state's and its label's: of a word's arc among the
    bigrams, of a bigram's among the trigrams.  Training counts are given; an n-gram that training doesn't have is no
    state and no arc.
    """

    def __init__(self, g: Grams, words: np.ndarray, bigrams: np.ndarray, trigrams: np.ndarray, total: float, distinct: float, mu: float):
        self.g, self.size = g, len(words)
        self.start = 1 + self.size
        context = np.append(words, words[np.searchsorted(g.uni, END)])
        b_from, b_label, t_from, t_to = g.parents()
        self.root = np.log10((words + 1.0) / (total + distinct + 1.0))
        second = (bigrams + mu * 10.0 ** self.root[b_label]) / (context[b_from] + mu)
        third = (trigrams + mu * second[t_to]) / (bigrams[t_from] + mu)
        self.failure = np.concatenate([[0.0], np.log10(mu / (context + mu)), np.log10(mu / (bigrams + mu))])
        self.fails_to = np.concatenate([np.zeros(1 + len(context), np.int32), 1 + b_label])
        self.key = np.concatenate([np.zeros(1, np.uint64), g.uni, np.array([START]), g.bi])
        self.two = g.bi, bigrams > 0, np.log10(second), np.arange(2 + self.size, 2 + self.size + len(bigrams), dtype=np.int32)
        self.three = g.tri, trigrams > 0, np.log10(third), 2 + self.size + t_to
        self.root_leads = np.where(words > 0, 1 + np.arange(self.size), 0)

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word for each reading: the state after it and the weight of the arcs taken.

        Where a state has no arc for the word its failure arc is taken, from bigrams to words and from words to the root.
        """
        state, total = state.copy(), np.zeros(len(state))
        nxt = np.zeros(len(state), np.int64)
        left = np.flatnonzero(state > self.start)
        for keys, seen, weight, leads in (self.three, self.two):
            if len(left) and len(keys):
                want = joined(self.key[state[left]], self.g.uni[label[left]])
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = (keys[at] == want) & seen[at]
                done = left[hit]
                total[done] += weight[at[hit]]
                nxt[done] = leads[at[hit]]
                state[done] = -1
                left = left[~hit]
            total[left] += self.failure[state[left]]
            state[left] = self.fails_to[state[left]]
            left = np.flatnonzero(state > 0)
        left = np.flatnonzero(state == 0)
        total[left] += self.root[label[left]]
        nxt[left] = self.root_leads[label[left]]
        return nxt, total

    def read(self, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The weight of each text, read from left to right; all lanes (of two words at least) in step."""
        lanes = -(-sizes // lane)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[owner] + number * lane
        end = np.minimum(begin + lane, (starts + sizes)[owner])
        state = np.where(number > 0, 0, self.start)
        for back in (2, 1):
            inside = np.flatnonzero(number > 0)
            state[inside] = self.step(state[inside], labels[begin[inside] - back])[0]
        by = np.argsort(begin - end, kind="stable")
        begin, end, state, owner = begin[by], end[by], state[by], owner[by]
        length = end - begin
        total = np.zeros(len(by))
        for k in range(int(length.max()) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            state[:live], weight = self.step(state[:live], labels[begin[:live] + k])
            total[:live] += weight
        return np.bincount(owner, total, len(sizes))


def score(docs: DataFrame, mu: float = MU, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every text by a model of the texts whose crc32(id) mod folds is not held_out."""
    spark = docs.sparkSession
    keep = Scratch(spark, "ngram-lm")
    blocks = keep.save(B.to_blocks(docs, id_col, text_col), "none")
    shards = B.shard_count(blocks)

    def ask(_: int, b: B.Block) -> Iterator[tuple[int, bytes]]:
        g = Grams(b.texts)
        counts = g.counts(np.repeat(in_training(b.ids, folds, held_out), g.sizes).astype(np.float64))
        edges = [B.shard_edges(k, shards) for k in g.keys()]
        for s in range(shards):
            parts = [(k[e[s] : e[s + 1]], n[e[s] : e[s + 1]]) for k, n, e in zip(g.keys(), counts, edges, strict=True)]
            if any(len(k) for k, _ in parts):
                yield s, B.dumps([(B.pack_sorted(k), B.planes(B.narrow(n))) for k, n in parts])

    def total(_: list[int], blobs: list[bytes]) -> list[bytes]:
        got = [B.loads(x) for x in blobs]
        answers: list[list] = [[] for _ in got]
        about = None
        for order in range(3):
            keys = [B.unpack_sorted(x[order][0]) for x in got]
            uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate([B.unplanes(x[order][1]).astype(np.float64) for x in got]), len(uniq)).astype(np.int64)
            about = about or (int(n.sum()), int((n > 0).sum()))
            for mine, a in zip(answers, np.split(n[at], np.cumsum([len(x) for x in keys])[:-1]), strict=True):
                mine.append(B.planes(B.narrow(a)))
        return [B.dumps(a) for a in answers] + [B.dumps(about)]

    answers = keep.save(B.each_shard(B.each_block(blocks, ask), total), "none")

    def stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [B.loads(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([n for n, _ in got], pa.int64()), "v": pa.array([v for _, v in got], pa.int64())})

    per_shard = answers.filter("block = -1").select("blob").mapInArrow(stats_of, "n long, v long")
    got = per_shard.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    all_n, all_v = int(got["n"]), int(got["v"])

    def read(_: int, b: B.Block, got: list[tuple[int, bytes]]) -> pa.Table:
        g = Grams(b.texts)
        parts = [B.loads(x) for _, x in got]
        uni, bi, tri = (np.concatenate([B.unplanes(p[order]).astype(np.int64) for p in parts]) for order in range(3))
        automaton = BackoffAutomaton(g, uni, bi, tri, all_n, all_v, mu)
        known = np.add.reduceat((uni > 0)[g.uni_at].astype(np.int64), g.starts)
        base = np.add.reduceat(automaton.root[g.uni_at], g.starts)
        full = automaton.read(g.uni_at, g.starts, g.sizes)
        held = [fold_of(i, folds) == held_out for i in b.ids]
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": g.sizes, "n_known": known, "train_tokens": pa.array([all_n] * len(b.ids), pa.int64()), "base_score": base, "score": full})

    return B.meet(blocks, answers.filter("block >= 0"), read, SCHEMA)
