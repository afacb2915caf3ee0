"""N-best segmentation into pieces, and decoding.

The lattice of a text has a node between any two characters and an arc for every
piece of the vocabulary, weighted with the piece's score; a character that is no
piece has an arc of its bytes' pieces.  A forward Viterbi pass gives each node
the best score from the start.  These are exact heuristics for an A-star search
backward from the end: complete paths come off its queue best first, and the
search ends with the n-th.

A text is escaped as the library does it (a space before the text, spaces as
U+2581, nothing else normalised).  No piece spans a space and what is before it
but for runs of spaces, none has a line break, and none joins letters and marks, so a segmentation of the text is one of each word with
the spaces before it, and the n best of the text are the n best sums of the
words' alternatives.  (A vocabulary with pieces that do is cut elsewhere only.)  Only the n - 1 words whose
second choice costs least can differ from their best.  A forward and a backward
Viterbi pass, made in numpy for all words of one length together, give every
word's best and what its second loses (the best path over any arc off the best
path), which a bounded table remembers; the A-star search then runs over the
words that can differ, and its paths are the other segmentations.

Ids and pieces are those of the vocabulary file.  The scores of a file whose pieces
come from merges are ranks, whose sum says nothing; `fit_scores` therefore takes a
unigram model over the file's pieces, ``log((c+1)/(N+V))`` in steps of 2**-20, from the counts of the
library's own segmentation of all texts.  (`fitted=False`: the file's scores.)

Defined results: null and empty texts have no pieces and one segmentation, of
score 0; U+2581 in a text decodes to a space; ties go to the longer first piece;
a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import release

N_BEST, TABLE = 4, 700_000
SPACE = "▁"
BYTE_PENALTY = 10.0
#: Longer words are segmented by themselves and not remembered.
LONG = 64
#: Scores below are no measure for the bytes'.
UNUSABLE = -1e8
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, n_segmentations int, scores array<double>, n_best_pieces array<long>, n_best_crc32 array<long>, decoded_sha256 string, round_trip boolean"
#: Characters that are segmented together, words that are counted together, and choices remembered; they bound memory and change no result.
SLICE, COUNTED, CHOICES = 1 << 15, 300_000, 50_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Segmentation with a vocabulary {piece: (id, score)} and ids for bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], n: int = N_BEST, table: int = TABLE):
        self.pieces, self.byte_ids, self.n = pieces, byte_ids, n
        self.byte_score = min((s for _, s in pieces.values() if s > UNUSABLE), default=0.0) - BYTE_PENALTY
        # Characters after which a piece goes on with a space: no cut there.
        joined = {a for p in pieces for a, b in zip(p, p[1:], strict=False) if b == SPACE}
        joined |= {" "} if SPACE in joined else set()
        # White space that no piece has stands alone in every segmentation; letters and marks that no piece joins are parted.
        alone = "".join(c for c in "\t\n\v\f\r" if not any(c in p for p in pieces))
        pairs = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        letters = re.compile("[A-Za-z0-9\u00c0-\u024f]")
        beside = {c for x in pairs for c, other in (x, x[::-1]) if letters.match(other)}
        marks = re.escape("".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~" if c not in beside)) or "\\b\\B"
        if joined <= {" ", SPACE}:
            lead, word, mark = f"[ {SPACE}]*+", letters.pattern, f"[{marks}]"
            other = f"(?![^{letters.pattern[1:-1]}{marks} {SPACE}{alone}])"
            one = f"[ {SPACE}]{'+' * bool(joined)}"
            lead = lead if joined else f"[ {SPACE}]?+"
            self.chunks = re.compile(f"{lead}{word}++{other}|{lead}{mark}++{other}|{lead}[^ {SPACE}{alone}]+|{one}|[{alone}]").findall
        else:
            cut = re.compile(f"(?<![{re.escape(''.join(sorted(joined)))}])(?=[ {SPACE}])")
            self.chunks = lambda s: [w for w in cut.split(s) if w]
        self.longest: dict[str, int] = {}
        self.trie: dict = {}
        for p, v in pieces.items():
            self.longest[p[0]] = max(self.longest.get(p[0], 0), len(p))
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = v
        self.words = Words(table)
        self.choices: dict[str, list[tuple[float, bytes]]] = {}
        # The trie in numpy: (node, character) in order, and what a step leads to.  Characters are numbered; 0 is none of them.
        self.letters = np.zeros(0x110000, np.int32)
        used = sorted({ord(c) for p in pieces for c in p})
        self.letters[used] = np.arange(1, len(used) + 1)
        bits = len(used).bit_length()
        edges, weight, piece = [], [np.nan], [-1]
        held = [(0, self.trie)]
        while held:
            at, node = held.pop()
            for ch, nxt in node.items():
                if ch:
                    edges.append((at << bits | int(self.letters[ord(ch)]), len(weight)))
                    i, w = nxt.get("", (-1, np.nan))
                    weight.append(w)
                    piece.append(i)
                    held.append((edges[-1][1], nxt))
        edges.sort()
        kind = np.int32 if len(weight) << bits < 1 << 31 else np.int64
        self.bits, self.step_key = bits, np.array([k for k, _ in edges] or [0], kind)
        self.step_to = np.array([v for _, v in edges] or [0], kind)
        self.weight, self.piece = np.array(weight), np.array(piece, np.int32)

    def learn(self) -> None:
        """Puts the best and the loss of every word that the table waits for into it."""
        by: dict[int, list[int]] = {}
        waiting = self.words.waiting
        for k, w in enumerate(waiting):
            by.setdefault(len(w), []).append(k)
        base = len(self.words) - len(waiting)
        for size, some in by.items():
            for at in range(0, len(some), max(1, SLICE // size)):
                part = np.array(some[at : at + max(1, SLICE // size)])
                words = [waiting[k] for k in part.tolist()]
                able = np.zeros(len(part), bool)
                if size <= LONG:
                    able, *got = self.best_many("".join(words).replace(" ", SPACE), len(words))
                    self.words.put(base + part[able], *got)
                for k in np.flatnonzero(~able).tolist():
                    ids, score, loss = self.best_two(words[k].replace(" ", SPACE))
                    self.words.put(base + part[k : k + 1], np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]), np.array([score]), np.array([loss]))
        self.words.waiting = []

    def best_many(self, joined: str, n: int) -> tuple[np.ndarray, ...]:
        """`best_two` of n words of one length, joined: which have only characters of pieces, and of those the ids one after another, their numbers, scores and losses."""
        size = len(joined) // n
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T
        codes = self.letters[codes].ravel()
        pos, node = np.arange(size * n), np.zeros(size * n, self.step_key.dtype)
        arcs, ids = [], []
        for reach in range(1, size + 1):
            if reach > 1:
                upto = int(np.searchsorted(pos, (size - reach + 1) * n))
                pos, node = pos[:upto], node[:upto]
            key = node << self.bits | codes[pos + (reach - 1) * n]
            at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            hit = np.flatnonzero(self.step_key[at] == key)
            pos, node = pos[hit], self.step_to[at[hit]]
            if not len(pos):
                break
            w, i = np.full(size * n, -np.inf), np.zeros(size * n, np.int32)
            ends = np.flatnonzero(self.piece[node] >= 0)
            w[pos[ends]] = self.weight[node[ends]]
            i[pos[ends]] = self.piece[node[ends]]
            arcs.append(w.reshape(size, n))
            ids.append(i.reshape(size, n))
        able = np.isfinite(arcs[0]).all(axis=0) if arcs else np.zeros(n, bool)
        if not able.any():
            return able, np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if not able.all():
            arcs, ids, n = [w[:, able] for w in arcs], [i[:, able] for i in ids], int(able.sum())
        best, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int16)
        best[0] = 0.0
        for k in range(1, size + 1):
            for i in range(max(0, k - len(arcs)), k):
                t = best[i] + arcs[k - i - 1][i]
                up = t > best[k]
                np.copyto(best[k], t, where=up)
                np.copyto(back[k], np.int16(i), where=up)
        own = np.arange(n)
        path, on_path, count, at = np.zeros((n, size), "<u4"), np.zeros((size, n), np.int16), np.zeros(n, np.int64), np.full(n, size)
        wide = np.stack(ids)
        r = own
        while len(r):
            k = at[r]
            i = back[k, r].astype(np.int64)
            on_path[i, r] = k
            count[r] += 1
            path[r, size - count[r]] = wide[k - i - 1, i, r]
            at[r] = i
            r = r[i > 0]
        ahead, second = np.zeros((size + 1, n)), np.full(n, -np.inf)
        for i in range(size - 1, -1, -1):
            most = np.full(n, -np.inf)
            for k in range(i + 1, min(size, i + len(arcs)) + 1):
                t = arcs[k - i - 1][i] + ahead[k]
                np.maximum(most, t, out=most)
                t += best[i]
                np.maximum(second, t, out=second, where=on_path[i] != k)
            ahead[i] = most
        return able, path[np.arange(size) >= (size - count)[:, None]], count, best[size], best[size] - second

    def arcs(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each node, the arcs that end there: (first node, score, ids), longest first."""
        out: list[list] = [[] for _ in range(len(s) + 1)]
        pieces = self.pieces
        for i, ch in enumerate(s):
            most = min(self.longest.get(ch, 0), len(s) - i)
            for k in range(i + 1, i + most + 1):
                hit = pieces.get(s[i:k])
                if hit is not None:
                    out[k].append((i, hit[1], (hit[0],)))
            if ch not in pieces:
                raw = ch.encode("utf-8", "surrogatepass")
                out[i + 1].append((i, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
        return out

    def n_best(self, s: str, n: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of s, best first: (score, ids)."""
        n = n or self.n
        arcs = self.arcs(s)
        best = [0.0] + [-np.inf] * len(s)
        for k in range(1, len(s) + 1):
            best[k] = max([best[i] + w for i, w, _ in arcs[k]], default=-np.inf)
        out: list[tuple[float, tuple[int, ...]]] = []
        queue: list = [(-best[-1], 0, len(s), 0.0, None)]
        # Of equals the last pushed is taken first, so that ties end in paths and not in a wide front.
        pushed = -1
        while queue and len(out) < n:
            _, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for i, w, ids in arcs[at]:
                heapq.heappush(queue, (-(best[i] + w + done), pushed, i, done + w, (ids, path)))
                pushed -= 1
        return out

    def best_two(self, s: str) -> tuple[bytes, float, float]:
        """The best segmentation's ids and score, and what the second best loses (infinite where there is none)."""
        n, trie = len(s), self.trie
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        back: list = [None] * (n + 1)
        arcs = []
        for i in range(n):
            node, out, b = trie, [], best[i]
            for k in range(i, n):
                node = node.get(s[k])
                if node is None:
                    break
                v = node.get("")
                if v is not None:
                    out.append((k + 1, v[1]))
                    if b + v[1] > best[k + 1]:
                        best[k + 1], back[k + 1] = b + v[1], (i, v[0])
            if not out or out[0][0] != i + 1:
                raw = s[i].encode("utf-8", "surrogatepass")
                w = self.byte_score * len(raw)
                out.append((i + 1, w))
                if b + w > best[i + 1]:
                    best[i + 1], back[i + 1] = b + w, (i, raw)
            arcs.append(out)
        ids: list[int] = []
        on_path = [0] * (n + 1)
        at = n
        while at:
            i, piece = back[at]
            on_path[i] = at
            if isinstance(piece, bytes):
                ids += [self.byte_ids[x] for x in reversed(piece)]
            else:
                ids.append(piece)
            at = i
        ahead = [0.0] * (n + 1)
        second = -np.inf
        for i in range(n - 1, -1, -1):
            most, b, nxt = -np.inf, best[i], on_path[i]
            for k, w in arcs[i]:
                t = w + ahead[k]
                if t > most:
                    most = t
                if k != nxt and b + t > second:
                    second = b + t
            ahead[i] = most
        return np.array(ids[::-1], "<u4").tobytes(), best[n], best[n] - second

    def cut(self, text: str) -> list[str]:
        """The words of a text, with the spaces before them."""
        return self.chunks(" " + text)

    def n_best_all(self, texts: list[str]) -> Iterator[list[tuple[float, bytes, list[tuple[bytes, bytes]]]]]:
        """For each text its n best segmentations, best first: score, ids (little-endian unsigned 32-bit) and, of each word that differs from the best, the best's ids and its own."""
        words = [self.cut(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        table = self.words
        at = np.fromiter(map(table.__getitem__, flat), np.int64, len(flat))
        self.learn()
        number, score, loss = table.number[at], table.score[at], table.loss[at]
        ends = np.cumsum(number)
        ids = table.pool[np.repeat(table.first[at] - ends + number, number) + np.arange(int(number.sum()))]
        upto = np.cumsum(list(map(len, words)))
        for text, hi, own in zip(texts, upto.tolist(), words, strict=True):
            lo = hi - len(own)
            if not text:
                yield [(0.0, b"", [])]
                continue
            begin = int(ends[lo - 1]) if lo else 0
            yield self._n_best(own, score[lo:hi], loss[lo:hi], ends[lo:hi] - begin, number[lo:hi], ids[begin : int(ends[hi - 1])].tobytes())
        if len(table) > table.most:
            table.forget()

    def _n_best(self, words: list[str], score: np.ndarray, loss: np.ndarray, ends: np.ndarray, number: np.ndarray, best: bytes) -> list[tuple[float, bytes, list[tuple[bytes, bytes]]]]:
        n, total = self.n, float(score.sum())
        few = np.arange(len(loss))
        if len(loss) > n - 1:
            # Of equal losses the first words'.
            few = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2])
            few = few[np.argsort(loss[few], kind="stable")][: n - 1]
        choices = []
        for k in few.tolist():
            if np.isfinite(loss[k]):
                hi = 4 * int(ends[k])
                choices.append((k, self.alternatives(words[k], best[hi - 4 * int(number[k]) : hi])))
        # The n least sums: each step takes the least and lets one part after the last one changed go one choice on.
        found, queue, seen = [], [(0.0, (0,) * len(choices))], set()
        while queue and len(found) < n:
            cost, pick = heapq.heappop(queue)
            found.append((cost, pick))
            for c, (_, own) in enumerate(choices):
                if pick[c] + 1 < len(own):
                    nxt = (*pick[:c], pick[c] + 1, *pick[c + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(queue, (sum(choices[k][1][x][0] for k, x in enumerate(nxt)), nxt))
        out = []
        for cost, pick in found:
            pieces, at, changed = [], 0, []
            for k, some, x in sorted((k, some, x) for (k, some), x in zip(choices, pick, strict=True) if x):
                hi = 4 * int(ends[k])
                pieces += [best[at : hi - 4 * int(number[k])], some[x][1]]
                at = hi
                changed.append((some[0][1], some[x][1]))
            out.append((total - cost, b"".join([*pieces, best[at:]]) if changed else best, changed))
        return out

    def alternatives(self, word: str, first: bytes) -> list[tuple[float, bytes]]:
        """A word's n best: (what it loses against the best, ids), by the A-star search.  `first` is the table's best."""
        got = self.choices.get(word)
        if got is None:
            found = self.n_best(word.replace(" ", SPACE))
            got = [(found[0][0] - score, np.array(ids, "<u4").tobytes()) for score, ids in found]
            # Of equals the search may have another first than the table.
            got = [(0.0, first), *(x for x in got if x[1] != first)][: self.n]
            if len(self.choices) >= CHOICES:
                self.choices.clear()
            if len(word) <= LONG:
                self.choices[word] = got
        return got

    def n_best_of(self, text: str) -> list[tuple[float, bytes, list[tuple[bytes, bytes]]]]:
        return next(iter(list(self.n_best_all([text]))))

    def segment(self, text: str) -> tuple[bytes, list[float]]:
        """Ids of the best segmentation and the scores of the n best."""
        found = self.n_best_of(text)
        return found[0][1], [score for score, _, _ in found]

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, best first: (score, ids)."""
        return [(score, np.frombuffer(ids, "<u4").tolist()) for score, ids, _ in self.n_best_of(text)]


class Words(dict):
    """word: its number; of each number the best's ids (a run of the pool), its score and what the second loses.

    Words not met before are numbered and wait to be learnt.  Beyond `most` words the table starts anew.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.pool, self.used = np.zeros(1 << 12, "<u4"), 0
        self.first, self.number = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.score, self.loss = np.zeros(1 << 10), np.zeros(1 << 10)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.waiting.append(word)
        return k

    def put(self, at: np.ndarray, ids: np.ndarray, number: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        if len(self) > len(self.first):
            size = max(len(self), 2 * len(self.first))
            self.first, self.number, self.score, self.loss = (np.resize(x, size) for x in (self.first, self.number, self.score, self.loss))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(ids), 2 * len(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[at], self.number[at] = self.used + np.cumsum(number) - number, number
        self.score[at], self.loss[at] = score, loss
        self.used += len(ids)


class Decoder:
    """Text bytes of ids: pieces with U+2581 as a space, bytes as they are, and the space before the text gone."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw

    def text(self, ids: bytes) -> bytes:
        """The bytes of some ids of a text."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> bytes:
        out = self.text(ids)
        return out[1:] if out.startswith(b" ") else out


@functools.lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def load(path: str, n: int = N_BEST, scores: dict[int, float] | None = None) -> tuple[Lattice, Decoder]:
    """A vocabulary file as lattice and decoder.  Control pieces have no arcs; scores of ids stand for the file's."""
    sp = library(path)
    pieces, byte_ids, raw = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            raw.append(p.replace(SPACE, " ").encode())
            pieces[p] = (i, sp.get_score(i) if scores is None else scores[i])
    return Lattice(pieces, byte_ids, n), Decoder(raw)


@functools.lru_cache(maxsize=2)
def cutter(path: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into its words."""
    return load(path)[0].cut


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def exactly(scores: np.ndarray) -> np.ndarray:
    """Scores in steps of 2**-20: their sums are exact, so that equal paths are equal and the A-star search need not walk them all."""
    return np.round(scores * (1 << 20)) / (1 << 20)


def fit_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """The unigram log-probability of each piece of the vocabulary, from the library's segmentation of all texts.

    A word's segmentation does not depend on others, so each distinct word of a part is segmented once.  Only the
    counts, one for a piece of the vocabulary, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, cut = library(path), cutter(path)
        total, first = np.zeros(sp.get_piece_size(), np.int64), (" ", SPACE)
        held: Counter[str] = Counter()

        def flush() -> None:
            words = list(held)
            for at in range(0, len(words), 1 << 14):
                part = words[at : at + (1 << 14)]
                # The library puts a space first, but none before nothing; what follows no space is put after a byte of its own.
                ids = sp.encode([w[1:] if w[0] in first else "\0" + w for w in part], num_threads=1)
                ids = [(i or [sp.piece_to_id(SPACE)]) if w[0] in first else i[2:] for w, i in zip(part, ids, strict=True)]
                times = np.repeat([held[w] for w in part], list(map(len, ids)))
                np.add.at(total, np.fromiter(itertools.chain.from_iterable(ids), np.int64, len(times)), times)
            held.clear()

        for b in batches:
            for t in b.column(1):
                text = t.as_py()
                if text:
                    held.update(cut(text))
                if len(held) >= COUNTED:
                    flush()
        flush()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    rows = _texts(docs, id_col, text_col).mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(library(path).get_piece_size())
    for r in rows:
        counts[r["piece"]] = r["n"]
    return dict(enumerate(exactly(np.log((counts + 1) / (counts.sum() + len(counts)))).tolist()))


_held: dict[str, tuple[Lattice, Decoder]] = {}


def loaded(name: str, path: str, n: int, shared) -> tuple[Lattice, Decoder]:
    """The process's lattice and decoder of a run."""
    if name not in _held:
        _held.clear()
        _held[name] = load(path, n, shared.value)
    return _held[name]


def encode(docs: DataFrame, path: str | None = None, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, fitted: bool = True) -> DataFrame:
    """Per document digests and scores of the n best segmentations and of the text that each decodes to; with_ids: also the ids of each (`ids`, binary)."""
    path = path or default_path()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_scores(docs, path, id_col, text_col) if fitted else None)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = loaded(name, path, n, shared)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.bool_(), pa.list_(pa.binary()))
        names = [x.strip().split()[0] for x in SCHEMA.split(", ")] + ["ids"]
        m = len(names) if with_ids else len(names) - 1
        for b in batches:
            texts, at = b.column(1), 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and size < 32 * SLICE:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                cols: list[list] = [[] for _ in kinds]
                for text, found in zip(some, lattice.n_best_all(some), strict=True):
                    ids = found[0][1]
                    back = decoder.decode(ids)
                    # What decodes alike word by word decodes alike.
                    alike = back == text.replace(SPACE, " ").encode() and all(decoder.text(x) == decoder.text(y) for _, _, changed in found for x, y in changed)
                    scores, every = [s for s, _, _ in found], [i for _, i, _ in found]
                    row = (len(ids) // 4, zlib.crc32(ids), len(found), scores, [len(i) // 4 for i in every], [zlib.crc32(i) for i in every], hashlib.sha256(back).hexdigest(), alike, every)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                arrays = [b.column(0).slice(at, len(some)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays[:m], names=names[:m])
                at += len(some)
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, SCHEMA + ", ids array<binary>" * with_ids)
