"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from loamline.llm import components as K
from loamline.llm import flat_graph, media, ngram_lm, packing, piece_lattice, quality, repeats, simhash, substring_dedup, suffix_dedup, token_counts
from loamline.llm.store import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, fp string, x string, shard int, mult string, id string"


def texts():
    rng = random.Random(5)
    words = [w + s for w in ("alpha", "Beta", "gamma", "délta", "o", "zeta", "梦") for s in ("", "1", "x", "ing", ",", ".")]
    make = lambda n: " ".join(rng.choices(words, k=n))
    base = [make(rng.randrange(1, 120)) for _ in range(30)]
    passage = make(40)
    long = make(9000)
    out = [None, "", "   \n\t", "a", "word " * 300, long, base[0], base[0], base[1] + " " + passage, passage + "\n" + base[2], base[3].upper(), base[3].lower(), "x" * 5000, "tail  double  space ", "<|endoftext|> in text", " nbsp　wide ▁ piece"]
    for b in base:
        out.append(b)
    for b in base[:8]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    return out


def rows():
    t = texts()
    out = [(i, x) for i, x in enumerate(t)]
    rng = random.Random(1)
    rng.shuffle(out)
    out += [out[3], (None, "an id that is null " * 9), (None, None), (-7, t[9])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, "en", "s", len(x or ""), "b", "f", "x", 1, "m", "i") for i, x in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


NULL = 1 << 63


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def raw(x):
    return (x or "").encode()


def test_simhash(docs, empty):
    got = by_id(simhash.dedup(docs))
    fps = {}
    for i, x in rows():
        w = raw(x).lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in ([w[k : k + 4] for k in range(len(w) - 3)] if len(w) >= 4 else [w])] if w else []
        f = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0
        fps.setdefault(i, set()).add(f)
    ids = [i for i in fps if i is not None]
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and any((f ^ g).bit_count() <= 4 for f in fps[a] for g in fps[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    for i in fps:
        assert {int(r["fingerprint"], 16) for r in got[i]} == fps[i]
        if i is not None:
            assert {r["component_id"] for r in got[i]} == {find(i)}
            assert {r["kept"] for r in got[i]} == {find(i) == i}
        else:
            assert all(r["component_id"] is None for r in got[i])
    assert sum(map(len, got.values())) == len(rows())
    assert simhash.dedup(empty).count() == 0


def test_similar(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    base = [rng.choices(words, k=300) for _ in range(40)]
    near = [[*b[:140], "new", *b[141:]] for b in base[:20]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*base, *near])] + [(None, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.dedup_similar(df).collect()}
    assert got == {**{i: i for i in range(40)}, **{40 + i: i for i in range(20)}}


def test_similar_exact(spark):
    """Pairs of similarities around 0.8 and texts of few shingles, against brute force."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(9000)]
    docs = [[], ["one"], ["one", "two"], *([f"s{k}" for k in range(n)] for n in (8, 9)), *([f"t{k}" for k in range(n)] for n in (12, 13))]
    for k in range(260):
        n = rng.choice((30, 60, 90, 200, 400))
        base = rng.choices(words, k=n)
        # The end is cut, or words are replaced, so that similarities are about 0.7 to 0.87.
        cut = base[: round((n - 4) * rng.uniform(0.7, 0.87)) + 4]
        docs += [base, cut if k % 2 else [rng.choice(words) if at % 50 == 25 else w for at, w in enumerate(base)]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root = K.local_forest(len(docs), *np.array(near).T)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.dedup_similar(df).collect()}
    wrong = [i for i in range(len(docs)) if got[i] != root[i]]
    assert all(got[i] == i for i in wrong), "a document went that is no near copy"
    assert got[4] == 3 and got[6] == 5 and len(near) > 60 and len(wrong) <= 0.01 * len(near)


@pytest.mark.parametrize("settled, star", [(simhash.SETTLED, simhash.STAR), (40, simhash.STAR), (16, 10)])
def test_similar_large_group(spark, monkeypatch, settled, star):
    """A large group of near copies, a chain at its edge and one by one less similar ones: cut into blocks or not, the links are the exact ones."""
    monkeypatch.setattr(simhash, "SETTLED", settled)
    monkeypatch.setattr(simhash, "STAR", star)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=200)
    docs = []
    for k in range(160):
        own = list(base)
        for at in rng.sample(range(200), rng.choice((0, 1, 2, 4, 8, 12))):
            own[at] = rng.choice(words)
        docs.append(own)
    chain = list(base)
    for _ in range(12):
        chain = [*chain[10:], *rng.choices(words, k=10)]
        docs.append(chain)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root = K.local_forest(len(docs), *np.array(near).T)
    assert 1 < len(set(root.tolist())) < 80
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.dedup_similar(df).collect()}
    assert [got[i] for i in range(len(docs))] == root.tolist()


@pytest.mark.parametrize("limit", [4, 1 << 13])
def test_trie_cut(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    ball = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    v = np.unique(np.concatenate([base, ball, base[:20] ^ np.uint64(5)]))
    keep = Scratch(spark, "test")
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = {r.id: r.component for r in K.components(simhash.links(df, keep, limit=limit, per_task=16), keep).collect()}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    root = K.local_forest(len(v), *np.nonzero(near))
    s = v.view(np.int64)
    for c in set(root.tolist()):
        own = s[root == c]
        if len(own) > 1:
            assert {got[int(x)] for x in own} == {int(own.min())}
        else:
            assert int(own[0]) not in got


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = {r.id: r.component for r in K.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    good = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in good:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent}


def covered_brute(seqs, length, same_doc):
    """For each row its covered tokens; seqs: (order, tokens)."""
    first = {}
    for order, t in seqs:
        for p in range(len(t) - length + 1):
            key = (order, p) if same_doc else (order, 0)
            k = tuple(t[p : p + length])
            if k not in first or key < first[k]:
                first[k] = key
    out = []
    for order, t in seqs:
        m = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[tuple(t[p : p + length])] < ((order, p) if same_doc else (order, 0)):
                m[p : p + length] = [True] * length
        out.append(m)
    return out


def test_suffix(docs, empty):
    got = by_id(suffix_dedup.dedup(docs))
    src = rows()
    want = covered_brute([(NULL if i is None else i, raw(x)) for i, x in src], 100, True)
    expect = {}
    for (i, x), m in zip(src, want, strict=True):
        kept = bytes(b for b, g in zip(raw(x), m, strict=True) if not g)
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        expect.setdefault(i, []).append((len(m), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    for i, e in expect.items():
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got[i]) == sorted(e)
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 20, repeats.HOT])
def test_hot_anchors(spark, monkeypatch, hot):
    """A line in a third of all rows, in other surroundings each, some of which repeat: bytes and words, hot or not."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(9)
    words = [f"{rng.choice('abcdef')}{k}" for k in range(300)]
    line = "this is a line that very many of the documents have in common today".split()
    sides = [rng.choices(words, k=14) for _ in range(12)]
    texts = []
    for k in range(150):
        before, after = rng.choices(words, k=rng.randrange(0, 25)), rng.choices(words, k=rng.randrange(0, 25))
        if k % 3 == 0:
            left, right = (rng.choice(sides) if rng.random() < 0.4 else rng.choices(words, k=14) for _ in range(2))
            texts.append([*before, *left, *line, *right, *after])
        else:
            texts.append([*before, *rng.choice(sides), *after])
    src = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(src)
    df = spark.createDataFrame(src, "doc_id long, text string").repartition(3)
    expect = covered_brute([(i, x.encode()) for i, x in src], 100, True)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}
    assert got == {i: (sum(m), hashlib.sha256(bytes(b for b, g in zip(x.encode(), m, strict=True) if not g)).hexdigest()) for (i, x), m in zip(src, expect, strict=True)}
    expect = covered_brute([(i, x.split()) for i, x in src], 13, False)
    assert sum(map(sum, expect)) > 500
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df).collect()}
    assert got == {i: (sum(m), hashlib.sha256(" ".join(w for w, g in zip(x.split(), m, strict=True) if not g).encode()).hexdigest()) for (i, x), m in zip(src, expect, strict=True)}


def test_suffix_rewrite_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x" * 300, 7, "a"), (2, None, None, None)], "doc_id long, text string, _was_null int, block string")
    out = suffix_dedup.rewrite(df)
    assert out.schema == df.schema
    assert {tuple(r) for r in out.collect()} == {(1, "x", 7, "a"), (2, None, None, None)}


def test_suffix_rewrite(docs, empty):
    out = suffix_dedup.rewrite(docs)
    assert out.schema == docs.schema
    src = rows()
    want = covered_brute([(NULL if i is None else i, raw(x)) for i, x in src], 100, True)
    expect = Counter((i, None if x is None else bytes(b for b, g in zip(raw(x), m, strict=True) if not g).decode("utf-8", "ignore")) for (i, x), m in zip(src, want, strict=True))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == expect
    assert suffix_dedup.rewrite(empty).count() == 0


def test_substring(docs, empty):
    got = by_id(substring_dedup.dedup(docs))
    src = rows()
    want = covered_brute([(NULL if i is None else i, raw(x).split()) for i, x in src], 13, False)
    expect = {}
    for (i, x), m in zip(src, want, strict=True):
        kept = b" ".join(w for w, g in zip(raw(x).split(), m, strict=True) if not g)
        expect.setdefault(i, []).append((len(m), sum(m), hashlib.sha256(kept).hexdigest()))
    for i, e in expect.items():
        assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got[i]) == sorted(e)
    assert substring_dedup.dedup(empty).count() == 0


class Trigrams:
    """The model over plain counters: probabilities by their definition, not by an automaton."""

    def __init__(self, texts, mu):
        self.uni, self.bi, self.tri, self.texts, self.mu = Counter(), Counter(), Counter(), len(texts), mu
        for w in texts:
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w[:-1]], w, strict=True))
            self.tri.update(zip(["<s>", *w], w, w[1:], strict=False))
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def one(self, w):
        return (self.uni[w] + 1) / (self.n + self.v + 1)

    def two(self, v, w):
        return (self.bi[v, w] + self.mu * self.one(w)) / ((self.texts if v == "<s>" else self.uni[v]) + self.mu)

    def three(self, u, v, w):
        return (self.tri[u, v, w] + self.mu * self.two(v, w)) / (self.bi[u, v] + self.mu)

    def score(self, text):
        past = ["<s>", *text]
        return math.log10(self.two("<s>", text[0])) + sum(math.log10(self.three(*past[k - 1 : k + 2])) for k in range(1, len(text)))


@pytest.mark.parametrize("lane", [ngram_lm.LANE, 3])
def test_lm(docs, empty, monkeypatch, lane):
    monkeypatch.setattr(ngram_lm.BackoffAutomaton.read, "__defaults__", (lane,))
    got = by_id(ngram_lm.score(docs))
    src = [(i, raw(x).lower().split() + [None]) for i, x in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    m = Trigrams([w for i, w in src if not held(i)], ngram_lm.MU)
    assert any(m.tri[t] == 0 and m.bi[t[1:]] > 0 for _, w in src for t in zip(w, w[1:], w[2:], strict=False)) and max(m.tri.values()) > 1
    expect = {}
    for i, w in src:
        expect.setdefault(i, []).append((len(w), sum(m.uni[x] > 0 for x in w), sum(math.log10(m.one(x)) for x in w), m.score(w)))
    for i, e in expect.items():
        for r, want in zip(sorted(got[i], key=lambda r: (r["n_tokens"], r["score"])), sorted(e, key=lambda x: (x[0], x[3])), strict=True):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (want[0], want[1], m.n, held(i))
            assert r["base_score"] == pytest.approx(want[2]) and r["score"] == pytest.approx(want[3])
    assert ngram_lm.score(empty).count() == 0


@pytest.mark.parametrize("lane", [2, 3, 1000])
def test_lm_reads_with_carried_states(lane):
    """Words after any state sum to one, and lanes of any length read a text alike."""
    rng = random.Random(5)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(1, 30))] + ["</s>"] for _ in range(12)]
    m = Trigrams(texts, 2.0)
    read = [*texts, ["e", "unseen", "a", "b", "unseen", "unseen", "c", "</s>"]]
    g = ngram_lm.Grams([" ".join(w[:-1]).encode() for w in read])
    counts = g.counts(np.repeat([1.0] * len(texts) + [0.0], g.sizes))
    a = ngram_lm.BackoffAutomaton(g, *counts, m.n, m.v, 2.0)
    got = a.read(g.uni_at, g.starts, g.sizes, lane)
    assert got == pytest.approx([m.score(w) for w in read])
    end = 1 + int(np.searchsorted(g.uni, ngram_lm.END))
    last = np.concatenate([[0], 1 + np.arange(len(g.uni)), [a.start], a.fails_to[a.start + 1 :]])
    # Nothing follows the end of a text.
    for state in np.flatnonzero(last != end).tolist():
        _, weight = a.step(np.full(len(g.uni), state), np.arange(len(g.uni)))
        assert (10.0**weight).sum() == pytest.approx(1.0)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    got = packing.pack(docs).collect()
    want = []
    for i, x in rows():
        ids = tok.encode(x or "", add_special_tokens=False).ids + [2]
        at, size, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.append((i, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, size, k = at + size, 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(5))
def test_fit_keeps_every_capacity(seed, by):
    rng = np.random.default_rng(seed)
    c = packing.Capacity(100, int(rng.integers(2, 9)), int(rng.integers(3000, 10001)), (1.0, float(rng.random()), float(rng.random())), by)
    top = int(min(100, c.cost**0.5))
    hist = Counter(rng.integers(1, top + 1, 500).tolist())
    p = packing.fit(hist, c)
    seqs = {}
    for n, m in hist.items():
        seq, off = p.place(np.full(m, n), np.arange(m))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            seqs.setdefault(s, []).append((o, n))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= c.tokens and len(s) <= c.documents and sum(n * n for _, n in s) <= c.cost
    assert sorted(seqs) == list(range(p.sequences))


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    from loamline.llm.token_ids import default_path

    tok = Tokenizer.from_file(default_path())
    tok.encode_special_tokens = True
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_documents(docs).collect())
    assert got == Counter((i, len(tok.encode(x or "", add_special_tokens=False).ids)) for i, x in rows())
    assert token_counts.count_documents(empty).count() == 0


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_separator_scan(spark, group):
    rng = np.random.default_rng(group)
    files, want = [], {}
    for f in range(4):
        docs = [rng.integers(0, 9, n).tolist() for n in rng.choice([0, 0, 1, 3, 50, 211], 12)]
        flat = [x for d in docs for x in [*d, 9]]
        if f % 2 and docs[-1]:
            flat = flat[:-1]
        want[f] = [len(d) for d in docs]
        raw_ = np.array(flat, "<u2").tobytes()
        files += [(f, k, bytearray(raw_[i : i + 14])) for k, i in enumerate(range(0, len(raw_), 14))]
    rng.shuffle(files)
    got = {}
    for r in token_counts.count(spark.createDataFrame([(int(a), int(b), c) for a, b, c in files], "file long, block long, data binary"), 9, group=group).collect():
        got.setdefault(r.file, {})[r.document] = r.n_tokens
    assert {f: [g[k] for k in sorted(g)] for f, g in got.items()} == want
    assert all(sorted(g) == list(range(12)) for g in got.values())


def test_media(docs, empty):
    got = by_id(media.digest(docs))
    seen = {}
    for i, x in rows():
        p = media.payload_of(raw(x))
        hit = [r for r in got[i] if r["payload_sha256"] == hashlib.sha256(p).hexdigest()]
        assert hit and hit[0]["n_bytes"] == len(raw(x)) and hit[0]["payload_bytes"] == len(p) and hit[0]["tail_crc32"] == zlib.crc32(p[-64:])
        key = (hit[0]["media_bytes"], hit[0]["media_sha256"], hit[0]["feature"])
        assert seen.setdefault(raw(x), key) == key
    assert media.digest(empty).count() == 0


def test_media_bad_rows(spark):
    """Bytes that are no JPEG, or a broken one, have an error and no columns; the others are read."""
    good = media.encode([b"x" * 128])[0]
    huge = good.replace(struct.pack(">HH", 16, 512), struct.pack(">HH", 65535, 65535))
    assert huge != good
    cut = [good[: len(good) // 2], good[:-2], b"", b"no jpeg", None, good[:40] + b"\xff" * 60 + good[100:], huge]
    df = spark.createDataFrame([(k, f, "w") for k, f in enumerate([good, *cut, good])], "doc_id long, media binary, width string")
    got = {r.doc_id: r for r in media.read(df, with_payload=True).collect()}
    assert len(got) == len(cut) + 2
    for k in (0, len(cut) + 1):
        assert got[k].error is None and got[k].payload == b"x" * 128 and got[k].width == 512
    for k in range(1, len(cut) + 1):
        assert got[k].error and got[k].width is None and got[k].payload_sha256 is None


def test_media_of_several_images(monkeypatch):
    """A file of several images has the hash of all."""
    monkeypatch.setattr(media, "LARGEST", 128)
    (a, _), (b, _) = media.decode(media.encode([b"a" * 256 + b"b" * 32 + b"c" * 32, b"a" * 256 + b"c" * 32 + b"b" * 32]))
    assert len(a) == 3 and media.file_hash(a) != media.file_hash(b)


def test_jpeg_wide_and_many():
    rng = np.random.default_rng(0)
    for n in (1, 8191, 8192, 20000):
        p = rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        (img, t), = media.thumbnails(media.encode([p]))[0]
        assert t.tobytes()[: img.payload] == p and t.shape == (img.height // 8, img.width // 8)


def test_jpeg_with_ac_and_colour():
    """A hand-made file: three components, 2 x 1 luminance sampling, AC coefficients in between, no restarts."""
    import struct

    dc = media.codes(media.DC_COUNTS, media.DC_VALUES)
    ac_counts, ac_values = (0, 2, 1) + (0,) * 13, (0x00, 0x01, 0xF0)
    ac = media.codes(ac_counts, ac_values)
    bits = ""

    def put(code, size):
        nonlocal bits
        bits += format(code, f"0{size}b")

    def block(diff, with_ac):
        cat = abs(diff).bit_length()
        put(*dc[cat])
        if cat:
            put(diff if diff > 0 else diff + (1 << cat) - 1, cat)
        if with_ac:
            put(*ac[0xF0])
            put(*ac[0x01])
            put(1, 1)
        put(*ac[0x00])

    lum = [10, -20, 33, 40]
    last = 0
    for m in range(2):
        for y in lum[2 * m : 2 * m + 2]:
            block(y - last, m == 0)
            last = y
        block(0, False)
        block(5 if m == 0 else 0, True)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([16] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 8, 30, 3) + b"\x01\x21\x00\x02\x11\x00\x03\x11\x00")
    data += seg(0xC4, b"\x00" + bytes(media.DC_COUNTS) + bytes(media.DC_VALUES)) + seg(0xC4, b"\x10" + bytes(ac_counts) + bytes(ac_values))
    data += seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    (img, t), = media.thumbnails([data])[0]
    assert (img.width, img.height) == (30, 8)
    assert t.tolist() == [[128 + 2 * y for y in lum]]


def whole_text_segmentations(la, text):
    """The n best of a text as one word: no cuts, no tables."""
    return la.n_best("▁" + text.replace(" ", "▁")) if text else [(0.0, ())]


def test_pieces(docs, empty):
    """Every column against an A-star search over each whole text, and scores against counts of the library's own pieces."""
    import sentencepiece

    path = piece_lattice.default_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = np.zeros(sp.get_piece_size())
    for _, x in rows():
        for i in sp.encode(x or ""):
            counts[i] += 1
    fitted = np.round(np.log((counts + 1) / (counts.sum() + len(counts))) * 2**20) / 2**20
    assert piece_lattice.fit_scores(docs, path) == pytest.approx(dict(enumerate(fitted.tolist())))
    la, decoder = piece_lattice.load(path, scores=dict(enumerate(fitted.tolist())))
    got = by_id(piece_lattice.encode(docs, with_ids=True))
    for i, x in rows():
        text = x or ""
        want = text.replace("▁", " ").encode()
        sha = hashlib.sha256(want).hexdigest()
        mine = [r for r in got[i] if r["decoded_sha256"] == sha]
        assert mine and all(r["round_trip"] for r in mine)
        r = mine[0]
        assert r["ids_crc32"] == zlib.crc32(r["ids"][0]) == r["n_best_crc32"][0] and r["n_pieces"] == len(r["ids"][0]) // 4
        assert r["n_segmentations"] == len(r["scores"]) == len(set(r["n_best_crc32"])) and r["scores"] == sorted(r["scores"], reverse=True)
        assert all(decoder.decode(ids) == want for ids in r["ids"])
        if len(text) < 3000:
            best = whole_text_segmentations(la, text)
            assert r["scores"] == pytest.approx([s for s, _ in best], rel=1e-9)
            for s, ids in zip(r["scores"], r["ids"], strict=True):
                assert s == pytest.approx(sum(fitted[k] if not sp.is_byte(k) else la.byte_score for k in np.frombuffer(ids, "<u4").tolist()), rel=1e-9)
    assert piece_lattice.encode(empty).count() == 0


def test_pieces_of_many_words_at_once():
    la, _ = piece_lattice.load(piece_lattice.default_path())
    rng = random.Random(3)
    words = {"▁" * rng.randrange(3) + "".join(rng.choices("abcdeinorstué中", k=rng.randrange(1, 14))) for _ in range(400)}
    for size in {len(w) for w in words}:
        own = sorted(w for w in words if len(w) == size)
        able, ids, number, score, loss = la.best_many("".join(own), len(own))
        ends = np.cumsum(number)
        assert able.tolist() == [all(ch in la.pieces for ch in w) for w in own]
        for k, w in enumerate(w for w, ok in zip(own, able, strict=True) if ok):
            want = la.best_two(w)
            assert ids[ends[k] - number[k] : ends[k]].tobytes() == want[0] and (score[k], loss[k]) == pytest.approx(want[1:])


@pytest.mark.parametrize("text", ["don't stop.\nNow,  go_on (x_1) 'tis", "a.b_c..d ...e_", "x\u2019s \u00e9t\u00e9!?\t# 3.14%", "_a.b-c_ \u2014z"])
def test_cutting_changes_no_segmentation(text):
    la, _ = piece_lattice.load(piece_lattice.default_path())
    assert "".join(la.cut(text)) == " " + text
    want = whole_text_segmentations(la, text)
    assert [s for s, _ in la.segmentations(text)] == pytest.approx([s for s, _ in want], rel=1e-12)
    assert len(la.cut("a.b")) == 3 and len(la.cut("a_b")) == 1

@pytest.mark.parametrize("text", ["a   b", "a  b", "  a", "def f():\n        return  1 ", "x" + " " * 40 + "y", "a ▁  b", "   ", "one two three"])
def test_runs_of_spaces(text):
    """Cut into words or not, the segmentations are those of the whole text under the file's scores."""
    import sentencepiece

    path = piece_lattice.default_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    la, decoder = piece_lattice.load(path)
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            assert la.pieces[sp.id_to_piece(i)] == (i, sp.get_score(i))
    want = la.n_best("▁" + text.replace(" ", "▁"))
    got = la.segmentations(text)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want], rel=1e-12)
    ids, scores = la.segment(text)
    assert scores == pytest.approx([s for s, _ in want], rel=1e-12)
    assert decoder.decode(ids) == text.replace("▁", " ").encode()
    if text == "a   b":
        assert [sp.id_to_piece(i) for i in np.frombuffer(ids, "<u4").tolist()] == ["▁a", "▁▁", "▁b"]


@pytest.mark.parametrize("seed", range(8))
def test_nbest(seed):
    rng = random.Random(seed)
    alphabet = "ab▁c"
    pieces = {ch: (k, -rng.random() * 9) for k, ch in enumerate("ab▁")}
    for _ in range(25):
        p = "".join(rng.choices("ab", k=rng.randrange(2, 4)))
        pieces.setdefault(("▁" if rng.random() < 0.4 else "") + p, (len(pieces), -rng.random() * 9))
    la = piece_lattice.Lattice(pieces, list(range(1000, 1256)), n=6)

    def all_of(s):
        if not s:
            return [(0.0, ())]
        out = [(pieces[s[:k]][1] + t, (pieces[s[:k]][0], *i)) for k in range(1, len(s) + 1) if s[:k] in pieces for t, i in all_of(s[k:])]
        if s[0] not in pieces:
            out += [(la.byte_score * len(s[0].encode()) + t, (*(1000 + b for b in s[0].encode()), *i)) for t, i in all_of(s[1:])]
        return out

    for _ in range(15):
        text = "".join(rng.choices(alphabet.replace("▁", " "), k=rng.randrange(1, 11)))
        want = sorted(all_of("▁" + text.replace(" ", "▁")), key=lambda x: -x[0])[:6]
        got = la.segmentations(text)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        assert len({tuple(i) for _, i in got}) == len(got)
        assert la.n_best("▁" + text.replace(" ", "▁"), 1)[0][0] == pytest.approx(want[0][0])


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.12
    ball = base[0] + rng.normal(size=(60, 16)) * 0.15
    out = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(np.concatenate([base, near, ball, base[:5], base[:5] * 3.0]))]
    n = len(out)
    out += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, base[0].tolist(), None), (n + 4, [1.0, None], 1), (n + 5, [], 1), (n + 6, [float("inf")] * 16, 0), (n + 7, base[1][:8].tolist(), 1)]
    return out


@pytest.mark.parametrize("limit", [1500, 60])
def test_flat_graph(spark, limit):
    src = vectors()
    df = spark.createDataFrame([(i, v, c, "s", 1) for i, v, c in src], "vec_id long, embedding array<double>, label int, shard string, id int")
    got = {r.vec_id: r for r in flat_graph.near_dedup(df, limit=limit).collect()}
    ok = {i: np.array(v) for i, v, c in src if v and c is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    lab = {i: c for i, _, c in src}
    links = {i: {j for j in ok if j != i and lab[i] == lab[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93} for i in ok}
    assert len(got) == len(src)
    total = sum(map(len, links.values()))
    assert sum(r.n_links for r in got.values()) >= 0.99 * total
    assert all(got[i].n_links <= len(links.get(i, ())) for i in got)
    for i in got:
        if i not in ok:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    if limit > 1000:
        seen = {}
        for i in ok:
            stack, comp = [i], {i}
            while stack:
                for j in links[stack.pop()] - comp:
                    comp.add(j)
                    stack.append(j)
            seen[i] = min(comp)
        assert all(got[i].component_id == seen[i] for i in ok)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert flat_graph.near_dedup(none).count() == 0


def brute_links(u):
    """Each vector's number of links and the smallest vector of its component, all pairs compared."""
    n, root = np.zeros(len(u), np.int64), np.arange(len(u))
    for at in range(0, len(u), 1000):
        i, j = np.nonzero(u[at : at + 1000] @ u.T >= flat_graph.COSINE)
        i += at
        n += np.bincount(i, minlength=len(u)) - (np.arange(len(u)) // 1000 == at // 1000)
        apart = root[i] != root[j]
        root = K.local_forest(len(u), np.concatenate([np.arange(len(u)), i[apart]]), np.concatenate([root, j[apart]]))
    return n, root


@pytest.mark.parametrize("n, limit", [(1000, flat_graph.LIMIT), (3000, flat_graph.LIMIT), (3000, 300), (10000, flat_graph.LIMIT)])
def test_flat_graph_dense_ball(spark, n, limit):
    """Distinct near copies, within a shard and over many: the audit and brute force agree that every link is found."""
    rng = np.random.default_rng(n)
    centre = rng.normal(size=64)
    ball = centre / np.linalg.norm(centre) * 8 + rng.normal(size=(n, 64)) * 0.26
    x = np.concatenate([ball, rng.normal(size=(500, 64))])
    links, root = brute_links(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert 0.2 * n < links[:n].mean() < 0.99 * n
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in flat_graph.near_dedup(df, limit=limit).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * links.sum()
    assert all(got[i].n_links <= links[i] and got[i].component_id == root[i] for i in range(len(x)))
    assert got[0].recall >= 0.99


def test_flat_graph_falls_back(spark, monkeypatch):
    """Where the audit misses links, all pairs of the label's cells are verified."""
    x = np.random.default_rng(8).normal(size=(700, 64)) * 0.26 + 1
    links, root = brute_links(x / np.linalg.norm(x, axis=1, keepdims=True))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(flat_graph, "search_shard", lambda x, *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    got = {r.vec_id: r for r in flat_graph.near_dedup(df, limit=100).collect()}
    assert got[0].recall < flat_graph.RECALL
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(links[i]), int(root[i])) for i in range(len(x))}


def test_flat_graph_dealing(spark):
    """Every node has one home; copies and shards are bounded, also for vectors that centres cannot part."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([k + rng.normal(size=(90, 16)) * 0.5 for k in c] + [rng.normal(size=(300, 16)), np.ones((400, 16)) + rng.normal(size=(400, 16)) * 1e-12])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i) * 7919 % (1 << 61), "1", 16, v.tobytes()) for i, v in enumerate(u)], "id long, label string, dim int, x binary")
    got = flat_graph.shards(df, Scratch(spark, "test"), limit=100).collect()
    homes = [r.id for r in got if r.home]
    assert len(homes) == len(set(homes)) == len(u)
    size, copies = {}, {}
    for r in got:
        size[r.cell], copies[r.id] = size.get(r.cell, 0) + 1, copies.get(r.id, 0) + 1
    assert max(size.values()) <= 100 and max(copies.values()) <= 8


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    one = labels.filter("quality = 1")
    assert {r.predicted for r in quality.classify(docs, one).collect()} == {1}
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.accepted(docs, labels).schema == docs.schema


@pytest.mark.parametrize("text", ["", "a", "Ab, cd! cd cd\n\nAb, cd! #x\tY\n|z|", "\u00e9\u00e8 " * 7 + "1 2 2 2\x00", "x" * 500])
def test_quality_statistics(text):
    """Each statistic by its definition, a character or a word at a time."""
    raw_ = text.encode()
    words = raw_.split()
    lines = [x for x in raw_.split(b"\n") if x]
    kinds = [
        lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b in b" \t\r\x0b\x0c", lambda b: b == 10, lambda b: b in b".,;:'\"()-?", lambda b: b in b"!",
        lambda b: b in b"#$%&*+=@^~<>\\/_", lambda b: b in b"|[]{}", lambda b: b >= 128, lambda b: b < 32 and b not in b"\t\n\r\x0b\x0c",
    ]
    share = [sum(map(k, raw_)) / len(raw_) if raw_ else 0.0 for k in kinds]
    more = [0.0] * 10
    if words:
        m, sizes, runs = len(words), [len(w) for w in words], [1]
        for a, b in zip(words, words[1:], strict=False):
            runs.append(runs[-1] + 1 if a == b else 1)
        mean = sum(sizes) / m
        more = [
            sum(any(kinds[k](w[-1]) for k in (6, 7, 8)) for w in words) / m,
            sum(kinds[0](w[0]) for w in words) / m,
            sum(kinds[8](w[0]) for w in words) / m,
            1 - len(set(words)) / m,
            1 - len(set(lines)) / len(lines),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
            math.log(max(runs)) / 100,
            math.log1p(mean) / 100,
            math.log1p((sum((x - mean) ** 2 for x in sizes) / m) ** 0.5) / 100,
            math.log1p(m / max(1, len(lines))) / 100,
        ]
    assert quality.statistics(raw_) == pytest.approx([math.log1p(100 * x) for x in [*share, *more]])


def test_quality_fit_and_scores(spark, docs):
    """The query's scores against a discriminant fitted and evaluated without it."""
    labels = {i: int(i % 3 > 0) for i in range(40)}
    df = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    learn = [(quality.statistics(raw(x)), labels[i]) for i, x in rows() if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    side = {}
    for c in (0, 1):
        x = np.array([v for v, y in learn if y == c])
        mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
        target = 0.9 * np.diag(np.diag(cov)) + 0.1 * np.trace(cov) / quality.D * np.eye(quality.D)
        side[c] = len(x), mean, (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * target + 1e-6 * np.eye(quality.D)

    def log_density(v, c):
        n, mean, cov = side[c]
        return math.log(n) - 0.5 * (v - mean) @ np.linalg.solve(cov, v - mean) - 0.5 * np.linalg.slogdet(cov)[1]

    want = Counter()
    for i, x in rows():
        v = quality.statistics(raw(x))
        z = log_density(v, 1) - log_density(v, 0)
        want[i, round(1 / (1 + math.exp(-max(-500, min(500, z)))), 6)] += 1
    got = quality.classify(docs, df).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def test_quality_score_is_the_density_ratio():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (300, quality.D)), rng.normal(0.4, 1.5, (200, quality.D))
    m = quality.fit_sums({c: (len(x), x.sum(axis=0), x.T @ x) for c, x in ((0, a), (1, b))}, 0.05)
    x = rng.normal(0.2, 1, (5, quality.D))

    def log_density(c):
        cov = m.factors[c] @ m.factors[c].T
        d = x - m.means[c]
        return -0.5 * np.einsum("nd,de,ne->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]

    want = 1 / (1 + np.exp(-(log_density(1) - log_density(0) + np.log(200 / 300))))
    assert m.score(x) == pytest.approx(want)


def test_quality_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    right, n = got.selectExpr("avg(cast(predicted = quality as int))", "count(*)").first()
    assert n > 10 and right >= 0.85
