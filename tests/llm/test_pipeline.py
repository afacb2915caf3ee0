"""The pipeline's stages against brute force, in small."""

import random

import corpus_pipeline as P
import numpy as np

from loamline.llm.store import Scratch


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "simhash", "suffix", "packing"]


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def without_repeats(rows, length=100):
    """Each (doc_id, text) without the bytes of strings that start earlier; bytes of a character that loses some go with it."""
    seqs, first = [(i, (x or "").encode()) for i, x in rows], {}
    for i, t in seqs:
        for p in range(len(t) - length + 1):
            k = t[p : p + length]
            if k not in first or (i, p) < first[k]:
                first[k] = (i, p)
    out = {}
    for i, t in seqs:
        gone, upto = bytearray(len(t)), 0
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (i, p):
                at = max(p, upto)
                gone[at : p + length] = b"\1" * (p + length - at)
                upto = p + length
        out[i] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_run(spark, sf_dir):
    """Every stage over the smallest tables, against a plain version of it."""
    from tokenizers import Tokenizer

    from loamline.llm import packing, quality
    from loamline.llm.components import local_forest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = Scratch(spark, "test")
    stages = dict(P.STAGES)
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    good = keep.save(stages["quality"](spark, docs, sf_dir))
    assert good.columns == docs.columns
    now = text(good)
    score = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert set(now) == {i for i, s in score.items() if s >= 0.5} and 0 < len(now) < docs.count()

    one = keep.save(stages["simhash"](spark, good, sf_dir))
    assert one.columns == docs.columns
    ids = sorted(now)
    sets = [five_words(now[i]) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = local_forest(len(ids), *np.array(near).reshape(-1, 2).T)
    assert near and set(text(one)) == {ids[k] for k in set(root.tolist())}

    kept = keep.save(stages["suffix"](spark, one, sf_dir))
    assert kept.columns == docs.columns
    want = without_repeats(sorted(text(one).items()))
    assert {i: t or "" for i, t in text(kept).items()} == want
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())

    tok = Tokenizer.from_file(packing.default_path())
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    packed = P.run(spark, sf_dir).collect()
    got, sequences = {}, {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == n
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(n.values()) / 1024 + 1


def test_simhash_stage(spark, sf_dir):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choices(words, k=200) for _ in range(30)]
    near = [[*b[:99], "new", *b[100:]] for b in base[:10]]
    rows = [(i, " ".join(w), "en", "s", 0, "extra") for i, w in enumerate([*base, *near])] + [(None, "x y z " * 9, "en", "s", 0, "e"), (99, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    out = P.simhash_stage(spark, df, sf_dir)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {*range(30), None, 99}


def test_empty(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
