"""Candidates of near copies do not grow together over what very many texts hold."""

import random

import numpy as np

from loamline.llm import simhash
from loamline.llm.components import local_forest

WORDS = [f"w{k}" for k in range(20000)]


def wanted(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near
    return dict(enumerate(local_forest(len(sets), *np.array(near).T).tolist()))


def run(spark, monkeypatch, texts):
    """The components, and the sizes of the groups of candidates that are settled."""
    seen, settled = [], simhash.settled

    def held(grouped, *a, **k):
        seen.extend(r["count"] for r in grouped.groupBy("component").count().collect())
        return settled(grouped, *a, **k)

    monkeypatch.setattr(simhash, "settled", held)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.dedup_similar(df).collect()}, seen


def test_short_texts_with_a_common_line(spark, monkeypatch):
    rng = random.Random(3)
    line = rng.choices(WORDS, k=12)
    texts = [" ".join([*rng.choices(WORDS, k=25), *line]) for _ in range(150)]
    texts += [f"{t} end" for t in texts[:5]] + [" ".join(line), " ".join([*line, "end"])]
    got, sizes = run(spark, monkeypatch, texts)
    assert got == wanted(texts)
    assert max(sizes) <= 4


def test_long_texts_with_a_common_passage(spark, monkeypatch):
    rng = random.Random(4)
    passage = rng.choices(WORDS, k=300)
    texts = [" ".join([*rng.choices(WORDS, k=90), *passage]) for _ in range(60)]
    texts += [f"{t} end" for t in texts[:5]]
    monkeypatch.setattr(simhash, "SETTLED", 10)
    got, sizes = run(spark, monkeypatch, texts)
    assert got == wanted(texts)
    assert max(sizes) <= 4
