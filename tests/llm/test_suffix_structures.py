"""Suffix arrays, covers and trees against brute force."""

import random

import numpy as np
import pytest

from loamline.llm import repeats as R
from loamline.llm import substring_dedup as T
from loamline.llm import suffix_dedup as S


@pytest.mark.parametrize("v", [7, 13, 31])
def test_cover_meets_every_difference(v):
    d = S.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    text = bytes(rng.choices(b"ab\x00"[: 1 + seed % 3], k=rng.randrange(0, 400)))
    if seed % 2:
        text = text[:50] * 5 + text
    for v in (7, 31):
        assert S.suffix_array(text, v).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_winnow_covers_each_window_once():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 40, 300, 12, 13])
    v = rng.integers(0, 9, sizes.sum()).astype(np.uint64)
    lo, hi, q = R.winnow(v, sizes, 4, 13)
    starts = np.cumsum(sizes) - sizes
    want = [s + i for s, n in zip(starts, sizes, strict=True) for i in range(n - 12)]
    assert [i for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)] == want
    assert ((q >= hi) & (q + 4 <= lo + 13)).all()


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    text = rng.choices("abc"[: 2 + seed % 2], k=60)
    least = 3
    where = {}
    for n in range(least, 60):
        for i in range(60 - n + 1):
            where.setdefault(tuple(text[i : i + n]), []).append(i)
    want = set()
    for k, at in where.items():
        if len(at) > 1 and len({text[i - 1] if i else ("start", i) for i in at}) > 1 and len({text[i + len(k)] if i + len(k) < 60 else ("end", i) for i in at}) > 1:
            want.add((k, len(at)))
        elif len(at) > 1 and 0 in at and len({text[i + len(k)] if i + len(k) < 60 else ("end", i) for i in at}) > 1:
            want.add((k, len(at)))
    assert T.maximal_repeats(text, least, limit=8) == want


@pytest.mark.parametrize("seed", range(4))
def test_parts_need_not_know_each_other(seed):
    import xxhash

    rng = np.random.default_rng(seed)
    base = rng.integers(97, 100, 400).astype(np.uint8)
    docs = [np.concatenate([base[a : a + 120], rng.integers(97, 123, 30).astype(np.uint8), base[b : b + 60]]) for a, b in rng.integers(0, 280, (12, 2)).tolist()]
    task = S.task(20)
    rows = []
    for d, text in enumerate(docs):
        lo, hi, q = R.winnow(text.astype(np.uint64), np.array([len(text)]), task.k, 20)
        rows += [(text[a : b + 20], c - a, d, a, xxhash.xxh64_intdigest(text[c : c + task.k].tobytes())) for a, b, c in zip(lo, hi, q, strict=True)]
    sizes = np.array([len(r[0]) for r in rows])
    raw = np.concatenate([r[0] for r in rows])
    rest = [np.array([r[i] for r in rows]) for i in (1, 2, 3)]
    anchors = np.array([r[4] for r in rows], np.uint64)

    def windows(most):
        return {(int(s), w) for s, a, b in zip(*R.in_parts(task, raw, sizes, anchors, rest, most), strict=True) for w in range(int(a), int(b) + 1)}

    first = {}
    for text, _, d, a, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        for w in range(len(text) - 19):
            first.setdefault(text[w : w + 20].tobytes(), (d, a + w))
    want = {(k, w) for k, (text, _, d, a, _) in enumerate(rows) for w in range(len(text) - 19) if first[text[w : w + 20].tobytes()] < (d, a + w)}
    assert windows(1) == windows(300) == windows(1 << 30) == want and want
