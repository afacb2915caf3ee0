"""Quality classifier: regularised quadratic discriminant analysis.

A document is described by transformed statistics of its whole text (shares of
kinds of characters, word shapes, repetition).  Each class gets a mean and a
covariance shrunk towards a scaled identity; their Cholesky factors are kept in
the model, and a score is the logistic of the difference of the two log
densities, taken from Mahalanobis distances by triangular solves, and of the log
priors.

Sums and outer products are added up on the executors over all labelled rows, so
what comes to the driver is one vector and one matrix for each class.  Labels,
lang, source and doc_id are no input of a score.

Defined results: null and empty texts are scored like any other (their
statistics are zeros); a null id is never held out and never labelled; labels
without a class are ignored and repeated ones count each time; with labels of
one class only, or none, every score is that class's share (0.5 with none);
statistics are finite for every text; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import release
from loamline.llm.store import Scratch

FOLDS, HELD_OUT = 3, 1
SHRINKAGE = 0.05
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _kinds() -> np.ndarray:
    """Byte kinds as a 256 x k indicator: the shares of a text that are of each kind."""
    b = np.arange(256)
    sets = [
        (b >= 65) & (b <= 90),
        (b >= 97) & (b <= 122),
        (b >= 48) & (b <= 57),
        np.isin(b, list(b" \t\r\x0b\x0c")),
        b == 10,
        np.isin(b, list(b".,;:'\"()-?")),
        np.isin(b, list(b"!")),
        np.isin(b, list(b"#$%&*+=@^~<>\\/_")),
        np.isin(b, list(b"|[]{}")),
        b >= 128,
        (b < 32) & ~np.isin(b, list(b"\t\n\r\x0b\x0c")),
    ]
    return np.stack(sets, axis=1).astype(np.float64)


KINDS = _kinds()
D = KINDS.shape[1] + 10


def _longest_run(words: list[bytes]) -> float:
    """The log of the length of the longest run of one word."""
    same = np.fromiter(map(operator.ne, words, words[1:]), bool, len(words) - 1)
    at = np.flatnonzero(same)
    return float(np.log(np.diff(np.concatenate(([-1], at, [len(words) - 1]))).max()))


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of a text: shares as log(1 + 100 x), sizes as log(1 + x)."""
    out = np.zeros(D)
    n = len(text)
    if not n:
        return out
    out[: KINDS.shape[1]] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ KINDS / n
    words = text.split()
    if words:
        m = len(words)
        size = np.fromiter(map(len, words), np.float64, m)
        last = b"".join([w[-1:] for w in words])
        first = b"".join([w[:1] for w in words])
        ends = np.bincount(np.frombuffer(last, np.uint8), minlength=256) @ KINDS / m
        begins = np.bincount(np.frombuffer(first, np.uint8), minlength=256) @ KINDS / m
        lines = [x for x in text.split(b"\n") if x]
        k = KINDS.shape[1]
        out[k : k + 10] = (
            ends[5:9].sum() - ends[5],
            begins[0],
            begins[8],
            1 - len(set(words)) / m,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            sum(map(operator.eq, words, words[1:])) / m,
            _longest_run(words) / 100,
            np.log1p(size.mean()) / 100,
            np.log1p(size.std()) / 100,
            np.log1p(m / max(1, len(lines))) / 100,
        )
    return np.log1p(100 * out)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column(1)]).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with factor @ y = b for a lower triangular factor, row by row."""
    y = np.empty_like(b, dtype=np.float64)
    for k in range(len(b)):
        y[k] = (b[k] - factor[k, :k] @ y[:k]) / factor[k, k]
    return y


@dataclass
class Model:
    """Means, Cholesky factors and log determinants of both classes, and the log odds of class 1 before a text is seen."""

    means: np.ndarray
    factors: np.ndarray
    half_dets: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of statistics, the probability of class 1."""
        z = np.full(len(x), self.prior)
        if len(self.means):
            for c, sign in ((0, -1.0), (1, 1.0)):
                y = forward(self.factors[c], (x - self.means[c]).T)
                z += sign * (-0.5 * (y * y).sum(axis=0) - self.half_dets[c])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float) -> Model:
    """A model from each class's count, sum and sum of outer products."""
    n0, n1 = (sums[c][0] if c in sums else 0.0 for c in (0, 1))
    if n0 < 2 or n1 < 2:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(np.zeros((0, D)), np.zeros((0, D, D)), np.zeros(0), float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9))))
    means = np.stack([sums[c][1] / sums[c][0] for c in (0, 1)])
    covs = [sums[c][2] / sums[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    factors = []
    for c in covs:
        # Shrunk towards the diagonal of its own variances, and that towards their mean, so that a constant statistic stays invertible.
        scale = np.trace(c) / D
        target = 0.9 * np.diag(np.diag(c)) + 0.1 * scale * np.eye(D)
        factors.append(np.linalg.cholesky((1 - shrinkage) * c + shrinkage * target + 1e-6 * np.eye(D)))
    half = np.array([np.log(np.diag(f)).sum() for f in factors])
    return Model(means, np.stack(factors), half, float(np.log(n1) - np.log(n0)))


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """A model of rows (x, quality): partial sums of each partition, then of all."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                s = held.setdefault(c, [0.0, np.zeros(D), np.zeros((D, D))])
                s[0], s[1], s[2] = s[0] + len(own), s[1] + own.sum(axis=0), s[2] + own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([s[0] for s in held.values()], pa.float64()), pa.array([s[1].tobytes() for s in held.values()], pa.binary()), pa.array([s[2].tobytes() for s in held.values()], pa.binary())], names=["c", "n", "s", "o"]
        )

    def total(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x.as_py()) for x in t.column("s"))
        o = sum(np.frombuffer(x.as_py()) for x in t.column("o"))
        return pa.table({"c": t.column("c").slice(0, 1), "n": [float(sum(t.column("n").to_pylist()))], "s": [s.tobytes()], "o": [o.tobytes()]})

    schema = "c int, n double, s binary, o binary"
    got = rows.select("x", F.col("quality").cast("int")).mapInArrow(partial, schema).groupBy("c").applyInArrow(total, schema).collect()
    return fit_sums({r["c"]: (r["n"], np.frombuffer(bytes(r["s"])), np.frombuffer(bytes(r["o"])).reshape(D, D)) for r in got}, shrinkage)


def is_held_out(doc_id: int | None, folds: int = FOLDS, held_out: int = HELD_OUT) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held_out


def training(labels: DataFrame, folds: int, held_out: int, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, quality) of the labels outside the held-out fold."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("quality"))
    return known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held_out)


def accepted(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of documents, unchanged, that score at least `least`: only labelled texts are described to fit, then each text once."""
    known = Scratch(docs.sparkSession, "quality").save(training(labels, folds, held_out, id_col, label_col))
    own = F.col(id_col).cast("long")
    labelled = docs.select(own.alias("doc_id"), F.col(text_col).alias("text")).join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit(described(labelled, "doc_id", "text").join(known, "doc_id"), shrinkage)

    def keep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics((t.as_py() or "").encode()) for t in b.column(b.schema.get_field_index(text_col))]).reshape(-1, D)
            yield b.filter(pa.array(model.score(x) >= least))
        release()

    return docs.mapInArrow(keep_rows, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: Scratch | None = None) -> DataFrame:
    """Scores of every document by a model of the labelled ones whose crc32(id) mod folds is not held_out."""
    keep = keep or Scratch(docs.sparkSession, "quality")
    x = keep.save(described(docs, id_col, text_col))
    model = fit(x.join(training(labels, folds, held_out, id_col, label_col), "doc_id"), shrinkage)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D))
            held = [is_held_out(i, folds, held_out) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(score, SCHEMA)
