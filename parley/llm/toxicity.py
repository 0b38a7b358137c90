"""Toxicity: a character n-gram linear classifier with naive Bayes feature scaling.

Features are the distinct hashed character 3- to 5-grams of the whole lower-cased
text.  Each is scaled by its naive Bayes log-count ratio, and a logistic
regression with an L2 penalty is fitted on the scaled features.

Training uses a documented, bounded sample: about ``rows`` labelled texts of at
most ``chars`` characters, spread by a hash.  Scoring reads every text whole, one that
is longer than ``PIECE`` in overlapping pieces, so memory beyond the text is bounded.

Defined cases: null and empty texts score as a text without features.  If no
label of one class is there, every text scores the share of toxic labels (0
without labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, labelled_sample, text_udf
from .kernels import U64, blocks, mix64

BITS = 18
SIZES = (3, 4, 5)
TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000
#: Characters of a long text that are looked at together.
PIECE = 1 << 20
#: A feature is used when it occurs in at least so many training texts ...
LEAST_TEXTS = 4
#: ... and its log-count ratio is at least so far from 0.
LEAST_RATIO = 1.0


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every character n-gram, repeats included."""
    lows = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*lows, ""]).encode("utf-32-le", "replace"), dtype=np.uint32).astype(U64)
    owner = np.repeat(np.arange(len(lows)), [len(t) + 1 for t in lows])
    out_t, out_f = [], []
    with np.errstate(over="ignore"):
        h = code.copy()
        n = len(code)
        for size in range(2, max(SIZES) + 1):
            if n < size:
                break
            h = h[: n - size + 1] * U64(0x100000001B3) + code[size - 1 :]
            if size in SIZES:
                same = owner[: n - size + 1] == owner[size - 1 :]
                # the separator after a text may end its last gram, as a space would
                f = (mix64(h + U64(size)) >> U64(64 - BITS)).astype(np.int64)
                out_t.append(owner[: n - size + 1][same])
                out_f.append(f[same])
    if not out_t:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_t), np.concatenate(out_f)


def _long_text(text: str) -> np.ndarray:
    """Which features a long text has, piece by piece; the same as ``_distinct`` finds in it as a whole."""
    code = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    seen = np.zeros(1 << BITS, dtype=bool)
    with np.errstate(over="ignore"):
        for lo in range(0, len(code), PIECE):
            part = code[lo : lo + PIECE + max(SIZES) - 1].astype(U64)
            h = part.copy()
            for size in range(2, min(max(SIZES), len(part)) + 1):
                h = h[: len(part) - size + 1] * U64(0x100000001B3) + part[size - 1 :]
                if size in SIZES:
                    seen[(mix64(h + U64(size)) >> U64(64 - BITS)).astype(np.int64)] = True
    return seen


def _distinct(texts: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    t, f = _grams(texts)
    if used is not None:
        keep = used[f]
        t, f = t[keep], f[keep]
    both = np.unique((t << BITS) | f)
    return both >> BITS, both & ((1 << BITS) - 1)


class Model:
    """Weights by feature, an intercept, and the score of any text."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list) -> np.ndarray:
        data = [t or "" for t in texts]
        used = self.weights != 0
        out = np.full(len(data), self.bias)
        for lo, hi in blocks([len(t) for t in data], PIECE):
            if hi == lo + 1 and len(data[lo]) > PIECE:
                out[lo] += self.weights[_long_text(data[lo])].sum()
                continue
            t, f = _distinct(data[lo:hi], used)
            out[lo:hi] += np.bincount(t, self.weights[f], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(texts: list[str], labels: list[int], steps: int = 150, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """Naive Bayes ratios, then logistic regression on the scaled features by Adam."""
    y = np.array(labels, dtype=float)
    weights = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(weights, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # two passes over bounded blocks: only the features that are used are ever held for all texts
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for lo, hi in blocks([len(t) for t in texts], 1 << 20):
        t, f = _distinct(texts[lo:hi])
        pos += np.bincount(f, y[lo:hi][t], 1 << BITS)
        neg += np.bincount(f, 1 - y[lo:hi][t], 1 << BITS)
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
    ratio[(pos + neg < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    parts = [(lo, *_distinct(texts[lo:hi], ratio != 0)) for lo, hi in blocks([len(t) for t in texts], 1 << 20)]
    t = np.concatenate([p[1] + p[0] for p in parts])
    f = np.concatenate([p[2] for p in parts])
    names, at = np.unique(f, return_inverse=True)
    value = ratio[f]
    w, b = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(t, w[at] * value, len(y)), -50, 50)))
        g = (p - y) / len(y)
        grad = np.concatenate((np.bincount(at, g[t] * value, len(names)) + l2 * w, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * min(1.0, 2 * (1 - k / (steps + 1)))
        w, b = w - step[:-1], b - float(step[-1])
    weights[names] = w * ratio[names]
    weights[np.abs(weights) < 1e-3] = 0
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model from labelled documents outside the held-out fold.  Labels that contradict each other are averaged."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("__toxic"))
    learn = docs.select("doc_id", "text").where(F.crc32(F.col("doc_id").cast("string")) % fold != held_out).join(marks, "doc_id")
    sample = labelled_sample(learn, rows, chars, "__toxic")
    return fit([s[1] for s in sample], [s[2] for s in sample])


def score_udf(model: Model):
    return text_udf(lambda: lambda texts: {"score": model.scores(texts)}, "score double")


def toxicity(docs: DataFrame, model: Model, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, score (0 to 1) and predicted (1 from 0.5) of every document."""
    bounded_batches(docs.sparkSession)
    return docs.select(*keep, score_udf(model)("text").alias("s")).select(*keep, "s.score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents scored under 0.5, all columns as they came."""
    bounded_batches(docs.sparkSession)
    (name,) = fresh(docs, "tox")
    return docs.withColumn(name, score_udf(model)("text")).where(F.col(name)["score"] < 0.5).select(*docs.columns)
