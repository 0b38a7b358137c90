"""Quality: a linear-chain conditional random field over the lines of a document.

Each non-empty line gets features of its characters and words, and those of its
neighbours.  The field labels every line good or bad; documents' labels are the
labels of all their lines in training.  A document's quality is the mean of the lines'
forward-backward marginals, weighted by line length, mapped to a probability by a
logistic curve fitted on the same training documents.

Training uses a documented, bounded sample: about ``rows`` labelled texts of at
most ``chars`` characters, spread by a hash.  Scoring reads every text whole.

Defined cases: a text that is null or has no non-blank line scores the share of good
labels.  If only one class was learned, every text scores that share (0 without labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample, text_udf
from .kernels import CharTable, SpanHasher, blocks, token_bounds

TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000
# character classes
_LETTER, _UPPER, _DIGIT, _SPACE, _PUNCT, _BAR, _MARK, _SHOUT = (1 << k for k in range(8))


def _class_of(ch: str) -> int:
    if ch.isalpha():
        return _LETTER | (_UPPER if ch.isupper() else 0)
    if ch.isdigit():
        return _DIGIT
    if ch.isspace():
        return _SPACE
    if ch in "!?":
        return _SHOUT
    if ch in "|":
        return _BAR
    return _PUNCT if ch in ".,;:'\"()-" else _MARK


class Featurizer:
    """Line features of texts, by array operations over a block of texts."""

    own = 17

    def __init__(self):
        self.classes = CharTable(_class_of)
        self.hash = SpanHasher()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features per line, text number per line, characters per line)."""
        joined = "".join(t + "\n" for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        kind = self.classes(code)
        size = np.cumsum([len(t) + 1 for t in texts])
        begin, end = token_bounds(code != 10)
        word_a, word_b = token_bounds((kind & _SPACE) == 0)
        w0, w1 = np.searchsorted(word_a, begin), np.searchsorted(word_a, end)
        some = w1 > w0  # lines that hold a word
        begin, end, w0, w1 = begin[some], end[some], w0[some], w1[some]
        owner = np.searchsorted(size, begin, side="right")
        length = (end - begin).astype(float)
        if not len(begin):
            return np.zeros((0, 3 * self.own)), owner, length
        count = [self._sums(kind & bit != 0, begin, end) for bit in (_LETTER, _UPPER, _DIGIT, _SPACE, _PUNCT, _BAR, _MARK, _SHOUT)]
        n_words = (w1 - w0).astype(float)
        h = self.hash(code, word_a, word_b)
        line_of = np.repeat(np.arange(len(begin)), w1 - w0)
        again = []
        for lag in (1, 2, 3):
            same = np.zeros(len(h), dtype=bool)
            same[lag:] = (h[lag:] == h[:-lag]) & (line_of[lag:] == line_of[:-lag])
            again.append(self._sums(same, w0, w1) / n_words)
        tail = (kind[word_b - 1] & (_MARK | _SHOUT | _BAR)) != 0
        marked = self._sums(tail, w0, w1) / n_words
        line = self.hash(code, begin, end)
        twin = np.zeros(len(line))
        twin[1:] = (line[1:] == line[:-1]) & (owner[1:] == owner[:-1])
        closed = (kind[word_b[w1 - 1] - 1] & (_PUNCT | _SHOUT)) != 0
        upper_start = (kind[word_a[w0]] & _UPPER) != 0
        letters = np.maximum(count[0], 1)
        x = np.column_stack([
            count[0] / length, count[1] / letters, count[2] / length, count[4] / length, count[5] / length, count[6] / length, count[7] / length,
            np.log1p(length), np.log1p(n_words), (length - count[3]) / n_words / 10, *again, marked, twin, closed, upper_start,
        ])
        both = (owner[1:] == owner[:-1])[:, None]
        before, behind = np.zeros_like(x), np.zeros_like(x)
        before[1:] = np.where(both, x[:-1], 0)
        behind[:-1] = np.where(both, x[1:], 0)
        return np.hstack([x, before, behind]), owner, length

    @staticmethod
    def _sums(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[end] - total[begin]).astype(float)


def _chains(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines, where each begins, and how many have a line at each step."""
    lines = np.bincount(owner, minlength=n)
    begin = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    order = order[lines[order] > 0]
    most = int(lines[order[0]]) if len(order) else 0
    live = np.searchsorted(-lines[order], -np.arange(most), side="left")
    return begin[order], lines[order], live


def marginals(score: np.ndarray, step: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected count of each transition, by forward-backward.

    ``score`` has each line's log-odds of good, ``step`` the 2 x 2 transition scores.  All chains step together.
    """
    begin, lines, live = _chains(owner, n)
    move = np.exp(step - step.max())
    emit = np.ones((len(score), 2))
    emit[:, 1] = np.exp(np.clip(score, -30, 30))
    emit /= emit.sum(axis=1, keepdims=True)
    fwd, bwd = np.ones((len(score), 2)), np.ones((len(score), 2))
    for t, k in enumerate(live.tolist()):
        at = begin[:k] + t
        a = emit[at] if t == 0 else emit[at] * (fwd[at - 1] @ move)
        fwd[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        b = (bwd[at + 1] * emit[at + 1]) @ move.T
        bwd[at] = b / b.sum(axis=1, keepdims=True)
    both = fwd * bwd
    good = both[:, 1] / both.sum(axis=1)
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    if len(inner):
        x = fwd[inner][:, :, None] * move * (emit[inner + 1] * bwd[inner + 1])[:, None, :]
        pair = (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pair


class Model:
    """Feature scaling, line weights, transitions and the document curve."""

    def __init__(self, prior: float, mean=None, scale=None, weights=None, step=None, curve=(1.0, 0.0)):
        self.prior, self.mean, self.scale, self.weights, self.step, self.curve = prior, mean, scale, weights, step, curve

    def lines(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return marginals(z @ self.weights[:-1] + self.weights[-1], self.step, owner, n)[0]

    def scores(self, texts: list, features: Featurizer) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.weights is None:
            return out
        data = [t or "" for t in texts]
        for lo, hi in blocks([len(t) for t in data], 1 << 20):
            x, owner, length = features(data[lo:hi])
            if len(x):
                m = _mean_by(self.lines(x, owner, hi - lo), owner, length, hi - lo)
                p = 1 / (1 + np.exp(-np.clip(self.curve[0] * _logit(m) + self.curve[1], -50, 50)))
                have = np.bincount(owner, minlength=hi - lo) > 0
                out[lo:hi][have] = p[have]
        return out


def _mean_by(good: np.ndarray, owner: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(owner, length, n)
    return np.bincount(owner, length * good, n) / np.maximum(total, 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(grad_of, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = grad_of(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * min(1.0, 2 * (1 - k / (steps + 1)))
    return w


def fit(texts: list[str], labels: list[int], steps: int = 80, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """Maximum likelihood of the line labels by gradient steps; each document weighs the same."""
    y = np.array(labels, dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(prior)
    x, owner, length = Featurizer()(texts)
    if not len(x):
        return Model(prior)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    want = y[owner]
    weight = 1 / np.maximum(np.bincount(owner, minlength=len(y)), 1)[owner] / len(y)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (want[inner].astype(int), want[inner + 1].astype(int)), 1)
    k = z.shape[1]

    def grad(w: np.ndarray) -> np.ndarray:
        good, pair = marginals(z @ w[:k], w[k:].reshape(2, 2), owner, len(y))
        return np.concatenate((z.T @ ((good - want) * weight) + l2 * w[:k], ((pair - seen) / max(1, len(inner))).ravel() * 0.1 + l2 * w[k:]))

    w = _adam(grad, np.zeros(k + 4), steps, rate)
    model = Model(prior, mean, scale, w[:k], w[k:].reshape(2, 2))
    have = np.bincount(owner, minlength=len(y)) > 0
    s = _logit(_mean_by(model.lines(x, owner, len(y)), owner, length, len(y)))[have]

    def curve(c: np.ndarray) -> np.ndarray:
        d = 1 / (1 + np.exp(-np.clip(c[0] * s + c[1], -50, 50))) - y[have]
        return np.array([(d * s).mean() + 1e-3 * c[0], d.mean()])

    model.curve = tuple(_adam(curve, np.array([0.5, 0.0]), 400, 0.05))
    return model


def train(docs: DataFrame, labels: DataFrame, fold: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model from labelled documents outside the held-out fold.  Labels that contradict each other are averaged."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("__quality"))
    learn = docs.select("doc_id", "text").where(F.crc32(F.col("doc_id").cast("string")) % fold != held_out).join(marks, "doc_id")
    sample = labelled_sample(learn, rows, chars, "__quality")
    return fit([s[1] for s in sample], [s[2] for s in sample])


def quality(docs: DataFrame, model: Model, threshold: float = 0.7, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, score (0 to 1) and predicted (1 from ``threshold``) of every document."""
    bounded_batches(docs.sparkSession)

    def make():
        features = Featurizer()
        return lambda texts: {"score": model.scores(texts, features)}

    found = docs.select(*keep, text_udf(make, "score double")("text").alias("s")).select(*keep, "s.score")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
