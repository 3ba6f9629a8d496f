"""Quality scores by positive-unlabelled learning.

Trusted positives are the rows labelled 1; the rest of what is learned from is unlabelled web
text, whose labels are not looked at.  The share of positives in it, the class prior, is
estimated first: a plain classifier of positives against unlabelled texts is scored on rows it
was not fitted on, and the prior is the least ratio of the shares of unlabelled and of positive rows above
a score, with a margin for small counts (best-bin estimation).  Then a logistic model minimises
the non-negative unbiased risk

    prior * mean(loss(+1) over positives) + max(0, mean(loss(-1) over unlabelled) - prior * mean(loss(-1) over positives))

taking the step that raises a negative second part back where it would fall below zero.

Features are counts over the whole text: signs by kind, lengths, repeats of words, word pairs and lines.
Both sets are bounded samples of distinct texts by a hash; scores cover every row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs counted one by one; other signs, letters and digits are counted by kind.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = np.zeros(256, np.int64)
_KINDS[[ord(c) for c in SIGNS]] = np.arange(1, len(SIGNS) + 1)
for _kind, _range in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), (32,), (10,), range(0, 10)), len(SIGNS) + 1):
    _KINDS[list(_range)] = _kind
N_KINDS = len(SIGNS) + 8
WIDTH = 2 * N_KINDS + 12


def features(text: bytes | None) -> np.ndarray:
    """Features of one UTF-8 text: zeros if null or empty."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    shares = np.bincount(_KINDS[data], minlength=N_KINDS) / len(data)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    if n:
        counts = Counter(words)
        pairs = Counter(zip(words, words[1:]))
        lengths = np.array([*map(len, words)])
        rest = [
            math.log1p(n),
            lengths.mean() / 10,
            lengths.std() / 10,
            len(counts) / n,
            max(counts.values()) / n,
            len(pairs) / max(1, n - 1),
            max(pairs.values(), default=0) / max(1, n - 1),
            sum(w.isupper() for w in words) / n,
            sum(not w[:1].isalnum() and w[0] < 128 for w in words) / n,
            sum(w[-1:] in (b".", b",", b";", b":", b"?") for w in words) / n,
            len(set(lines)) / max(1, len(lines)),
            n / max(1, len(lines)) / 50,
        ]
        out[2 * N_KINDS :] = rest
    # how much, and whether at all
    out[:N_KINDS] = np.sqrt(shares)
    out[N_KINDS : 2 * N_KINDS] = np.log1p(1000 * shares) / 7
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Model:
    """A standardised logistic model."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, weights: np.ndarray, prior: float) -> None:
        self.middle, self.spread, self.weights, self.prior = middle, spread, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._rows(x) @ self.weights)

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.middle) / self.spread, -8, 8), np.ones((len(x), 1))])


def _descend(gradient, size: int, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam on a full-batch gradient, from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """The least ratio of the two shares above a score, from scores of rows that were not fitted; at least 1 %."""
    cuts = np.unique(positives)[::-1]
    p = np.array([(positives >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = math.sqrt(math.log(4 / sure) / 2) * (1 / math.sqrt(len(positives)) + 1 / math.sqrt(len(unlabelled)))
    best = np.argmin((u + margin) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_rows(positives: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3) -> Model:
    """The model of two samples; without positives or unlabelled rows every score is a half."""
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    model = Model(unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3, np.zeros(WIDTH + 1), 0.5)
    p, u = model._rows(positives), model._rows(unlabelled)
    shrink = np.append(np.full(WIDTH, decay), 0.0)

    def against(a: np.ndarray, b: np.ndarray):
        return lambda w: -(a * (1 - _sigmoid(a @ w))[:, None]).mean(axis=0) + (b * _sigmoid(b @ w)[:, None]).mean(axis=0) + shrink * w

    if len(p) > 3 and len(u) > 3:
        w = _descend(against(p[::2], u[::2]), WIDTH + 1, 150)
        model.prior = estimated_prior(p[1::2] @ w, u[1::2] @ w)
    prior = model.prior

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        plus = -prior * (p * (1 - sp)[:, None]).mean(axis=0)
        minus = (u * su[:, None]).mean(axis=0) - prior * (p * sp[:, None]).mean(axis=0)
        level = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        return (plus + minus if level >= 0 else -minus) + shrink * w

    model.weights = _descend(risk, WIDTH + 1)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.binary())], ["positive", "features"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of ``docs``; of ``labels`` only the rows labelled 1 are used.

    About ``sample`` distinct positive texts and as many unlabelled ones are taken, whole, by a
    hash of the text; a text counts once, however many rows share it, and is positive if one
    of them is.  Null texts teach nothing; an id that is labelled twice counts as positive if one label is 1.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text")).where("text is not null")
    trusted = labels.where(labels[label_col] == 1).select(labels[id_col].alias("doc_id")).distinct()

    def drawn(which, positive: bool) -> DataFrame:
        texts = which(rows.select("doc_id", F.xxhash64("text").alias("place"))).agg(F.approx_count_distinct("place")).first()[0]
        share = min(1.0, sample / max(1, texts)) * (1 << 30)
        # copies have one place, so all are taken or none, and meet again here
        return which(rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share)).select("text").distinct().withColumn("positive", F.lit(positive))

    positive = drawn(lambda some: some.join(trusted, "doc_id", "left_semi"), True)
    unlabelled = drawn(lambda some: some, False)
    # two bounded samples of feature rows
    got = positive.union(unlabelled).select("positive", "text").mapInArrow(_featured, "positive boolean, features binary").toArrow()
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
    mark = np.array(got.column("positive").to_pylist(), bool)
    order = np.lexsort((*x.T[:8], mark)) if len(x) else np.zeros(0, np.int64)  # the same rows in the same order on every run
    x, mark = x[order], mark[order]
    return fit_rows(x[mark], x[~mark])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row, from 0 to 1; a null text is scored as an empty one, other columns are ignored."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                x = np.stack([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.scores(x))], ["doc_id", "score"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(task, f"doc_id {kind}, score double")
