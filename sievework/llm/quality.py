"""Quality by positive-unlabelled learning with a non-negative risk.

Trusted documents of label 1 are positives; everything else, as it comes from the web, is
unlabelled. With a class prior pi the risk of a scorer is pi R+ (positives as 1), plus the risk of
unlabelled text as 0 less what positives in it add, pi R- (positives as 0). The latter difference
can't be below zero; where an estimate falls below, the step goes against it instead, so that the
scorer does not learn to set the trusted positives apart from other good text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import TRAIN_CHARS, TRAIN_DOCS, need, split_words, training_rows

#: The score from which a document counts as good.
THRESHOLD = 0.5
#: Hidden units of the scorer.
HIDDEN = 24

_GROUPS = (
    b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"*", b"$", b"%", b"&", b"#",
    b"<>[]{}()/\\=+_~^`@", b"'\"-;:",
)
_TABLE = np.zeros((len(_GROUPS) + 1, 256), np.float64)
for _i, _g in enumerate(_GROUPS):
    _TABLE[_i, list(_g)] = 1
_TABLE[-1, 128:] = 1


def features(text: str | None) -> np.ndarray:
    """Numbers about the form of a whole text; an empty text gives zeros but for the first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = split_words(text), raw.split(b"\n")
    n, w = max(1, len(raw)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    same = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)[1] if words else np.ones(1)
    share = np.sqrt(same / w)
    used = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.concatenate([
        [float(not words), np.log1p(len(raw)) / 10, np.log1p(len(words)) / 8, np.log1p(len(lines)) / 5],
        np.sqrt(_TABLE @ counts / n),
        [lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100, np.sqrt((lengths <= 2).mean()), np.sqrt((lengths >= 15).mean())],
        [distinct / w, np.sqrt(distinct) / w, share.max(), float((same / w) @ (same / w)), np.sqrt((same == 1).sum() / w)],
        [len(set(lines)) / len(lines), used.mean() / 1000, used.std() / 1000, w / len(lines) / 100],
    ])


@dataclass(frozen=True)
class Model:
    """A scorer with one hidden layer over standardised features, and the prior it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(good: np.ndarray, open_: np.ndarray, prior: float, steps: int = 3000, batch: int = 512, rate: float = 0.01, l2: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative risk over ``good`` and unlabelled rows with the logistic loss, by Adam.

    Without good or unlabelled rows there is nothing to learn: every score is the prior.
    """
    every = np.concatenate([good, open_]) if good.size or open_.size else np.zeros((1, features("").size))
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(every.shape[1]), (every.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    prior = float(np.clip(prior, 0.01, 0.99))
    p[3][0] = np.log(prior / (1 - prior))
    if not len(good) or not len(open_):
        return Model(mean, scale, p[0] * 0, p[1], p[2], float(p[3][0]), prior)
    p[2] = rng.normal(0, 0.1, HIDDEN)
    x1, x0 = (np.clip((x - mean) / scale, -8, 8) for x in (good, open_))
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    kept = [np.zeros_like(v) for v in p]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        a, b = x1[rng.integers(0, len(x1), batch)], x0[rng.integers(0, len(x0), 2 * batch)]
        x = np.concatenate([a, b])
        h = np.tanh(x @ p[0] + p[1])
        z = h @ p[2] + p[3][0]
        s = sig(z)
        # losses of being called 0 are softplus(z), their slopes s; of being called 1, s - 1
        rest = np.logaddexp(0, z[batch:]).mean() - prior * np.logaddexp(0, z[:batch]).mean()
        g = np.empty_like(z)
        if rest >= 0:
            g[:batch] = prior * (s[:batch] - 1) / batch - prior * s[:batch] / batch
            g[batch:] = s[batch:] / (2 * batch)
        else:
            g[:batch] = prior * s[:batch] / batch
            g[batch:] = -s[batch:] / (2 * batch)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [x.T @ back + l2 * p[0], back.sum(0), h.T @ g + l2 * p[2], np.array([g.sum()])]
        fall = rate * (1 - step / (steps + 1))
        for v, m1, m2, d in zip(p, first, second, grads, strict=True):
            m1 += 0.1 * (d - m1)
            m2 += 0.001 * (d * d - m2)
            v -= fall * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        # the mean of the last half of the steps is steadier than the last
        if step > steps // 2:
            for v, k in zip(p, kept, strict=True):
                k += v / (steps - steps // 2)
    return Model(mean, scale, kept[0], kept[1], kept[2], float(kept[3][0]), prior)


def estimated_prior(good: np.ndarray, open_: np.ndarray, least: float = 0.2) -> float:
    """The share of good rows among unlabelled ones, from trusted good rows alone.

    A scorer that tells both apart is trained on half of the rows. Where of the other half's good rows a share p
    scores higher than a threshold, at least p times the prior of the unlabelled rows do, as they hold good ones. So no
    threshold's quotient of both shares is lower than the prior, and the least one is near it where few bad rows score
    high. Thresholds above which a share ``least`` of good rows is are looked at, as quotients of few rows are chance;
    each is raised by two standard errors before the least is taken, and that one counts without them.
    """
    if len(good) < 20 or len(open_) < 20:
        return 0.5
    scorer = train(good[::2], open_[::2], 0.5, steps=1000)
    p, u = np.sort(scorer.scores(good[1::2])), np.sort(scorer.scores(open_[1::2]))
    cuts = np.quantile(p, np.linspace(0, 1 - least, 101))
    above = 1 - np.searchsorted(p, cuts, "left") / p.size
    shares = 1 - np.searchsorted(u, cuts, "left") / u.size
    error = 2 * np.sqrt(np.maximum(shares * (1 - shares), 1 / u.size) / u.size) / above + 2 * shares * np.sqrt(np.maximum(above * (1 - above), 1 / p.size) / p.size) / above**2
    best = int((shares / above + error).argmin())
    return float(np.clip(shares[best] / above[best], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, trusted: Column, label_col: str = "quality", most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Model:
    """A model from trusted positives and unlabelled rows.

    The sample is bounded by ``most_docs`` and ``most_chars`` for each of the two. The class prior is that of the
    unlabelled rows (:func:`estimated_prior`); labels of 0 are used for nothing. Unlabelled rows are those whose id has no label, by the hash of their ids; where
    all have one, the rows that may not be learned from are taken as text, without their labels.
    """
    texts, y = training_rows(docs, labels, trusted, label_col, most_docs, most_chars)
    rows = need(docs, doc_id="doc_id", text="text").where("doc_id IS NOT NULL")
    learned = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    marked = rows.select("doc_id").join(learned, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("label"))
    other, _ = training_rows(docs, marked, F.lit(True), "label", most_docs, most_chars)
    if not other:
        other, _ = training_rows(docs, labels, ~trusted, label_col, most_docs, most_chars)
    empty = np.zeros((0, features("").size))
    good = [features(t) for t, v in zip(texts, y.tolist(), strict=True) if v == 1]
    good, open_ = np.array(good) if good else empty, np.array([features(t) for t in other]) if other else empty
    return train(good, open_, estimated_prior(good, open_))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for every row of ``docs``, from whole texts.

    Null text is as empty text, which has features of its own and so a score; repeated rows are scored alike.
    """
    rows = need(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = model.scores(np.array([features(t.as_py()) for t in batch["text"]]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
