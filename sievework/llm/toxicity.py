"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Each sentence has a score, the logistic of the summed weights of its words. The document's score is
their noisy-or, one minus the product of what each sentence leaves open. Only documents have labels;
the gradient of the document's likelihood reaches each sentence through the noisy-or, so that the
weights also say which sentence offends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from sievework.llm.common import need, trained_in_task

#: A model has this many weights; words share them by hash.
BUCKETS = 1 << 18
#: Lengths of the beginnings of words that have weights of their own.
PREFIXES = (3, 4, 5, 6)
#: The score from which a document counts as toxic.
THRESHOLD = 0.3

_SENTENCE = re.compile(rb"[.!?\n\r]+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    """Weights by bucket, and the score that a sentence without known words has."""

    weights: np.ndarray
    bias: float


def word_buckets(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings; their weights add up to the word's."""
    text = word.decode("utf-8", "replace")
    parts = {text, *(text[:k] + "~" for k in PREFIXES if len(text) >= k)}
    return [xxhash.xxh3_64_intdigest(p.encode()) % BUCKETS for p in parts]


def sentence_words(text: str | None) -> list[set[bytes]]:
    """The distinct words of each sentence that has any."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    return [ws for s in _SENTENCE.split(low) if (ws := set(_WORD.findall(s)))]


def train(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.3, l1: float = 3e-4) -> Model:
    """Sparse weights for the likelihood of document labels under the noisy-or, by proximal Adagrad.

    The bias starts low, so that the many plain sentences of a long document leave its score low.
    Buckets that fewer than three training documents have keep weight zero. Without labelled
    documents of both kinds there is nothing to learn: weights are zero and the bias gives the rate.
    """
    share = float(np.clip(labels.mean() if labels.size else 0.5, 1e-3, 1 - 1e-3))
    ids: dict[bytes, int] = {}
    word, sent, doc = [], [], []
    for d, text in enumerate(texts):
        for ws in sentence_words(text):
            word.append(np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int32, len(ws)))
            sent.append(len(ws))
            doc.append(d)
    if labels.size == 0 or labels.min() == labels.max() or not doc:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    n = len(doc)
    words, sents, docs = np.concatenate(word), np.repeat(np.arange(n, dtype=np.int32), sent), np.array(doc)
    parts = [word_buckets(w) for w in ids]
    of = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
    bucket = np.concatenate([np.array(p) for p in parts])
    del word, sent, parts
    # documents by bucket, counted once for each word of a document
    pairs = np.unique(docs[sents].astype(np.int64) * len(ids) + words) % len(ids)
    held = np.bincount(bucket, np.bincount(pairs, minlength=len(ids))[of], minlength=BUCKETS) >= 3
    of, bucket = of[held[bucket]], bucket[held[bucket]]
    y = labels.astype(np.float64)
    weights, bias = np.zeros(BUCKETS), -7.0
    square, square_b = np.full(BUCKETS, 1e-6), 1e-6
    # documents of the rarer kind weigh as much together as half of the others
    heavy = np.where(y > 0, max(1.0, 0.5 * (1 - share) / share), 1.0)
    for _ in range(rounds):
        z = np.bincount(sents, np.bincount(of, weights[bucket], minlength=len(ids))[words], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        left = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=y.size)
        whole = np.clip(-np.expm1(left), 1e-9, 1 - 1e-9)
        # d log-likelihood / d z of a sentence: p (y / P - 1)
        g = heavy[docs] * p * (y[docs] / whole[docs] - 1)
        by_word = np.bincount(words, g[sents], minlength=len(ids))
        grad = np.bincount(bucket, by_word[of], minlength=BUCKETS) / y.size
        grad_b = g.sum() / y.size / 20
        square += grad * grad
        square_b += grad_b * grad_b
        step = rate / np.sqrt(square)
        weights += step * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        bias += rate * 0.2 * grad_b / np.sqrt(square_b)
    return Model(weights.astype(np.float32), float(bias))


class Scorer:
    """Scores texts; remembers the weights of words up to a fixed number of them."""

    MOST_WORDS = 200_000

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """Begin and end (in UTF-8 bytes) and score of every sentence that has words."""
        low = (text or "").encode("utf-8", "surrogatepass").lower()
        at = 0
        known = self.known
        for m in [*_SENTENCE.finditer(low), None]:
            end = m.start() if m else len(low)
            if ws := set(_WORD.findall(low, at, end)):
                total = self.model.bias
                for w in ws:
                    v = known.get(w)
                    total += self._add(w) if v is None else v
                yield at, end, 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))
            at = m.end() if m else end

    def _add(self, word: bytes) -> float:
        if len(self.known) >= self.MOST_WORDS:
            self.known.clear()
        v = self.known[word] = float(self.model.weights[word_buckets(word)].sum())
        return v

    def score(self, text: str | None) -> tuple[float, int, int]:
        """The document's score and the span of its worst sentence; no words: 0 and an empty span."""
        left, worst, span = 0.0, -1.0, (0, 0)
        for a, b, p in self.sentences(text):
            left += math.log1p(-min(p, 1 - 1e-9))
            if p > worst:
                worst, span = p, (a, b)
        return -math.expm1(left), *span


def fit(docs: DataFrame, labels: DataFrame, trusted: Column, label_col: str = "toxic") -> Model:
    """A model from documents whose label may be used (``trusted``, over ``doc_id``)."""
    return trained_in_task(docs, labels, trusted, label_col, _of_distinct)


def _of_distinct(texts: list[str], labels: np.ndarray) -> Model:
    # copies of one text would count as independent evidence for its words
    first = list({t: i for i, t in reversed(list(enumerate(texts)))}.values())
    return train([texts[i] for i in first], labels[first])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and the worst sentence's text for every row of ``docs``.

    Null, empty and wordless texts score 0 and have an empty sentence; repeated rows are scored alike.
    """
    rows = need(docs, doc_id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = []
            for t in batch["text"]:
                text = t.as_py()
                p, a, b = scorer.score(text)
                found.append((p, int(p >= threshold), (text or "").encode("utf-8", "surrogatepass")[a:b].decode("utf-8", "replace").strip()))
            p, yes, worst = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p, pa.float64()), pa.array(yes, pa.int32()), pa.array(worst, pa.string())], names=["doc_id", "score", "predicted", "worst_sentence"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int, worst_sentence string")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; null and empty texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            keep = [scorer.score(t.as_py())[0] < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
