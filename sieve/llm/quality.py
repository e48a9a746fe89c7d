"""Quality classifier: supervised subword embeddings.

Every hashed whole word and every hashed character n-gram of a word has a
learned vector, and so has the word bigram that repeats a word. A document is
the mean of the vectors of all its features, and a softmax layer turns that
into class probabilities. Vectors and softmax are
trained together by stochastic gradient descent in NumPy, on the
driver, over a bounded sample of labelled rows. Scoring reads every whole text
in Arrow batches on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import pieces, training_rows

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 8
NGRAMS = 4            # character n-grams of 2 up to this many bytes, word ends included
EPOCHS = 6
RATE = 2.0
TRAIN_ROWS = 5000
TRAIN_CHARS = 40_000_000
REPEAT = crc32(b"\x00repeat") % BUCKETS


def _features(piece: bytes, before: int | None) -> tuple[np.ndarray, int | None]:
    """Buckets of all features of a piece of text, and its last word's hash.

    ``before`` is the hash of the word in front of the piece. The n-grams are
    rolled over the words joined by single spaces; one with a space inside,
    rather than at its ends, spans two words and is left out.
    """
    words = piece.split()
    if not words:
        return np.empty(0, np.int64), before
    hashes = np.fromiter(map(crc32, words), np.uint32, len(words))
    repeats = int((hashes[1:] == hashes[:-1]).sum()) + (before == int(hashes[0]))
    out = [hashes % np.uint32(BUCKETS), np.full(repeats, REPEAT, np.uint32)]
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    rolled, inner, solid = data.astype(np.uint32), np.ones(len(data), bool), data != 32
    for n in range(2, NGRAMS + 1):
        if len(data) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + data[n - 1:]
        inner = inner[:-1] & solid[n - 2:-1] if n > 2 else inner[:-1]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
        out.append((mixed >> np.uint32(32 - BUCKET_BITS))[inner])
    return np.concatenate(out), int(hashes[-1])


def text_features(text: str | None) -> Iterator[np.ndarray]:
    """The feature buckets of a whole text, piece by piece (null: as empty)."""
    before = None
    for piece in pieces((text or "").encode()):
        buckets, before = _features(piece, before)
        yield buckets


def document_bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares, which add up to 1."""
    counts = np.zeros(BUCKETS, np.int64)
    for buckets in text_features(text):
        counts += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used.astype(np.int32), (counts[used] / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class SubwordModel:
    vectors: np.ndarray   # buckets x dim
    output: np.ndarray    # dim x classes
    bias: np.ndarray      # classes

    def bucket_logits(self) -> np.ndarray:
        """Of two classes the softmax is the sigmoid of the logits' difference,
        and that difference is linear in the document's mean vector: each
        bucket's share of it is one number."""
        return (self.vectors.astype(np.float64) @ (self.output[:, 1] - self.output[:, 0]).astype(np.float64))

    def bucket_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 1,
               epochs: int = EPOCHS, rate: float = RATE) -> SubwordModel:
    """One gradient step per document, in a seeded order, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            buckets, weights = bags[k]
            hidden = weights @ vectors[buckets]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias -= np.float32(0.1) * step * p
            vectors[buckets] -= step * weights[:, None] * back
            done += 1
    return SubwordModel(vectors, output, bias)


def score_text(text: str | None, logits: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for buckets in text_features(text):
        total += float(logits[buckets].sum())
        n += len(buckets)
    x = bias + (total / n if n else 0.0)
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column,
          rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> SubwordModel:
    """Fit on at most ``rows`` labelled documents of at most ``chars``
    characters; their bags are made on the executors. Without any labelled row
    the model scores 0.5 everywhere."""
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [document_bag(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "buckets": [x for x, _ in made], "weights": [w for _, w in made]})

    got = (training_rows(docs, labels, label, usable, rows, chars).repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
           .mapInPandas(bags, "doc_id long, label int, buckets array<int>, weights array<float>").toPandas().sort_values("doc_id"))
    return train_bags([(np.asarray(b, np.int64), np.asarray(w, np.float32)) for b, w in zip(got["buckets"], got["weights"])], got["label"].tolist())


def score(docs: DataFrame, model: SubwordModel, text: str = "text") -> Column:
    """Column of the probability of class 1 for every whole text (null: as
    empty; empty: the softmax of the bias alone)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_logits(), model.bucket_bias()))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logits, bias = shared.value
        for texts in batches:
            yield pd.Series([score_text(t, logits, bias) for t in texts], dtype="float64")

    return scored(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, label: str, usable: Column, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int). Extra columns
    stay; columns of those two names are replaced. Repeated rows are scored
    alike, an empty table gives an empty table. Null and empty texts, and such
    of white space, have no features and score the softmax's bias; null ids
    are scored like others and never train. Texts of any length are scored
    whole, a piece of a mebibyte at a time; equal scores have no order, as each
    row is judged by itself. Without labelled rows of both classes the model is
    what its start or its one class makes of it, and a warning says so."""
    model = train(docs, labels, label, usable)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, score(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
