"""Toxicity: a convolutional text classifier.

Words (ASCII letters lower-cased, split at other ASCII bytes) have hashed
embeddings, the sum of the vectors of the whole word and of its first five
bytes. Filters of several widths slide over the word sequence, each keeps its
largest response in the whole text, and a logistic layer reads these maxima.
Every labelled row counts: the rows are dealt into shards of bounded size, each
round every shard takes its stochastic gradient steps from the same model, and
Spark averages what the shards have changed. One labelled row in CALIBRATE is
left out of that and sets a threshold per language.
"""

from __future__ import annotations

import copy
import math
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import WORD_TABLE, pieces
from sieve.session import ensure_checkpoint_dir

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 4           # of each width
EPOCHS = 3
INIT = 0.02           # small: unseen words must not outshout learned ones
RATE = 0.2
ENOUGH = 0.01         # texts with a smaller error make no step
SLOPE = 0.1           # of the activation below zero
MOST_WEIGHT = 10
PREFIX = 5            # bytes
SHARD_ROWS = 4000     # of a shard, about
SHARD_CHARS = 32_000_000
CALIBRATE = 5         # one row in so many sets thresholds instead of weights
CACHE_WORDS = 60_000
STEP_WORDS = 1 << 16
#: Columns of a word's response table: a block of FILTERS for each width and offset.
BLOCKS = {(w, j): slice(k * FILTERS, (k + 1) * FILTERS) for k, (w, j) in enumerate((w, j) for w in WIDTHS for j in range(w))}
TOTAL = len(WIDTHS) * FILTERS
#: What training changes besides the word vectors, each with its sums of squared gradients.
DENSE = {"filters": (DIM, len(BLOCKS) * FILTERS), "shift": (TOTAL,), "output": (TOTAL,), "bias": (1,),
         "seen_f": (DIM, len(BLOCKS) * FILTERS), "seen_s": (TOTAL,), "seen_o": (TOTAL,)}
GRID = 2.0 ** 24      # shards' values are summed as multiples of 1 / GRID, so that the order does not matter


@lru_cache(CACHE_WORDS)
def _hash(word: bytes) -> tuple[int, int]:
    return crc32(word) % BUCKETS, crc32(b"\x00" + word[:PREFIX]) % BUCKETS


def words_of(piece: bytes) -> list[bytes]:
    return piece.translate(WORD_TABLE).split()


def text_ids(text: str | None) -> np.ndarray:
    """Two buckets for each word of a whole text, one row a word."""
    out = [np.array([_hash(w) for w in words_of(piece)], np.int16).reshape(-1, 2) for piece in pieces((text or "").encode())]
    return np.concatenate(out) if out else np.empty((0, 2), np.int16)


@dataclass
class ConvModel:
    vectors: np.ndarray       # buckets x dim
    filters: np.ndarray       # dim x blocks, a column block per width and offset
    shift: np.ndarray         # per filter
    output: np.ndarray        # per filter
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def _responses(table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per width the filters' responses at every word; behind the end of the
    text a window reads zero vectors."""
    n = len(table)
    for k, w in enumerate(WIDTHS):
        out = table[:, BLOCKS[w, 0]].copy()
        for j in range(1, min(w, n)):
            out[:n - j] += table[j:, BLOCKS[w, j]]
        yield k, out


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.float32(SLOPE) * x)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _stored(ids: np.ndarray) -> bytes:
    return zlib.compress(ids.tobytes(), 1)


def _loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int16).reshape(-1, 2)


def _peaks(m: ConvModel, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in a whole text (0 without words) and its
    first place there, in steps that overlap by the widest window."""
    best, at = np.full(TOTAL, -np.inf, np.float32), np.zeros(TOTAL, np.int64)
    if not len(ids):
        return np.zeros(TOTAL, np.float32), at
    for start in range(0, len(ids), STEP_WORDS):
        part = ids[start:start + STEP_WORDS + max(WIDTHS) - 1]
        for k, out in _responses((m.vectors[part[:, 0]] + m.vectors[part[:, 1]]) @ m.filters):
            out = out[:STEP_WORDS]
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            first = out.argmax(0)
            top = out[first, np.arange(FILTERS)]
            at[own] = np.where(top > best[own], first + start, at[own])
            best[own] = np.maximum(best[own], top)
    return best, at


@dataclass
class _Training:
    """A model and the sums of squared gradients that set AdaGrad's steps: every
    filter weight, and every word vector as a whole, steps by its own past."""
    model: ConvModel
    seen_v: np.ndarray
    seen_f: np.ndarray
    seen_s: np.ndarray
    seen_o: np.ndarray

    @classmethod
    def start(cls, rng: np.random.Generator) -> _Training:
        m = ConvModel(rng.normal(0, INIT, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, DENSE["filters"]).astype(np.float32),
                      np.zeros(TOTAL, np.float32), rng.normal(0, 0.3, TOTAL).astype(np.float32))
        return cls(m, np.full(BUCKETS, 1e-4, np.float32), *(np.full(DENSE[k], 1e-4, np.float32) for k in ("seen_f", "seen_s", "seen_o")))

    def table(self) -> np.ndarray:
        """All numbers in rows of DIM + 1: a row per bucket, then the others."""
        m = self.model
        flat = np.concatenate([np.ravel(x).astype(np.float64) for x in (m.filters, m.shift, m.output, m.bias, self.seen_f, self.seen_s, self.seen_o)])
        flat = np.pad(flat, (0, -len(flat) % (DIM + 1))).reshape(-1, DIM + 1)
        return np.vstack([np.column_stack([m.vectors, self.seen_v]).astype(np.float64), flat])

    @classmethod
    def of_table(cls, table: np.ndarray) -> _Training:
        flat, parts = table[BUCKETS:].ravel(), {}
        for name, shape in DENSE.items():
            parts[name], flat = flat[:math.prod(shape)].reshape(shape), flat[math.prod(shape):]
        bias = float(parts.pop("bias")[0])
        parts = {k: x.astype(np.float32) for k, x in parts.items()}
        m = ConvModel(table[:BUCKETS, :DIM].astype(np.float32), parts.pop("filters"), parts.pop("shift"), parts.pop("output"), bias)
        return cls(m, table[:BUCKETS, DIM].astype(np.float32), **parts)

    def step(self, ids: np.ndarray, label: int, weight: tuple[np.float32, np.float32], rate: float) -> None:
        """One gradient step, its size set by AdaGrad."""
        m = self.model
        best, at = _peaks(m, ids)
        raw = best + m.shift
        pooled = _leaky(raw)
        error = np.float32(_sigmoid(float(pooled @ m.output) + m.bias) - label) * weight[label]
        if abs(error) < ENOUGH:
            return
        back = error * m.output * np.where(raw > 0, np.float32(1), np.float32(SLOPE))
        grad = error * pooled
        self.seen_o += grad * grad
        m.output -= rate * grad / np.sqrt(self.seen_o)
        m.bias -= rate * 0.1 * float(error)
        self.seen_s += back * back
        m.shift -= rate * back / np.sqrt(self.seen_s)
        if not len(ids):
            return
        toward: dict[int, np.ndarray] = {}
        for f in range(TOTAL):
            w, column = WIDTHS[f // FILTERS], f % FILTERS
            for p in range(at[f], min(at[f] + w, len(ids))):
                c = BLOCKS[w, p - at[f]].start + column
                for bucket in ids[p]:
                    toward[bucket] = toward.get(bucket, 0) + back[f] * m.filters[:, c]
                grad = back[f] * (m.vectors[ids[p, 0]] + m.vectors[ids[p, 1]])
                self.seen_f[:, c] += grad * grad
                m.filters[:, c] -= rate * grad / np.sqrt(self.seen_f[:, c])
        for bucket, grad in toward.items():
            self.seen_v[bucket] += grad @ grad / DIM
            m.vectors[bucket] -= rate * grad / np.sqrt(self.seen_v[bucket])


def _by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each shard, of batches in which they follow each other."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for shard, part in b.groupby("shard", sort=False):
            if held and held[0]["shard"].iat[0] != shard:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


ROW_COLUMNS = [f"v{i}" for i in range(DIM + 1)]


def _round(shared, turn: int, weight: tuple[np.float32, np.float32], rate: float, alone: bool) -> Callable:
    """Function of a task: each shard's steps from the shared model, one per
    text in a seeded order, and the rows of ``_Training.table`` it has changed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_shard(batches):
            rng, before = copy.deepcopy(shared.value)
            for _ in range(turn + 1):
                order = rng.permutation(len(part))
            state = _Training.of_table(before)
            texts, y = [_loaded(x) for x in part["ids"]], part["label"].tolist()
            for k in order:
                state.step(texts[k], y[k], weight, rate)
            after = state.table()
            rows = np.flatnonzero((after != before).any(1) | (np.arange(len(after)) >= BUCKETS))
            yield pd.DataFrame(after[rows] if alone else np.round(after[rows] * GRID) / GRID, columns=ROW_COLUMNS).assign(row=rows)

    return run


class _Scorer:
    """Responses of known words are kept as rows of one table; a full table
    starts anew, which loses only time (a step never has more words than it)."""

    def __init__(self, m: ConvModel):
        self.m, self.rows = m, {}
        self.table = np.zeros((CACHE_WORDS, len(BLOCKS) * FILTERS), np.float32)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows
        if new := set(words).difference(rows):
            if len(rows) + len(new) > CACHE_WORDS:
                rows.clear()
                new = set(words)
            first = len(rows)
            ids = np.array([_hash(w) for w in new], np.int64)
            rows.update(zip(new, range(first, first + len(new))))
            self.table[first:first + len(new)] = (self.m.vectors[ids[:, 0]] + self.m.vectors[ids[:, 1]]) @ self.m.filters
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def score(self, text: str | None) -> float:
        """Of a whole text, in steps that overlap by the widest window."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        held: list[bytes] = []
        for piece in pieces((text or "").encode()):
            held += words_of(piece)
            while len(held) > STEP_WORDS // 2:
                part, held = held[:STEP_WORDS // 2], held[STEP_WORDS // 2 - max(WIDTHS) + 1:]
                self._raise(best, part, last=False)
        self._raise(best, held, last=True)
        pooled = _leaky(np.where(np.isinf(best), 0, best) + self.m.shift)
        return _sigmoid(float(pooled @ self.m.output) + self.m.bias)

    def _raise(self, best: np.ndarray, words: list[bytes], last: bool) -> None:
        if not words:
            return
        for k, out in _responses(self.lookup(words)):
            if not last:
                out = out[:len(out) - WIDTHS[k] + 1]
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            np.maximum(best[own], out.max(0), out=best[own])


def calibrate(scored: DataFrame) -> dict[str, float]:
    """Of rows ``lang, score, label``, per language the middle of the widest gap
    between neighbouring scores among the cuts with the best F1 (equal gaps: the
    lowest); languages without both classes have none. Rows are dealt by range,
    so that a language may lie in several partitions, and one row per language
    that holds both classes reaches the driver."""
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    dealt = points.repartitionByRange(n, "lang", "score").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy("lang", "part").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.max("score").alias("last"))
    whole = Window.partitionBy("lang")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("lang", "part", F.sum("n").over(whole).alias("rows"), F.sum("y").over(whole).alias("toxic"), F.sum("n").over(earlier).alias("n0"),
                         F.sum("y").over(earlier).alias("y0"), F.max("last").over(earlier).alias("last"))
    lower = Window.partitionBy("lang", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    cuts = (dealt.withColumn("n1", F.sum("n").over(lower)).withColumn("y1", F.sum("y").over(lower)).withColumn("below", F.max("score").over(lower))
            .join(parts, ["lang", "part"]).where((F.col("toxic") > 0) & (F.col("toxic") < F.col("rows")))
            .withColumn("below", F.coalesce("below", "last"))
            .withColumn("under", F.coalesce("n0", none) + F.coalesce("n1", none))
            .withColumn("hits", F.col("toxic") - F.coalesce("y0", none) - F.coalesce("y1", none)))
    f1 = F.when(F.col("under") > 0, 2 * F.col("hits") / (F.col("rows") - F.col("under") + F.col("toxic"))).otherwise(F.lit(-1.0))
    below = F.coalesce("below", "score")                            # under the lowest score there is no cut
    best = cuts.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), (F.col("score") - below).alias("gap"), (-F.col("score")).alias("low"),
                                                   ((F.col("score") + below) / 2).alias("cut"))).alias("best"))
    return {r["lang"]: r["cut"] for r in best.select("lang", "best.cut").orderBy("lang").collect()}


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SHARD_ROWS, chars: int = SHARD_CHARS,
          seed: int = 1, epochs: int = EPOCHS, rate: float = RATE) -> ConvModel:
    """Fit on every labelled document; one in CALIBRATE of each shard sets the
    thresholds by language. ``usable`` filters on ``doc_id``; null labels and
    ids take no part, of repeated ids the largest label and the smallest text
    and language count. Shards are dealt by a hash of the id and hold about
    ``rows`` documents of ``chars`` characters, which one task keeps as two
    buckets a word; a longer text is in its shard whole. A round averages each
    bucket over the shards that changed it, so what reaches the driver is
    bounded by the model. Without any labelled row the model scores an untrained
    0.5 or so; warns if the rows hold fewer than two classes."""
    ensure_checkpoint_dir(docs.sparkSession)
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    own = docs.where(F.col("doc_id").isNotNull() & usable).select("doc_id", lang.alias("lang"), "text")
    sizes = own.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).join(marked, "doc_id")
    found = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"), F.countDistinct("label").alias("classes")).first()
    if found["classes"] < 2:
        warnings.warn(f"the {found['rows']} training rows do not hold both classes of {label}", stacklevel=2)
    shards = max(1, -(-found["rows"] // rows), -(-found["chars"] // chars))

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([_stored(text_ids(t)) for t in texts], dtype=object)

    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id"))
    dealt = (own.join(marked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
             .select("doc_id", "label", "lang", ids("text").alias("ids"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
             .repartition(shards, "shard").withColumn("held", place % CALIBRATE == 1)
             .sortWithinPartitions("shard", "doc_id").persist(StorageLevel.DISK_ONLY))
    try:
        steps = dealt.where("not held").agg(F.count("*").alias("n"), F.sum("label").alias("y")).first()
        share = min(max((steps["y"] or 0) / max(1, steps["n"]), 1 / MOST_WEIGHT), 0.5)
        weight = (np.float32(1), np.float32(0.5 / share))    # the rarer class steps further
        rng = np.random.default_rng(seed)
        table = _Training.start(rng).table()
        for turn in range(epochs):
            shared = docs.sparkSession.sparkContext.broadcast((rng, table))
            changed = (dealt.where("not held").select("shard", "label", "ids")
                       .mapInPandas(_round(shared, turn, weight, rate, shards == 1), ", ".join(f"{c} double" for c in ROW_COLUMNS) + ", row int")
                       .groupBy("row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ROW_COLUMNS]).toPandas())
            table = table.copy()
            table[changed["row"].to_numpy(np.int64)] = changed[ROW_COLUMNS].to_numpy(np.float64) / changed[["n"]].to_numpy(np.float64)
            shared.unpersist()
        m = _Training.of_table(table).model
        shared = docs.sparkSession.sparkContext.broadcast(m)

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            m = shared.value
            best = [_peaks(m, _loaded(x))[0] for x in texts]
            return pd.Series([_sigmoid(float(_leaky(b + m.shift) @ m.output) + m.bias) for b in best], dtype="float64")

        m.thresholds = calibrate(dealt.where("held").select("lang", scored("ids").alias("score"), "label"))
        shared.unpersist()
    finally:
        dealt.unpersist()
    return m


def score(docs: DataFrame, model: ConvModel, text: str = "text") -> Column:
    """Column of the probability of class 1 for every whole text (null: as
    empty; empty: what the logistic layer gives for zero responses)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return scored(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, label: str, usable: Column, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (double), ``predicted`` (int, at the given
    threshold), ``lang_threshold`` and ``flagged`` (boolean, at the threshold
    calibrated for the row's language; unknown or null languages take the given
    one). The language chooses a threshold and never enters the score. Extra
    columns stay, columns of these four names are replaced; repeated rows are
    scored alike, an empty table gives an empty table. Null and empty texts, and
    such without words, score what the logistic layer gives for zero responses;
    null ids are scored like others and never train. Texts of any length are
    scored whole, in steps that overlap by the widest filter; of equal responses
    one counts."""
    model = train(docs, labels, label, usable)
    made = ("score", "predicted", "lang_threshold", "flagged")
    out = docs.select(*[c for c in docs.columns if c not in made], score(docs, model).alias("score"))
    cuts = F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv]) if model.thresholds else None
    cut = F.coalesce(F.try_element_at(cuts, F.coalesce("lang", F.lit(""))), F.lit(threshold)) if cuts is not None and "lang" in docs.columns else F.lit(threshold)
    return (out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("lang_threshold", cut.cast("double"))
            .withColumn("flagged", F.col("score") >= F.col("lang_threshold")))
