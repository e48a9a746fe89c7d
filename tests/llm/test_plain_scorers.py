"""The classifiers' scores by plain loops, over texts longer than a piece too, and the
pipeline's rows against brute force of each stage."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from sieve.llm import common, decontaminate, mixing, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def texts():
    rng = random.Random(5)
    words = ["the", "a", "Ébène", "x", "thing", "🙂", "re-run", "ok!"]
    out = ["", " \t\n", "a", "a a a", "é", "one two", "ab\x0bcd  ef"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(20)]
    return out + [" ".join(rng.choices(words, k=9_000))]


def plain_quality(text, model):
    logits = model.bucket_logits()
    words = re.split(rb"[\x20\x09-\x0D]+", text.encode())
    words = [w for w in words if w]
    found = []
    for i, w in enumerate(words):
        found.append(crc32(w) % quality.BUCKETS)
        if i and words[i - 1] == w:
            found.append(quality.REPEAT)
        led = b" " + w + b" "
        for n in range(2, quality.NGRAMS + 1):
            for at in range(len(led) - n + 1):
                h = led[at]
                for c in led[at + 1:at + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF
                found.append(h >> (32 - quality.BUCKET_BITS))
    return sigmoid(model.bucket_bias() + (sum(float(logits[b]) for b in found) / len(found) if found else 0.0))


def test_quality_by_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality.SubwordModel(rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32), rng.normal(size=(quality.DIM, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    logits, bias = model.bucket_logits(), model.bucket_bias()
    plain = [plain_quality(t, model) for t in texts()]
    assert [quality.score_text(t, logits, bias) for t in texts()] == pytest.approx(plain, abs=1e-9)
    assert quality.score_text(None, logits, bias) == plain[0]
    monkeypatch.setattr(quality, "pieces", lambda data: common.pieces(data, 64))             # carries between pieces
    assert [quality.score_text(t, logits, bias) for t in texts()] == pytest.approx(plain, abs=1e-9)


def plain_toxicity(text, m):
    words = toxicity.words_of((text or "").encode())
    rows = [m.vectors[list(toxicity._hash(w))].astype(np.float64).sum(0) for w in words]
    best = []
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            sums = [sum(float(rows[p + j] @ m.filters[:, toxicity.BLOCKS[w, j].start + f].astype(np.float64)) for j in range(w) if p + j < len(rows)) for p in range(len(rows))]
            best.append(max(sums, default=0.0))
    raw = np.array(best) + m.shift
    return sigmoid(float(np.where(raw > 0, raw, toxicity.SLOPE * raw) @ m.output) + m.bias)


def test_toxicity_by_plain_loops(monkeypatch):
    rng = np.random.default_rng(2)
    total = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.ConvModel(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, len(toxicity.BLOCKS) * toxicity.FILTERS)).astype(np.float32),
                           rng.normal(size=total).astype(np.float32), rng.normal(size=total).astype(np.float32), 0.3)
    some = [t[:2_000] for t in texts()]
    plain = [plain_toxicity(t, m) for t in some]
    assert [toxicity._Scorer(m).score(t) for t in some] == pytest.approx(plain, abs=1e-3)
    monkeypatch.setattr(toxicity, "pieces", lambda data: common.pieces(data, 50))
    monkeypatch.setattr(toxicity, "STEP_WORDS", 12)                                          # windows over steps of a long text
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 16)
    assert [toxicity._Scorer(m).score(t) for t in some] == pytest.approx(plain, abs=1e-3)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def near_copies(texts):
    """The smallest id of each component of fingerprints within three bits."""
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    prints, root = {d: fingerprint(t) for d, t in texts.items()}, {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            least = min(root[b] for b in texts if (prints[a] ^ prints[b]).bit_count() <= 3)
            changed |= least < root[a]
            root[a] = least
    return root


def leaking(texts, items):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    holders, own = defaultdict(set), {i: grams(t) for i, t in items.items()}
    for i, gs in own.items():
        for g in gs:
            holders[g].add(i)
    out = set()
    for d, t in texts.items():
        a = grams(t)
        for i in set().union(*(holders[g] for g in set(a) if g in holders), set()):
            m, c = len(own[i]), Counter(own[i])
            windows = (Counter(a[s:s + m]) for s in range(max(1, len(a) - m + 1)))
            if any(sum((c & w).values()) >= decontaminate.SIMILARITY * sum((c | w).values()) - 1e-9 for w in windows):
                out.add(d)
    return out


def redacted(text):
    spans = sorted((m.start(), place, m.end(), r.kind) for place, r in enumerate(secrets.RULES) for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least)
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_rows_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, "quality", common.crc_mod(F.col("doc_id"), 5) != 0)
    logits, bias = model.bucket_logits(), model.bucket_bias()
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {d: r["text"] for d, r in rows.items() if quality.score_text(r["text"], logits, bias) >= 0.3}
    root = near_copies(kept)
    kept = {d: t for d, t in kept.items() if root[d] == d}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaked = leaking(kept, items)
    kept = {d: redacted(t) for d, t in kept.items() if d not in leaked}
    assert leaked and len(kept) < len(rows)
    got = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in kept.items()}
    assert {d: r["size"] for d, r in got.items()} == size
    source = Counter()
    for d, n in size.items():
        source[rows[d]["source"]] += n
    wanted = mixing.targets(sorted(source.items(), key=lambda x: x[0].encode()))
    taken = Counter()
    for d, r in got.items():
        s = rows[d]["source"]
        assert r["source_size"] == source[s] and r["target"] == pytest.approx(wanted[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] + 32 for s in source)


def test_toxicity_trains_on_every_labelled_row(spark):
    n = 8_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.sha1(F.col("id").cast("string"))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    m = toxicity.train(docs, labels, "toxic", F.lit(True), rows=1_000)
    start = toxicity._Training.start(np.random.default_rng(1)).model.vectors
    words = [toxicity._hash(r["text"].encode())[0] for r in docs.collect()]
    moved = (m.vectors != start).any(1)
    assert sum(bool(moved[k]) for k in words) >= 0.78 * n           # four in five take steps, the others set thresholds


def test_toxicity_long_texts_train_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = toxicity._Training.start(rng).model
    ids = rng.integers(0, toxicity.BUCKETS, (500, 2)).astype(np.int16)
    best, at = toxicity._peaks(m, ids)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 7)
    again, place = toxicity._peaks(m, ids)
    assert again == pytest.approx(best, abs=1e-5) and place.tolist() == at.tolist()
    docs = spark.createDataFrame([(i, "bad word " * 30 if i % 2 else "fine word " * 30) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, "toxic", F.lit(True), chars=100)               # each text is longer than that
    assert (m.vectors != toxicity._Training.start(np.random.default_rng(1)).model.vectors).any()


def test_toxicity_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"some words {i % 7} {'nasty' if i % 3 == 0 else 'nice'} end", "en") for i in range(90)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    one, two = (toxicity.train(docs.repartition(n), labels.repartition(n), "toxic", F.lit(True), rows=20) for n in (1, 5))
    assert (one.vectors == two.vectors).all() and one.bias == two.bias and one.thresholds == two.thresholds


def plain_thresholds(rows):
    out = {}
    for lang in {r[0] for r in rows}:
        own = sorted((s, y) for x, s, y in rows if x == lang)
        toxic = sum(y for _, y in own)
        if not 0 < toxic < len(own):
            continue
        cuts = [(-1.0, 0.0, -own[0][0], own[0][0])]
        for k in range(1, len(own)):
            if own[k][0] > own[k - 1][0]:
                f1 = 2 * sum(y for _, y in own[k:]) / (len(own) - k + toxic)
                cuts.append((f1, own[k][0] - own[k - 1][0], -own[k][0], (own[k][0] + own[k - 1][0]) / 2))
        out[lang] = max(cuts)[3]
    return out


def test_toxicity_thresholds_by_plain_loops(spark):
    rng = random.Random(5)
    rows = [(lang, rng.randrange(40) / 40 + 0.2 * y * (lang == "en"), y) for lang in ("en", "de", "") for y in (rng.randrange(2) for _ in range(200))]
    rows += [("one", 0.5, 1), ("one", 0.5, 0), ("clean", 0.1, 0), ("clean", 0.9, 0), ("bad", 0.1, 1)]
    assert toxicity.calibrate(spark.createDataFrame(rows, "lang string, score double, label int")) == pytest.approx(plain_thresholds(rows))
