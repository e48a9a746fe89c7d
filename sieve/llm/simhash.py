"""SimHash near-duplicates by anchor points of a covering code.

Two 64-bit fingerprints with at most three differing bits differ in at most one
bit in one of their two 32-bit halves. The anchors of a half are the words whose
low 31 bits are a codeword of the binary Hamming code of length 31 (any top
bit): every half lies within one bit of exactly one anchor, its home. Each
distinct fingerprint is sent to its home and, as a visitor, to every anchor
within two bits (covering radius plus the half's threshold). A pair that agrees
on a half up to one bit meets at the home of either, so comparing whole
fingerprints per anchor loses no pair. Fingerprints rather than rows are
compared, so copies of a text cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sieve.llm.common import pieces
from sieve.session import ensure_checkpoint_dir

SEED = 42
CHUNK = 1 << 14
LOW31 = np.uint64((1 << 31) - 1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the
    shingles' hashes. Fewer words than ``shingle``: their whole sequence is the
    only shingle; none (or null): zero."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    join = b" ".join

    def add(words: list[bytes]) -> int:
        for i in range(0, len(words) - shingle + 1, CHUNK):
            part = words[i:i + CHUNK + shingle - 1]
            grams = map(join, zip(*(part[j:] for j in range(shingle))))
            hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
            ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return max(0, len(words) - shingle + 1)

    for piece in pieces((text or "").encode()):
        held += piece.lower().split()          # of bytes: ASCII letters and ASCII white space only
        if len(held) >= CHUNK:
            n += add(held)
            held = held[len(held) - shingle + 1:]
    n += add(held)
    if not n:
        return xxh64_intdigest(join(held), SEED) if held else 0
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> Column:
    """Column of the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return made(F.col(text))


# Bit p (from 0) of a half's low 31 bits stands for p + 1 in the Hamming code's
# check matrix: the syndrome is the xor of the numbers of the set bits, and a
# word with syndrome s is one flip, of bit s - 1, away from its codeword.

def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint64)
    for check in range(5):
        mask = np.uint64(sum(1 << p for p in range(31) if (p + 1) >> check & 1))
        out |= (np.bitwise_count(half & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(check)
    return out


def _flip(half: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """With bit number - 1 flipped; number 0 flips nothing."""
    number = np.asarray(number, np.uint64)
    return half ^ np.where(number > 0, np.uint64(1) << (np.maximum(number, 1) - np.uint64(1)), np.uint64(0)).astype(np.uint64)


def homes(half: np.ndarray) -> np.ndarray:
    """The one anchor within one bit of each half."""
    return _flip(half, _syndrome(half))


def visited(half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, anchor) arrays of every anchor within two bits of each half."""
    syndrome, all_rows = _syndrome(half), np.arange(len(half))
    top, home = half ^ np.uint64(1 << 31), _flip(half, syndrome)
    # One of the two flips may be the free top bit, if the other mends the rest.
    out = [(all_rows, home), (all_rows, _flip(top, syndrome))]
    # Two flips a < b in the low bits reach a codeword where a xor b is the syndrome.
    for a in range(1, 32):
        b = syndrome ^ np.uint64(a)
        rows = np.flatnonzero((syndrome > 0) & (b > a))
        out.append((rows, _flip(_flip(half[rows], a), b[rows])))
    return out


def _postings(batches: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = batch["fp"].to_numpy(np.int64)
        for side in (0, 1):
            half = (fp.view(np.uint64) >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
            sent = [(np.arange(len(fp)), homes(half))] if home else visited(half)
            for rows, anchor in sent:
                yield pd.DataFrame({"anchor": anchor.view(np.int64) + (side << 32), "fp": fp[rows]})


def linked(distinct: DataFrame, most: int = 3) -> DataFrame:
    """``a < b``: pairs of distinct fingerprints (column ``fp``) that differ in
    at most ``most`` bits; the anchors guarantee all of them up to three."""
    if most > 3:
        raise ValueError("the anchors cover at most three differing bits")
    at_home = distinct.mapInPandas(lambda it: _postings(it, True), "anchor long, fp long").withColumnRenamed("fp", "a")
    visiting = distinct.mapInPandas(lambda it: _postings(it, False), "anchor long, fp long").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    # A fingerprint visits some 34 anchors, but Spark counts as many rows out of mapInPandas as in and would broadcast them.
    visiting = visiting.hint("merge")
    return at_home.join(visiting, (at_home["anchor"] == visiting["anchor"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of the edges (``a``, ``b``) with the smallest
    node it can reach, by alternating large-star and small-star steps; both
    keep a node's neighbours in groups by hash and aggregate before they join.
    Each round's edges go to the checkpoint folder."""
    ensure_checkpoint_dir(edges.sparkSession)
    least, before = F.least("a", "b"), None
    edges = edges.select(F.greatest("a", "b").alias("u"), least.alias("v")).where("u <> v").distinct().checkpoint()
    while True:
        # large star: neighbours above a node move to the smallest node around it
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours move to the lowest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u")
        small = (kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = small.checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if state == before:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
        before = state


def _grouped(docs: DataFrame, shingle: int, most: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (k, h: hash of the text, fp), and (fp, root: one fingerprint of its
    component) of all distinct fingerprints."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), fingerprints(docs, shingle, text).alias("fp")).checkpoint()
    distinct = rows.select("fp").distinct()
    roots = components(linked(distinct, most)).withColumnRenamed("node", "fp")
    return rows, distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")).checkpoint()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key`` with ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest key of all rows reachable over links of at
    most ``most`` differing bits.

    Null and empty texts have fingerprint zero and link like any other; null
    keys name no component, unless it has no other key and its id is null;
    repeated rows come out as often as they went in; an empty table gives an
    empty table; columns besides key and text are not read.
    """
    rows, roots = _grouped(docs, shingle, most, key, text)
    least = rows.groupBy("fp").agg(F.min("k").alias("least")).join(roots, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    label = least.join(named, "root").select("fp", "component_id")
    return rows.join(label, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest
    key (null last), of equal keys the smallest hash of the text, of repeated
    rows any one."""
    rows, roots = _grouped(docs, shingle, most, key, text)
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h"))
    chosen = (rows.groupBy("fp").agg(first.alias("first")).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
              .select(F.coalesce(F.col("first.k").cast("string"), F.lit("")).alias("__k"), F.col("first.none").alias("__n"), F.col("first.h").alias("__h")).distinct())
    named = docs.withColumns({"__k": F.coalesce(F.col(key).cast("string"), F.lit("")), "__n": F.col(key).isNull(), "__h": F.xxhash64(F.col(text))})
    return named.join(chosen, ["__k", "__n", "__h"], "left_semi").dropDuplicates(["__k", "__n", "__h"]).select(*docs.columns)
