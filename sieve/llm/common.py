"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NON_WORD = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: ASCII upper case to lower case, every ASCII byte that is neither a letter nor a digit to a space.
WORD_TABLE = bytes(32 if b in _NON_WORD else b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The bytes in pieces of about ``size``, cut only at ASCII white space, so
    that splitting a very long text into words needs bounded memory."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            cut = _SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, chars: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents with at
    most ``chars`` characters together, first in the order of a hash of the id.
    A text that does not fit what is left of ``chars`` is passed over, and texts
    longer than ``chars`` do not count towards ``rows``. Warns if fewer than two
    classes are among the rows chosen.

    ``usable`` filters on ``doc_id``. Null labels and ids take no part; of
    repeated ids the largest label and the smallest text count. Only ids and
    lengths reach the driver, ``rows`` of them at most, so the broadcast of the
    chosen ids is bounded by that parameter.
    """
    spark = docs.sparkSession
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    sizes = docs.where(F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    first = marked.join(sizes, "doc_id").where(F.col("n") <= chars).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    chosen, total = [], 0
    for r in first:
        if total + r["n"] <= chars:
            total += r["n"]
            chosen.append((r["doc_id"], r["label"]))
    if len({x for _, x in chosen}) < 2:
        warnings.warn(f"the training sample of {len(chosen)} rows does not hold both classes of {label}", stacklevel=2)
    ids = spark.createDataFrame(chosen, "doc_id long, label int")
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
