"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame
functions only.

Texts become words (lower case, split at ASCII bytes that are neither letters
nor digits) and hashed five-word shingles. A window is as long as an item, and a
document's windows slide word by word. Windows that hold too few shingles of any
item to reach the similarity asked for are passed over before fingerprinting,
which is exact: a multiset that shares less than that share of an item's
shingles can't be that similar to it. All others get a 64-bit SimHash, whose
eight-bit blocks are looked up in an index of the items' blocks under all values
within two bits. Two fingerprints that differ in at most 23 bits differ in at
most two bits in one of eight blocks, so the index yields all of them. What is
within the radius is verified by the exact weighted Jaccard similarity of the
shingles, a shingle's weight being how often it occurs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.session import ensure_checkpoint_dir

WORDS = 5
SIMILARITY = 0.8
RADIUS = 23                    # 3.5 deviations and more above the distance expected at a similarity of 0.8
BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
RUN_WORDS = 1024               # starts of windows that share one stretch of shingles, or the longest item's words if they are more
BROADCAST_ROWS = 500_000       # of item shingles, index rows or document keys; beyond they are joined by shuffle
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT, -1), lambda w: w != "")


def shingles(own: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; none if there are fewer words.
    ``own`` must be a plain column: an expression would run once a word."""
    at = F.when(F.size(own) >= k, F.sequence(F.lit(0), F.size(own) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.xxhash64(*[F.get(own, p + j) for j in range(k)]))


def fingerprint(hashes: Column, most: int) -> Column:
    """64-bit SimHash of up to ``most`` hashes: a bit is 1 if it is set in over
    half of them. Bits are counted in lanes of a long, wide enough for ``most``:
    the sums of (h >>> i) & 0..010..01 hold the counts of every lane's bit i, and
    adding the rest up to a lane's top bit marks those over half."""
    lane = 8
    while most >= 1 << (lane - 1):
        lane *= 2
    if lane > 32:
        raise ValueError("too many hashes for one fingerprint")

    def long(value: int) -> Column:
        return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")

    def add(i: int):
        return lambda counts, h: counts + F.shiftrightunsigned(h, i).bitwiseAND(long(ones))

    ones = sum(1 << j for j in range(0, 64, lane))
    half, top = F.floor(F.size(hashes) / 2), 64 - lane          # the top lane is compared by itself, so that no sum leaves a long
    rest = ((1 << (lane - 1)) - 1 - half) * long(ones & ((1 << top) - 1))
    out = F.lit(0).cast("long")
    for i in range(lane):
        counts = F.aggregate(hashes, F.lit(0).cast("long"), add(i))
        marked = (counts.bitwiseAND(long((1 << top) - 1)) + rest).bitwiseAND(long(ones << (lane - 1) & ((1 << top) - 1)))
        out = out.bitwiseOR(F.shiftrightunsigned(marked, lane - 1 - i))
        out = out.bitwiseOR(F.when(F.shiftrightunsigned(counts, top) > half, long(1 << (top + i))).otherwise(long(0)))
    return out


def _blocks(fp: Column) -> Column:
    """Array of (block, value)."""
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.struct(
        b.alias("block"), F.call_function("shiftrightunsigned", fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int").alias("value")))


def _numbered(ordered: Column) -> Column:
    """The sorted multiset as a set: each hash joined with how many equal ones
    precede it. Two of them have as many members in common, and together, as the
    multisets have by smaller and by larger count."""
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.array_position(ordered, h)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Hinted either way: Spark counts as many rows out of an explode as in, and
    would broadcast what it sizes too low."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _key(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))


def find_leaks(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``k, h, item_id, start_word, n_words, hamming, similarity``: for each
    distinct (document key k, hash h of its text) and item its most similar
    window, if it reaches ``least``; of equal ones the first.

    Items of fewer than five words have one shingle, their whole sequence;
    items without words match nothing, nor do null and empty texts. A document
    shorter than an item has one window, itself. Item ids that repeat with
    different texts are items of their own that share the id. Repeated documents
    give one result; extra columns are not read; if either table is empty the
    result is.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    benchmark = (items.select(F.col(item_key).alias("item_id"), words(F.col(item_text)).alias("w")).distinct().where(F.size("w") > 0)
                 .withColumn("k", F.least(F.size("w"), F.lit(WORDS))))
    sizes = [r["k"] for r in benchmark.select("k").distinct().collect()]           # five at most
    found = [_find(docs, benchmark.where(F.col("k") == k), k, least, key, text) for k in sorted(sizes)]
    if not found:
        found = [_find(docs, benchmark, WORDS, least, key, text)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max_by(F.struct("start_word", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start_word")))
    return out.groupBy("k", "h", "item_id").agg(best.alias("b")).select("k", "h", "item_id", "b.*")


def _find(docs: DataFrame, benchmark: DataFrame, k: int, least: float, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    most = benchmark.agg(F.max(F.size("w"))).first()[0] or 1
    listed = (benchmark.select("item_id", shingles(F.col("w"), k).alias("hashes")).withColumn("ordered", F.array_sort("hashes"))
              .select(F.struct("item_id", F.xxhash64("hashes").alias("of")).alias("item"), F.size("hashes").alias("m"), "hashes", _numbered(F.col("ordered")).alias("set"))
              .withColumn("fp", fingerprint(F.col("hashes"), most)).checkpoint())
    marks = listed.select("item", "m", F.explode(F.array_distinct("hashes")).alias("shingle")).checkpoint()
    keyed = _key(docs, key, text)
    # Places of item shingles in documents.
    placed = keyed.select("k", "h", words(F.col("t")).alias("w")).select("k", "h", F.posexplode(shingles(F.col("w"), k)).alias("at", "shingle"))
    hits = placed.join(_small(marks, marks.count()), "shingle").groupBy("k", "h", "item", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # A window of m shingles needs this many hits; each run of so many that fits one gives the starts that cover it.
    need = F.greatest(F.ceil(F.col("m") * least - 1e-9).cast("int"), F.lit(1))
    hits = hits.withColumn("need", need).where(F.size("at") >= F.col("need"))
    run = lambda i: F.when(F.get("at", i + F.col("need") - 1) - F.get("at", i) < F.col("m"),                         # noqa: E731
                           F.sequence(F.greatest(F.get("at", i + F.col("need") - 1) - F.col("m") + 1, F.lit(0)), F.get("at", i))).otherwise(F.array().cast("array<int>"))
    hits = hits.withColumn("starts", F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), run))))
    # Windows of one length at one place are one window, whatever item led there. A text's windows go in runs of
    # starts, each with its own stretch of shingles, so that no window's row carries the whole text.
    run_words = max(RUN_WORDS, most)
    places = (hits.where(F.size("starts") > 0).select("k", "h", "m", F.explode("starts").alias("start")).distinct()
              .groupBy("k", "h", F.floor(F.col("start") / run_words).cast("int").alias("run")).agg(F.collect_list(F.struct("m", "start")).alias("places"))
              .groupBy("k", "h").agg(F.collect_list(F.struct("run", "places")).alias("runs")).checkpoint())
    # Few bytes but much arithmetic: the number of partitions is stated, or they would be joined into one.
    texts = (keyed.join(_small(places.select(F.col("k").alias("pk"), F.col("h").alias("ph"), "runs"), places.count()),
                        F.col("k").eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph"))).select("k", "h", "t", "runs")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k", "h").dropDuplicates(["k", "h"]))
    cut = texts.select("k", "h", "runs", words(F.col("t")).alias("w")).select("k", "h", "runs", shingles(F.col("w"), k).alias("all"))
    # A window that would end behind the text begins earlier, by less than the longest item.
    low = lambda r: F.greatest(r["run"] * run_words - most, F.lit(0))                                                # noqa: E731
    cut = cut.select("k", "h", F.size("all").alias("n"), F.explode(F.transform("runs", lambda r: F.struct(
        low(r).alias("low"), r["places"].alias("places"), F.slice("all", low(r) + 1, F.lit(run_words + 2 * most)).alias("own")))).alias("r"))
    cut = cut.select("k", "h", "n", "r.low", "r.places", "r.own")
    # Length and start in one long: longs are made distinct by hash, structs by comparing each with all.
    window = F.transform("places", lambda p: F.shiftleft(p["m"].cast("long"), 32).bitwiseOR(
        F.greatest(F.least(p["start"], F.col("n") - p["m"]), F.lit(0)).cast("long")))
    windows = (cut.select("k", "h", "low", "own", F.explode(F.array_distinct(window)).alias("p"))
               .select("k", "h", "low", "own", F.shiftright("p", 32).cast("int").alias("m"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start"))
               .select("k", "h", "m", "start", F.slice("own", F.col("start") - F.col("low") + 1, F.col("m")).alias("part"))
               .withColumn("fp", fingerprint(F.col("part"), most)).checkpoint())
    # The items' blocks under all near values, and the windows' blocks.
    flips = [0, *(sum(1 << b for b in bits) for n in range(1, NEAR + 1) for bits in combinations(range(BLOCK_BITS), n))]
    index = (listed.select("item", "m", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"))).alias("b"))
             .select("item", "m", "item_fp", "b.block", "b.value", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
             .withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip"))
    asked = windows.select("k", "h", "m", "start", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select("k", "h", "m", "start", "fp", "b.block", "b.value")
    n_index = len(flips) * BLOCKS * listed.count()
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = (asked.join(_small(index, n_index), ["m", "block", "value"]).where(hamming <= RADIUS)
            .groupBy("k", "h", "m", "start", "item").agg(F.min(hamming).alias("hamming")))
    # Verification, of the pairs within the radius only.
    pairs = near.groupBy("k", "h", "m", "start").agg(F.collect_list(F.struct("item", "hamming")).alias("items"))
    x, y = windows.select("k", "h", "m", "start", "part").alias("x"), pairs.alias("y")
    same = F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.m") == F.col("y.m")) & (F.col("x.start") == F.col("y.start"))
    checked = (x.join(y, same).select("x.k", "x.h", "x.m", "x.start", "x.part", F.array_sort("x.part").alias("ordered"), "y.items")
               .select("k", "h", "m", "start", "part", _numbered(F.col("ordered")).alias("own"), F.explode("items").alias("i")))
    checked = (checked.select("k", "h", "start", "part", "own", "i.item", "i.hamming").join(_small(listed.select("item", "set"), listed.count()), "item")
               .withColumn("similarity", F.size(F.array_intersect("own", "set")) / F.size(F.array_union("own", "set"))))
    return (checked.where(F.col("similarity") >= least)
            .select("k", "h", F.col("item.item_id").alias("item_id"), F.col("start").alias("start_word"), (F.size("part") + k - 1).alias("n_words"), F.col("hamming").cast("int").alias("hamming"), "similarity"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """One row per contaminated document and item: document key, ``item_id``,
    ``start_word``, ``n_words``, ``hamming``, ``similarity``; of a key that
    repeats with several texts the most similar window counts."""
    best = F.max_by(F.struct("start_word", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start_word"), "h"))
    return (find_leaks(docs, items, key=key, **more).groupBy(F.col("k").alias(key), "item_id").agg(best.alias("b")).select(key, "item_id", "b.*"))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` whose text has no leak, all columns as they are."""
    found = find_leaks(docs, items, key=key, text=text, **more).select(F.col("k").alias("__k"), F.col("h").alias("__h")).distinct().checkpoint()
    return docs.join(_small(found, found.count()), docs[key].eqNullSafe(found["__k"]) & (F.xxhash64(docs[text]) == found["__h"]), "left_anti")
