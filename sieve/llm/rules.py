"""Quality rules: countable faults of a text, and a hashed n-gram log-likelihood
ratio between a trusted target and the raw corpus; in DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets.
Two multinomials over the buckets are counted, one over the texts of trusted
documents and one over all texts, each with one occurrence added per bucket. A
bucket's weight is the logarithm of its two probabilities' ratio, as a whole
number of millionths, so that sums don't depend on their order. A text's score is
the mean weight of its n-grams, rounded down to ten-thousandths. A fifth of the
trusted documents, by a hash of the key, is left out of the target's counts; the
threshold is the score that all but a stated share of these reach. (Documents
that were counted score higher than equally good ones that were not.) A text is
kept if it reaches the threshold and breaks no base rule. Nothing is drawn at
random: equal texts get equal verdicts, on any number of machines.

A text's counts are taken within its row, so no text is shuffled as long as the
trusted ids are few enough to be broadcast (their number is checked). A row takes
memory in proportion to its own text, about 150 bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import crc_mod
from sieve.llm.sql import CRC_TABLE, crc32_of
from sieve.session import ensure_checkpoint_dir

BUCKETS = 10_000
SHARE = 0.005              # of the trusted documents left out that may score below the threshold
LEFT_OUT = 5               # one in so many trusted documents sets the threshold
LEAST_WORDS = 50           # a text of fewer words fails
REPEATED = 50              # percent of words in repeated windows beyond which a text fails
UNIT, STEP = 1_000_000, 100        # weights are in millionths, scores in steps of 100 of them
TRUSTED_BROADCAST = 2_000_000      # ids; beyond, they are joined by shuffle
_SPACES = r"[\x20\x09-\x0D]+"
_WORD_CHAR, _SYMBOL = r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES, -1), "")


def _split(docs: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """``keep``, the words, their hashes and those of neighbouring pairs. Each
    array is a column of its own, or it would be built anew for every word."""
    rest = F.greatest(F.size("__hashes") - 1, F.lit(0))
    return (docs.select(*keep, words(F.col(text)).alias("__words"))                        # the text itself goes on only if asked for
            .withColumn("__hashes", F.transform("__words", lambda w: F.crc32(w.cast("binary"))))
            .withColumn("__pairs", F.zip_with(F.slice("__hashes", 1, rest), F.slice("__hashes", 2, rest), lambda a, b: a * 31 + b)))


def _measures(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the measures of words, from the columns that ``_split`` makes."""
    size = F.size("__words")
    # Hashes of all three-word windows. Only where two are equal are windows placed, by a hash of the words themselves.
    quick = F.transform(F.slice("__pairs", 1, F.greatest(size - 2, F.lit(0))), lambda pair, i: F.xxhash64(pair, F.get("__hashes", i + 2)))
    out = found.withColumn("__quick", quick)
    at = F.when(F.size(F.array_distinct("__quick")) < F.size("__quick"), F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))
    own = lambda p, j: F.get("__words", p + j)                                                                  # noqa: E731
    out = out.withColumn("__placed", F.sort_array(F.transform(at, lambda p: F.struct(F.xxhash64(own(p, 0), own(p, 1), own(p, 2)).alias("h"), p.alias("p")))))
    alike = lambda x, i: F.coalesce(x["h"] == F.get("__placed", i)["h"], F.lit(False))                          # noqa: E731
    out = out.withColumn("__places", F.sort_array(F.transform(F.filter("__placed", lambda x, i: alike(x, i - 1) | alike(x, i + 1)), lambda x: x["p"])))
    # Each repeated window covers three words, less those that the one before covers too.
    covered = F.aggregate(F.transform("__places", lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get("__places", i - 1), F.lit(3)))),
                          F.lit(0).cast("long"), lambda total, n: total + n)
    return out.select(*keep, size.cast("long").alias("n_words"), covered.alias("n_repeat_words"))


def _line_measures(docs: DataFrame, *keep: Column | str, text: str = "__text") -> DataFrame:
    """``keep``, the text and what needs no words of it."""
    lines = docs.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD_CHAR)))
    return lines.select(
        *keep, text, F.length(F.regexp_replace(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, _SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))


def weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, weight`` for every bucket: the weight in millionths. ``trusted``
    holds distinct keys in a column named as ``key``; without any, or without
    texts, all weights come from the added occurrences alone."""
    marked = _split(docs.join(trusted.select(F.col(key), F.lit(1).alias("__trusted")), key, "left"), text, "__trusted")
    # Counts are taken within each task first; at most ``buckets`` rows leave it.
    counts = (marked.select("__trusted", F.explode(F.concat("__hashes", "__pairs")).alias("hash"))
              .groupBy((F.col("hash") % buckets).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count("__trusted").alias("target")))
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"]).checkpoint()
    total = full.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    ratio = F.log((F.col("target") + 1) / (total["target"] + buckets)) - F.log((F.col("raw") + 1) / (total["raw"] + buckets))
    return full.select("bucket", F.floor(ratio * UNIT + 0.5).cast("long").alias("weight"))


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``score`` (long, in
    ten-thousandths; 0 without words), ``threshold``, ``base_failed``, ``kept``.

    ``trusted`` holds the keys of the target's documents; null and unknown keys
    there count for nothing, repeated ones once. Null texts count as empty; they
    and texts of white space have no words and so fail. Repeated rows are judged
    each, and alike; every row with a trusted key belongs to the target. Other
    columns are not read, so their names can't clash. If no trusted document is
    among those left out there is no threshold, and the base rules alone decide. An empty table gives
    no rows. Words in windows are compared by 64-bit hash.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    ids = trusted.where(F.col(key).isNotNull()).select(key).distinct().checkpoint()
    few = ids.count() <= TRUSTED_BROADCAST
    counted, left_out = [F.broadcast(x) if few else x for x in (ids.where(crc_mod(F.col(key), LEFT_OUT) != 0), ids.where(crc_mod(F.col(key), LEFT_OUT) == 0))]
    table = weights(docs, counted, key, text, buckets)
    row = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("weights"))      # one row of ``buckets`` numbers
    # Each step drops what later ones don't need, as a row is copied at every step.
    kept = [key, "word_chars", "n_symbols", "n_dup_lines"]
    own = _split(_line_measures(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")), key), "__text", *kept).withColumn("__weights", row.scalar())
    weight = lambda so_far, h: so_far + F.get("__weights", (h % buckets).cast("int"))                           # noqa: E731
    total = F.aggregate("__pairs", F.aggregate("__hashes", F.lit(0).cast("long"), weight), weight)
    n_grams = F.size("__hashes") + F.size("__pairs")
    score = F.when(n_grams > 0, F.floor(total / (n_grams * STEP))).otherwise(0).cast("long")
    own = own.select(*kept, "__words", "__hashes", "__pairs", score.alias("score"))
    found = _measures(own, [*kept, "score"]).checkpoint()
    lowest = found.join(left_out, key, "left_semi").agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY score)").cast("long").alias("threshold"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return (found.withColumn("threshold", lowest.scalar()).withColumn("base_failed", failed)
            .select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "threshold", "base_failed",
                    (~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True))).alias("kept")))


ORACLE_SQL = rf"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs),
placed AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM split),
crcs AS (SELECT w, {crc32_of("w")} AS crc FROM (SELECT DISTINCT w FROM placed), crc_table),
hashed AS (SELECT r, p, w, crc, lead(crc) OVER (PARTITION BY r ORDER BY p) AS next FROM placed JOIN crcs USING (w)),
grams AS (SELECT r, crc % {BUCKETS} AS b FROM hashed UNION ALL SELECT r, (crc * 31 + next) % {BUCKETS} FROM hashed WHERE next IS NOT NULL),
marked AS (SELECT DISTINCT r, doc_id FROM docs JOIN labels USING (doc_id) WHERE quality = 1),
parts AS (SELECT r, {crc32_of("doc_id::VARCHAR")} % {LEFT_OUT} AS part FROM marked, crc_table),
trusted AS (SELECT r FROM parts WHERE part <> 0),
counts AS (SELECT b, count(*) AS raw, count(t.r) AS target FROM grams g LEFT JOIN trusted t ON g.r = t.r GROUP BY b),
full_counts AS (SELECT k.b, coalesce(raw, 0) AS raw, coalesce(target, 0) AS target FROM (SELECT unnest(range({BUCKETS})) AS b) k LEFT JOIN counts USING (b)),
weights AS (SELECT b, floor((ln((target + 1)::DOUBLE / (sum(target) OVER () + {BUCKETS})) - ln((raw + 1)::DOUBLE / (sum(raw) OVER () + {BUCKETS}))) * {UNIT} + 0.5)::BIGINT AS weight FROM full_counts),
scores AS (SELECT r, floor(sum(weight)::DOUBLE / (count(*) * {STEP}))::BIGINT AS score FROM grams JOIN weights USING (b) GROUP BY r),
lowest AS (SELECT quantile_disc(coalesce(score, 0), {SHARE}) AS threshold FROM parts LEFT JOIN scores USING (r) WHERE part = 0),
windows AS (SELECT r, p, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS v FROM placed WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, v) AS n FROM windows WHERE v IS NOT NULL) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p + i) AS n FROM twice, (SELECT unnest(range(3)) AS i) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
found AS (SELECT d.r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(score, 0) AS score, threshold
  FROM docs d JOIN split USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN scores USING (r), lowest),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM found)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  score, threshold, base_failed, NOT base_failed AND coalesce(score >= threshold, true) AS kept FROM judged
"""
