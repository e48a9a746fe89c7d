"""Spelling variants by permuterm rotations, in DataFrame functions only.

Every word gets a terminator and is turned into all its rotations. A rotation is
a row of two groups: as it stands, and without its last letter, the *edited* one.
Two words that differ in one replaced letter have a rotation each that is equal
but for that last letter; if a letter is inserted, the shorter word's rotation is
the longer one's without its last letter. So in sorted order a rotation and all
rotations that extend it by one letter stand together as one range, and a scan of
the range finds the neighbours: for any two words one range, as of a run of equal
letters only the first counts as inserted. A range holds at most one row for
each letter of the alphabet and one more. The scan emits for each row how many
neighbours it has there and the best of them, never the pairs.

Forms are followed by pointer doubling. A form occurs at least twice as often as
its word, so a chain is no longer than the logarithm of the largest count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.sql import CRC_TABLE, crc32_of
from sieve.session import ensure_checkpoint_dir

LEAST_LETTERS, LEAST_COUNT = 5, 3
TYPO_RATE = 97              # one run in so many loses a letter before it is counted
FACTOR = 2                  # a form occurs so many times as often as its word, at least
END = "$"                   # no letter of a word
_RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of whole texts, as the contract of ``op11`` makes them: of a
    run whose CRC-32 with its document's key is a multiple of 97 one letter is
    left out. Counts are taken within each task before words are shuffled."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(
        F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % TYPO_RATE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return (runs.select("run", h.alias("h")).select(word.alias("word")).where(F.length("word") >= least_letters)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def rotations(words: DataFrame) -> DataFrame:
    """``key, edited, canonical, n``: each rotation whole (``edited`` empty), and
    without its last letter (``edited``); ``canonical`` unless the letter before
    it is the same. The word can be read off ``key`` and ``edited``."""
    cut = words.select("word", "n", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    part = lambda start, size=F.col("size"): F.substring("word", start, size)                                    # noqa: E731
    before, letter = part(F.lit(1), F.col("i")), part(F.col("i") + 1, F.lit(1))
    whole = F.struct(F.concat(part(F.col("i") + 1), F.lit(END), before).alias("key"), F.lit("").alias("edited"), F.lit(False).alias("canonical"))
    short = F.struct(F.concat(part(F.col("i") + 2), F.lit(END), before).alias("key"), letter.alias("edited"),
                     ((F.col("i") == 0) | (letter != part(F.col("i"), F.lit(1)))).alias("canonical"))
    rows = F.when(F.col("i") < F.col("size"), F.array(whole, short)).otherwise(F.array(whole))
    return cut.select("n", F.explode(rows).alias("r")).select("r.key", "r.edited", "r.canonical", "n")


def _word(edited: Column) -> Column:
    """The word that a range's key and an edited letter (or none) stand for."""
    return F.concat(F.substring_index("key", END, -1), edited, F.substring_index("key", END, 1))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: how many of ``words`` differ from a word in exactly
    one inserted, deleted or replaced code point, and of these the one with the
    largest ``n``, ties by code point, as a struct of ``minus`` (-n) and ``word``.
    Words without neighbours are left out."""
    # Sorted: the letters that extend the range's key, most frequent words first, then the key itself if it is a word.
    order = Window.partitionBy("key").orderBy(F.col("edited") == "", F.desc("n"), "edited")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extends = F.col("edited") != ""
    row = F.struct("n", "edited")
    scanned = rotations(words).select(
        "*", F.row_number().over(order).alias("place"), F.first(row).over(whole).alias("top"), F.lead(row).over(order).alias("next"),
        F.count("*").over(whole).alias("rows"), F.count(F.when(extends, 1)).over(whole).alias("letters"),
        F.count(F.when(F.col("canonical"), 1)).over(whole).alias("longer"), F.first(F.when(F.col("canonical"), row), ignorenulls=True).over(whole).alias("top_longer"),
        F.max(F.when(~extends, F.col("n"))).over(whole).alias("shorter")).where(F.col("rows") > 1)
    candidate = lambda r: F.when(r.isNotNull(), F.struct((-r["n"]).alias("minus"), _word(r["edited"]).alias("word")))
    other = F.when(F.col("place") > 1, F.col("top")).when(F.col("next.edited") != "", F.col("next"))
    shorter = F.when(F.col("canonical") & F.col("shorter").isNotNull(), F.struct(F.col("shorter").alias("n"), F.lit("").alias("edited")))
    found = scanned.select(
        _word(F.col("edited")).alias("word"),
        F.when(extends, F.col("letters") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("longer")).alias("near"),
        F.when(extends, F.least(candidate(other), candidate(shorter))).otherwise(candidate(F.col("top_longer"))).alias("best"))
    return found.where(F.col("near") > 0).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` (both set, no cycles): the last form that
    can be reached. Every round doubles the steps taken."""
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        now = then.select("word", "root")
        if not then.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR, **more) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, a row per word.

    A word's form is its most frequent neighbour (ties: smallest by code point)
    if that occurs ``factor`` times as often at least; its root is the last form
    that can be reached, or itself. Null texts hold no words, null keys count as
    empty text, repeated rows count each, other columns are not read. An empty
    table, or one without frequent words, gives no rows. Of a text all runs are
    in memory at once; nothing else is held per document, word or letter.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    words = counted_words(docs, key, text, **more).checkpoint()
    best_n = -F.col("best.minus")
    judged = (words.join(neighbours(words), "word", "left")
              .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best_n >= factor * F.col("n"), F.col("best.word")).alias("form"),
                      F.when(best_n >= factor * F.col("n"), best_n).alias("form_n")).checkpoint())
    return (judged.join(roots(judged.where(F.col("form").isNotNull())), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS key, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT key, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_of("key || ':' || run")} AS h FROM counted, crc_table),
spelt AS (SELECT CASE WHEN h % {TYPO_RATE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM places),
near AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
ranked AS (SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS rank
  FROM near JOIN words ON words.word = other),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {FACTOR} * w.n THEN other END AS form, CASE WHEN r.n >= {FACTOR} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND rank = 1),
steps(word, place, depth) AS (SELECT word, word, 0 FROM judged UNION ALL SELECT s.word, j.form, depth + 1 FROM steps s JOIN judged j ON s.place = j.word WHERE j.form IS NOT NULL),
last AS (SELECT word, arg_max(place, depth) AS root FROM steps GROUP BY word)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM judged JOIN last USING (word)
"""
