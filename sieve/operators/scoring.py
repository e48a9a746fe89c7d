"""Scoring of predictions: exact match, token precision/recall/F1, pass@k,
accuracy rollups, log-prob aggregates and choice argmax.

Token overlaps of long texts are computed as a distributed multiset
intersection (explode tokens, count per side, join on (id, token), sum of the
smaller counts), which is linear in the text length; the array form in
:func:`token_prf` is for short strings only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions import text as T

HF_PUNCT = T.PUNCTUATION


# --------------------------------------------------------------------------
# exact match
# --------------------------------------------------------------------------

def em_normalise(c, ignore_case: bool = True, ignore_punctuation: bool = True) -> Column:
    c = T.col(c)
    if ignore_case:
        c = F.lower(c)
    if ignore_punctuation:
        c = T.drop_punctuation(c)
    return c


def exact_match(df: DataFrame, pred: str, gold: str, by: list[str] | None = None,
                ignore_case: bool = True, ignore_punctuation: bool = True) -> DataFrame:
    """Mean of equality (x 100 is left to the caller)."""
    eq = (em_normalise(pred, ignore_case, ignore_punctuation) ==
          em_normalise(gold, ignore_case, ignore_punctuation)).cast("double")
    g = df.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(eq, F.lit(0.0))).alias("exact_match"))


# --------------------------------------------------------------------------
# token overlap
# --------------------------------------------------------------------------

def token_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys + [tok, cnt]`` of the normalised whitespace tokens."""
    return (df.select(*keys, F.explode(T.answer_tokens(text)).alias("tok"))
            .groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("cnt")))


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str],
                     left_text: str, right_text: str) -> DataFrame:
    """Shared token count ``sum(min(count))`` per (keys + right_keys) pair.

    ``left`` has one text per ``keys``; ``right`` one text per
    ``keys + right_keys`` (e.g. several gold answers per question)."""
    lc = token_counts(left, keys, left_text).withColumnRenamed("cnt", "lc")
    rc = token_counts(right, keys + right_keys, right_text).withColumnRenamed("cnt", "rc")
    return (lc.join(rc, keys + ["tok"])
            .groupBy(*keys, *right_keys).agg(F.sum(F.least("lc", "rc")).alias("common")))


def _token_side(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per (key, token): the token's count in the normalised text, with the
    text's token count, 64-bit hash and length riding along as per-key
    constants. An empty text keeps one row with a null token and count 0, so
    every key appears; each text is read and normalised once."""
    # normalise in its own projection so the generator below reuses the value
    normed = df.select(*keys, T.norm_answer(text).alias("_n"))
    n = F.col("_n")
    toks = F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))
    # the stats get their own projection below the generator: columns selected
    # next to a generator are evaluated above it, once per emitted token
    per_text = normed.select(*keys, toks.alias("_toks"), F.size(toks).alias("n_tok"), F.xxhash64(n).alias("_h"),
                             F.length(n).alias("_len"))
    return (per_text.select(*keys, "n_tok", "_h", "_len", F.explode_outer("_toks").alias("tok"))
            .groupBy(*keys, "tok").agg(F.count("tok").alias("cnt"), F.first("n_tok").alias("n_tok"),
                                       F.first("_h").alias("_h"), F.first("_len").alias("_len")))


def squad_scores(references: DataFrame, predictions: DataFrame, id_col: str = "id",
                 answers: str = "answers", prediction: str = "prediction_text",
                 order_col: str | None = None) -> DataFrame:
    """Per-reference EM / F1 / precision / recall (each the max over the gold
    answers); references without a prediction score 0. Duplicate prediction
    ids keep the last one by ``order_col``; without it they are an error.
    Predictions of other ids are dropped before any text is read.

    One join of the two token tables on (id, token) gives, per (id, answer),
    the shared token count and both texts' stats. Pairs with no shared token
    do not appear and score 0 everywhere, which is their exact score unless
    both texts are empty; the null tokens of empty texts meet through the
    null-safe join key, so that case appears too. Exact match compares the
    normalised strings through their 64-bit hash and length, together with
    equal token multisets."""
    predictions = predictions.join(references.select(id_col).distinct(), id_col, "left_semi")
    if order_col:
        preds = predictions.groupBy(id_col).agg(F.max_by(prediction, order_col).alias(prediction))
    else:
        twice = F.raise_error(F.concat(F.lit("several predictions for "), F.col(id_col).cast("string"))).cast("string")
        preds = predictions.groupBy(id_col).agg(F.first(prediction).alias(prediction), F.count(F.lit(1)).alias("_n"))
        preds = preds.select(id_col, F.when(F.col("_n") > 1, twice).otherwise(F.col(prediction)).alias(prediction))
    gold = references.select(id_col, F.posexplode(answers).alias("ans_idx", "gold"))
    pc = _token_side(preds, [id_col], prediction).select(
        F.col(id_col).alias("_pid"), F.col("tok").alias("_ptok"), F.col("cnt").alias("lc"),
        F.col("n_tok").alias("n_pred"), F.col("_h").alias("hp"), F.col("_len").alias("lp"))
    gc = _token_side(gold, [id_col, "ans_idx"], "gold").select(
        id_col, "ans_idx", "tok", F.col("cnt").alias("rc"), F.col("n_tok").alias("n_gold"),
        F.col("_h").alias("hg"), F.col("_len").alias("lg"))
    joined = gc.join(pc, (gc[id_col] == pc["_pid"]) & gc["tok"].eqNullSafe(pc["_ptok"]))
    per_answer = joined.groupBy(id_col, "ans_idx").agg(
        F.sum(F.least("lc", "rc")).alias("common"),
        *[F.first(c).alias(c) for c in ("n_pred", "hp", "lp", "n_gold", "hg", "lg")])
    em = ((F.col("hg") == F.col("hp")) & (F.col("lg") == F.col("lp")) & (F.col("n_gold") == F.col("n_pred")) &
          ((F.col("common") == F.col("n_pred")) | (F.col("n_pred") == 0))).cast("double")
    p = F.try_divide(F.col("common").cast("double"), F.col("n_pred"))
    r = F.try_divide(F.col("common").cast("double"), F.col("n_gold"))
    scored = per_answer.select(
        id_col, em.alias("em"),
        F.when(F.col("common") == 0, 0.0).otherwise(p).alias("precision"),
        F.when(F.col("common") == 0, 0.0).otherwise(r).alias("recall"),
        F.when(F.col("common") == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))
    best = scored.groupBy(id_col).agg(*[F.max(c).alias(c) for c in ("em", "f1", "precision", "recall")])
    return (references.select(id_col).join(best, id_col, "left")
            .fillna(0.0, subset=["em", "f1", "precision", "recall"]))


def squad_summary(per_ref: DataFrame) -> DataFrame:
    """Mean x 100 over all references."""
    return per_ref.agg(*[(F.avg(c) * 100).alias(n) for c, n in
                         (("em", "exact_match"), ("f1", "f1"), ("precision", "precision"), ("recall", "recall"))])


def token_prf(pred, gold) -> Column:
    """Struct (precision, recall, f1) for two short strings (array form)."""
    p, g = T.answer_tokens(pred), T.answer_tokens(gold)
    common = F.aggregate(
        F.array_distinct(p), F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))))
    prec = F.try_divide(common.cast("double"), F.size(p))
    rec = F.try_divide(common.cast("double"), F.size(g))
    zero = common == 0
    return F.struct(F.when(zero, 0.0).otherwise(prec).alias("precision"),
                    F.when(zero, 0.0).otherwise(rec).alias("recall"),
                    F.when(zero, 0.0).otherwise(2 * prec * rec / (prec + rec)).alias("f1"))


# --------------------------------------------------------------------------
# pass@k
# --------------------------------------------------------------------------

def pass_at_k_estimator(n: Column, c: Column, k: int) -> Column:
    """``1`` if n - c < k else ``1 - prod_{j=n-c+1..n} (1 - k/j)``."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, j: acc * (F.lit(1.0) - F.lit(float(k)) / j))
    return (F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod))


def pass_at_k(results: DataFrame, ks=(1, 10, 100), task: str = "task_id", passed: str = "passed") -> DataFrame:
    """``k, pass_at_k``: mean estimator over tasks, reported for k only when
    every task has at least k samples."""
    per_task = results.groupBy(task).agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col(passed).cast("int")).alias("c"))
    parts = []
    for k in ks:
        parts.append(per_task.agg(F.lit(k).alias("k"), F.min("n").alias("min_n"),
                                  F.avg(pass_at_k_estimator(F.col("n"), F.col("c"), k)).alias("pass_at_k")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("min_n") >= F.col("k")).drop("min_n")


# --------------------------------------------------------------------------
# accuracy rollup
# --------------------------------------------------------------------------

def accuracy_rollup(rows: DataFrame, correct: str = "correct", subject: str = "subject",
                    subcategory: str = "subcategory", category: str = "category") -> DataFrame:
    """Accuracy per subject, subcategory, category and overall, all micro
    averaged over rows: ``level, name, n, accuracy`` (one grouping-sets
    aggregate, one shuffle)."""
    g = rows.groupingSets([[subject], [subcategory], [category], []], subject, subcategory, category)
    agg = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"),
                F.grouping_id().alias("_gid"))
    # the level follows from the grouping id alone; rows without a subject (subcategory, category) count
    # in the other levels and get no row of that one
    gid = F.col("_gid")
    level = F.when(gid == 3, "subject").when(gid == 5, "subcategory").when(gid == 6, "category").otherwise("overall")
    name = F.when(gid == 3, F.col(subject)).when(gid == 5, F.col(subcategory)).when(gid == 6, F.col(category)).otherwise("all")
    return agg.select(level.alias("level"), name.alias("name"), "n", "accuracy").where(F.col("name").isNotNull())


# --------------------------------------------------------------------------
# log-probs and choices
# --------------------------------------------------------------------------

def logprob_summary(df: DataFrame, keys: list[str], logprob: str = "logprob") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(logprob).alias("sum_logprob"), F.avg(logprob).alias("mean_logprob"),
                                 F.max(logprob).alias("max_logprob"), F.count(F.lit(1)).alias("n_tokens"))


def rollup_map(df: DataFrame, prompt: str, completion: str, score: str, order: list[str]) -> DataFrame:
    """prompt -> {completion: score}; a repeated (prompt, completion) keeps the
    last score in ``order``."""
    last = df.groupBy(prompt, completion).agg(F.max_by(score, F.struct(*order)).alias(score))
    return last.groupBy(prompt).agg(F.map_from_entries(F.collect_list(F.struct(completion, score))).alias("scores"))


def softmax(v) -> Column:
    from sieve.functions.vectors import per_element
    v = T.col(v)
    e = F.zip_with(v, per_element(v, F.array_max(v)), lambda x, m: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(e, per_element(e, s), lambda x, t: x / t)


def argmax_choice(scores, choices=("A", "B", "C", "D")) -> Column:
    """Struct (choice, prob): softmax over the candidate scores, the first best
    candidate and its probability."""
    p = softmax(scores)
    best = F.array_position(p, F.array_max(p))
    return F.struct(F.element_at(F.array(*[F.lit(c) for c in choices]), best.cast("int")).alias("choice"),
                    F.array_max(p).alias("prob"))


__all__ = ["exact_match", "token_counts", "multiset_overlap", "squad_scores", "squad_summary", "token_prf",
           "pass_at_k", "pass_at_k_estimator", "accuracy_rollup", "logprob_summary", "rollup_map", "softmax",
           "argmax_choice"]
