"""Scoring queries: answers and predictions derived from the given tables.

Mapping (kept identical in the oracle SQL):
* QA references: ``benchmark`` (id = item_id, gold answers = the lines of its
  text); predictions: ``documents`` that have a ``labels`` row (id = doc_id);
* code samples: ``labels`` joined to ``documents`` (task = source, passed =
  quality 1); problems = the distinct sources;
* numeric answers: the numbers in ``documents.text``;
* graded rows with a category tree: ``orders`` (correct = status F) under
  customer nation -> region -> west / east.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import text as T
from sieve.operators import joins as J
from sieve.operators import sampling as SA
from sieve.operators import scoring as SC
from sieve.plans import fixtures as FX
from sieve.plans.catalog import r6, register


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
PUNCT_SQL = lit_sql(T.PUNCTUATION)
NUM_SQL = lit_sql(T.NUMBER_PATTERN)


def norm_sql(x: str) -> str:
    toks = (f"list_filter(string_split_regex(trim(translate(lower({x}), {PUNCT_SQL}, ''), {WS}), "
            f"'[ \\t\\n\\r\\x0b\\x0c]+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")
    return f"array_to_string({toks}, ' ')"


def tokens_sql(x: str) -> str:
    n = norm_sql(x)
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END)"


def last_number_sql(x: str) -> str:
    return (f"(CASE WHEN len(regexp_extract_all({x}, {NUM_SQL})) > 0 "
            f"THEN regexp_extract_all({x}, {NUM_SQL})[-1] ELSE {x} END)")


def strip_commas_sql(x: str) -> str:
    return f"regexp_replace({x}, '(\\d),(\\d)', '\\1\\2', 'g')"


def docs(spark, sf):
    return FX.table(spark, sf, "documents")


@register("norm_answer", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def norm_answer(spark, sf):
    return docs(spark, sf).select("doc_id", T.norm_answer("text").alias("norm"))


@register("strip_digit_commas", f"SELECT doc_id, {strip_commas_sql('text')} AS text FROM documents")
def strip_digit_commas(spark, sf):
    return docs(spark, sf).select("doc_id", T.strip_digit_commas("text").alias("text"))


@register("last_number", f"SELECT doc_id, {last_number_sql(strip_commas_sql('text'))} AS answer FROM documents")
def last_number(spark, sf):
    return docs(spark, sf).select("doc_id", T.last_number(T.strip_digit_commas("text")).alias("answer"))


GOLD_TEXT = "'Reasoning.' || chr(10) || '#### ' || regexp_extract(text, '\\d[\\d,]*(\\.\\d+)?', 0)"


def _gold_text():
    return F.concat(F.lit("Reasoning.\n#### "), F.regexp_extract("text", r"\d[\d,]*(\.\d+)?", 0))


@register("gsm_gold", f"""SELECT doc_id, {strip_commas_sql(f"trim(split_part({GOLD_TEXT}, '####', -1), {WS})")} AS gold
FROM documents""")
def gsm_gold(spark, sf):
    """Gold answer after ``####`` of a worked answer whose result is the first
    number of the document."""
    return docs(spark, sf).select("doc_id", T.gsm_gold(_gold_text()).alias("gold"))


@register("agg_exact_match", f"""
WITH p AS (SELECT lang,
                  {last_number_sql(strip_commas_sql('text'))} AS pred,
                  {strip_commas_sql(f"trim(split_part({GOLD_TEXT}, '####', -1), {WS})")} AS gold FROM documents)
SELECT lang, count(*) AS n,
       round(avg(CASE WHEN translate(lower(pred), {PUNCT_SQL}, '') = translate(lower(gold), {PUNCT_SQL}, '')
                 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS exact_match
FROM p GROUP BY lang""")
def agg_exact_match(spark, sf):
    """Last number of each document (the model output) against the gold answer
    built from its first number, per language."""
    d = docs(spark, sf).select("lang", T.last_number(T.strip_digit_commas("text")).alias("pred"),
                               T.gsm_gold(_gold_text()).alias("gold"))
    em = SC.exact_match(d, "pred", "gold", by=["lang"])
    return em.select("lang", F.col("n").cast("long").alias("n"), r6("exact_match").alias("exact_match"))


def references(spark, sf):
    b = FX.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.split("text", "\n").alias("answers"))


def predictions(spark, sf):
    d = docs(spark, sf).join(FX.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("prediction_text"))


SQL_QA = f"""
g AS (SELECT item_id AS id, unnest(string_split(text, chr(10))) AS gold,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ans_idx FROM benchmark),
p AS (SELECT doc_id AS id, text AS pred FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
pt AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest({tokens_sql('pred')}) AS tok FROM p) GROUP BY id, tok),
gt AS (SELECT id, ans_idx, tok, count(*) AS c FROM (SELECT id, ans_idx, unnest({tokens_sql('gold')}) AS tok FROM g) GROUP BY id, ans_idx, tok),
cm AS (SELECT gt.id, gt.ans_idx, sum(least(gt.c, pt.c)) AS common FROM gt JOIN pt USING (id, tok) GROUP BY gt.id, gt.ans_idx),
pa AS (SELECT g.id, g.ans_idx, coalesce(cm.common, 0) AS common, len({tokens_sql('p.pred')}) AS n_pred,
              len({tokens_sql('g.gold')}) AS n_gold,
              CASE WHEN {norm_sql('g.gold')} = {norm_sql('p.pred')} THEN 1.0 ELSE 0.0 END AS em
       FROM g JOIN p USING (id) LEFT JOIN cm USING (id, ans_idx)),
sc AS (SELECT id, em,
              CASE WHEN common = 0 THEN 0.0 ELSE common / n_pred END AS precision,
              CASE WHEN common = 0 THEN 0.0 ELSE common / n_gold END AS recall,
              CASE WHEN common = 0 THEN 0.0 ELSE 2 * (common / n_pred) * (common / n_gold) / ((common / n_pred) + (common / n_gold)) END AS f1
       FROM pa),
best AS (SELECT id, max(em) AS em, max(f1) AS f1, max(precision) AS precision, max(recall) AS recall FROM sc GROUP BY id),
per AS (SELECT b.item_id AS id, coalesce(best.em, 0.0) AS em, coalesce(best.f1, 0.0) AS f1,
               coalesce(best.precision, 0.0) AS precision, coalesce(best.recall, 0.0) AS recall
        FROM benchmark b LEFT JOIN best ON best.id = b.item_id)"""


@register("token_prf", f"""WITH {SQL_QA}
SELECT id, round(em, 6) + 0.0 AS em, round(f1, 6) + 0.0 AS f1, round(precision, 6) + 0.0 AS precision,
       round(recall, 6) + 0.0 AS recall FROM per""")
def token_prf(spark, sf):
    per = SC.squad_scores(references(spark, sf), predictions(spark, sf))
    return per.select("id", *[r6(c).alias(c) for c in ("em", "f1", "precision", "recall")])


@register("agg_squad", f"""WITH {SQL_QA}
SELECT round(avg(em) * 100, 6) + 0.0 AS exact_match, round(avg(f1) * 100, 6) + 0.0 AS f1,
       round(avg(precision) * 100, 6) + 0.0 AS precision, round(avg(recall) * 100, 6) + 0.0 AS recall FROM per""")
def agg_squad(spark, sf):
    s = SC.squad_summary(SC.squad_scores(references(spark, sf), predictions(spark, sf)))
    return s.select(*[r6(c).alias(c) for c in ("exact_match", "f1", "precision", "recall")])


@register("agg_multiset_overlap", f"""WITH {SQL_QA}
SELECT id, ans_idx, common::BIGINT AS common FROM cm""")
def agg_multiset_overlap(spark, sf):
    gold = references(spark, sf).select("id", F.posexplode("answers").alias("ans_idx", "gold"))
    cm = SC.multiset_overlap(predictions(spark, sf), gold, ["id"], ["ans_idx"], "prediction_text", "gold")
    return cm.select("id", F.col("ans_idx").cast("long").alias("ans_idx"), F.col("common").cast("long").alias("common"))


@register("join_reference_prediction", """
SELECT b.item_id AS id, d.text IS NOT NULL AS answered, length(coalesce(d.text, '')) AS prediction_chars
FROM benchmark b LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d
  ON d.doc_id = b.item_id""")
def join_reference_prediction(spark, sf):
    """References left-joined to predictions (missing ones still count)."""
    j = J.reference_prediction(references(spark, sf), predictions(spark, sf), "id")
    return j.select("id", F.col("prediction_text").isNotNull().alias("answered"),
                    F.length(F.coalesce("prediction_text", F.lit(""))).cast("long").alias("prediction_chars"))


@register("intersect_multiset", f"""
WITH p AS (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS tok FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
g AS (SELECT item_id AS id, unnest({tokens_sql('text')}) AS tok FROM benchmark),
i AS (SELECT id, tok FROM p INTERSECT ALL SELECT id, tok FROM g)
SELECT id, count(*) AS common FROM i GROUP BY id""")
def intersect_multiset(spark, sf):
    """Shared tokens of each benchmark item and its prediction, as a multiset
    intersection of token rows (``intersectAll``)."""
    p = predictions(spark, sf).select("id", F.explode(T.answer_tokens("prediction_text")).alias("tok"))
    g = FX.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"),
                                                 F.explode(T.answer_tokens("text")).alias("tok"))
    return p.intersectAll(g).groupBy("id").agg(F.count(F.lit(1)).alias("common"))


SQL_SAMPLES = """
s AS (SELECT d.source AS task_id, l.doc_id, l.quality = 1 AS passed FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT task_id, count(*) AS n, sum(passed::INT)::BIGINT AS c FROM s GROUP BY task_id)"""


def samples(spark, sf):
    lab = FX.table(spark, sf, "labels")
    return (lab.join(docs(spark, sf).select("doc_id", "source"), "doc_id")
            .select(F.col("source").alias("task_id"), F.col("doc_id").alias("completion_id"),
                    (F.col("quality") == 1).alias("passed")))


def _pass_sql(k: int) -> str:
    est = (f"CASE WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_reduce(list_transform("
           f"range(n - c + 1, n + 1), lambda j: 1.0 - {k}.0 / j), lambda a, b: a * b) END")
    return f"SELECT {k} AS k, min(n) AS min_n, avg({est}) AS p FROM t"


@register("agg_pass_at_k", f"""WITH {SQL_SAMPLES},
r AS ({_pass_sql(1)} UNION ALL {_pass_sql(5)} UNION ALL {_pass_sql(10)} UNION ALL {_pass_sql(100)})
SELECT k, round(p, 6) + 0.0 AS pass_at_k FROM r WHERE min_n >= k""")
def agg_pass_at_k(spark, sf):
    out = SC.pass_at_k(samples(spark, sf), ks=(1, 5, 10, 100))
    return out.select(F.col("k").cast("int").alias("k"), r6("pass_at_k").alias("pass_at_k"))


@register("join_problem_sample", f"""WITH {SQL_SAMPLES}
SELECT p.task_id, coalesce(t.n, 0) AS n, coalesce(t.c, 0)::BIGINT AS c
FROM (SELECT DISTINCT source AS task_id FROM documents) p JOIN t USING (task_id)""")
def join_problem_sample(spark, sf):
    problems = docs(spark, sf).select(F.col("source").alias("task_id")).distinct()
    j = J.problem_samples(problems, samples(spark, sf), "task_id", check=True)
    return j.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("c"))


@register("completeness_except", """
SELECT DISTINCT source AS task_id FROM documents
EXCEPT SELECT DISTINCT d.source FROM labels l JOIN documents d USING (doc_id)""")
def completeness_except(spark, sf):
    """Problems never attempted (empty when every problem has a sample)."""
    problems = docs(spark, sf).select(F.col("source").alias("task_id")).distinct()
    return J.missing_problems(problems, samples(spark, sf), "task_id")


SQL_GRADED = """
gr AS (SELECT n.n_name AS subject, r.r_name AS subcategory,
              CASE WHEN r.r_name IN ('AMERICA', 'EUROPE') THEN 'west' ELSE 'east' END AS category,
              o.o_orderstatus = 'F' AS correct
       FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
       JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def category_tree(spark, sf):
    nation = FX.table(spark, sf, "nation")
    region = FX.table(spark, sf, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_nationkey"), F.col("n_name").alias("subject"), F.col("r_name").alias("subcategory"),
                    F.when(F.col("r_name").isin("AMERICA", "EUROPE"), "west").otherwise("east").alias("category")))


def graded(spark, sf):
    o = FX.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("correct"))
    c = FX.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "correct")
    return J.attach_category(rows, category_tree(spark, sf), "c_nationkey", "n_nationkey")


@register("join_category", f"""WITH {SQL_GRADED}
SELECT subject, subcategory, category, count(*) AS n FROM gr GROUP BY ALL""")
def join_category(spark, sf):
    return graded(spark, sf).groupBy("subject", "subcategory", "category").agg(F.count(F.lit(1)).alias("n"))


@register("agg_accuracy_rollup", f"""WITH {SQL_GRADED}
SELECT CASE GROUPING(subject, subcategory, category) WHEN 3 THEN 'subject' WHEN 5 THEN 'subcategory'
            WHEN 6 THEN 'category' ELSE 'overall' END AS level,
       coalesce(subject, subcategory, category, 'all') AS name, count(*) AS n,
       round(avg(correct::DOUBLE), 6) + 0.0 AS accuracy
FROM gr GROUP BY GROUPING SETS ((subject), (subcategory), (category), ())""")
def agg_accuracy_rollup(spark, sf):
    r = SC.accuracy_rollup(graded(spark, sf))
    return r.select("level", "name", F.col("n").cast("long").alias("n"), r6("accuracy").alias("accuracy"))


@register("agg_logprob", """
SELECT user_id, event_type, round(sum(-abs(value)), 6) + 0.0 AS sum_logprob, round(avg(-abs(value)), 6) + 0.0 AS mean_logprob,
       round(max(-abs(value)), 6) + 0.0 AS max_logprob, count(*) AS n_tokens
FROM events GROUP BY user_id, event_type""")
def agg_logprob(spark, sf):
    """Per (prompt, completion) = (user, event type): sum / mean / max of the
    token log-probs (here ``-|value|`` of each event)."""
    ev = FX.table(spark, sf, "events").select("user_id", "event_type", (-F.abs("value")).alias("logprob"))
    s = SC.logprob_summary(ev, ["user_id", "event_type"])
    return s.select("user_id", "event_type", r6("sum_logprob").alias("sum_logprob"),
                    r6("mean_logprob").alias("mean_logprob"), r6("max_logprob").alias("max_logprob"),
                    F.col("n_tokens").cast("long").alias("n_tokens"))


@register("agg_rollup_map", """
SELECT user_id, event_type, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS score
FROM events GROUP BY user_id, event_type""")
def agg_rollup_map(spark, sf):
    """user -> {event type: value}, the last event of a repeated pair winning."""
    ev = FX.table(spark, sf, "events")
    m = SC.rollup_map(ev, "user_id", "event_type", "value", ["ts", "event_id"])
    return m.select("user_id", F.explode("scores").alias("event_type", "score")).select(
        "user_id", "event_type", r6("score").alias("score"))


@register("agg_argmax_choice", """
WITH s AS (SELECT vec_id, list_transform(range(4), lambda c: list_sum(list_transform(embedding[c * 16 + 1:c * 16 + 16], lambda x: x::DOUBLE))) AS v FROM embeddings),
e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS ex FROM s),
p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM e)
SELECT vec_id, ['A', 'B', 'C', 'D'][list_position(pr, list_max(pr))] AS choice, round(list_max(pr), 6) + 0.0 AS prob FROM p""")
def agg_argmax_choice(spark, sf):
    """Choice among A-D from four scores, the sums of the embedding's four quarters."""
    emb = FX.table(spark, sf, "embeddings")
    quarter = lambda c: F.aggregate(F.slice("embedding", c * 16 + 1, 16), F.lit(0.0), lambda a, x: a + x.cast("double"))      # noqa: E731
    c = emb.select("vec_id", F.array(*map(quarter, range(4))).alias("s")).select("vec_id", SC.argmax_choice("s").alias("c"))
    return c.select("vec_id", F.col("c.choice").alias("choice"), r6("c.prob").alias("prob"))


@register("join_prompt_output", """
WITH o AS (SELECT text AS prompt, arg_max(lang, doc_id) AS output FROM documents GROUP BY text)
SELECT b.item_id, coalesce(o.output, '') AS output FROM benchmark b LEFT JOIN o ON o.prompt = b.text""")
def join_prompt_output(spark, sf):
    """Stored outputs (documents keyed by their text) matched back to the
    prompts by text; a missing output is ''."""
    outputs = docs(spark, sf).select(F.col("text").alias("prompt"), F.col("lang").alias("output"), "doc_id")
    j = J.prompt_output(FX.table(spark, sf, "benchmark").withColumnRenamed("text", "prompt"), outputs,
                        order_col="doc_id")
    return j.select("item_id", "output")


@register("anti_already_done", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'reused' ELSE 'todo' END AS status FROM documents""")
def anti_already_done(spark, sf):
    """Rows with a stored output (``labels``) are reused, the rest go to the
    to-do set; decided per row."""
    done = FX.table(spark, sf, "labels").select("doc_id")
    rows = J.mark_done(docs(spark, sf).select("doc_id"), done, "doc_id")
    return rows.select("doc_id", F.when(F.col("done"), F.lit("reused")).otherwise(F.lit("todo")).alias("status"))


@register("member_set", "SELECT DISTINCT lang FROM documents")
def member_set(spark, sf):
    return docs(spark, sf).select("lang").distinct()


CODE_STOPS = T.CODE_STOPS


def _stops_sql(x: str) -> str:
    pos = ", ".join(f"nullif(strpos({x}, {lit_sql(s).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}), 0)"
                    for s in CODE_STOPS)
    return f"(CASE WHEN coalesce({pos}) IS NULL THEN {x} ELSE substr({x}, 1, least({pos}) - 1) END)"


@register("cut_at_stop", f"SELECT doc_id, {_stops_sql('text')} AS text FROM documents")
def cut_at_stop(spark, sf):
    return docs(spark, sf).select("doc_id", T.cut_at_stop("text", CODE_STOPS).alias("text"))


@register("code_signature", "SELECT doc_id, split_part(text, ':', 1) AS signature FROM documents")
def code_signature(spark, sf):
    return docs(spark, sf).select("doc_id", T.code_signature("text").alias("signature"))


SQL_CODE = """
cp AS (SELECT b.item_id AS task_id, b.text AS description, string_split(d.text, chr(10)) AS test_list, d.text AS code
       FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"""


def code_problems(spark, sf):
    b = FX.table(spark, sf, "benchmark")
    d = docs(spark, sf)
    return b.join(d, b.item_id == d.doc_id).select(
        F.col("item_id").alias("task_id"), b.text.alias("description"),
        F.split(d.text, "\n").alias("test_list"), d.text.alias("code"))


@register("code_prompt", f"""WITH {SQL_CODE}
SELECT task_id, '\"\"\"' || chr(10) || description || chr(10) || test_list[1] || chr(10) || '\"\"\"' || chr(10) AS prompt,
       array_to_string(test_list, chr(10)) AS reference FROM cp""")
def code_prompt(spark, sf):
    from sieve.plans import targets as TG
    p = code_problems(spark, sf)
    return p.select("task_id", TG.code_prompt("description", "test_list").alias("prompt"),
                    F.array_join("test_list", "\n").alias("reference"))


@register("assemble_check_program", f"""WITH {SQL_CODE}
SELECT task_id, 'Complete the following python function.' || chr(10) || chr(10) || chr(10) || description
       || split_part(code, ':', 1) || chr(10) || array_to_string(test_list, chr(10)) || chr(10) || 'check(f' || task_id || ')' AS program
FROM cp""")
def assemble_check_program(spark, sf):
    """Text of prompt + completion + tests + ``check(entry)`` (never executed)."""
    from sieve.plans import targets as TG
    p = code_problems(spark, sf)
    prompt = F.concat(F.lit("Complete the following python function.\n\n\n"), "description")
    return p.select("task_id", TG.check_program(prompt, T.code_signature("code"), F.array_join("test_list", "\n"),
                                                F.concat(F.lit("f"), F.col("task_id").cast("string"))).alias("program"))


@register("repeat_samples", "SELECT item_id, c AS completion_id FROM benchmark CROSS JOIN range(0, 3) r(c)")
def repeat_samples(spark, sf):
    b = FX.table(spark, sf, "benchmark").select("item_id")
    return SA.repeat_samples(b, 3).select("item_id", F.col("completion_id").cast("long").alias("completion_id"))


@register("holdout_slice", "SELECT item_id FROM benchmark ORDER BY item_id LIMIT 20 OFFSET 10")
def holdout_slice(spark, sf):
    return SA.holdout_slice(FX.table(spark, sf, "benchmark").select("item_id"), 10, 20, "item_id")
