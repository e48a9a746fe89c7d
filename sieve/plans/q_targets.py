"""Target-set builders and samplers over the given tables.

Every item is made of its whole text. Multiple-choice items come from
``documents``: subject = source, options A-D = the last four lines and question =
all lines before them (a text of fewer than five lines is all question, with empty
options), answer letter = ``n_chars mod 4``; documents with a ``labels`` row form
the dev split, the rest the test split. Numeric items: question = all lines but the
last, or the whole text of one line; worked answer = the last line; answer = first
number of the text. Conversations give instruction/response pairs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.functions import text as T
from sieve.operators import sampling as SA
from sieve.plans import fixtures as FX
from sieve.plans import target_sets as TS
from sieve.plans import targets as TG
from sieve.plans.catalog import register

NL = "chr(10)"
WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
SEED = 42
COT_SHOTS = 3               # worked questions in a task's prompt


def key_sql(col: str, seed: int = SEED) -> str:
    return f"md5('{seed}|' || {col})"


# ---------------------------------------------------------------- MC items

def mc_items(spark, sf, split: str):
    d = FX.table(spark, sf, "documents")
    lab = FX.table(spark, sf, "labels").select("doc_id")
    d = d.join(lab, "doc_id", "left_semi" if split == "dev" else "left_anti")
    lines = F.split("text", "\n")
    n = F.size(lines)
    return d.select(F.col("doc_id").alias("target_id"), F.col("source").alias("subject"),
                    F.when(n > 4, F.array_join(F.slice(lines, F.lit(1), n - 4), "\n")).otherwise(F.coalesce("text", F.lit(""))).alias("q"),
                    *[F.when(n > 4, F.get(lines, n - 4 + i)).otherwise(F.lit("")).alias(o) for i, o in enumerate("abcd")],
                    F.element_at(F.array(*[F.lit(c) for c in TG.CHOICES]),
                                 (F.col("n_chars") % 4 + 1).cast("int")).alias("answer"))


def mc_items_sql(split: str) -> str:
    cond = "IN" if split == "dev" else "NOT IN"
    opts = ", ".join(f"CASE WHEN len(ls) > 4 THEN ls[len(ls) - {3 - i}] ELSE '' END AS {o}" for i, o in enumerate("abcd"))
    return f"""m AS (SELECT doc_id AS target_id, source AS subject, CASE WHEN len(ls) > 4 THEN array_to_string(ls[1:len(ls) - 4], {NL}) ELSE coalesce(text, '') END AS q, {opts},
       ['A', 'B', 'C', 'D'][n_chars % 4 + 1] AS answer FROM (SELECT *, string_split(text, {NL}) AS ls FROM documents) WHERE doc_id {cond} (SELECT doc_id FROM labels))"""


def mc_body_sql(with_answer: bool = False) -> str:
    s = (f"q || {NL} || 'A. ' || a || {NL} || 'B. ' || b || {NL} || 'C. ' || c || {NL} || 'D. ' || d || {NL} "
         f"|| 'Answer:'")
    if with_answer:
        s += f" || ' ' || answer || {NL} || {NL}"
    return s


HEADER_SQL = (f"'The following are multiple choice questions (with answers) about ' || "
              f"array_to_string(list_transform(string_split(subject, '_'), lambda w: ' ' || w), '') || '.' || {NL} || {NL}")


def chat_sql(content: str) -> str:
    return f"'<|user|>' || {NL} || {content} || {NL} || '<|assistant|>' || {NL}"


def mc_body(include_answer=False):
    return TG.mc_prompt("q", list("abcd"), "answer", include_answer)


def _out(df):
    return df.select(F.col("target_id").cast("long").alias("target_id"), "prompt", "label")


def _set(spark, name: str, **inputs):
    """A registered target set over these inputs, with its own draw."""
    return _out(TS.targets_of(spark, name, inputs, seed=SEED))


@register("mc_prompt", f"""WITH {mc_items_sql('test')}
SELECT target_id, {HEADER_SQL} || {mc_body_sql()} AS prompt, answer AS label FROM m""")
def mc_prompt(spark, sf):
    m = mc_items(spark, sf, "test")
    return _out(m.select("target_id", F.concat(TG.mc_header("subject"), mc_body()).alias("prompt"),
                         F.col("answer").alias("label")))


@register("tgt_mmlu", f"""WITH {mc_items_sql('test')}
SELECT target_id, {chat_sql(HEADER_SQL + ' || ' + mc_body_sql())} || 'The answer is:' AS prompt, answer AS label FROM m""")
def tgt_mmlu(spark, sf):
    """All test items, zero-shot, chat format, cue appended."""
    return _set(spark, "mmlu", test=mc_items(spark, sf, "test"))


def _round_robin_sql(source: str, group: str, n: int) -> str:
    return f"""
rr AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {key_sql('target_id')}, target_id) AS pass FROM {source}),
pc AS (SELECT pass, count(*) AS c FROM rr GROUP BY pass),
pb AS (SELECT pass, sum(c) OVER (ORDER BY pass) - c AS before FROM pc),
dr AS (SELECT rr.* FROM rr JOIN pb USING (pass) WHERE before < {n}),
sh AS (SELECT *, row_number() OVER (ORDER BY {key_sql('target_id')}, target_id) AS shuffle_rank FROM dr)"""


@register("sample_round_robin", f"""WITH {mc_items_sql('dev')}, p AS (SELECT target_id, subject FROM m), {_round_robin_sql('p', 'subject', 45)}
SELECT target_id, subject, shuffle_rank FROM sh WHERE shuffle_rank <= 45""")
def sample_round_robin(spark, sf):
    m = mc_items(spark, sf, "dev").select("target_id", "subject")
    s = SA.sample_round_robin(m, "subject", 45, SEED, "target_id")
    return s.select("target_id", "subject", "shuffle_rank")


@register("tgt_mmlu_shots", f"""WITH {mc_items_sql('dev')},
p AS (SELECT target_id, subject, {chat_sql(HEADER_SQL + ' || ' + mc_body_sql())} || 'The answer is:' AS prompt, answer AS label FROM m),
{_round_robin_sql('p', 'subject', 285)}
SELECT target_id, prompt, label FROM sh WHERE shuffle_rank <= 285""")
def tgt_mmlu_shots(spark, sf):
    """Dev items as targets: one random item per subject per pass, then 285."""
    return _set(spark, "mmlu_shots", dev=mc_items(spark, sf, "dev"))


SHOTS_SQL = f"""
sd AS (SELECT subject, target_id AS sid, q AS sq, {mc_body_sql(True)} AS demo,
              row_number() OVER (PARTITION BY subject ORDER BY target_id) AS sr FROM m),
js AS (SELECT m.target_id, string_agg(sd.demo, '' ORDER BY sd.sr) AS shots, list(len(list_filter(string_split_regex(sd.demo, '[ ' || {NL} || ']+'), lambda t: t <> '')) ORDER BY sd.sr) AS shot_lens
       FROM m JOIN sd ON sd.subject = m.subject AND sd.sr <= 5 AND sd.sq <> m.q GROUP BY m.target_id)"""


def mc_with_shots(spark, sf, k=5):
    m = mc_items(spark, sf, "dev")
    demos = m.select("subject", "target_id", "q", mc_body(True).alias("demo"))
    return TG.attach_shots(m, demos, "subject", k, order_col="target_id", key_col="q", demo_col="demo")


@register("few_shot_loo", f"""WITH {mc_items_sql('dev')}, {SHOTS_SQL}
SELECT m.target_id, {HEADER_SQL} || coalesce(js.shots, '') || {mc_body_sql()} AS prompt, m.answer AS label
FROM m LEFT JOIN js USING (target_id)""")
def few_shot_loo(spark, sf):
    """Each dev item with the first five dev items of its subject as shots,
    minus any with the same question (leave-one-out)."""
    s = mc_with_shots(spark, sf)
    prompt = F.concat(TG.mc_header("subject"), TG.few_shot_prefix("shots", sep=""), mc_body())
    return _out(s.select("target_id", prompt.alias("prompt"), F.col("answer").alias("label")))


@register("tgt_mmlu_shots_shots", f"""WITH {mc_items_sql('dev')}, {SHOTS_SQL},
p AS (SELECT m.target_id, m.subject, {chat_sql(HEADER_SQL + " || coalesce(js.shots, '') || " + mc_body_sql())} || 'The answer is:' AS prompt,
             m.answer AS label FROM m LEFT JOIN js USING (target_id)),
{_round_robin_sql('p', 'subject', 285)}
SELECT target_id, prompt, label FROM sh WHERE shuffle_rank <= 285""")
def tgt_mmlu_shots_shots(spark, sf):
    return _set(spark, "mmlu_shots_shots", dev=mc_items(spark, sf, "dev"))


BUDGET = 128


@register("shot_budget", f"""WITH {mc_items_sql('dev')}, {SHOTS_SQL},
b AS (SELECT m.target_id, len(list_filter(string_split_regex({HEADER_SQL} || {mc_body_sql()}, '[ ' || {NL} || ']+'), lambda t: t <> '')) AS base,
             coalesce(js.shot_lens, []) AS lens FROM m LEFT JOIN js USING (target_id))
SELECT target_id, len(list_filter(list_transform(generate_series(1, len(lens)), lambda i: base + list_sum(lens[1:i])),
                                  lambda s: s <= {BUDGET}))::INT AS k FROM b""")
def shot_budget(spark, sf):
    """Largest number of shots whose prompt stays within the token budget."""
    s = mc_with_shots(spark, sf)
    base = F.size(C.tokens(F.concat(TG.mc_header("subject"), mc_body())))
    lens = F.transform("shots", lambda d: F.size(C.tokens(d)))
    return s.select(F.col("target_id").cast("long").alias("target_id"),
                    TG.shot_budget(base, lens, BUDGET).cast("int").alias("k"))


# ---------------------------------------------------------------- numeric items

def num_items(spark, sf, split: str):
    d = FX.table(spark, sf, "documents")
    lab = FX.table(spark, sf, "labels").select("doc_id")
    d = d.join(lab, "doc_id", "left_semi" if split == "dev" else "left_anti")
    lines = F.split("text", "\n")
    gold = T.strip_digit_commas(F.regexp_extract("text", r"\d[\d,]*(\.\d+)?", 0))
    n = F.size(lines)
    return d.select(F.col("doc_id").alias("target_id"), "source", "lang",
                    F.when(n > 1, F.array_join(F.slice(lines, F.lit(1), n - 1), "\n")).otherwise(F.col("text")).alias("question"),
                    gold.alias("answer"),
                    F.concat(F.when(n > 1, F.get(lines, n - 1)).otherwise(F.lit("")), F.lit(" So the answer is "), gold, F.lit("."))
                    .alias("cot_answer"), "text")


def num_items_sql(split: str, name: str = "g") -> str:
    cond = "IN" if split == "dev" else "NOT IN"
    gold = "regexp_replace(regexp_extract(text, '\\d[\\d,]*(\\.\\d+)?', 0), '(\\d),(\\d)', '\\1\\2', 'g')"
    return f"""{name} AS (SELECT doc_id AS target_id, source, lang, CASE WHEN len(ls) > 1 THEN array_to_string(ls[1:len(ls) - 1], {NL}) ELSE text END AS question, {gold} AS answer,
       CASE WHEN len(ls) > 1 THEN ls[len(ls)] ELSE '' END || ' So the answer is ' || {gold} || '.' AS cot_answer, text
       FROM (SELECT *, string_split(text, {NL}) AS ls FROM documents) WHERE doc_id {cond} (SELECT doc_id FROM labels))"""


@register("tgt_gsm8k", f"""WITH {num_items_sql('test')}, {num_items_sql('dev', 'e')},
ex AS (SELECT * FROM e ORDER BY target_id LIMIT 8),
pre AS (SELECT 'Answer the following questions.' || {NL} || {NL} ||
               string_agg('Question: ' || question || {NL} || 'Answer: ' || cot_answer, {NL} || {NL} ORDER BY target_id)
               || {NL} || {NL} AS prefix FROM ex),
p AS (SELECT target_id, {chat_sql(f"pre.prefix || 'Question: ' || trim(question, {WS})")} || 'Answer:' AS prompt, answer AS label
      FROM g, pre WHERE TRY_CAST(answer AS DOUBLE) IS NOT NULL)
SELECT target_id, prompt, label FROM p""")
def tgt_gsm8k(spark, sf):
    """Word problems with the eight worked examples as a prefix, all of them."""
    return _set(spark, "gsm8k", test=num_items(spark, sf, "test"), examples=num_items(spark, sf, "dev"))


@register("tgt_gsm8k_shots", f"""WITH {num_items_sql('dev', 'e')},
ex AS (SELECT * FROM e ORDER BY target_id LIMIT 8)
SELECT target_id, {chat_sql(f"'Answer the following question.' || {NL} || {NL} || 'Question: ' || trim(question, {WS})")} || 'Answer:' AS prompt,
       cot_answer AS label FROM ex""")
def tgt_gsm8k_shots(spark, sf):
    """The worked examples themselves as targets (label = worked answer)."""
    return _set(spark, "gsm8k_shots", examples=num_items(spark, sf, "dev"))


@register("tgt_gsm8k_shots_shots", f"""WITH {num_items_sql('dev', 'e')},
ex AS (SELECT *, 1 AS grp FROM e ORDER BY target_id LIMIT 8),
js AS (SELECT a.target_id, string_agg('Question: ' || b.question || {NL} || 'Answer: ' || b.cot_answer, {NL} || {NL} ORDER BY b.target_id) AS shots
       FROM ex a JOIN ex b ON a.grp = b.grp AND lower(b.question) <> lower(a.question) GROUP BY a.target_id)
SELECT ex.target_id, {chat_sql(f"'Answer the following questions.' || {NL} || {NL} || coalesce(js.shots, '') || {NL} || {NL} || 'Question: ' || trim(ex.question, {WS})")} || 'Answer:' AS prompt,
       ex.cot_answer AS label FROM ex LEFT JOIN js USING (target_id)""")
def tgt_gsm8k_shots_shots(spark, sf):
    """Each worked example with the other seven as shots (case-insensitive
    leave-one-out)."""
    return _set(spark, "gsm8k_shots_shots", examples=num_items(spark, sf, "dev"))


# ---------------------------------------------------------------- per-task prompts

TP_SQL = f"""tp AS (SELECT source AS task, row_number() OVER (ORDER BY source) AS prompt_id, 'Answer questions about ' || source || '.' ||
    string_agg({NL} || {NL} || 'Q: ' || replace(text, {NL}, ' ') || {NL} || 'A: It has ' || n_chars || ' characters. So the answer is ' || n_chars || '.', '' ORDER BY doc_id)
    || {NL} AS task_prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE rk <= {COT_SHOTS} GROUP BY source)"""


def task_prompts(spark, sf):
    """``task, task_prompt, prompt_id``: a prompt file per source with two lines of
    header, an introduction and the questions of its first three dev documents,
    written and read back by the reader of such files."""
    path = FX.scratch(spark, "cot-prompts")
    d = FX.table(spark, sf, "documents").join(FX.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    few = (d.withColumn("rk", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter(F.col("rk") <= COT_SHOTS))
    size = F.col("n_chars").cast("string")
    shot = F.concat(F.lit("\n\nQ: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nA: It has "), size, F.lit(" characters. So the answer is "), size, F.lit("."))
    made = few.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", shot.alias("s")))).alias("shots"))
    text = F.concat(F.lit("made for this test\n-----\nAnswer questions about "), "source", F.lit("."), F.array_join(F.transform("shots", lambda x: x["s"]), ""))
    made.select(F.col("source").alias("task"), text.alias("value")).write.partitionBy("task").text(path)
    return TS._prompts(spark, path)


@register("src_cot_text", f"WITH {TP_SQL} SELECT task, task_prompt FROM tp")
def src_cot_text(spark, sf):
    """One prompt file per task, read with its first two lines dropped."""
    return task_prompts(spark, sf).select("task", "task_prompt")


@register("sample_group_cap", f"""
SELECT doc_id, source, rk AS group_rank FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {key_sql('doc_id')}, doc_id) AS rk FROM documents)
WHERE rk <= 5""")
def sample_group_cap(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "source")
    s = SA.sample_group_cap(d, "source", 5, SEED, "doc_id")
    return s.select("doc_id", "source", F.col("group_rank").cast("long").alias("group_rank"))


@register("tgt_bbh", f"""WITH {num_items_sql('test')}, {TP_SQL},
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {key_sql('target_id')}, target_id) AS rk FROM g) WHERE rk <= 40),
p AS (SELECT target_id, {chat_sql(f"trim(tp.task_prompt, {WS}) || {NL} || {NL} || 'Q: ' || cap.question")} || 'A:' AS prompt, answer AS label
      FROM cap JOIN tp ON tp.task = cap.source)
SELECT target_id, prompt, label FROM p ORDER BY {key_sql('target_id')}, target_id LIMIT 270""")
def tgt_bbh(spark, sf):
    """At most 40 examples per task, each after its task's prompt text."""
    return _set(spark, "bbh", test=num_items(spark, sf, "test").withColumnRenamed("source", "task"), prompts=task_prompts(spark, sf))


PARTS_SQL = f"""{TP_SQL},
split AS (SELECT task, prompt_id, task_prompt, string_split(task_prompt, {NL} || {NL} || 'Q:') AS parts FROM tp),
parts AS (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM split)"""


@register("tgt_bbh_shots", f"""WITH {PARTS_SQL},
p AS (SELECT prompt_id * 1000 + pos - 1 AS target_id, parts[1] || {NL} || {NL} || 'Q:' || split_part(part, {NL} || 'A: ', 1) AS prompt, split_part(part, {NL} || 'A: ', 2) AS label
      FROM parts WHERE pos > 1)
SELECT * FROM p ORDER BY {key_sql('target_id')}, target_id LIMIT 81""")
def tgt_bbh_shots(spark, sf):
    """The questions inside the task prompts as targets, after the introduction."""
    return _set(spark, "bbh_shots", prompts=task_prompts(spark, sf))


@register("tgt_bbh_shots_shots", f"""WITH {PARTS_SQL},
p AS (SELECT prompt_id * 1000 + pos - 1 AS target_id,
        {chat_sql(f"trim(array_to_string(list_concat(parts[1:pos - 1], parts[pos + 1:]), {NL} || {NL} || 'Q:'), {WS}) || {NL} || {NL} || 'Q: ' || split_part(part, {NL} || 'A: ', 1)")} || 'A:' AS prompt,
        split_part(part, {NL} || 'A: ', 2) AS label
      FROM parts WHERE pos > 1)
SELECT * FROM p ORDER BY {key_sql('target_id')}, target_id LIMIT 270""")
def tgt_bbh_shots_shots(spark, sf):
    """Every question inside a task prompt as a target, after the rest of its prompt."""
    return _set(spark, "bbh_shots_shots", prompts=task_prompts(spark, sf))


# ---------------------------------------------------------------- reading comprehension

def truncate_sql(x: str, n: int) -> str:
    toks = f"list_filter(string_split_regex({x}, '[ ' || {NL} || ']+'), lambda t: t <> '')"
    return f"(CASE WHEN len({toks}) > {n} THEN array_to_string({toks}[1:{n}], ' ') ELSE {x} END)"


LANGUAGES = list(TG.QA_TEMPLATES)


def qa_items(spark, sf, split: str):
    """Passage items whose id begins with one of the nine languages, by turns."""
    name = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("target_id") % len(LANGUAGES) + 1).cast("int"))
    rows = num_items(spark, sf, split).withColumn("id", F.concat(name, F.lit("-"), F.col("target_id").cast("string")))
    return rows.select("target_id", F.split("id", "-")[0].alias("lang"), "text", "question", "answer")


def qa_items_sql(split: str, name: str) -> str:
    return (f"{num_items_sql(split, name + '_all')}, {name} AS (SELECT target_id, {LANGUAGES}[target_id % {len(LANGUAGES)} + 1] AS lang, text, question, answer FROM {name}_all)")


def template_sql(with_passage: bool = True) -> str:
    table = TG.QA_TEMPLATES if with_passage else {k: (v[0], "", *v[1:]) for k, v in TG.QA_TEMPLATES_NO_PASSAGE.items()}
    return "tpl AS (SELECT * FROM (VALUES " + ", ".join(str((k, *v)) for k, v in table.items()) + ") t(lang, intro, pt, qt, acue))"


def _qa_sql(with_passage: bool) -> str:
    """The three forms' prompts over ``t`` (targets) and ``s`` (shots)."""
    def block(x, cut):
        text = truncate_sql(f"{x}.text", TS.QA_TOKENS) if cut else f"{x}.text"
        return (f"tpl.pt || ' ' || {text} || {NL} || " if with_passage else "") + f"tpl.qt || ' ' || {x}.question || {NL}"

    def prompt(shot, cut):
        demo = f"{block('s', cut)} || tpl.acue || ' ' || s.answer || {NL} || {NL} || " if shot else ""
        return f"{chat_sql(f'tpl.intro || {NL} || {NL} || {demo}{block(chr(116), cut)}')} || tpl.acue"
    return prompt


def _first_sql(source: str, n: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {key_sql('target_id')}, target_id) AS rk FROM {source}) WHERE rk <= {n})"


def tydiqa_sql(with_passage: bool = True) -> str:
    return f"""WITH {qa_items_sql('test', 'g')}, {qa_items_sql('dev', 'e')}, {template_sql(with_passage)},
p AS (SELECT t.target_id, {_qa_sql(with_passage)(True, True)} AS prompt, t.answer AS label
      FROM {_first_sql('g', TS.QA_PER_LANGUAGE)} t JOIN tpl USING (lang) JOIN {_first_sql('e', 1)} s USING (lang))
SELECT target_id, prompt, label FROM p ORDER BY {key_sql('target_id')}, target_id LIMIT 90"""


@register("tgt_tydiqa", tydiqa_sql())
def tgt_tydiqa(spark, sf):
    """Passage QA per language: at most 100 items and one shot per language,
    passages cut at 1,024 tokens, the language's template around them."""
    return _set(spark, "tydiqa", dev=qa_items(spark, sf, "test"), train=qa_items(spark, sf, "dev"))


@register("tgt_tydiqa_no_passage", tydiqa_sql(False))
def tgt_tydiqa_no_passage(spark, sf):
    """The same with the templates that have no passage."""
    return _out(TS.tydiqa({"dev": qa_items(spark, sf, "test"), "train": qa_items(spark, sf, "dev")}, 90, SEED, with_passage=False))


@register("tgt_tydiqa_shots", f"""WITH {qa_items_sql('dev', 'e')}, {template_sql()}
SELECT t.target_id, {_qa_sql(True)(False, False)} AS prompt, t.answer AS label FROM {_first_sql('e', 1)} t JOIN tpl USING (lang)""")
def tgt_tydiqa_shots(spark, sf):
    """The per-language shots themselves as targets (passages not cut)."""
    return _set(spark, "tydiqa_shots", train=qa_items(spark, sf, "dev"))


@register("tgt_tydiqa_shots_shots", f"""WITH {qa_items_sql('dev', 'e')}, {template_sql()}, two AS {_first_sql('e', 2)}
SELECT t.target_id, {_qa_sql(True)(True, False)} AS prompt, t.answer AS label
FROM (SELECT * FROM two WHERE rk = 1) t JOIN (SELECT * FROM two WHERE rk = 2) s USING (lang) JOIN tpl USING (lang)""")
def tgt_tydiqa_shots_shots(spark, sf):
    """Two items per language: the first is the target, the second its shot."""
    return _set(spark, "tydiqa_shots_shots", train=qa_items(spark, sf, "dev"))


@register("join_template", f"""WITH {qa_items_sql('test', 'g')}, {template_sql()}, short AS (SELECT lang, qt, acue FROM ({'WITH ' + template_sql(False) + ' SELECT * FROM tpl'}) x)
SELECT target_id, g.lang, tpl.intro, tpl.qt AS question_cue, tpl.acue AS answer_cue, short.qt AS short_question_cue FROM g JOIN tpl USING (lang) JOIN short USING (lang)""")
def join_template(spark, sf):
    """Language -> template, in both forms: as many rows as there are items."""
    rows = qa_items(spark, sf, "test").select("target_id", "lang", TG.template("lang").alias("t"), TG.template("lang", False).alias("s"))
    return rows.select("target_id", "lang", "t.intro", F.col("t.question").alias("question_cue"), F.col("t.answer").alias("answer_cue"),
                       F.col("s.question").alias("short_question_cue"))


@register("sample_n_shot", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {key_sql('doc_id')}, doc_id) AS rk
                          FROM documents) WHERE rk <= 2""")
def sample_n_shot(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "lang")
    return SA.sample_n_shot(d, "lang", 2, SEED, "doc_id").select("doc_id", "lang")


@register("sample_shuffle_take", f"""
SELECT doc_id, row_number() OVER (ORDER BY {key_sql('doc_id')}, doc_id) AS shuffle_rank FROM documents
ORDER BY {key_sql('doc_id')}, doc_id LIMIT 50""")
def sample_shuffle_take(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id")
    return SA.sample_shuffle_take(d, 50, SEED, "doc_id").select("doc_id", "shuffle_rank")


# ---------------------------------------------------------------- instruction / response pairs

PAIRS_SQL = """
c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM conversations),
pr AS (SELECT conv_id, arg_min(text, idx) FILTER (WHERE role = 'user') AS instruction,
              arg_min(text, idx) FILTER (WHERE role = 'assistant') AS output FROM c GROUP BY conv_id)"""


def pairs(spark, sf):
    m = FX.conversation_messages(spark, sf)
    first = lambda role: F.get(F.filter("messages", lambda x: x["role"] == role), 0)["content"]
    return m.select(F.col("conv_id").alias("target_id"), first("user").alias("instruction"),
                    first("assistant").alias("output"))


def _instruction_pairs(name: str, of: str, n: int):
    """Instruction -> reference output, stripped, chat format; a draw of n."""
    @register(name, f"""WITH {PAIRS_SQL}
SELECT conv_id AS target_id, {chat_sql(f"trim(instruction, {WS})")} AS prompt, trim(output, {WS}) AS label
FROM pr WHERE instruction IS NOT NULL AND output IS NOT NULL ORDER BY {key_sql('conv_id')}, conv_id LIMIT {n}""")
    def build(spark, sf):
        return _set(spark, of, pairs=pairs(spark, sf))
    return build


tgt_alpacafarm = _instruction_pairs("tgt_alpacafarm", "alpacafarm", 50)
tgt_arena_hard = _instruction_pairs("tgt_arena_hard", "arena_hard", 500)
tgt_wildchat = _instruction_pairs("tgt_wildchat", "wildchat", 100)


def passages(spark, sf):
    """The document of each benchmark item as passage, its text as question; the
    answer, a passage's first span, is its first line."""
    b, d = FX.table(spark, sf, "benchmark"), FX.table(spark, sf, "documents")
    return b.join(d, b.item_id == d.doc_id).select(F.col("item_id").alias("target_id"), d.text.alias("text"), b.text.alias("question"),
                                                   F.get(F.split(d.text, "\n"), 0).alias("answer"))


@register("tgt_squad", f"""
SELECT b.item_id AS target_id, {chat_sql(f"d.text || {NL} || {NL} || b.text")} AS prompt, string_split(d.text, {NL})[1] AS label
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id ORDER BY {key_sql('b.item_id')}, b.item_id LIMIT 500""")
def tgt_squad(spark, sf):
    """Passage + blank line + question -> first answer."""
    return _set(spark, "squad", rows=passages(spark, sf))


def _codex_inputs(spark, sf):
    problems = FX.table(spark, sf, "benchmark").join(FX.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("solution")), "item_id")
    named = F.concat(F.lit("HumanEval/"), F.col("item_id").cast("string"))
    instructions = FX.table(spark, sf, "documents").select(F.replace(F.concat(F.lit("Python/"), F.col("doc_id").cast("string")), F.lit("Python"), F.lit("HumanEval")).alias("task_id"),
                                                          F.concat("source", F.lit(": "), "text").alias("instruction"))
    return problems.select(F.col("item_id").alias("target_id"), named.alias("task_id"), F.col("text").alias("problem"), "solution"), instructions


@register("tgt_codex", f"""
WITH pb AS (SELECT 'HumanEval/' || item_id AS task_id, item_id, text AS problem FROM benchmark),
ins AS (SELECT replace('Python/' || doc_id, 'Python', 'HumanEval') AS task_id, source || ': ' || text AS instruction, text AS solution FROM documents)
SELECT pb.item_id AS target_id, {chat_sql('ins.instruction')} || 'Here is the function:' || {NL} || {NL} || '```python' || {NL} || pb.problem AS prompt,
       ins.solution AS label
FROM pb JOIN ins USING (task_id) ORDER BY {key_sql('pb.item_id')}, pb.item_id LIMIT 100""")
def tgt_codex(spark, sf):
    """Problems with instructions looked up by the rewritten task id; a problem
    without one raises."""
    problems, instructions = _codex_inputs(spark, sf)
    return _set(spark, "codex", problems=problems, instructions=instructions)


@register("tgt_codex_no_instructions", f"""
SELECT item_id AS target_id, {chat_sql(f"'Complete the following python function.' || {NL} || {NL} || {NL} || b.text")} || 'Here is the completed function:' || {NL} || {NL} || {NL} AS prompt, d.text AS label
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id ORDER BY {key_sql('item_id')}, item_id LIMIT 100""")
def tgt_codex_no_instructions(spark, sf):
    """Without the table of instructions: the problem itself is asked for."""
    return _set(spark, "codex", problems=_codex_inputs(spark, sf)[0])


@register("tgt_debug_subset", f"""WITH
c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM conversations),
r AS (SELECT conv_id, trim(string_agg(CASE role WHEN 'system' THEN '<|system|>' || {NL} || trim(text, {WS}) || {NL}
                                 WHEN 'user' THEN '<|user|>' || {NL} || trim(text, {WS}) || {NL}
                                 ELSE '<|assistant|>' || {NL} || trim(text, {WS}) || '</s>' || {NL} END, '' ORDER BY idx), {WS}) AS prompt
      FROM c GROUP BY conv_id)
SELECT conv_id AS target_id, prompt, '' AS label FROM r ORDER BY conv_id LIMIT 100""")
def tgt_debug_subset(spark, sf):
    """The first 100 pool conversations, default rendering (rows known to be
    in the pool, for sanity runs)."""
    pool = FX.conversation_messages(spark, sf).withColumnRenamed("conv_id", "target_id")
    return _out(TS.build(spark, "debug_subset", {"pool": pool}))
