"""Parts of target-set builders: source rows -> prompt text -> seeded sample.

Text templates and few-shot helpers; the target sets themselves, their input
files and options are in :mod:`sieve.plans.target_sets`.

Text templates are Column expressions; few-shot blocks are built from a
bounded set of shots per group (never a pairing of all rows of a group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.functions import text as T
from sieve.operators import sampling as SA

# Multiple-choice letters and the answer cue of the reference's
# multiple-choice prompt.
CHOICES = ("A", "B", "C", "D")
ANSWER_CUE = "Answer:"
MC_HEADER = "The following are multiple choice questions (with answers) about "
COT_CUE = "The answer is:"
GSM_PREFIX = "Answer the following questions.\n\n"
GSM_PREFIX_ONE = "Answer the following question.\n\n"
BBH_CUE = "A:"
CODE_INSTRUCTION = "Complete the following python function.\n\n\n"
CODE_ANSWER = "Here is the completed function:\n\n\n"
CODE_ANSWER_WITH_INSTRUCTIONS = "Here is the function:\n\n```python\n"
# Reading-comprehension templates by language (instruction, passage, question and answer cues).
QA_TEMPLATES = {
    "english": ("Answer the following question based on the information in the given passage.", "Passage:", "Question:", "Answer:"),
    "arabic": ("أجب على السؤال التالي بناءً على المعلومات في المقطع المعطى.", "المقطع:", "السؤال:", "الإجابة:"),
    "bengali": ("প্রদত্ত অধ্যায়ের তথ্যের উপর ভিত্তি করে নিম্নলিখিত প্রশ্নের উত্তর দিন।", "অধ্যায়:", "প্রশ্ন:", "উত্তর:"),
    "finnish": ("Vastaa seuraavaan kysymykseen annetun kappaleen tiedon perusteella.", "Kappale:", "Kysymys:", "Vastaus:"),
    "indonesian": ("Jawab pertanyaan berikut berdasarkan informasi di bagian yang diberikan.", "Bagian:", "Pertanyaan:", "Jawaban:"),
    "korean": ("주어진 문단의 정보에 기반하여 다음 질문에 답하십시오.", "문단:", "질문:", "답변:"),
    "russian": ("Ответьте на следующий вопрос на основе информации в данном отрывке.", "Отрывок:", "Вопрос:", "Ответ:"),
    "swahili": ("Jibu swali lifuatalo kulingana na habari kwenye kifungu kilichotolewa.", "Kifungu:", "Swali:", "Jibu:"),
    "telugu": ("ఇచ్చిన పేరాలోని సమాచారం ఆధారంగా కింది ప్రశ్నకు సమాధానం ఇవ్వండి.", "పేరా:", "ప్రశ్న:", "సమాధానం:"),
}
# The same without a passage (instruction, question and answer cues).
QA_TEMPLATES_NO_PASSAGE = {
    "english": ("Answer the following question.", "Question:", "Answer:"),
    "arabic": ("أجب على السؤال التالي.", "السؤال:", "الإجابة:"),
    "bengali": ("নিম্নলিখিত প্রশ্নের উত্তর দিন।", "প্রশ্ন:", "উত্তর:"),
    "finnish": ("Vastaa seuraavaan kysymykseen.", "Kysymys:", "Vastaus:"),
    "indonesian": ("Jawab pertanyaan berikut.", "Pertanyaan:", "Jawaban:"),
    "korean": ("다음 질문에 답하십시오.", "질문:", "답변:"),
    "russian": ("Ответьте на следующий вопрос.", "Вопрос:", "Ответ:"),
    "swahili": ("Jibu swali lifuatalo.", "Swali:", "Jibu:"),
    "telugu": ("క్రింది ప్రశ్నకు సమాధానం ఇవ్వండి.", "ప్రశ్న:", "సమాధానం:"),
}


# --------------------------------------------------------------------------
# templates
# --------------------------------------------------------------------------

def subject_words(subject) -> Column:
    """``abstract_algebra`` -> `` abstract algebra`` (leading space per word)."""
    parts = F.split(T.col(subject), "_")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.lit(" "), w)), "")


def mc_prompt(question, options: list, answer=None, include_answer: bool = False) -> Column:
    """Question, then ``\\nA. option`` for each choice, then ``\\nAnswer:``
    (``include_answer`` appends `` X\\n\\n`` for a demonstration)."""
    pieces = [T.col(question)]
    for letter, opt in zip(CHOICES, options):
        pieces += [F.lit(f"\n{letter}. "), T.col(opt)]
    pieces.append(F.lit("\n" + ANSWER_CUE))
    if include_answer:
        pieces += [F.lit(" "), T.col(answer), F.lit("\n\n")]
    return F.concat(*pieces)


def mc_header(subject) -> Column:
    """Header naming the subject; the subject words carry a leading space, so
    the header has two spaces after "about" (as in the reference)."""
    return F.concat(F.lit(MC_HEADER), subject_words(subject), F.lit(".\n\n"))


def few_shot_prefix(shots, k: int | Column | None = None, sep: str = "\n\n") -> Column:
    """First k demonstrations (``array<string>``) joined; k None or -1 = all."""
    s = T.col(shots)
    if k is not None and not (isinstance(k, int) and k < 0):
        k = F.lit(k) if isinstance(k, int) else k
        s = F.slice(s, F.lit(1), F.greatest(k, F.lit(0)))
    return F.array_join(s, sep)


def gsm_demo(question, answer, cot: bool = True) -> Column:
    """One worked example. The non-CoT branch spells ``Quesion`` as the
    reference does (fixed value)."""
    if cot:
        return F.concat(F.lit("Question: "), T.col(question), F.lit("\nAnswer: "), T.col(answer))
    return F.concat(F.lit("Quesion: "), T.col(question), F.lit("\nAnswer: "), T.col(answer))


def template(lang, with_passage: bool = True) -> Column:
    """A language's template as a struct of ``intro, passage, question, answer``
    (``passage`` empty without one). A literal map, so no row is lost to a join; a
    language without a template raises, as the reference does."""
    table = QA_TEMPLATES if with_passage else {k: (v[0], "", *v[1:]) for k, v in QA_TEMPLATES_NO_PASSAGE.items()}
    names = ("intro", "passage", "question", "answer")
    entries = [x for k, v in table.items() for x in (F.lit(k), F.struct(*[F.lit(t).alias(n) for n, t in zip(names, v)]))]
    found = F.try_element_at(F.create_map(*entries), T.col(lang))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no template for language "), F.coalesce(T.col(lang), F.lit("null")))))


def cot_blocks(task_prompt) -> Column:
    """A worked-examples prompt as a struct of ``intro`` and ``blocks``, an array of
    (pos, question, answer, start, end): what stands before the first blank line
    followed by ``Q:``, and each such block with its place in the prompt, in
    characters, from the blank line on; the question with its ``Q:``, up to the
    ``A:`` that begins a line. ``task_prompt`` must be a plain column."""
    sep, cue = "\n\nQ:", "\nA: "
    text = T.col(task_prompt)
    parts = F.split(text, sep, -1)
    # where part i ends: the lengths of all parts to it and of the separators between them
    end = lambda i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.lit(len(sep)) * i
    block = lambda p, i: F.struct(                                                                                               # noqa: E731
        i.alias("pos"), F.concat(F.lit("Q:"), F.split_part(p, F.lit(cue), F.lit(1))).alias("question"),
        F.split_part(p, F.lit(cue), F.lit(2)).alias("answer"), (end(i) - F.length(p) - len(sep)).alias("start"), end(i).alias("end"))
    return F.struct(F.get(parts, 0).alias("intro"), F.filter(F.transform(parts, block), lambda b: b["pos"] > 0).alias("blocks"))


def code_prompt(description, test_list) -> Column:
    """Docstring holding the description and the first test."""
    return F.concat(F.lit('"""\n'), T.col(description), F.lit("\n"), F.element_at(T.col(test_list), 1),
                    F.lit('\n"""\n'))


def check_program(prompt, completion, tests, entry_point) -> Column:
    """Text of the program a sandbox would run (never executed here)."""
    return F.concat(T.col(prompt), T.col(completion), F.lit("\n"), T.col(tests), F.lit("\ncheck("),
                    T.col(entry_point), F.lit(")"))


def chat_wrap(prompt) -> Column:
    """Prompt as one user turn in chat format (ends with the assistant tag)."""
    return C.chat_prompt(F.array(F.struct(F.lit("user").alias("role"), T.col(prompt).alias("content"))))


# --------------------------------------------------------------------------
# few-shot helpers
# --------------------------------------------------------------------------

def attach_shots(rows: DataFrame, shots: DataFrame, group: str, k: int | None, order_col: str,
                 key_col: str, demo_col: str, case_insensitive: bool = False) -> DataFrame:
    """Give every row the first k demonstrations of its group (in ``order_col``
    order), minus those whose key equals the row's own (leave-one-out without
    refilling, as the reference does); k None = all shots of the group.

    The shots of a group are gathered into one small array (bounded by k) and
    joined to the rows on the group key, so the work is linear in the rows;
    no pairing of all rows of a group is formed. Adds ``shots array<string>``
    and ``shot_keys``.
    """
    cand = shots
    if k is not None:
        w = Window.partitionBy(group).orderBy(order_col)
        cand = shots.withColumn("_sr", F.row_number().over(w)).filter(F.col("_sr") <= k).drop("_sr")
    per_group = cand.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(key_col).alias("key"),
                                             F.col(demo_col).alias("demo")))).alias("_shots"))
    norm = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    own = F.col(key_col)
    kept = F.filter(F.coalesce(F.col("_shots"), F.array().cast(per_group.schema["_shots"].dataType)),
                    lambda s: norm(s["key"]) != norm(own))
    return (rows.join(per_group, group, "left")
            .withColumn("shots", F.transform(kept, lambda s: s["demo"]))
            .drop("_shots"))


def shot_budget(base_len, shot_lens, budget: int) -> Column:
    """Largest k with ``base + sum(first k shot lengths) <= budget`` (closed
    form of the reference's retry loop; floor 0)."""
    prefix = F.aggregate(T.col(shot_lens), F.struct(F.lit(0).alias("k"), F.lit(0).alias("used"), F.lit(True).alias("ok")),
                         lambda acc, x: F.struct(
                             F.when(acc["ok"] & (T.col(base_len) + acc["used"] + x <= budget), acc["k"] + 1)
                             .otherwise(acc["k"]).alias("k"),
                             F.when(acc["ok"] & (T.col(base_len) + acc["used"] + x <= budget), acc["used"] + x)
                             .otherwise(acc["used"]).alias("used"),
                             (acc["ok"] & (T.col(base_len) + acc["used"] + x <= budget)).alias("ok")))
    return prefix["k"]


def finish(df: DataFrame, num_samples: int | None, seed: int, id_col: str = "target_id") -> DataFrame:
    """Seeded shuffle and first ``num_samples`` (all when None)."""
    return SA.sample_shuffle_take(df, num_samples, seed, id_col)
