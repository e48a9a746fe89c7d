"""Target sets by name, from files or DataFrames, with the reference's options.

A :class:`TargetSet` names its inputs (a path below the data folder and a reader
for each), a recipe that turns them into ``target_id, prompt, label`` with its
draw, and the defaults of ``num_samples`` and ``max_length``. ``build`` reads what
it is not given, runs the recipe and adds the sample's tokens and labels::

    build(spark, "mmlu_shots", "/data/eval", num_samples=100, max_length=512)
    build(spark, "gsm8k", {"test": problems, "examples": worked}, prompt_only=True)

Recipes take plain columns (named in each docstring), so the catalog's queries,
files and a user's own tables go through the same code. ``register`` adds a set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.functions import text as T
from sieve.operators import sampling as SA
from sieve.plans import targets as TG
from sieve.sources import readers as RD

QA_TOKENS = 1024            # a passage is cut after so many tokens
QA_PER_LANGUAGE = 100
BBH_PER_TASK = 40

Inputs = dict[str, DataFrame]


@dataclass(frozen=True)
class TargetSet:
    make: Callable[[Inputs, int | None, int], DataFrame]          # inputs, num_samples, seed
    files: Mapping[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = field(default_factory=dict)
    num_samples: int | None = None
    max_length: int = 2048
    optional: frozenset[str] = frozenset()                        # inputs that may be missing
    whole: bool = False                                           # whole conversations (``messages``): no prompt and label


REGISTRY: dict[str, TargetSet] = {}


def register(name: str, **options):
    """Decorator: the function becomes the recipe of the target set ``name``."""
    def deco(make):
        REGISTRY[name] = TargetSet(make, **options)
        return make
    return deco


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def inputs_of(spark: SparkSession, target_set: TargetSet, data: str | Inputs) -> Inputs:
    given = {} if isinstance(data, str) else dict(data)
    for name, (path, read) in target_set.files.items():
        if name in given:
            continue
        if not isinstance(data, str) or not _exists(spark, f"{data.rstrip('/')}/{path}"):
            if name in target_set.optional:
                continue
            raise FileNotFoundError(f"input {name!r} of the target set is not given" if not isinstance(data, str) else f"{data}/{path} is missing")
        given[name] = read(spark, f"{data.rstrip('/')}/{path}")
    return given


def targets_of(spark: SparkSession, name: str, data: str | Inputs, num_samples: int | None = None, seed: int = 42) -> DataFrame:
    """``target_id, prompt, label`` of a registered set (of whole conversations
    ``target_id, messages`` and the like), after its draw. ``num_samples`` None is
    the set's own default; -1 takes all."""
    if name not in REGISTRY:
        raise ValueError(f"unknown target set {name!r}; registered: {', '.join(sorted(REGISTRY))}")
    s = REGISTRY[name]
    n = s.num_samples if num_samples is None else None if num_samples < 0 else num_samples
    return s.make(inputs_of(spark, s, data), n, seed)


def build(spark: SparkSession, name: str, data: str | Inputs, num_samples: int | None = None, seed: int = 42, max_length: int | None = None,
          prompt_only: bool = False, response_only: bool = False) -> DataFrame:
    """``target_id, prompt, label, tokens, labels``: the drawn targets and what a
    model is given for each, ``labels`` null where masked. Prompt and label are cut
    at ``max_length`` tokens each; a set of whole conversations is cut as a whole, and
    has no ``prompt_only`` and ``response_only`` (it raises)."""
    rows = targets_of(spark, name, data, num_samples, seed)
    s = REGISTRY[name]
    n = s.max_length if max_length is None else max_length
    if s.whole:
        if prompt_only or response_only:
            raise ValueError(f"prompt_only and response_only are not supported for {name}")
        return whole_samples(rows, n)
    sample = C.target_sample("prompt", "label", n, prompt_only, response_only)
    return rows.select("target_id", "prompt", "label").withColumn("s", sample).select("target_id", "prompt", "label", "s.tokens", "s.labels")


def whole_samples(rows: DataFrame, n: int) -> DataFrame:
    """Samples of pool rows: ``messages`` and, where there are, ``mid`` and
    ``system_message``; the label text is empty."""
    mid = F.col("mid") if "mid" in rows.columns else F.lit(None).cast("string")
    said = F.col("system_message") if "system_message" in rows.columns else F.lit(None).cast("string")
    made = rows.select("target_id", C.row_pieces("messages", mid, said).alias("pieces"))
    made = made.select("target_id", C.pieces_text("pieces").alias("prompt"), F.lit("").alias("label"), C.token_labels("pieces", n).alias("s"))
    return made.select("target_id", "prompt", "label", "s.tokens", "s.labels")


# --------------------------------------------------------------------------
# readers of the reference's files; every row gets an id
# --------------------------------------------------------------------------

def _lines(spark: SparkSession, path: str) -> DataFrame:
    return RD.with_row_position(spark.read.json(path), "target_id")


def _array(spark: SparkSession, path: str) -> DataFrame:
    return RD.with_row_position(spark.read.option("multiLine", True).json(path), "target_id")


def _subjects(split: str):
    def read(spark: SparkSession, path: str) -> DataFrame:
        df = RD.read_csv_by_subject(spark, path, ("q", "a", "b", "c", "d", "answer"), split)
        return RD.with_row_position(df, "target_id")
    return read


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """An id from the keys of a row: the same wherever the row is read."""
    return df.withColumn("target_id", F.xxhash64(*keys))


def _qa(spark: SparkSession, path: str) -> DataFrame:
    rows = RD.read_nested_qa(spark, path)
    return _numbered(rows.select("id", "lang", F.col("context").alias("text"), "question", F.get("answers", 0).alias("answer")), "id")


def _problems(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(RD.read_problems(spark, path), "task_id").select(
        "target_id", "task_id", F.col("prompt").alias("problem"), F.col("canonical_solution").alias("solution"))


def _instructions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select(F.replace("task_id", F.lit("Python"), F.lit("HumanEval")).alias("task_id"), "instruction")


def _word_problems(spark: SparkSession, path: str) -> DataFrame:
    gold = T.strip_digit_commas(T.strip(F.element_at(F.split("answer", "####"), -1)))
    return _lines(spark, path).select("target_id", "question", gold.alias("answer"))


def _worked(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select("target_id", "question", "cot_answer", F.col("short_answer").alias("answer"))


def _tasks(spark: SparkSession, path: str) -> DataFrame:
    rows = RD.read_task_examples(spark, path)
    return _numbered(rows.select("task", "pos", F.col("input").alias("question"), F.col("target").alias("answer")), "task", "pos")


def _prompts(spark: SparkSession, path: str) -> DataFrame:
    """One row per task; ``prompt_id`` is the task's place in the order of names."""
    rows = RD.read_cot_prompts(spark, path)
    return rows.withColumn("prompt_id", F.row_number().over(Window.orderBy("task")).cast("long"))          # one row per task file


def _flat_qa(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select("target_id", F.col("context").alias("text"), "question", F.get("answers.text", 0).alias("answer"))


def _pairs(prompt: str, label: str):
    return lambda spark, path: _lines(spark, path).select("target_id", F.col(prompt).alias("instruction"), F.col(label).alias("output"))


def _array_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _array(spark, path).select("target_id", "instruction", "output")


def _code(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select(F.col("task_id").cast("long").alias("target_id"), F.col("prompt").alias("description"), "code", "test_list")


def _pool(spark: SparkSession, path: str) -> DataFrame:
    return RD.read_file_target(spark, path).withColumnRenamed("row_pos", "target_id")


def _groups(spark: SparkSession, path: str) -> DataFrame:
    return RD.read_lines_by_file(spark, path).select(F.col("row_pos").alias("target_id"), F.concat_ws("_", "label", "group").alias("source"), "text")


# --------------------------------------------------------------------------
# recipes
# --------------------------------------------------------------------------

def _rows(df: DataFrame, prompt: Column, label) -> DataFrame:
    return df.select("target_id", prompt.alias("prompt"), T.col(label).alias("label"))


def _ask(content, cue: str | None = None) -> Column:
    chat = TG.chat_wrap(content)
    return chat if cue is None else T.suffix_cue(chat, cue)


def _mc(include_answer: bool = False) -> Column:
    return TG.mc_prompt("q", list("abcd"), "answer", include_answer)


@register("mmlu", files={"test": ("mmlu/test", _subjects("test"))}, max_length=512)
def mmlu(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``test``: target_id, subject, q, a, b, c, d, answer. All, zero-shot."""
    return TG.finish(_rows(i["test"], _ask(F.concat(TG.mc_header("subject"), _mc()), TG.COT_CUE), "answer"), n, seed)


@register("mmlu_cot", files={"test": ("mmlu/test", _subjects("test"))}, num_samples=114, max_length=512)
def mmlu_cot(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """As mmlu, without header and cue."""
    return TG.finish(_rows(i["test"], _ask(_mc()), "answer"), n, seed)


def _by_subject(rows: DataFrame, content: Column, n: int | None, seed: int) -> DataFrame:
    """One random item per subject and pass until n are drawn."""
    p = rows.select("target_id", "subject", _ask(content, TG.COT_CUE).alias("prompt"), F.col("answer").alias("label"))
    return TG.finish(p, None, seed) if n is None else SA.sample_round_robin(p, "subject", n, seed, "target_id")


@register("mmlu_shots", files={"dev": ("mmlu/dev", _subjects("dev"))}, num_samples=285, max_length=512)
def mmlu_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``dev``: columns as mmlu's; the dev items as targets."""
    return _by_subject(i["dev"], F.concat(TG.mc_header("subject"), _mc()), n, seed)


@register("mmlu_shots_shots", files={"dev": ("mmlu/dev", _subjects("dev"))}, num_samples=285, max_length=512)
def mmlu_shots_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """Each dev item after the first five of its subject, itself left out."""
    demos = i["dev"].select("subject", "target_id", "q", _mc(True).alias("demo"))
    rows = TG.attach_shots(i["dev"], demos, "subject", 5, order_col="target_id", key_col="q", demo_col="demo")
    return _by_subject(rows, F.concat(TG.mc_header("subject"), TG.few_shot_prefix("shots", sep=""), _mc()), n, seed)


def _first_examples(examples: DataFrame, n: int) -> DataFrame:
    return examples.orderBy("target_id").limit(n)


@register("gsm8k", files={"test": ("gsm/test.jsonl", _word_problems), "examples": ("gsm/examples.jsonl", _worked)})
def gsm8k(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``test``: target_id, question, answer; ``examples``: target_id, question,
    cot_answer. The first eight examples stand before every question. Their text is a
    one-row side, read with the job; an answer that is no number drops its row."""
    s = F.struct("target_id", TG.gsm_demo("question", "cot_answer").alias("d"))
    prefix = _first_examples(i["examples"], 8).agg(F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["d"]), "\n\n").alias("shots"))
    test = i["test"].filter(F.col("answer").try_cast("double").isNotNull()).withColumn("shots", prefix.scalar())
    content = F.concat(F.lit(TG.GSM_PREFIX), "shots", F.lit("\n\nQuestion: "), T.strip("question"))
    return TG.finish(_rows(test, _ask(content, "Answer:"), "answer"), n, seed)


@register("gsm8k_shots", files={"examples": ("gsm/examples.jsonl", _worked)}, num_samples=8)
def gsm8k_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """The worked examples as targets (label: the worked answer)."""
    content = F.concat(F.lit(TG.GSM_PREFIX_ONE + "Question: "), T.strip("question"))
    return TG.finish(_rows(_first_examples(i["examples"], 8), _ask(content, "Answer:"), "cot_answer"), n, seed)


@register("gsm8k_shots_shots", files={"examples": ("gsm/examples.jsonl", _worked)}, num_samples=8)
def gsm8k_shots_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """Each worked example after the others; equal questions, whatever their case, are left out."""
    ex = _first_examples(i["examples"], 8).withColumn("all", F.lit(0))
    demos = ex.select("all", "target_id", "question", TG.gsm_demo("question", "cot_answer").alias("demo"))
    rows = TG.attach_shots(ex, demos, "all", 8, order_col="target_id", key_col="question", demo_col="demo", case_insensitive=True)
    content = F.concat(F.lit(TG.GSM_PREFIX), F.array_join("shots", "\n\n"), F.lit("\n\nQuestion: "), T.strip("question"))
    return TG.finish(_rows(rows, _ask(content, "Answer:"), "cot_answer"), n, seed)


BBH_PROMPTS = ("bbh/cot-prompts", _prompts)


@register("bbh", files={"test": ("bbh/bbh", _tasks), "prompts": BBH_PROMPTS}, num_samples=270)
def bbh(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``test``: target_id, task, question, answer; ``prompts``: task, task_prompt,
    prompt_id. At most 40 examples a task, after its task's prompt."""
    rows = SA.sample_group_cap(i["test"], "task", BBH_PER_TASK, seed, "target_id").join(i["prompts"], "task")
    content = F.concat(T.strip("task_prompt"), F.lit("\n\nQ: "), "question")
    return TG.finish(_rows(rows, _ask(content, TG.BBH_CUE), "answer"), n, seed)


def cot_questions(prompts: DataFrame) -> DataFrame:
    """``target_id, task, task_prompt, intro, pos, question, answer, start, end``: a
    row per worked question; its id is a thousand of the prompt's and its place. More
    than 999 questions in a prompt raise."""
    cut = prompts.select("task", "task_prompt", "prompt_id", TG.cot_blocks("task_prompt").alias("p"))
    cut = cut.withColumn("p", F.when(F.size("p.blocks") < 1000, F.col("p")).otherwise(F.raise_error(F.lit("over 999 questions in a prompt"))))
    cut = cut.select("task", "task_prompt", "prompt_id", F.col("p.intro").alias("intro"), F.explode("p.blocks").alias("b"))
    return cut.select((F.col("prompt_id") * 1000 + F.col("b.pos")).alias("target_id"), "task", "task_prompt", "intro", "b.*")


@register("bbh_shots", files={"prompts": BBH_PROMPTS}, num_samples=81)
def bbh_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """The questions of the prompts as targets, each after its task's introduction."""
    return TG.finish(_rows(cot_questions(i["prompts"]), F.concat("intro", F.lit("\n\n"), "question"), "answer"), n, seed)


@register("bbh_shots_shots", files={"prompts": BBH_PROMPTS}, num_samples=270)
def bbh_shots_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """Each question after the rest of its prompt, its own block cut out."""
    rows = cot_questions(i["prompts"])
    rest = F.concat(F.substring("task_prompt", F.lit(1), F.col("start")), F.substring("task_prompt", F.col("end") + 1, F.length("task_prompt")))
    return TG.finish(_rows(rows, _ask(F.concat(T.strip(rest), F.lit("\n\nQ: "), F.substring("question", 3, 1 << 30)), TG.BBH_CUE), "answer"), n, seed)


def cut_passage(text, n: int = QA_TOKENS) -> Column:
    toks = C.tokens(text)
    return F.when(F.size(toks) > n, F.array_join(F.slice(toks, 1, n), " ")).otherwise(T.col(text))


def _qa_block(t, passage, question, with_passage: bool) -> Column:
    asked = F.concat(t["question"], F.lit(" "), T.col(question), F.lit("\n"))
    return F.concat(t["passage"], F.lit(" "), T.col(passage), F.lit("\n"), asked) if with_passage else asked


def _qa_rows(rows: DataFrame, with_passage: bool, shot: bool) -> DataFrame:
    """``lang, text, question, answer`` and, with a shot, ``s_text, s_question,
    s_answer``; the template is looked up by language and raises if there is none."""
    rows = rows.withColumn("t", TG.template("lang", with_passage))
    t = F.col("t")
    demo = [_qa_block(t, "s_text", "s_question", with_passage), t["answer"], F.lit(" "), F.col("s_answer"), F.lit("\n\n")] if shot else []
    content = F.concat(t["intro"], F.lit("\n\n"), *demo, _qa_block(t, "text", "question", with_passage))
    return _rows(rows, F.concat(TG.chat_wrap(content), t["answer"]), "answer")


def _with_shot(rows: DataFrame, shots: DataFrame, cut: bool) -> DataFrame:
    """Each row with its language's shot; a language without one raises."""
    text = cut_passage("text") if cut else F.col("text")
    s = shots.select("lang", text.alias("s_text"), F.col("question").alias("s_question"), F.col("answer").alias("s_answer"), F.lit(True).alias("s_found"))
    joined = rows.join(s, "lang", "left")
    return joined.withColumn("s_text", F.when(F.col("s_found"), F.col("s_text")).otherwise(
        F.raise_error(F.concat(F.lit("no shot for language "), F.coalesce("lang", F.lit("null"))))))


TYDIQA = {"dev": ("tydiqa/tydiqa-goldp-v1.1-dev.json", _qa), "train": ("tydiqa/tydiqa-goldp-v1.1-train.json", _qa)}


@register("tydiqa", files=TYDIQA, num_samples=90)
def tydiqa(i: Inputs, n: int | None, seed: int, with_passage: bool = True) -> DataFrame:
    """``dev, train``: target_id, lang, text, question, answer. At most 100 items and
    one shot of ``train`` per language, passages cut at 1,024 tokens."""
    test = SA.sample_group_cap(i["dev"], "lang", QA_PER_LANGUAGE, seed, "target_id").withColumn("text", cut_passage("text"))
    shots = SA.sample_n_shot(i["train"], "lang", 1, seed, "target_id", check=False)
    return TG.finish(_qa_rows(_with_shot(test, shots, True), with_passage, True), n, seed)


@register("tydiqa_shots", files={"train": TYDIQA["train"]}, num_samples=90)
def tydiqa_shots(i: Inputs, n: int | None, seed: int, with_passage: bool = True) -> DataFrame:
    """One item of ``train`` per language, without a shot, passages whole."""
    return TG.finish(_qa_rows(SA.sample_n_shot(i["train"], "lang", 1, seed, "target_id", check=False), with_passage, False), n, seed)


@register("tydiqa_shots_shots", files={"train": TYDIQA["train"]}, num_samples=90)
def tydiqa_shots_shots(i: Inputs, n: int | None, seed: int, with_passage: bool = True) -> DataFrame:
    """Two items of ``train`` per language: the first as target, the second its shot."""
    two = SA.sample_group_cap(i["train"], "lang", 2, seed, "target_id")
    rows = _with_shot(two.filter("group_rank = 1"), two.filter("group_rank = 2"), False)
    return TG.finish(_qa_rows(rows, with_passage, True), n, seed)


def codex(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``problems``: target_id, task_id, problem, solution; ``instructions``: task_id,
    instruction. With instructions each problem must have one (else it raises); without
    that table the problem itself is the instruction."""
    problems = i["problems"]
    if "instructions" not in i:
        content, answer = F.concat(F.lit(TG.CODE_INSTRUCTION), "problem"), F.lit(TG.CODE_ANSWER)
    else:
        problems = problems.join(i["instructions"].select("task_id", "instruction", F.lit(True).alias("found")), "task_id", "left")
        content = F.when(F.col("found"), F.col("instruction")).otherwise(F.raise_error(F.concat(F.lit("no instruction for "), F.coalesce("task_id", F.lit("null")))))
        answer = F.concat(F.lit(TG.CODE_ANSWER_WITH_INSTRUCTIONS), "problem")
    chat = TG.chat_wrap(content)
    gap = F.when(chat.endswith("\n") | chat.endswith(" "), F.lit("")).otherwise(F.lit(" "))
    return TG.finish(_rows(problems, F.concat(chat, gap, answer), "solution"), n, seed)


def instruction_pairs(i: Inputs, n: int | None, seed: int, strip_label: bool = True) -> DataFrame:
    """``pairs``: target_id, instruction, output; rows without either are dropped."""
    p = i["pairs"].filter(F.col("instruction").isNotNull() & F.col("output").isNotNull())
    return TG.finish(_rows(p, _ask(T.strip("instruction")), T.strip("output") if strip_label else "output"), n, seed)


def limo(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``pairs`` as instruction_pairs; the solution is not stripped."""
    return instruction_pairs(i, n, seed, strip_label=False)


def squad(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``rows``: target_id, text, question, answer: passage, blank line, question."""
    return TG.finish(_rows(i["rows"], _ask(F.concat("text", F.lit("\n\n"), "question")), "answer"), n, seed)


def squad_shots(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """As squad, after the texts of the first three rows of ``examples``."""
    first = _first_examples(i["examples"], 3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_id", "text"))), lambda s: s["text"]), "\n").alias("s"))
    rows = i["rows"].withColumn("shots", first.scalar())
    return TG.finish(_rows(rows, _ask(F.concat("shots", F.lit("\n"), "text", F.lit("\n\n"), "question")), "answer"), n, seed)


def mbpp(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``tasks``: target_id, description, code, test_list."""
    lines = F.array_join(F.transform("test_list", lambda t: F.concat(t, F.lit("\n"))), "")
    content = F.rtrim(F.concat("description", F.lit(" You need to pass the following test cases:\n"), lines), F.lit("\n"))
    return TG.finish(_rows(i["tasks"], _ask(content), F.concat(F.lit("Here is the function:\n\n```python\n\n"), "code")), n, seed)


def toxigen(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``lines``: target_id, source, text. At most ten lines a source, to be
    completed; the label is the source's first line after these."""
    ranked = SA.sample_group_cap(i["lines"], "source", 11, seed, "target_id")
    label = ranked.filter("group_rank = 11").select("source", F.col("text").alias("label"))
    rows = ranked.filter("group_rank <= 10").join(label, "source")
    return TG.finish(_rows(rows, _ask(F.concat(F.lit("Complete the following: "), "text")), "label"), n, seed)


def whole_rows(i: Inputs, n: int | None, seed: int) -> DataFrame:
    """``pool``: target_id, messages (mid, system_message): rows known to be in the pool."""
    return i["pool"].orderBy("target_id").limit(n) if n is not None else i["pool"]


for _name, _make, _options in (
    ("codex", codex, dict(files={"problems": ("codex_humaneval/HumanEval_dev.jsonl.gz", _problems), "instructions": ("codex_humaneval/humanevalpack.jsonl", _instructions)},
                          optional=frozenset({"instructions"}), num_samples=100, max_length=512)),
    ("codex_test", codex, dict(files={"problems": ("codex_humaneval/HumanEval.jsonl.gz", _problems), "instructions": ("codex_humaneval/humanevalpack.jsonl", _instructions)},
                               optional=frozenset({"instructions"}), num_samples=100, max_length=512)),
    ("alpacafarm", instruction_pairs, dict(files={"pairs": ("alpacaeval/alpaca_eval_dev.json", _array_pairs)}, num_samples=50, max_length=512)),
    ("alpacafarm_test", instruction_pairs, dict(files={"pairs": ("alpacaeval/alpaca_eval_test.json", _array_pairs)}, num_samples=50, max_length=512)),
    ("squad", squad, dict(files={"rows": ("squad/validation.jsonl", _flat_qa)}, num_samples=500, max_length=512)),
    ("squad_test", squad, dict(files={"rows": ("squad/validation.jsonl", _flat_qa)}, num_samples=500, max_length=512)),
    ("squad_shots", squad_shots, dict(files={"rows": ("squad/train.jsonl", _flat_qa), "examples": ("squad/examples.jsonl", _flat_qa)}, num_samples=500, max_length=512)),
    ("arena_hard", instruction_pairs, dict(files={"pairs": ("arena_hard.jsonl", _pairs("prompt", "label"))}, num_samples=500)),
    ("wildchat", instruction_pairs, dict(files={"pairs": ("wildchat_100_prompts.jsonl", _pairs("prompt", "response"))}, num_samples=100)),
    ("limo", limo, dict(files={"pairs": ("limo/limo.jsonl", _pairs("question", "solution"))}, num_samples=8)),
    ("mbpp_pro", mbpp, dict(files={"tasks": ("mbpp/prompt.jsonl", _code)}, num_samples=7, max_length=1024)),
    ("mbpp_val", mbpp, dict(files={"tasks": ("mbpp/validation.jsonl", _code)}, num_samples=43, max_length=1024)),
    ("debug_subset", whole_rows, dict(files={"pool": ("100_200k_debug.jsonl", _pool)}, num_samples=100, whole=True)),
    ("file", whole_rows, dict(files={"pool": ("", _pool)}, whole=True)),
    ("toxigen", toxigen, dict(files={"lines": ("toxigen/dev", _groups)}, num_samples=140, max_length=512)),
):
    register(_name, **_options)(_make)
