"""Target sets on files in the reference's formats, and on DataFrames, with all options."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.plans import target_sets as TS
from sieve.plans import targets as TG

LANGUAGES = list(TG.QA_TEMPLATES)


def lines(path, rows, opener=open):
    path.parent.mkdir(parents=True, exist_ok=True)
    with opener(path, "wt") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")


def nested(split):
    def qa(lang, k):
        return {"id": f"{lang}-{split}-{k}", "question": f"{lang} question {k}?", "answers": [{"text": f"{lang} {split} answer {k}"}]}
    return {"data": [{"paragraphs": [{"context": f"{lang} passage {split} " + "word " * (1500 if k == 0 else 3), "qas": [qa(lang, k)]} for k in range(3)]} for lang in LANGUAGES]}


COT = """canary
-----
Find the odd one out.

Q: one, two, six?
A: Let's think. So the answer is six.

Q: red, blue, dog?
A: Colours. So the answer is dog."""


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    at = tmp_path_factory.mktemp("eval")
    for split in ("test", "dev"):
        (at / "mmlu" / split).mkdir(parents=True)
        for subject in ("abstract_algebra", "world_history"):
            (at / "mmlu" / split / f"{subject}_{split}.csv").write_text("".join(f'"{subject}, {split} {k}?",a{k},"b, {k}",c{k},d{k},{"ABCD"[k % 4]}\n' for k in range(7)))
    lines(at / "gsm" / "test.jsonl", [{"question": f"How many are {k}?", "answer": f"Work.\n#### 1,00{k}"} for k in range(5)])
    lines(at / "gsm" / "examples.jsonl", [{"question": f"Example {k}?", "cot_answer": f"Because so. So the answer is {k}.", "short_answer": str(k)} for k in range(8)])
    for name in ("odd", "sums"):
        path = at / "bbh" / "bbh" / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"examples": [{"input": f"{name} input {k}", "target": f"t{k}"} for k in range(45)]}))
        (at / "bbh" / "cot-prompts").mkdir(exist_ok=True)
        (at / "bbh" / "cot-prompts" / f"{name}.txt").write_text(COT)
    (at / "tydiqa").mkdir()
    for split in ("dev", "train"):
        (at / "tydiqa" / f"tydiqa-goldp-v1.1-{split}.json").write_text(json.dumps(nested(split)))
    problem = lambda k: {"task_id": f"HumanEval/{k}", "prompt": f"def f{k}(x):\n", "canonical_solution": f"    return {k}\n"}                    # noqa: E731
    lines(at / "codex_humaneval" / "HumanEval_dev.jsonl.gz", [problem(k) for k in range(4)], gzip.open)
    lines(at / "codex_humaneval" / "HumanEval.jsonl.gz", [problem(k) for k in range(6)], gzip.open)
    lines(at / "codex_humaneval" / "humanevalpack.jsonl", [{"task_id": f"Python/{k}", "instruction": f"Write f{k}."} for k in range(6)])
    for split in ("dev", "test"):
        (at / "alpacaeval").mkdir(exist_ok=True)
        (at / "alpacaeval" / f"alpaca_eval_{split}.json").write_text(json.dumps([{"instruction": f" ask {split} {k} ", "output": f"say {k}\n"} for k in range(60)]))
    flat = [{"id": f"i{k}", "title": "t", "context": f"context {k}", "question": f"what {k}?", "answers": {"text": [f"a{k}", "other"]}} for k in range(6)]
    for name in ("validation", "train", "examples"):
        lines(at / "squad" / f"{name}.jsonl", flat)
    lines(at / "arena_hard.jsonl", [{"prompt": f" p {k}", "label": f"l {k} "} for k in range(5)])
    lines(at / "wildchat_100_prompts.jsonl", [{"prompt": f"w {k}", "response": f"r {k}"} for k in range(5)])
    lines(at / "limo" / "limo.jsonl", [{"question": f"q {k}", "solution": f"s {k} ", "answer": "x"} for k in range(12)])
    code = [{"source_file": "s", "task_id": k, "prompt": f"Do {k}.", "code": f"x = {k}", "test_imports": [], "test_list": [f"assert {k}", "assert 1"]} for k in range(9)]
    lines(at / "mbpp" / "prompt.jsonl", code)
    lines(at / "mbpp" / "validation.jsonl", code)
    chat = [{"id": f"c{k}", "dataset": "d", "messages": [{"role": "user", "content": f"hello {k}"}, {"role": "assistant", "content": f"hi {k}"}]} for k in range(3)]
    vendor = [{"mid": "m1", "system_message": "be kind", "messages": [{"role": "HUMAN", "content": "hello"}, {"role": "OBSERVATION", "content": "seen"}, {"role": "ASSISTANT", "content": "hi there"}]}]
    lines(at / "100_200k_debug.jsonl", chat + vendor)
    (at / "toxigen" / "dev").mkdir(parents=True)
    (at / "toxigen" / "dev" / "hate_some_group.txt").write_text("".join(f" - line {k}\\nmore\n" for k in range(13)))
    return str(at)


SIZES = {"mmlu": 14, "mmlu_cot": 14, "mmlu_shots": 14, "mmlu_shots_shots": 14, "gsm8k": 5, "gsm8k_shots": 8, "gsm8k_shots_shots": 8, "bbh": 80, "bbh_shots": 4, "bbh_shots_shots": 4,
         "tydiqa": 27, "tydiqa_shots": 9, "tydiqa_shots_shots": 9, "codex": 4, "codex_test": 6, "alpacafarm": 50, "alpacafarm_test": 50, "squad": 6, "squad_test": 6, "squad_shots": 6,
         "arena_hard": 5, "wildchat": 5, "limo": 8, "mbpp_pro": 7, "mbpp_val": 9, "debug_subset": 4, "toxigen": 10}


@pytest.mark.parametrize("name", SIZES)
def test_every_name_builds_from_files(spark, data, name):
    rows = TS.build(spark, name, data).collect()
    assert len(rows) == SIZES[name] and len({r["target_id"] for r in rows}) == len(rows)
    n = TS.REGISTRY[name].max_length
    for r in rows:
        assert r["prompt"] and r["label"] is not None and len(r["tokens"]) == len(r["labels"]) <= 2 * n
        assert all(x is None or x == t for t, x in zip(r["tokens"], r["labels"])) and any(x is not None for x in r["labels"])
    assert TS.build(spark, name, data, num_samples=2).count() == 2


def test_all_names_of_the_registry_are_covered():
    assert set(TS.REGISTRY) - {"file"} == set(SIZES) and len(SIZES) == 27


def one(spark, data, name, **how):
    return {r["target_id"]: r for r in TS.build(spark, name, data, num_samples=-1, **how).collect()}


def test_prompts_by_hand(spark, data):
    user = lambda text: f"<|user|>\n{text}\n<|assistant|>\n"                                                                                     # noqa: E731
    p = lambda name: {(r["prompt"], r["label"]) for r in one(spark, data, name).values()}                                                         # noqa: E731
    assert (user("Find the odd one out.\n\nQ: one, two, six?\nA: Let's think. So the answer is six.\n\nQ:  red, blue, dog?") + "A:", "Colours. So the answer is dog.") in p("bbh_shots_shots")
    assert ("Find the odd one out.\n\nQ: red, blue, dog?", "Colours. So the answer is dog.") in p("bbh_shots")
    assert (user("Write f3.") + "Here is the function:\n\n```python\ndef f3(x):\n", "    return 3\n") in p("codex")
    assert (user("context 2\n\nwhat 2?"), "a2") in p("squad")
    assert (user("Do 4. You need to pass the following test cases:\nassert 4\nassert 1"), "Here is the function:\n\n```python\n\nx = 4") in p("mbpp_val")
    assert {x for _, x in p("gsm8k")} == {f"100{k}" for k in range(5)}
    assert all(text.startswith("<|user|>\nAnswer the following questions.\n\nQuestion: Example 0?\nAnswer: Because so. So the answer is 0.") for text, _ in p("gsm8k"))
    assert all(text.count("Example") == 8 and text.count("Answer: Because") == 7 for text, _ in p("gsm8k_shots_shots"))


@pytest.mark.parametrize("with_passage", [True, False])
def test_nine_languages_in_both_forms(spark, data, with_passage):
    i = TS.inputs_of(spark, TS.REGISTRY["tydiqa"], data)
    table = TG.QA_TEMPLATES if with_passage else TG.QA_TEMPLATES_NO_PASSAGE
    rows = TS.tydiqa(i, None, 42, with_passage).collect()
    assert len(rows) == i["dev"].count() == 27
    for lang in LANGUAGES:
        own = [r for r in rows if r["label"].startswith(f"{lang} dev")]
        assert len(own) == 3 and all(r["prompt"].startswith(f"<|user|>\n{table[lang][0]}\n\n") and r["prompt"].endswith(table[lang][-1]) for r in own)
        assert all(("passage" in r["prompt"]) == with_passage for r in own)
    with pytest.raises(Exception, match="no template for language french"):
        TS.tydiqa_shots({"train": i["train"].withColumn("lang", F.lit("french"))}, None, 42).collect()
    with pytest.raises(Exception, match="no shot for language"):
        TS.tydiqa({"dev": i["dev"], "train": i["train"].where("lang <> 'korean'")}, None, 42).collect()


def test_modes_and_lengths(spark, data):
    both, prompt, reply = (one(spark, data, "squad", **how) for how in ({"max_length": 4}, {"prompt_only": True}, {"response_only": True}))
    for k, r in both.items():
        assert r["tokens"] == ["<|user|>", "context", str(k), "what", f"a{k}</s>"] and r["labels"] == [None] * 4 + [f"a{k}</s>"]
        assert prompt[k]["tokens"] == ["<|user|>", "context", str(k), "what", f"{k}?</s>"] and set(prompt[k]["labels"]) == {None}
        assert reply[k]["tokens"] == reply[k]["labels"] == [f"<s>a{k}</s>"]
    with pytest.raises(ValueError, match="not supported"):
        TS.build(spark, "debug_subset", data, prompt_only=True)
    with pytest.raises(ValueError, match="exclude each other"):
        TS.build(spark, "squad", data, prompt_only=True, response_only=True)


def test_whole_rows_by_form(spark, data):
    rows = sorted(TS.build(spark, "file", f"{data}/100_200k_debug.jsonl").collect(), key=lambda r: r["target_id"])
    assert rows[0]["prompt"] == "<|user|>\nhello 0\n<|assistant|>\nhi 0</s>" and rows[0]["labels"] == [None, None, None, None, "hi", "0</s>"]
    assert rows[3]["prompt"] == "<|system|>\nbe kind\n<|user|>\nhello\n<|observation|>\nseen\n<|assistant|>\nhi there</s>"
    assert rows[3]["labels"] == [None] * 8 + ["hi", "there</s>"]


def test_codex_without_and_with_a_gap_in_the_instructions(spark, data):
    i = TS.inputs_of(spark, TS.REGISTRY["codex"], data)
    alone = TS.build(spark, "codex", {"problems": i["problems"]}).collect()
    assert {r["prompt"] for r in alone} == {f"<|user|>\nComplete the following python function.\n\n\ndef f{k}(x):\n\n<|assistant|>\nHere is the completed function:\n\n\n" for k in range(4)}
    with pytest.raises(Exception, match="no instruction for HumanEval/2"):
        TS.build(spark, "codex", {"problems": i["problems"], "instructions": i["instructions"].where("task_id <> 'HumanEval/2'")}).collect()


def test_user_sets_and_missing_inputs(spark, data):
    @TS.register("own_set", files={"rows": ("arena_hard.jsonl", TS._pairs("prompt", "label"))}, num_samples=2)
    def own(i, n, seed):
        return TG.finish(i["rows"].select("target_id", F.upper("instruction").alias("prompt"), F.col("output").alias("label")), n, seed)
    try:
        assert TS.build(spark, "own_set", data).count() == 2
        given = spark.createDataFrame([(5, "a b", "c")], "target_id long, instruction string, output string")
        assert [tuple(r) for r in TS.build(spark, "own_set", {"rows": given}, response_only=True).collect()] == [(5, "A B", "c", ["<s>c</s>"], ["<s>c</s>"])]
    finally:
        del TS.REGISTRY["own_set"]
    with pytest.raises(FileNotFoundError):
        TS.build(spark, "mmlu", data + "/limo")
    with pytest.raises(FileNotFoundError):
        TS.build(spark, "gsm8k", {"test": given})
    with pytest.raises(ValueError, match="unknown target set"):
        TS.build(spark, "no_such_set", data)


def test_block_parser_places(spark):
    text = "intro\n\nQ: one?\nA: 1\n\nfree\n\nQ: two?\nA: 2"
    df = spark.createDataFrame([(text,), ("no blocks",), ("",)], "p string").select("p", TG.cot_blocks("p").alias("c"))
    got = {r["p"]: r["c"] for r in df.collect()}
    assert [(text[b["start"]:b["end"]], b["question"], b["answer"]) for b in got[text]["blocks"]] == [("\n\nQ: one?\nA: 1\n\nfree", "Q: one?", "1\n\nfree"), ("\n\nQ: two?\nA: 2", "Q: two?", "2")]
    assert got["no blocks"]["intro"] == "no blocks" and got["no blocks"]["blocks"] == [] and got[""]["intro"] == ""


def test_spans_cut_the_text_into_turns(spark):
    msgs = [("system", " s "), ("user", "a b\n"), ("assistant", "c"), ("assistant", "d"), ("user", "é🙂")]
    df = spark.createDataFrame([(msgs,)], "messages array<struct<role:string,content:string>>").select(C.chat_pieces("messages").alias("p"))
    r = df.select(C.pieces_text("p").alias("t"), C.spans("p").alias("s"), C.token_labels("p", 99).alias("l")).first()
    assert [r["t"][s["start"]:s["end"]].strip() for s in r["s"]] == ["<|system|>\ns", "<|user|>\na b", "<|assistant|>\nc</s>", "<|assistant|>\nd</s>", "<|user|>\né🙂"]
    assert [s["kept"] for s in r["s"]] == [False, False, True, True, False] and "".join(r["t"][s["start"]:s["end"]] for s in r["s"]) == r["t"]
    assert r["l"]["labels"] == [None] * 6 + ["c</s>", "<|assistant|>", "d</s>", None, None]
