"""Readers on small hand-written files (formats the driver tables do not have)."""

import gzip
import json

from sieve.sources import readers as RD


def test_row_positions_follow_sorted_paths(spark, tmp_path):
    for name, rows in (("b.jsonl", [{"id": "b0"}, {"id": "b1"}]), ("a.jsonl", [{"id": "a0"}, {"id": "a1"}, {"id": "a2"}])):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    df = RD.read_jsonl_dir(spark, str(tmp_path))
    got = sorted((r["row_pos"], r["id"]) for r in df.collect())
    assert got == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b0"), (4, "b1")]


def test_read_problems_gzip_last_duplicate_wins(spark, tmp_path):
    lines = [{"task_id": "t/1", "prompt": "old"}, {"task_id": "t/2", "prompt": "x"}, {"task_id": "t/1", "prompt": "new"}]
    with gzip.open(tmp_path / "problems.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + "\n   \n")
    got = {r["task_id"]: r["prompt"] for r in RD.read_problems(spark, str(tmp_path / "problems.jsonl.gz")).collect()}
    assert got == {"t/1": "new", "t/2": "x"}


def test_task_examples_and_cot_prompts(spark, tmp_path):
    (tmp_path / "ex").mkdir()
    (tmp_path / "ex" / "navigate.json").write_text(json.dumps({"examples": [{"input": "i0", "target": "t0"},
                                                                             {"input": "i1", "target": "t1"}]}))
    ex = sorted((r["task"], r["pos"], r["input"], r["target"]) for r in RD.read_task_examples(spark, str(tmp_path / "ex")).collect())
    assert ex == [("navigate", 0, "i0", "t0"), ("navigate", 1, "i1", "t1")]
    (tmp_path / "cot").mkdir()
    (tmp_path / "cot" / "navigate.txt").write_text("header\n-----\nIntro.\n\nQ: a\nA: b\n")
    cot = RD.read_cot_prompts(spark, str(tmp_path / "cot")).collect()
    assert [(r["task"], r["task_prompt"]) for r in cot] == [("navigate", "Intro.\n\nQ: a\nA: b\n")]


def test_lines_by_file(spark, tmp_path):
    (tmp_path / "hate_asian_group.txt").write_text("  line one \\\\ x\nline\\ntwo\n")
    rows = sorted(RD.read_lines_by_file(spark, str(tmp_path)).collect(), key=lambda r: r["row_pos"])
    assert [(r["label"], r["group"], r["text"]) for r in rows] == [
        ("hate", "asian_group", "line one \\ x"), ("hate", "asian_group", "line\ntwo")]


def test_influence_files_drop_minus_one(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"0": 0.5, "-1": 9.0, "2": 0.1}, {"1": 0.7}]))
    got = sorted((r["target_id"], r["pool_id"], r["score"]) for r in RD.read_influence_json(spark, str(tmp_path / "list.json")).collect())
    assert got == [(0, 0, 0.5), (0, 2, 0.1), (1, 1, 0.7)]
    (tmp_path / "dict.json").write_text(json.dumps({"0": {"3": 0.2, " -1": 1.0}, "1": {"4": 0.3}}))
    got = sorted((r["target_id"], r["pool_id"], r["score"]) for r in RD.read_influence_json(spark, str(tmp_path / "dict.json")).collect())
    assert got == [(0, 3, 0.2), (1, 4, 0.3)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "p.jsonl").write_text('{"target_id": 0, "scores": {"5": 0.4, "-1": 0.0}}\n')
    got = [(r["target_id"], r["pool_id"]) for r in RD.read_influence_lines(spark, str(tmp_path / "lines")).collect()]
    assert got == [(0, 5)]


def test_domain_weights_and_allow_ids(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"math": 1.0, "science": 3.0}))
    w = {r["domain"]: r["weight"] for r in RD.read_domain_weights(spark, str(tmp_path / "w.json")).collect()}
    assert w == {"math": 1.0, "science": 3.0}
    (tmp_path / "allow.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n{"id": "a"}\n')
    assert sorted(r["id"] for r in RD.read_allow_ids(spark, str(tmp_path / "allow.jsonl")).collect()) == ["a", "b"]


def test_named_pool_errors_on_unknown(spark, tmp_path):
    import pytest
    with pytest.raises(ValueError):
        RD.read_named_pool(spark, str(tmp_path / "missing"))
