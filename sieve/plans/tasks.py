"""Evaluation tasks as a registry of DataFrame/Column functions.

A task bundles what an evaluation needs: the problems (a DataFrame read from
the tables), the prompt and the reference built from a problem row (Column
expressions), the clean-up of a generation (Column -> Column) and the scoring
of the generations (DataFrame -> DataFrame). Users add a task with
``register_task``; ``run_task`` joins the generations to the problems on the
cluster and scores them, so nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions import text as T


@dataclass(frozen=True)
class Task:
    dataset: Callable[..., DataFrame]              # (spark, sf_dir) -> problems with a ``task_id`` column
    prompt: Callable[[], Column]                   # prompt text of a problem row
    reference: Callable[[], Column]                # reference (tests, gold answer) of a problem row
    postprocess: Callable[[Column, Column], Column]  # (generation, prompt) -> cleaned generation
    process_results: Callable[[DataFrame], DataFrame]  # scored rows -> metrics


TASKS: dict[str, Task] = {}


def register_task(name: str, task: Task) -> Task:
    TASKS[name] = task
    return task


def prompts(spark, name: str, sf_dir: str) -> DataFrame:
    """``task_id, prompt, reference`` of every problem of the task."""
    t = TASKS[name]
    return t.dataset(spark, sf_dir).select("task_id", t.prompt().alias("prompt"), t.reference().alias("reference"))


def run_task(spark, name: str, sf_dir: str, generations: DataFrame) -> DataFrame:
    """Score ``generations`` (``task_id, completion_id, generation`` plus any
    result columns such as ``passed``) with the task's own functions."""
    t = TASKS[name]
    p = prompts(spark, name, sf_dir)
    joined = generations.join(p, "task_id")
    cleaned = joined.withColumn("generation", t.postprocess(F.col("generation"), F.col("prompt")))
    return t.process_results(cleaned)


# --------------------------------------------------------------------------
# built-in: the code-generation task (programs are assembled, never executed)
# --------------------------------------------------------------------------

def _code_dataset(spark, sf_dir):
    from sieve.plans import q_scoring
    return q_scoring.code_problems(spark, sf_dir)


def _code_results(df: DataFrame) -> DataFrame:
    from sieve.operators import scoring as SC
    return SC.pass_at_k(df, ks=(1, 10, 100))


def _code_prompt() -> Column:
    from sieve.plans import targets as TG
    return TG.code_prompt("description", "test_list")


register_task("mbpp", Task(
    dataset=_code_dataset,
    prompt=_code_prompt,
    reference=lambda: F.array_join("test_list", "\n"),
    postprocess=lambda gen, prompt: T.cut_at_stop(gen, T.CODE_STOPS),
    process_results=_code_results,
))
