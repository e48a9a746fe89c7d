"""Join patterns of the scoring and bookkeeping steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_prediction(references: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every reference with its prediction, or null when it has none."""
    return references.join(predictions, key, "left")


def missing_problems(problems: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Problems without any sample."""
    return problems.join(samples.select(key), key, "left_anti")


def problem_samples(problems: DataFrame, samples: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Samples joined to their problem; every problem must be attempted."""
    if check and missing_problems(problems, samples, key).limit(1).count():
        raise ValueError("Some problems are not attempted.")
    return samples.join(problems, key)


def attach_category(rows: DataFrame, tree: DataFrame, row_key: str, tree_key: str) -> DataFrame:
    """Rows -> subject -> subcategory -> category (the tree is one row per subject)."""
    return rows.join(tree, rows[row_key] == tree[tree_key]).drop(row_key, tree_key)


def prompt_output(prompts: DataFrame, outputs: DataFrame, prompt: str = "prompt", output: str = "output",
                  order_col: str | None = None) -> DataFrame:
    """Outputs matched back to prompts by text; a repeated prompt keeps the last
    output (by ``order_col``); a missing one becomes ''."""
    if order_col:
        outputs = outputs.groupBy(prompt).agg(F.max_by(output, order_col).alias(output))
    return (prompts.join(outputs.select(prompt, output), prompt, "left")
            .withColumn(output, F.coalesce(F.col(output), F.lit(""))))


def mark_done(rows: DataFrame, done: DataFrame, key: str, name: str = "done") -> DataFrame:
    """``rows`` with a flag: has a stored output. One join, rows are read once."""
    keys = done.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(keys, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def split_done(rows: DataFrame, done: DataFrame, key: str):
    """(to do, reusable): rows without / with a stored output, per row. Where both
    are used, :func:`mark_done` reads the rows once instead of twice."""
    keys = done.select(key)
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")
