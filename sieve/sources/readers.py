"""Readers for the input formats of the reference (JSON lines, CSV per subject,
nested QA JSON, per-task files, influence score files, allow-lists, domain
weights) and the pool-vector cache.

Row identity: the reference identifies a pool row by its position in the
loaded dataset (files in sorted path order, lines in file order).
:func:`with_row_position` computes that position on the cluster: inside one
file split, ``monotonically_increasing_id`` is consecutive, so a line's offset
in its split is its id minus the split's smallest id; split offsets come from a
running count over the (small) table of splits ordered by (path, start).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.session import ensure_checkpoint_dir
from sieve.functions import chat as C
from sieve.functions.text import strip
from sieve.operators.tiles import ScoreTiles

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
POOL_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("system", T.StringType()), T.StructField("mid", T.StringType()),
    T.StructField("system_message", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
])


SPLITS_BROADCAST = 200_000   # file splits whose offsets are broadcast; more are joined by shuffle


def with_row_position(df: DataFrame, name: str = "row_pos") -> DataFrame:
    """Add the 0-based position of each row in (sorted file path, line) order.
    Must be applied directly to a file scan (before any shuffle)."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                       F.col("_metadata.file_block_start").alias("_fb"),
                       F.monotonically_increasing_id().alias("_mid"))
    splits = tagged.groupBy("_fp", "_fb").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per file split, ordered on one task; kept in the checkpoint folder, so counting it is free
    ensure_checkpoint_dir(df.sparkSession)
    w = Window.orderBy("_fp", "_fb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    offsets = offsets.select("_fp", "_fb", "_first", "_off").checkpoint()
    if offsets.count() <= SPLITS_BROADCAST:
        offsets = F.broadcast(offsets)
    return (tagged.join(offsets, ["_fp", "_fb"])
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_fp", "_fb", "_mid", "_first", "_off"))


def read_jsonl_dir(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   position: bool = True) -> DataFrame:
    """Every JSON-lines file below ``path`` (recursively; blank lines skipped;
    gzip transparent), with its source file and row position."""
    reader = spark.read.option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    df = df.withColumn("source_file", F.col("_metadata.file_path"))
    return with_row_position(df) if position else df


@dataclass(frozen=True)
class NamedPool:
    path: str
    renderer: Callable[[DataFrame], Column] | None = None


# Named pools: name -> location and renderer. Register the locations of your
# cluster here (or call ``register_pool``); any other name is treated as a path.
NAMED_POOLS: dict[str, NamedPool] = {}


def register_pool(name: str, path: str, renderer: Callable[[DataFrame], Column] | None = None) -> None:
    """``renderer`` maps the pool's rows to the Column of their text; without one the
    renderer goes by the pool's name and the row's form."""
    NAMED_POOLS[name] = NamedPool(path, renderer)


def render_pool(df: DataFrame, name: str, column: str = "text") -> DataFrame:
    """``df``, rows of the pool ``name``, with their rendered text."""
    entry = NAMED_POOLS.get(name)
    if entry is not None and entry.renderer is not None:
        return df.withColumn(column, entry.renderer(df))
    field = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")                      # noqa: E731
    return df.withColumn(column, C.render_dispatch(name, "messages", field("system"), field("system_message"), field("mid")))


def read_named_pool(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A registered pool by name, else an existing path, else an error."""
    path = NAMED_POOLS[name_or_path].path if name_or_path in NAMED_POOLS else name_or_path
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise ValueError(f"Invalid train dataset {name_or_path}.")
    return read_jsonl_dir(spark, path, POOL_SCHEMA)


def order_key() -> Column:
    """Where a line stands among all lines of a scan, as a struct that sorts as they
    do (file path, place of the file's split, place within it); no count of lines and
    no second scan. For a file scan only, before any shuffle."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def read_problems(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """JSON lines keyed by ``key``, gzip and blank lines welcome; a repeated key
    keeps its last line, in the order of sorted paths."""
    df = spark.read.option("recursiveFileLookup", True).json(path)
    cols = [c for c in df.columns if c != key]
    last = (df.select("*", order_key().alias("_at")).groupBy(key).agg(F.max_by(F.struct(*cols), "_at").alias("_r")))
    return last.select(key, "_r.*")


def read_csv_by_subject(spark: SparkSession, path: str, columns=("question", "A", "B", "C", "D", "answer"),
                        split: str = "test") -> DataFrame:
    """Header-less multiple-choice CSVs, one per subject (``<subject>_<split>.csv``
    or a ``subject=<name>`` directory); the subject comes from the path."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("recursiveFileLookup", True).schema(schema).csv(
        path, header=False, multiLine=True, quote='"', escape='"')
    fp = F.col("_metadata.file_path")
    subject = F.coalesce(F.nullif(F.regexp_extract(fp, rf"([^/]+)_{split}\.csv$", 1), F.lit("")),
                         F.regexp_extract(fp, r"subject=([^/]+)", 1))
    return df.withColumn("subject", subject)


def read_nested_qa(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``data[].paragraphs[].qas[]`` flattened to one row per question, with
    ``lang`` = the id's prefix before the first ``-``."""
    df = spark.read.option("multiLine", multiline).json(path)
    art = df.select(F.explode("data").alias("a"))
    par = art.select(F.explode("a.paragraphs").alias("p"))
    qa = par.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return qa.select(F.col("q.id").alias("id"), F.split(F.col("q.id"), "-")[0].alias("lang"), "context",
                     F.col("q.question").alias("question"),
                     F.transform("q.answers", lambda a: a["text"]).alias("answers"))


def _name_in(path_key: str) -> Column:
    """The value of a ``<key>=<value>`` directory, else the file's name to its first dot."""
    return F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), f"/{path_key}=([^/]+)/", 1), F.lit("")),
                      F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))


def read_task_examples(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One JSON document per task (``examples``), the task from the file's name or a
    ``task=<name>`` directory. Not ``multiline``: a document a line, several a task
    (files that can be split); positions then count within a document."""
    df = spark.read.option("multiLine", multiline).option("recursiveFileLookup", True).json(path)
    task = _name_in("task")
    return df.select(task.alias("task"), F.posexplode("examples").alias("pos", "e")).select(
        "task", "pos", F.col("e.input").alias("input"), F.col("e.target").alias("target"))


def drop_first_lines(text, n: int = 2):
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.lit(n + 1), F.greatest(F.size(lines) - n, F.lit(0))), "\n")


def read_cot_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt file per task (``<task>.txt`` or a ``task=<name>`` directory),
    first two lines dropped."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(_name_in("task").alias("task"), drop_first_lines(F.col("value")).alias("task_prompt"))


def read_lines_by_file(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per line; ``label`` and ``group`` from the file name
    ``<label>_<group>.txt`` or a ``name=<label>_<group>`` directory; escaped
    backslashes and newlines restored."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    df = with_row_position(raw.select("value", _name_in("name").alias("_name")))
    parts = F.split("_name", "_")
    text = F.replace(F.replace(strip(F.col("value")), F.lit("\\\\"), F.lit("\\")), F.lit("\\n"), F.lit("\n"))
    return df.select(F.get(parts, 0).alias("label"),
                     F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "_").alias("group"),
                     text.alias("text"), "row_pos")


def read_file_target(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A pool-format JSON-lines file used as a target set, in file order; with
    ``limit`` only its first rows."""
    df = read_jsonl_dir(spark, path, POOL_SCHEMA)
    if "messages" not in df.columns:
        raise ValueError("file target sets need pool rows with messages")
    return df if limit is None else df.filter(F.col("row_pos") < limit)


INFLUENCE_LIST = T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))


def influence_from_maps(df: DataFrame, target_col: str = "target_id", map_col: str = "scores",
                        src: int = 0) -> DataFrame:
    """``target, map<pool idx, score>`` -> long score table; entries with pool
    index -1 (as number or as the string "-1") are malformed and dropped."""
    long = df.select(F.col(target_col).cast("long").alias("target_id"), F.explode(map_col).alias("k", "score"))
    return (long.filter(F.btrim(F.col("k")) != "-1")
            .select("target_id", F.lit(src).alias("src"), F.col("k").cast("long").alias("pool_id"),
                    F.col("score").cast("double").alias("score")))


def read_influence_columns(spark: SparkSession, path: str) -> DataFrame:
    """Influence scores as JSON lines, kept as arrays: ``target_id, pool_ids,
    scores`` for every line, in order of the ids, without a row per pair and
    without entries of pool index -1; a line that holds nothing else gives none."""
    raw = spark.read.schema("target_id bigint, scores map<string,double>").json(path)
    entries = F.array_sort(F.transform(F.filter(F.map_entries("scores"), lambda e: F.btrim(e["key"]) != "-1"),
                                       lambda e: F.struct(e["key"].cast("long").alias("pool_id"), e["value"].alias("score"))))
    return (raw.select("target_id", entries.alias("e")).where(F.size("e") > 0)
            .select("target_id", F.transform("e", lambda e: e["pool_id"]).alias("pool_ids"), F.transform("e", lambda e: e["score"]).alias("scores")))


def read_similarity(spark: SparkSession, path: str, target_set: str) -> ScoreTiles:
    """What ``sinks.write_similarity`` has stored for a target set, all shards."""
    of = F.col("target_set") == target_set
    return ScoreTiles(spark.read.parquet(f"{path}/tiles").where(of), spark.read.parquet(f"{path}/targets").where(of).drop("target_set"))


def read_influence_lines(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Influence scores as JSON lines ``{"target_id": t, "scores": {idx: s}}``
    (splittable; the scalable text form)."""
    schema = "target_id bigint, scores map<string,double>"
    return influence_from_maps(spark.read.schema(schema).json(path), src=src)


def read_influence_json(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """The reference's single-document forms: a list of ``{idx: score}`` maps
    (position = target) or a ``{target: {idx: score}}`` object. One document is
    one task (JSON documents cannot be split); use Parquet or JSON lines for
    large score sets."""
    raw = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", INFLUENCE_LIST)
    as_map = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
    parsed = raw.select(F.when(F.btrim("value").startswith("["), as_list).alias("l"),
                        F.when(~F.btrim("value").startswith("["), as_map).alias("m"))
    from_list = parsed.select(F.posexplode("l").alias("target_id", "scores"))
    from_map = parsed.select(F.explode("m").alias("target_id", "scores"))
    both = from_list.unionByName(from_map.select(F.col("target_id").cast("int"), "scores"))
    return influence_from_maps(both.filter(F.col("scores").isNotNull()), src=src)


def read_allow_ids(spark: SparkSession, path: str) -> DataFrame:
    """The set of ``id`` values of a JSON-lines file."""
    return spark.read.schema("id string").json(path).select("id").distinct()


def read_domain_weights(spark: SparkSession, path: str) -> DataFrame:
    """``{domain: weight}`` JSON object -> ``domain, weight``."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))).alias("domain", "weight"))
    return m


def cached_embeddings(spark: SparkSession, path: str, compute, params: dict | None = None) -> DataFrame:
    """Pool vectors from ``path`` if stored there in full, else ``compute()``
    them, store them as Parquet and read them back (one pool serves many target
    sets). A folder without Spark's ``_SUCCESS`` mark is a broken write and is
    written anew. ``params`` (pooling, layers, seed, model ...) are stored next
    to the data; stored data with other parameters are refused."""
    jvm = spark.sparkContext._jvm
    folder, note = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"), f"{path.rstrip('/')}.params"
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = json.dumps(params or {}, sort_keys=True)
    if fs.exists(folder):
        held = jvm.org.apache.hadoop.fs.Path(note, "_SUCCESS")
        stored = spark.read.text(note, wholetext=True).first()["value"].strip() if fs.exists(held) else "{}"
        if stored != wanted:
            raise ValueError(f"{path} holds vectors made with {stored}, not {wanted}")
    else:
        compute().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(note)
    return spark.read.parquet(path)
