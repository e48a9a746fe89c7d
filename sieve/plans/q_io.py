"""Source and sink queries: data derived from the given tables is written with
the sinks into a fresh folder under the session's checkpoint directory (the
shared folder of the cluster), then read back with the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.operators import pooling as P
from sieve.operators import selection as S
from sieve.operators import tiles as TL
from sieve.plans import fixtures as FX
from sieve.plans import batch as BT
from sieve.plans import q_chat, q_scoring, q_select, q_targets
from sieve.plans.catalog import r6, register
from sieve.plans.fixtures import scratch
from sieve.sources import readers as RD
from sieve.sources import sinks as SK


def pool_rows(spark, sf):
    """Conversations as pool rows in chat form (``id``, ``dataset``, ``messages``)."""
    m = FX.conversation_messages(spark, sf)
    return m.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("id"),
                    F.lit("conversations").alias("dataset"), "messages",
                    F.pmod(F.col("conv_id"), F.lit(3)).alias("shard"))


RENDER_SQL = q_chat.SQL_TURNS


@register("src_jsonl_dir", f"""WITH {RENDER_SQL}
SELECT 'conv_' || conv_id AS id, trim(string_agg({q_chat._piece()}, '' ORDER BY idx), {q_chat.WS}) AS text
FROM c GROUP BY conv_id""")
def src_jsonl_dir(spark, sf):
    """Pool rows written as JSON lines into three sub-folders, read back
    recursively and rendered."""
    path = scratch(spark, "pool")
    pool_rows(spark, sf).write.partitionBy("shard").json(path)
    back = RD.read_jsonl_dir(spark, path, RD.POOL_SCHEMA)
    return back.select("id", C.render_default("messages").alias("text"))


@register("src_named_pool", """SELECT 'conv_' || conv_id AS id, count(*) AS n_messages FROM conversations GROUP BY conv_id""")
def src_named_pool(spark, sf):
    path = scratch(spark, "named")
    pool_rows(spark, sf).drop("shard").write.json(path)
    RD.register_pool("conversation_pool", path)
    back = RD.read_named_pool(spark, "conversation_pool")
    return back.select("id", F.size("messages").cast("long").alias("n_messages"))


@register("src_file_target", f"""WITH {RENDER_SQL}
SELECT 'conv_' || conv_id AS id, trim(string_agg({q_chat._piece()}, '' ORDER BY idx), {q_chat.WS}) AS text
FROM c GROUP BY conv_id""")
def src_file_target(spark, sf):
    """A pool-format file used as a target set (file order, capped at one
    million rows as in the reference)."""
    path = scratch(spark, "target-file")
    pool_rows(spark, sf).drop("shard").write.json(path)
    t = RD.read_file_target(spark, path)
    return t.select("id", C.render_default("messages").alias("text"))


@register("src_csv_by_subject", f"""WITH {q_targets.mc_items_sql('test')}
SELECT subject, q || chr(10) || '"' || a || '"' AS question, nullif(a, '') AS a, nullif(b, '') AS b, nullif(c, '') AS c, nullif(d, '') AS d, answer FROM m""")
def src_csv_by_subject(spark, sf):
    """Multiple-choice items, their questions with a line break and quotes in
    them, written as header-less CSV per subject and read back with the subject
    taken from the path."""
    path = scratch(spark, "mmlu")
    items = q_targets.mc_items(spark, sf, "test")
    question = F.concat("q", F.lit('\n"'), "a", F.lit('"'))
    (items.select(question.alias("question"), "a", "b", "c", "d", "answer", "subject").write.partitionBy("subject")
     .csv(path, header=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    back = RD.read_csv_by_subject(spark, path)
    return back.select("subject", "question", *[F.nullif(F.col(c), F.lit("")).alias(c.lower()) for c in "ABCD"], "answer")


@register("src_nested_qa", f"""
SELECT lang || '-' || doc_id AS id, lang, text AS context, string_split(text, chr(10))[1] AS question, len(string_split(text, chr(10))) - 1 AS n_answers,
       array_to_string(string_split(text, chr(10))[2:], '|') AS answers
FROM documents""")
def src_nested_qa(spark, sf):
    """QA documents in the nested ``data / paragraphs / qas`` form (one small
    document per line), flattened back."""
    path = scratch(spark, "qa")
    d = FX.table(spark, sf, "documents")
    lines = F.split("text", "\n")
    answers = F.transform(F.slice(lines, F.lit(2), F.size(lines) - 1), lambda x: F.struct(x.alias("text")))
    qa = F.struct(F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("id"),
                  F.get(lines, 0).alias("question"), answers.alias("answers"))
    doc = F.array(F.struct(F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs")))
    d.select(doc.alias("data")).write.json(path)
    back = RD.read_nested_qa(spark, path, multiline=False)
    return back.select("id", "lang", "context", "question", F.size("answers").cast("long").alias("n_answers"), F.array_join("answers", "|").alias("answers"))


@register("src_influence", f"""WITH {q_select.SQL_VECTORS.rstrip()},
c AS (SELECT target_id, pool_id // 100 AS batch, pool_id, score FROM scores)
SELECT target_id, batch, string_agg(pool_id::VARCHAR, ',' ORDER BY pool_id) AS pool_ids, string_agg((round(score * 1e6))::BIGINT::VARCHAR, ',' ORDER BY pool_id) AS scores
FROM c GROUP BY target_id, batch""")
def src_influence(spark, sf):
    """Scores written in the influence-file form (per target maps from pool index
    to score, plus malformed ``-1`` entries) and read back as arrays. Pool rows
    come in batches of 100 ids, the work of one task each."""
    path = scratch(spark, "influence")
    batch = F.floor(F.col("pool_id") / 100).cast("int")
    pool = FX.pool_vectors(spark, sf).withColumn("src", batch).repartition("src").sortWithinPartitions("src", "pool_id")
    SK.write_influence(TL.columns_of(pool, FX.target_vectors(spark, sf)), path)
    SK.write_influence(FX.target_vectors(spark, sf).select("target_id", F.array(F.lit(-1)).alias("pool_ids"), F.array(F.lit(0.0)).alias("scores")), path)
    back = RD.read_influence_columns(spark, path)
    # a task's batch of ids may be cut where an Arrow batch ends: its parts are joined in order
    first = F.get("pool_ids", 0)
    parts = (back.groupBy("target_id", F.floor(first / 100).cast("long").alias("batch"))
             .agg(F.array_sort(F.collect_list(F.struct("pool_ids", "scores"))).alias("p")))
    joined = lambda c: F.flatten(F.transform("p", lambda x: x[c]))                                     # noqa: E731
    return parts.select("target_id", "batch", F.array_join(joined("pool_ids").cast("array<string>"), ",").alias("pool_ids"), TL.listed(joined("scores")).alias("scores"))


@register("src_jsonl_gz", """
SELECT 'doc/' || doc_id AS task_id, CASE WHEN doc_id % 3 = 0 THEN n_chars + 2 WHEN doc_id % 3 = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars, source FROM documents""")
def src_jsonl_gz(spark, sf):
    """Documents as gzip JSON lines keyed by a task id, in three files with blank
    lines: the second and third repeat some keys, and the last line of a key counts."""
    path = scratch(spark, "problems")
    d = FX.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("task_id"), "n_chars", "source", "doc_id")
    for part, rows in enumerate((d, d.where("doc_id % 3 <> 2"), d.where("doc_id % 3 = 0"))):
        line = F.to_json(F.struct("task_id", (F.col("n_chars") + part).alias("n_chars"), "source"))
        with_blank = rows.select(F.explode(F.array(line, F.lit(""), F.lit("  "))).alias("value"))
        with_blank.write.option("compression", "gzip").text(f"{path}/part={part}")
    return RD.read_problems(spark, path).select("task_id", "n_chars", "source")


@register("src_task_json", """
SELECT source AS task, k AS pos, text AS input, n_chars::VARCHAR AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS k FROM documents)""")
def src_task_json(spark, sf):
    """Examples per task: documents by source, a JSON document for a thousand ids."""
    path = scratch(spark, "examples")
    d = FX.table(spark, sf, "documents")
    one = F.struct("doc_id", F.struct(F.col("text").alias("input"), F.col("n_chars").cast("string").alias("target")).alias("e"))
    made = d.groupBy(F.col("source").alias("task"), F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    made.select("task", F.transform("x", lambda x: x["e"]).alias("examples")).write.partitionBy("task").json(path)
    return RD.read_task_examples(spark, path, multiline=False).select("task", F.col("pos").cast("long").alias("pos"), "input", "target")


@register("src_lines_by_file", f"""
WITH e AS (SELECT lang, source, replace(replace(text, '\\', '\\\\'), chr(10), '\\n') AS line FROM documents)
SELECT lang AS label, source AS "group", replace(replace(trim(line, {q_targets.WS}), '\\\\', '\\'), '\\n', chr(10)) AS text FROM e""")
def src_lines_by_file(spark, sf):
    """A line per document, escaped, in files named by language and source."""
    path = scratch(spark, "lines")
    d = FX.table(spark, sf, "documents")
    line = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    d.select(F.concat_ws("_", "lang", "source").alias("name"), line.alias("value")).write.partitionBy("name").text(path)
    return RD.read_lines_by_file(spark, path).select("label", "group", "text")


@register("src_allow_ids", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1")
def src_allow_ids(spark, sf):
    path = scratch(spark, "allow")
    lab = FX.table(spark, sf, "labels").filter("quality = 1")
    lab.select(F.col("doc_id").cast("string").alias("id")).write.json(path)
    return RD.read_allow_ids(spark, path)


@register("src_domain_weights_file", f"""
WITH {q_select.WEIGHTS_SQL.strip()}
SELECT domain, round(weight / sum(weight) OVER (), 6) + 0.0 AS weight,
       round(weight / sum(weight) OVER () * {q_select.K_SELECT}, 6) + 0.0 AS quota FROM w""")
def src_domain_weights_file(spark, sf):
    """Domain weights stored as one JSON object, read back and normalised."""
    path = scratch(spark, "weights")
    w = q_select.domain_weights(spark, sf)   # one row per domain
    obj = w.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("domain", "weight")))).alias("value"))
    obj.write.text(path)
    q = S.domain_quotas(RD.read_domain_weights(spark, path), q_select.K_SELECT)
    return q.select("domain", r6("weight").alias("weight"), r6("quota").alias("quota"))


@register("src_embedding_cache", f"""WITH {__import__('sieve.plans.q_vectors', fromlist=['x']).SQL_STATES}
SELECT sample_id, d, round(x, 6) + 0.0 AS x FROM wm WHERE layer = {FX.N_LAYERS}""")
def src_embedding_cache(spark, sf):
    """Pool vectors computed once, stored as Parquet, then served from the
    store (the second read does not recompute)."""
    path = scratch(spark, "emb")
    compute = lambda: P.embed(FX.token_states(spark, sf), "weighted_mean", n_layers=FX.N_LAYERS)
    RD.cached_embeddings(spark, path, compute)
    again = RD.cached_embeddings(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("cache miss")))
    return P.explode_dims(again).select("sample_id", F.col("d").cast("long").alias("d"), r6("x").alias("x"))


@register("snk_similarity", f"""WITH {q_select.SQL_VECTORS.rstrip()}
SELECT 'benchmark_2_redcat_model_2048' AS target_set, 'redcat' AS sec_pooling, * FROM ({q_select.tiles_sql()})""")
def snk_similarity(spark, sf):
    path = scratch(spark, "sim")
    name = SK.similarity_name("benchmark", 2, "redcat", "org/model", 2048, None)
    SK.write_similarity(q_select.tiles(spark, sf), path, name, n_layer=2, sec_pooling="redcat")
    back = RD.read_similarity(spark, path, name).tiles
    return back.select("target_set", "sec_pooling", "pool_id", F.col("block").cast("long").alias("block"), TL.listed("scores").alias("scores"))


@register("snk_selected_rows", q_select._rr_sql("DESC", q_select.K_SELECT) + f"""
SELECT o.sel_rank, o.pool_id, e.label, round(o.score, 6) + 0.0 AS influence_score
FROM o JOIN embeddings e ON e.vec_id = o.pool_id WHERE o.sel_rank <= {q_select.K_SELECT}""")
def snk_selected_rows(spark, sf):
    path = scratch(spark, "selected")
    pool = FX.pool_vectors(spark, sf)
    sel = S.select_round_robin_from_pool(pool, FX.target_vectors(spark, sf), q_select.K_SELECT)
    SK.write_selected_rows(sel, pool.drop("vec"), path)
    back = spark.read.json(path)
    return back.select("sel_rank", "pool_id", F.col("label").cast("int").alias("label"),
                       r6("influence_score").alias("influence_score"))


@register("batch_selected_rows", q_select._mean_sql(q_select.NORM_SQL, True, q_select.K_SELECT).replace("SELECT row_number()", ", picked AS (SELECT row_number()", 1) + """)
SELECT sel_rank, p.pool_id, label, score AS influence_score FROM picked p JOIN pv USING (pool_id)""")
def batch_selected_rows(spark, sf):
    """Pool and targets to written rows in one batch call."""
    path = scratch(spark, "batch")
    BT.run(spark, FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), method="normalized_mean_max", k=q_select.K_SELECT, out=path)
    back = spark.read.json(f"{path}/rows")
    return back.select("sel_rank", "pool_id", F.col("label").cast("int").alias("label"), r6("influence_score").alias("influence_score"))


@register("snk_selected_ids", q_select._rr_sql("DESC", q_select.K_SELECT) + f"""
SELECT sel_rank, pool_id FROM o WHERE sel_rank <= {q_select.K_SELECT}""")
def snk_selected_ids(spark, sf):
    path = scratch(spark, "ids")
    sel = S.select_round_robin_from_pool(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), q_select.K_SELECT)
    SK.write_selected_ids(sel, path)
    return spark.read.json(path).select("sel_rank", "pool_id")


@register("snk_predictions", """
SELECT doc_id, 2 AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def snk_predictions(spark, sf):
    """Predictions appended twice (gzip JSON lines); every id comes back twice."""
    path = scratch(spark, "pred")
    p = q_scoring.predictions(spark, sf).select(F.col("id").alias("doc_id"), "prediction_text")
    SK.write_predictions(p, path)
    SK.write_predictions(p, path)
    back = spark.read.json(path)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("snk_metrics", f"""WITH {q_scoring.SQL_GRADED}
SELECT CASE GROUPING(subject, subcategory, category) WHEN 3 THEN 'subject' WHEN 5 THEN 'subcategory'
            WHEN 6 THEN 'category' ELSE 'overall' END AS level,
       coalesce(subject, subcategory, category, 'all') AS name, count(*) AS n,
       round(avg(correct::DOUBLE), 6) + 0.0 AS accuracy
FROM gr GROUP BY GROUPING SETS ((subject), (subcategory), (category), ())""")
def snk_metrics(spark, sf):
    """Accuracy rollup written as CSV per level and read back."""
    path = scratch(spark, "metrics")
    SK.write_metrics(q_scoring.agg_accuracy_rollup(spark, sf), path, partition_by="level", fmt="csv")
    back = spark.read.option("header", True).schema("name string, n bigint, accuracy double, level string").csv(path)
    return back.select("level", "name", "n", r6("accuracy").alias("accuracy"))
