"""More target-set builders, selection dispatch and small join/operator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import text as T
from sieve.operators import selection as S
from sieve.operators import similarity as SIM
from sieve.operators import tiles as TL
from sieve.plans import fixtures as FX
from sieve.plans import q_select as QS
from sieve.plans import target_sets as TS
from sieve.plans.catalog import r6, register
from sieve.plans.q_io import scratch
from sieve.plans.q_targets import (NL, SEED, TP_SQL, WS, _out, _set, chat_sql, key_sql, mc_body_sql, mc_items, mc_items_sql, num_items, num_items_sql, pairs, passages,
                                   task_prompts, PAIRS_SQL)
from sieve.sources import readers as RD
from sieve.sources import sinks as SK


@register("tgt_mmlu_cot", f"""WITH {mc_items_sql('test')}
SELECT target_id, {chat_sql(mc_body_sql())} AS prompt, answer AS label FROM m
ORDER BY {key_sql('target_id')}, target_id LIMIT 114""")
def tgt_mmlu_cot(spark, sf):
    """Items of one question file, chat format, no header and no cue; 114 drawn."""
    return _set(spark, "mmlu_cot", test=mc_items(spark, sf, "test"))


def cot_answer_only(task_prompt):
    """Keep each ``Q:`` block as question + ``\\nA: `` + the text after its last
    "So the answer is" (blocks without that phrase stay as they are)."""
    fields = F.split(T.col(task_prompt), "\n\n", -1)

    def short(f):
        q = T.strip(F.split_part(f, F.lit("\nA:"), F.lit(1)))
        a = T.strip(F.element_at(F.split(f, "So the answer is", -1), -1))
        ok = f.startswith("Q:") & f.contains("So the answer is") & f.contains("\nA:")
        return F.when(ok, F.concat(q, F.lit("\nA: "), a)).otherwise(f)
    return F.array_join(F.transform(fields, short), "\n\n")


@register("cot_answer_only", f"""WITH {TP_SQL},
f AS (SELECT task, unnest(string_split(task_prompt, {NL} || {NL})) AS field,
             generate_subscripts(string_split(task_prompt, {NL} || {NL}), 1) AS pos FROM tp)
SELECT task, string_agg(CASE WHEN starts_with(field, 'Q:') AND contains(field, 'So the answer is') AND contains(field, {NL} || 'A:')
                        THEN trim(split_part(field, {NL} || 'A:', 1), {WS}) || {NL} || 'A: ' || trim(split_part(field, 'So the answer is', -1), {WS})
                        ELSE field END, {NL} || {NL} ORDER BY pos) AS task_prompt
FROM f GROUP BY task""")
def cot_answer_only_q(spark, sf):
    tp = task_prompts(spark, sf)
    return tp.select("task", cot_answer_only("task_prompt").alias("task_prompt"))


@register("tgt_squad_shots", f"""WITH {num_items_sql('dev', 'e')},
sh AS (SELECT string_agg(text, {NL} ORDER BY target_id) AS shots FROM (SELECT * FROM e ORDER BY target_id LIMIT 3)),
p AS (SELECT b.item_id AS target_id, {chat_sql(f"sh.shots || {NL} || d.text || {NL} || {NL} || b.text")} AS prompt,
             string_split(d.text, {NL})[1] AS label
      FROM benchmark b JOIN documents d ON d.doc_id = b.item_id, sh)
SELECT * FROM p ORDER BY {key_sql('target_id')}, target_id LIMIT 500""")
def tgt_squad_shots(spark, sf):
    """Passage QA with three example passages in front (here the first three dev
    documents; the reference prints three fixed passages)."""
    return _set(spark, "squad_shots", rows=passages(spark, sf), examples=num_items(spark, sf, "dev"))


@register("tgt_mbpp", f"""
WITH cp AS (SELECT b.item_id AS target_id, b.text AS description, d.text AS code, string_split(d.text, {NL}) AS tests
            FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
p AS (SELECT target_id, {chat_sql(f"rtrim(description || ' You need to pass the following test cases:' || {NL} || array_to_string(list_transform(tests, lambda t: t || {NL}), ''), {NL})")} AS prompt,
             'Here is the function:' || {NL} || {NL} || '```python' || {NL} || {NL} || code AS label FROM cp)
SELECT * FROM p ORDER BY {key_sql('target_id')}, target_id LIMIT 43""")
def tgt_mbpp(spark, sf):
    """Task text plus its test lines -> the code under a fixed header."""
    from sieve.plans.q_scoring import code_problems
    return _set(spark, "mbpp_val", tasks=code_problems(spark, sf).withColumnRenamed("task_id", "target_id"))


@register("tgt_limo", f"""WITH {PAIRS_SQL}
SELECT conv_id AS target_id, {chat_sql(f"trim(instruction, {WS})")} AS prompt, output AS label
FROM pr WHERE instruction IS NOT NULL AND output IS NOT NULL ORDER BY {key_sql('conv_id')}, conv_id LIMIT 100""")
def tgt_limo(spark, sf):
    """Question -> worked solution (the solution is not stripped)."""
    return _out(TS.targets_of(spark, "limo", {"pairs": pairs(spark, sf)}, num_samples=100, seed=SEED))


@register("tgt_toxigen", f"""
WITH g AS (SELECT doc_id, source, replace(text, {NL}, '\\n') AS line,
                  row_number() OVER (PARTITION BY source ORDER BY {key_sql('doc_id')}, doc_id) AS rk FROM documents),
lp AS (SELECT source, replace(replace(trim(line, {WS}), '\\\\', '\\'), '\\n', {NL}) AS label_prompt FROM g WHERE rk = 11)
SELECT g.doc_id AS target_id, {chat_sql("'Complete the following: ' || replace(replace(trim(g.line, " + WS + "), '\\\\', '\\'), '\\n', " + NL + ")")} AS prompt,
       lp.label_prompt AS label
FROM g JOIN lp USING (source) WHERE g.rk <= 10 ORDER BY {key_sql('g.doc_id')}, g.doc_id LIMIT 140""")
def tgt_toxigen(spark, sf):
    """At most ten lines per group (here: per source), each as "Complete the
    following: ..."; the label is the group's first line after the cap (the
    reference draws it from that, empty, remainder)."""
    line = T.strip(F.replace("text", F.lit("\n"), F.lit("\\n")))          # a file's line, its line feeds escaped
    text = F.replace(F.replace(line, F.lit("\\\\"), F.lit("\\")), F.lit("\\n"), F.lit("\n"))
    return _set(spark, "toxigen", lines=FX.table(spark, sf, "documents").select(F.col("doc_id").alias("target_id"), "source", text.alias("text")))


# ---------------------------------------------------------------- joins and small operators

@register("join_domain_lookup", QS._rr_sql("DESC", QS.K_SELECT) + f""",
sel AS (SELECT * FROM o WHERE sel_rank <= {QS.K_SELECT})
SELECT sel.sel_rank, sel.pool_id, CAST(pv.label AS VARCHAR) AS domain, trim(d.text, {WS}) AS first_message
FROM sel JOIN pv USING (pool_id) JOIN documents d ON d.doc_id = sel.pool_id""")
def join_domain_lookup(spark, sf):
    """Selected rows with their domain and first message (here: the document
    with the same id), as the quota bookkeeping looks them up."""
    pool = FX.pool_vectors(spark, sf)
    sel = S.select_round_robin_from_pool(pool, FX.target_vectors(spark, sf), QS.K_SELECT)
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("pool_id"),
                                                T.strip("text").alias("first_message"))
    return (sel.join(pool.select("src", "pool_id", "domain"), ["src", "pool_id"]).join(d, "pool_id")
            .select(F.col("sel_rank").cast("long").alias("sel_rank"), "pool_id", "domain", "first_message"))


@register("union_shards", f"""WITH {QS.SQL_VECTORS} {QS.tiles_sql()}""")
def union_shards(spark, sf):
    """The pool scored in three shards (by label), each stored by itself as tiles,
    and the shards read back as one matrix."""
    path = scratch(spark, "shards")
    targets = SIM.target_matrix(FX.target_vectors(spark, sf))
    for cond in (F.col("label") < 3, F.col("label").between(3, 6), F.col("label") > 6):
        SK.write_similarity(TL.score_tiles(FX.pool_vectors(spark, sf).filter(cond), targets, QS.TILE_WIDTH), path, "benchmark")
    return QS._tiles_out(RD.read_similarity(spark, path, "benchmark").tiles)


def _dispatch_sql() -> str:
    from sieve.plans.q_select import MEAN_SQL, NORM_SQL, RR_COLS, _mean_sql, _rr_sql, K_SELECT as K
    parts = {
        "max": _rr_sql("DESC", K) + f"SELECT {RR_COLS} FROM o WHERE sel_rank <= {K}",
        "min": _rr_sql("ASC", K, cut=False) + f"SELECT {RR_COLS} FROM o WHERE sel_rank <= {K}",
        "mean_min": _mean_sql(MEAN_SQL, False, K), "mean_max": _mean_sql(MEAN_SQL, True, K),
        "normalized_mean_min": _mean_sql(NORM_SQL, False, K), "normalized_mean_max": _mean_sql(NORM_SQL, True, K),
    }
    return "\nUNION ALL\n".join(f"SELECT '{m}' AS method, sel_rank, pool_id, score FROM ({sql}) x{i}"
                                for i, (m, sql) in enumerate(parts.items()))


@register("dispatch", _dispatch_sql())
def dispatch(spark, sf):
    """Every selection method through the name dispatch."""
    pool, targets = FX.pool_vectors(spark, sf), SIM.target_matrix(FX.target_vectors(spark, sf))
    out = None
    for m in ("max", "min", "mean_min", "mean_max", "normalized_mean_min", "normalized_mean_max"):
        sel = S.select_from_pool(pool, targets, m, QS.K_SELECT).select(F.lit(m).alias("method"),
                                                                    F.col("sel_rank").cast("long").alias("sel_rank"), "pool_id",
                                                                    r6("score").alias("score"))
        out = sel if out is None else out.unionByName(sel)
    return out


STOP_SEQ = ["of", "the"]


SEP = "\u0001"


def cut_at_stop_ids(tokens, stop, pad: str = "<pad>"):
    """Token form of the stop cut: from the first occurrence of the stop
    sequence on, every token becomes ``pad``.

    The tokens are joined with a control character (assumed absent from
    tokens) and the stop sequence is found with one ``instr``; the number of
    separators before the match is the index of its first token. Linear in the
    length of the array."""
    toks = T.col(tokens)
    joined = F.concat(F.lit(SEP), F.array_join(F.transform(toks, lambda t: t.cast("string")), SEP), F.lit(SEP))
    pos = F.instr(joined, SEP + SEP.join(str(x) for x in stop) + SEP)
    before = F.substring(joined, F.lit(1), pos - 1)
    first = F.when(pos > 0, F.length(before) - F.length(F.replace(before, F.lit(SEP), F.lit(""))))
    # tokens before the match, then pads (no row-level expression inside a lambda)
    kept = F.slice(toks, F.lit(1), F.coalesce(first, F.size(toks)))
    return F.concat(kept, F.array_repeat(F.lit(pad), F.size(toks) - F.size(kept)))


@register("cut_at_stop_ids", f"""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS toks FROM documents),
s AS (SELECT doc_id, len(toks) AS n_tokens,
             list_min(list_filter(range(1, len(toks)), lambda i: toks[i] = '{STOP_SEQ[0]}' AND toks[i + 1] = '{STOP_SEQ[1]}')) AS first FROM t)
SELECT doc_id, n_tokens, coalesce(first - 1, n_tokens) AS n_kept FROM s""")
def cut_at_stop_ids_q(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("toks"))
    cut = d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                   cut_at_stop_ids("toks", STOP_SEQ).alias("cut"))
    return cut.select("doc_id", "n_tokens",
                      F.size(F.filter("cut", lambda t: t != "<pad>")).cast("long").alias("n_kept"))


