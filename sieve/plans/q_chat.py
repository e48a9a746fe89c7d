"""Conversation rendering queries over the ``conversations`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.functions import text as T
from sieve.plans import fixtures as FX
from sieve.plans.catalog import register

NL = "chr(10)"
WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
TRUNC = 64
MASK_N = 256

# one row per turn with its 1-based position and the conversation's first role
SQL_TURNS = """
c AS (SELECT conv_id, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx,
             first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first_role
      FROM conversations),
ids AS (SELECT DISTINCT conv_id FROM conversations)"""


def _piece(strip_user: bool = True, eos_assistant: str = "'</s>'") -> str:
    u = f"trim(text, {WS})" if strip_user else "text"
    return (f"CASE role WHEN 'system' THEN '<|system|>' || {NL} || {u} || {NL} "
            f"WHEN 'user' THEN '<|user|>' || {NL} || {u} || {NL} "
            f"WHEN 'assistant' THEN '<|assistant|>' || {NL} || trim(text, {WS}) || {eos_assistant} || {NL} "
            f"ELSE error('Invalid role: ' || role) END")


def messages(spark, sf):
    return FX.conversation_messages(spark, sf)


def _out(df, col):
    return df.select("conv_id", col.alias("text"))


@register("chat_prompt", f"""WITH {SQL_TURNS}
SELECT conv_id, string_agg({_piece(False)}, '' ORDER BY idx) || '<|assistant|>' || {NL} AS text FROM c GROUP BY conv_id""")
def chat_prompt(spark, sf):
    return _out(messages(spark, sf), C.chat_prompt("messages"))


def _cleanup(expr: str) -> str:
    return f"replace(replace({expr}, '<|assistant|>' || {NL}, ''), '</s>', '')"


@register("chat_prompt_prompt_only", f"""WITH {SQL_TURNS},
a AS (SELECT conv_id, string_agg({_piece(False)}, '' ORDER BY idx) AS body FROM c
      WHERE idx <= CASE WHEN first_role = 'system' THEN 2 ELSE 1 END GROUP BY conv_id)
SELECT ids.conv_id, {_cleanup(f"coalesce(a.body, '') || '<|assistant|>' || {NL}")} AS text
FROM ids LEFT JOIN a USING (conv_id)""")
def chat_prompt_prompt_only(spark, sf):
    return _out(messages(spark, sf), C.chat_prompt("messages", prompt_only=True))


@register("chat_prompt_response_only", f"""WITH {SQL_TURNS},
a AS (SELECT conv_id, string_agg({_piece(False)}, '' ORDER BY idx) AS body FROM c
      WHERE idx = CASE WHEN first_role = 'system' THEN 3 ELSE 2 END GROUP BY conv_id)
SELECT ids.conv_id, {_cleanup(f"coalesce(a.body, '') || '<|assistant|>' || {NL}")} AS text
FROM ids LEFT JOIN a USING (conv_id)""")
def chat_prompt_response_only(spark, sf):
    return _out(messages(spark, sf), C.chat_prompt("messages", response_only=True))


@register("chat_prompt_no_special_tokens", f"""WITH {SQL_TURNS}
SELECT conv_id, replace(replace(string_agg({_piece(False)}, '' ORDER BY idx) || '<|assistant|>' || {NL}, '<s>', ''), '</s>', '') AS text
FROM c GROUP BY conv_id""")
def chat_prompt_no_special_tokens(spark, sf):
    return _out(messages(spark, sf), C.chat_prompt("messages", no_special_tokens=True))


@register("render_default", f"""WITH {SQL_TURNS}
SELECT conv_id, trim(string_agg({_piece()}, '' ORDER BY idx), {WS}) AS text FROM c GROUP BY conv_id""")
def render_default(spark, sf):
    return _out(messages(spark, sf), C.render_default("messages"))


def _vendor_sql(eos_each: bool) -> str:
    eos = "'</s>'" if eos_each else "''"
    piece = (f"CASE role WHEN 'user' THEN '<|user|>' || {NL} || trim(text, {WS}) || {NL} "
             f"WHEN 'assistant' THEN '<|assistant|>' || {NL} || trim(text, {WS}) || {eos} || {NL} "
             f"ELSE error('Invalid role: ' || role) END")
    tail = "" if eos_each else " || '</s>'"
    return f"""WITH {SQL_TURNS},
s AS (SELECT conv_id, text AS sys FROM c WHERE idx = 1 AND role = 'system'),
b AS (SELECT conv_id, string_agg({piece}, '' ORDER BY idx) AS body FROM c WHERE role <> 'system' GROUP BY conv_id)
SELECT ids.conv_id,
       trim(coalesce('<|system|>' || {NL} || trim(s.sys, {WS}) || {NL}, '') ||
            coalesce(b.body, error('messages field is empty.')), {WS}){tail} AS text
FROM ids LEFT JOIN s USING (conv_id) LEFT JOIN b USING (conv_id)"""


def vendor_rows(spark, sf):
    """Conversations in the vendor form: a leading system turn becomes
    ``system_message``; user/assistant become HUMAN/ASSISTANT."""
    m = messages(spark, sf)
    return m.select("conv_id", C.system_text("messages").alias("system_message"),
                    C.to_vendor("messages").alias("messages"))


@register("render_vendor", _vendor_sql(False))
def render_vendor(spark, sf):
    return _out(vendor_rows(spark, sf), C.render_vendor("messages", "system_message"))


@register("render_vendor_eos", _vendor_sql(True))
def render_vendor_eos(spark, sf):
    return _out(vendor_rows(spark, sf), C.render_vendor_eos("messages", "system_message"))


SYSTEM_FIELD_SQL = f"""WITH {SQL_TURNS},
s AS (SELECT conv_id, text AS sys FROM c WHERE idx = 1 AND role = 'system'),
b AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<|user|>' || {NL} || trim(text, {WS}) || {NL}
                                  WHEN 'assistant' THEN '<|assistant|>' || {NL} || trim(text, {WS}) || {NL}
                                  WHEN 'system' THEN '' ELSE error('Invalid role: ' || role) END, '' ORDER BY idx) AS body
      FROM c GROUP BY conv_id)
SELECT ids.conv_id, trim(coalesce('<|system|>' || {NL} || trim(s.sys, {WS}) || {NL}, '') || b.body, {WS}) || '</s>' AS text
FROM ids LEFT JOIN s USING (conv_id) JOIN b USING (conv_id)"""


def system_field_rows(spark, sf):
    m = messages(spark, sf)
    return m.select("conv_id", C.system_text("messages").alias("system"), "messages")


@register("render_system_field", SYSTEM_FIELD_SQL)
def render_system_field(spark, sf):
    return _out(system_field_rows(spark, sf), C.render_system_field("messages", "system"))


@register("render_dispatch", f"""
SELECT 'tulu3' AS pool, conv_id, text FROM ({SYSTEM_FIELD_SQL}) d
UNION ALL
SELECT 'alpaca' AS pool, conv_id, text FROM (WITH {SQL_TURNS}
  SELECT conv_id, trim(string_agg({_piece()}, '' ORDER BY idx), {WS}) AS text FROM c GROUP BY conv_id) x
WHERE conv_id % 2 = 0
UNION ALL
SELECT 'alpaca' AS pool, conv_id, text FROM ({_vendor_sql(True)}) v WHERE conv_id % 2 = 1
UNION ALL
SELECT 'ling_mini' AS pool, conv_id, text FROM ({_vendor_sql(False)}) y""")
def render_dispatch(spark, sf):
    """The renderer chosen by pool name, for three pool names; in a pool of another
    name by row: here every second row carries ``mid`` and has the vendor's roles."""
    rows = system_field_rows(spark, sf).join(vendor_rows(spark, sf).select(
        "conv_id", "system_message", F.col("messages").alias("vendor_messages")), "conv_id")
    parts = []
    for pool in ("tulu3", "alpaca", "ling_mini"):
        own = rows.withColumn("mid", F.when(F.col("conv_id") % 2 == 1, F.col("conv_id").cast("string")) if pool == "alpaca" else F.lit(None).cast("string"))
        own = own.withColumn("messages", F.when(F.col("mid").isNotNull() | F.lit("ling" in pool), F.col("vendor_messages")).otherwise(F.col("messages")))
        text = C.render_dispatch(pool, "messages", system="system", system_message="system_message", mid="mid")
        parts.append(own.select(F.lit(pool).alias("pool"), "conv_id", text.alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("first_two_turns", f"""WITH {SQL_TURNS}
SELECT conv_id, trim(string_agg({_piece()}, '' ORDER BY idx), {WS}) AS text FROM c
WHERE (first_role = 'system' AND idx IN (2, 3)) OR (first_role <> 'system' AND idx IN (1, 2)) GROUP BY conv_id""")
def first_two_turns(spark, sf):
    return _out(messages(spark, sf), C.render_default(C.first_two_turns("messages")))


@register("prompt_only", f"""WITH {SQL_TURNS}
SELECT conv_id, trim(string_agg({_piece()}, '' ORDER BY idx), {WS}) || '</s>' AS text FROM c
WHERE idx <= CASE WHEN first_role = 'system' THEN 2 ELSE 1 END GROUP BY conv_id""")
def prompt_only(spark, sf):
    return _out(messages(spark, sf), C.prompt_only("messages"))


@register("response_only", f"""WITH {SQL_TURNS},
r AS (SELECT conv_id, '<|assistant|>' || {NL} || trim(text, {WS}) || '</s>' AS text FROM c
      WHERE idx = CASE WHEN first_role = 'system' THEN 3 ELSE 2 END)
SELECT ids.conv_id, r.text FROM ids LEFT JOIN r USING (conv_id)""")
def response_only(spark, sf):
    return _out(messages(spark, sf), C.response_only("messages"))


TOKENS_SQL = f"list_filter(string_split_regex(%s, '[ ' || {NL} || ']+'), lambda t: t <> '')"


@register("truncate_tokens", f"""WITH {SQL_TURNS},
r AS (SELECT conv_id, {TOKENS_SQL % f"trim(string_agg({_piece()}, '' ORDER BY idx), {WS})"} AS toks FROM c GROUP BY conv_id)
SELECT conv_id, len(toks) AS n_tokens, array_to_string(toks[1:{TRUNC}], ' ') AS text FROM r""")
def truncate_tokens(spark, sf):
    toks = C.tokens(C.render_default("messages"))
    m = messages(spark, sf).select("conv_id", toks.alias("toks"))
    return m.select("conv_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.array_join(C.truncate_tokens("toks", TRUNC), " ").alias("text"))


MASKED = "-100"


def _labels_sql(pieces: str, form: str) -> str:
    """Tokens and labels of ``pieces`` (conv_id, idx, role, prev_role, text)."""
    return f"""SELECT '{form}' AS form, conv_id, array_to_string(flatten(list(toks ORDER BY idx))[1:{MASK_N}], ' ') AS tokens,
  array_to_string(flatten(list(CASE WHEN role <> 'assistant' THEN list_transform(toks, lambda t: '{MASKED}')
    WHEN prev_role IS NOT NULL AND prev_role <> 'assistant' THEN list_concat(['{MASKED}'], toks[2:]) ELSE toks END ORDER BY idx))[1:{MASK_N}], ' ') AS labels
FROM (SELECT *, {TOKENS_SQL % 'piece'} AS toks FROM ({pieces})) GROUP BY conv_id"""


def _masked_out(df, form: str):
    """A label is shown as -100 where it is masked."""
    return df.select(F.lit(form).alias("form"), "conv_id", F.array_join("s.tokens", " ").alias("tokens"), F.array_join("s.labels", " ", MASKED).alias("labels"))


@register("mask_non_assistant", f"""
{_labels_sql(f"WITH {SQL_TURNS} SELECT conv_id, idx, role, lag(role) OVER (PARTITION BY conv_id ORDER BY idx) AS prev_role, {_piece()} AS piece FROM c", "chat")}
UNION ALL
{_labels_sql(f"WITH {SQL_TURNS} SELECT conv_id, idx, role, CASE WHEN first_role = 'system' AND idx = 2 THEN NULL ELSE lag(role) OVER (PARTITION BY conv_id ORDER BY idx) END AS prev_role, {_piece()} AS piece FROM c", "vendor")}""")
def mask_non_assistant(spark, sf):
    """Tokens and labels of the chat and the vendor form, by one mask. In the vendor
    form the system message masks itself only, not the tag of a reply after it."""
    chat = messages(spark, sf).select("conv_id", C.chat_pieces("messages").alias("p"))
    vendor = vendor_rows(spark, sf).select("conv_id", C.vendor_pieces("messages", "system_message").alias("p"))
    parts = [_masked_out(df.select("conv_id", C.token_labels("p", MASK_N).alias("s")), form) for df, form in ((chat, "chat"), (vendor, "vendor"))]
    return parts[0].unionByName(parts[1])


@register("turn_spans", f"""WITH {SQL_TURNS},
p AS (SELECT conv_id, idx, role, length({_piece()}) AS n FROM c),
q AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY idx) AS stop, sum(n) OVER (PARTITION BY conv_id) AS total FROM p)
SELECT conv_id, idx - 1 AS turn, role, (stop - n)::BIGINT AS start, least(stop, total - 1)::BIGINT AS "end" FROM q""")
def turn_spans(spark, sf):
    """Every turn's place in the rendered text (whose last line feed is stripped)."""
    m = messages(spark, sf).select("conv_id", C.chat_pieces("messages").alias("p"))
    return m.select("conv_id", F.posexplode(C.spans("p")).alias("turn", "s")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "s.role", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


SAMPLE_N = 48

_SAMPLE_SQL = f"""WITH {SQL_TURNS},
pr AS (SELECT conv_id, string_agg({_piece(False)}, '' ORDER BY idx) || '<|assistant|>' || {NL} AS prompt FROM c
       WHERE idx <= CASE WHEN first_role = 'system' THEN 2 ELSE 1 END GROUP BY conv_id),
lb AS (SELECT conv_id, trim(text, {WS}) AS label FROM c WHERE idx = CASE WHEN first_role = 'system' THEN 3 ELSE 2 END),
t AS (SELECT conv_id, ({TOKENS_SQL % "prompt"})[1:{SAMPLE_N}] AS p, ({TOKENS_SQL % f"replace(prompt || '</s>', {NL} || '<|assistant|>' || {NL}, '')"})[1:{SAMPLE_N}] AS po,
        ({TOKENS_SQL % "label || '</s>'"})[1:{SAMPLE_N}] AS l, ({TOKENS_SQL % "'<s>' || label || '</s>'"})[1:{SAMPLE_N}] AS ro FROM pr JOIN lb USING (conv_id))"""


@register("join_prompt_label", f"""{_SAMPLE_SQL}
SELECT 'both' AS mode, conv_id, array_to_string(list_concat(p, l), ' ') AS tokens, array_to_string(list_concat(list_transform(p, lambda x: '{MASKED}'), l), ' ') AS labels FROM t
UNION ALL SELECT 'prompt_only', conv_id, array_to_string(po, ' '), array_to_string(list_transform(po, lambda x: '{MASKED}'), ' ') FROM t
UNION ALL SELECT 'response_only', conv_id, array_to_string(ro, ' '), array_to_string(ro, ' ') FROM t""")
def join_prompt_label(spark, sf):
    """Target samples from conversations in the three modes: prompt tokens (masked)
    and reply tokens with EOS (kept), each side cut by itself."""
    m = messages(spark, sf)
    system = F.element_at("messages", 1)["role"] == "system"
    first = F.when(system, F.slice("messages", 1, 2)).otherwise(F.slice("messages", 1, 1))
    reply = F.when(system, F.get(F.col("messages"), 2)).otherwise(F.get(F.col("messages"), 1))
    t = (m.select("conv_id", C.chat_prompt(first).alias("prompt"), T.strip(reply["content"]).alias("label"))
         .filter(F.col("label").isNotNull()))
    out = None
    for mode, how in (("both", {}), ("prompt_only", {"prompt_only": True}), ("response_only", {"response_only": True})):
        part = t.select("conv_id", C.target_sample("prompt", "label", SAMPLE_N, **how).alias("s"))
        part = _masked_out(part, mode).withColumnRenamed("form", "mode")
        out = part if out is None else out.unionByName(part)
    return out


@register("suffix_cue", f"""
SELECT item_id, CASE WHEN suffix(text, {NL}) OR suffix(text, ' ') THEN text || 'The answer is:'
                     ELSE text || ' The answer is:' END AS text FROM benchmark""")
def suffix_cue(spark, sf):
    b = FX.table(spark, sf, "benchmark")
    return b.select("item_id", T.suffix_cue("text", "The answer is:").alias("text"))
