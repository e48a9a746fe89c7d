"""Rendering of chat conversations to model input text.

All renderers are Column expressions over ``messages array<struct<role,
content>>``: ``transform`` builds each turn's piece and ``array_join`` glues
them, so rendering runs in the JVM with no Python UDF. An unknown role raises
(``raise_error``), as the reference does.

The forms that can be masked for training emit their pieces with what is needed to
place them again: :func:`spans` gives every turn's place in the text, and
:func:`token_labels` the tokens with those of other turns than the assistant's
masked, by one code for every form.

Templates (fixed values): turns are introduced by ``<|system|>``, ``<|user|>``,
``<|assistant|>`` (and ``<|observation|>`` in the vendor form), each followed by
a newline; ``eos`` and ``bos`` default to the Llama strings ``</s>`` and ``<s>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieve.functions.text import col, lstrip, strip

# Role tags of the chat template.
SYSTEM_TAG = "<|system|>\n"
USER_TAG = "<|user|>\n"
ASSISTANT_TAG = "<|assistant|>\n"
OBSERVATION_TAG = "<|observation|>\n"
EOS = "</s>"
BOS = "<s>"


def _bad_role(m) -> Column:
    return F.raise_error(F.concat(F.lit("Invalid role: "), F.coalesce(m["role"], F.lit("null"))))


def _render(messages, piece) -> Column:
    return F.array_join(F.transform(col(messages), piece), "")


def _first_is_system(messages) -> Column:
    return F.element_at(col(messages), 1)["role"] == "system"


def chat_prompt(messages, eos: str = EOS, bos: str = BOS, prompt_only: bool = False,
                response_only: bool = False, no_special_tokens: bool = False) -> Column:
    """Chat-format prompt text: user/system contents as is, assistant contents
    stripped plus EOS, then a trailing assistant tag. ``response_only`` keeps
    message 2 (3 after a system turn), ``prompt_only`` the first turn (two after a
    system turn); both then delete every assistant tag and EOS."""
    msgs = col(messages)
    if response_only:
        msgs = F.when(_first_is_system(msgs), F.slice(msgs, 3, 1)).otherwise(F.slice(msgs, 2, 1))
    elif prompt_only:
        msgs = F.when(_first_is_system(msgs), F.slice(msgs, 1, 2)).otherwise(F.slice(msgs, 1, 1))

    def piece(m):
        return (F.when(m["role"] == "system", F.concat(F.lit(SYSTEM_TAG), m["content"], F.lit("\n")))
                .when(m["role"] == "user", F.concat(F.lit(USER_TAG), m["content"], F.lit("\n")))
                .when(m["role"] == "assistant",
                      F.concat(F.lit(ASSISTANT_TAG), strip(m["content"]), F.lit(eos), F.lit("\n")))
                .otherwise(_bad_role(m)))

    text = F.concat(_render(msgs, piece), F.lit(ASSISTANT_TAG))
    if response_only or prompt_only:
        text = F.replace(F.replace(text, F.lit(ASSISTANT_TAG), F.lit("")), F.lit(eos), F.lit(""))
    if no_special_tokens:
        if bos:
            text = F.replace(text, F.lit(bos), F.lit(""))
        if eos:
            text = F.replace(text, F.lit(eos), F.lit(""))
    return text


def _default_text(m, eos: str) -> Column:
    return (F.when(m["role"] == "system", F.concat(F.lit(SYSTEM_TAG), strip(m["content"]), F.lit("\n")))
            .when(m["role"] == "user", F.concat(F.lit(USER_TAG), strip(m["content"]), F.lit("\n")))
            .when(m["role"] == "assistant", F.concat(F.lit(ASSISTANT_TAG), strip(m["content"]), F.lit(eos), F.lit("\n")))
            .otherwise(_bad_role(m)))


def _default_piece(eos: str):
    return lambda m: _default_text(m, eos)


def _pieces(messages, text, assistant: str) -> Column:
    """Array of (role, kept, after_other, text): ``kept`` for the assistant's turns,
    ``after_other`` if the message before is another role's."""
    msgs = col(messages)
    return F.transform(msgs, lambda m, i: F.struct(
        m["role"].alias("role"), (m["role"] == assistant).alias("kept"),
        F.coalesce(F.get(msgs, i - 1)["role"] != assistant, F.lit(False)).alias("after_other"), text(m).alias("text")))


def chat_pieces(messages, eos: str = EOS) -> Column:
    """The pieces of :func:`render_default`, before the text is stripped."""
    return _pieces(_non_empty(messages), _default_piece(eos), "assistant")


def vendor_pieces(messages, system_message, eos: str = EOS) -> Column:
    """The pieces of :func:`render_vendor_eos`. The system message is a piece of its
    own, of role ``system``; it masks itself, not the tag of a turn after it."""
    s = col(system_message)
    own = _pieces(_non_empty(messages), _vendor_piece(eos), "ASSISTANT")
    first = F.struct(F.lit("system").alias("role"), F.lit(False).alias("kept"), F.lit(False).alias("after_other"), _system_prefix(s).alias("text"))
    return F.when(s.isNotNull(), F.concat(F.array(first), own)).otherwise(own)


def row_pieces(messages, mid, system_message, eos: str = EOS) -> Column:
    """Pieces by the row's own form: vendor rows carry ``mid``."""
    return F.when(col(mid).isNotNull(), vendor_pieces(messages, system_message, eos)).otherwise(chat_pieces(messages, eos))


def pieces_text(pieces) -> Column:
    """The text that pieces make up, stripped."""
    return strip(F.array_join(F.transform(col(pieces), lambda p: p["text"]), ""))


def spans(pieces) -> Column:
    """Array of (role, kept, start, end): each turn's place in the text that
    :func:`pieces_text` gives, in characters, ends exclusive. ``pieces`` must be a
    plain column; the work grows with the square of the number of turns."""
    p = col(pieces)
    length = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + F.length(y["text"]))                     # noqa: E731
    text = F.array_join(F.transform(p, lambda x: x["text"]), "")
    head = F.length(text) - F.length(lstrip(text))
    size = F.length(strip(text))
    clip = lambda n: F.least(F.greatest(n - head, F.lit(0)), size)                                        # noqa: E731
    return F.transform(p, lambda x, i: F.struct(
        x["role"].alias("role"), x["kept"].alias("kept"), clip(length(F.slice(p, F.lit(1), i))).alias("start"),
        clip(length(F.slice(p, F.lit(1), i + 1))).alias("end")))


def token_labels(pieces, n: int) -> Column:
    """Struct of ``tokens`` and ``labels`` (``array<string>``), both cut at n: a label
    is the token itself within the assistant's turns and null (for -100) elsewhere;
    the assistant's tag after another role's turn is null too. Pieces end in a
    newline, so no token spans two of them and the tokens of the pieces are those of
    the whole text. One pass over the text."""
    def labelled(p):
        toks = tokens(p["text"])
        return F.transform(toks, lambda t, j: F.struct(t.alias("t"), F.when(p["kept"] & ~(p["after_other"] & (j == 0)), t).alias("l")))

    both = F.slice(F.flatten(F.transform(col(pieces), labelled)), 1, n)
    return F.struct(F.transform(both, lambda x: x["t"]).alias("tokens"), F.transform(both, lambda x: x["l"]).alias("labels"))


def _non_empty(messages) -> Column:
    return F.when(F.size(col(messages)) > 0, col(messages)).otherwise(
        F.raise_error(F.lit("messages field is empty.")))


def render_default(messages, eos: str = EOS, bos: str = BOS, add_bos: bool = False) -> Column:
    """Every content stripped, EOS after each assistant turn, whole text stripped."""
    text = _render(_non_empty(messages), _default_piece(eos))
    if add_bos:
        text = F.concat(F.lit(bos), text)
    return strip(text)


def first_two_turns(messages) -> Column:
    """First two turns, skipping a leading system turn."""
    msgs = col(messages)
    return F.when(_first_is_system(msgs), F.slice(msgs, 2, 2)).otherwise(F.slice(msgs, 1, 2))


def prompt_only(messages, eos: str = EOS) -> Column:
    """First turn (two after a system turn) rendered, stripped, plus EOS."""
    msgs = col(messages)
    first = F.when(_first_is_system(msgs), F.slice(msgs, 1, 2)).otherwise(F.slice(msgs, 1, 1))
    return F.concat(strip(_render(first, _default_piece(eos))), F.lit(eos))


def response_only(messages, eos: str = EOS) -> Column:
    """Assistant tag + the reply (turn 2, or 3 after a system turn) stripped + EOS."""
    msgs = col(messages)
    reply = F.when(_first_is_system(msgs), F.get(msgs, 2)).otherwise(F.get(msgs, 1))
    return F.concat(F.lit(ASSISTANT_TAG), strip(reply["content"]), F.lit(eos))


def _vendor_piece(eos_after_assistant: str):
    def piece(m):
        return (F.when(m["role"] == "HUMAN", F.concat(F.lit(USER_TAG), strip(m["content"]), F.lit("\n")))
                .when(m["role"] == "OBSERVATION", F.concat(F.lit(OBSERVATION_TAG), strip(m["content"]), F.lit("\n")))
                .when(m["role"] == "ASSISTANT",
                      F.concat(F.lit(ASSISTANT_TAG), strip(m["content"]), F.lit(eos_after_assistant), F.lit("\n")))
                .otherwise(_bad_role(m)))
    return piece


def _system_prefix(system) -> Column:
    s = col(system)
    return F.when(s.isNotNull(), F.concat(F.lit(SYSTEM_TAG), strip(s), F.lit("\n"))).otherwise(F.lit(""))


def render_vendor(messages, system_message, eos: str = EOS) -> Column:
    """Vendor roles (HUMAN / OBSERVATION / ASSISTANT), optional system message,
    one EOS at the very end."""
    body = F.concat(_system_prefix(system_message), _render(_non_empty(messages), _vendor_piece("")))
    return F.concat(strip(body), F.lit(eos))


def render_vendor_eos(messages, system_message, eos: str = EOS) -> Column:
    """Vendor roles with EOS after every ASSISTANT turn (rows that carry ``mid``)."""
    body = F.concat(_system_prefix(system_message), _render(_non_empty(messages), _vendor_piece(eos)))
    return strip(body)


def render_system_field(messages, system, eos: str = EOS) -> Column:
    """System text from the row's ``system`` field, system turns in ``messages``
    skipped, one EOS at the end."""
    def piece(m):
        return (F.when(m["role"] == "user", F.concat(F.lit(USER_TAG), strip(m["content"]), F.lit("\n")))
                .when(m["role"] == "assistant", F.concat(F.lit(ASSISTANT_TAG), strip(m["content"]), F.lit("\n")))
                .when(m["role"] == "system", F.lit(""))
                .otherwise(_bad_role(m)))
    body = F.concat(_system_prefix(system), _render(_non_empty(messages), piece))
    return F.concat(strip(body), F.lit(eos))


def render_dispatch(pool_name: str, messages, system=None, system_message=None, mid=None, eos: str = EOS) -> Column:
    """Renderer by pool name: contains "ling" -> vendor form, "tulu" -> system
    field form, else by row: rows that carry ``mid`` take the vendor form with EOS
    after each reply, all others the default form."""
    if "ling" in pool_name:
        return render_vendor(messages, system_message if system_message is not None else F.lit(None), eos)
    if "tulu" in pool_name:
        return render_system_field(messages, system if system is not None else F.lit(None), eos)
    if mid is not None:
        said = system_message if system_message is not None else F.lit(None).cast("string")
        return F.when(col(mid).isNotNull(), render_vendor_eos(messages, said, eos)).otherwise(render_default(messages, eos))
    return render_default(messages, eos)


def to_vendor(messages) -> Column:
    """Chat roles -> vendor roles (user -> HUMAN, assistant -> ASSISTANT),
    dropping system turns (they move to ``system_message``)."""
    msgs = F.filter(col(messages), lambda m: m["role"] != "system")
    return F.transform(msgs, lambda m: F.struct(
        F.when(m["role"] == "user", F.lit("HUMAN")).when(m["role"] == "assistant", F.lit("ASSISTANT"))
        .otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def system_text(messages) -> Column:
    """Content of a leading system turn, else null."""
    msgs = col(messages)
    return F.when(_first_is_system(msgs), F.element_at(msgs, 1)["content"])


# ---------------------------------------------------------------------------
# token-level helpers (whitespace tokens stand in for a subword tokenizer)
# ---------------------------------------------------------------------------

def tokens(text) -> Column:
    """Whitespace tokens (spaces and newlines), empty pieces dropped."""
    return F.filter(F.split(col(text), r"[ \n]+"), lambda t: t != "")


def truncate_tokens(tok, n: int) -> Column:
    return F.slice(col(tok), 1, n)


def mask_non_assistant(messages, n: int, eos: str = EOS) -> Column:
    """Per-token labels of the default rendering, cut at n tokens (``array<string>``,
    null where masked): :func:`token_labels` of :func:`chat_pieces`."""
    return token_labels(chat_pieces(messages, eos), n)["labels"]


def target_sample(prompt, label, n: int, prompt_only: bool = False, response_only: bool = False, eos: str = EOS, bos: str = BOS) -> Column:
    """Struct of ``tokens`` and ``labels`` of a target: the prompt's tokens, masked,
    then the label's with EOS; each side is cut at n by itself. ``prompt_only`` gives
    the prompt with EOS and without its trailing assistant tag, all masked;
    ``response_only`` BOS, label and EOS, all kept."""
    if prompt_only and response_only:
        raise ValueError("prompt_only and response_only exclude each other")
    cut = lambda text: F.slice(tokens(text), 1, n)                                                        # noqa: E731
    none = lambda toks: F.transform(toks, lambda t: F.lit(None).cast("string"))                           # noqa: E731
    if prompt_only:
        toks = cut(F.replace(F.concat(col(prompt), F.lit(eos)), F.lit("\n" + ASSISTANT_TAG), F.lit("")))
        return F.struct(toks.alias("tokens"), none(toks).alias("labels"))
    reply = cut(F.concat(F.lit(bos if response_only else ""), col(label), F.lit(eos)))
    if response_only:
        return F.struct(reply.alias("tokens"), reply.alias("labels"))
    toks = cut(prompt)
    return F.struct(F.concat(toks, reply).alias("tokens"), F.concat(none(toks), reply).alias("labels"))
