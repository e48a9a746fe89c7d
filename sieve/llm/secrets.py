"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over mandatory trigrams is
derived: every match holds all trigrams of one of its clauses. The index holds the
trigrams that any rule asks for. A document's postings are the bits of those that
its text contains; they are intersected by clause beside the text, and only where a
rule's query is met is the text verified by its expression. As a query never asks
across documents, postings need not leave their row: no text is shuffled and
nothing is joined. A rule without mandatory trigrams scans all texts.

Positions are counted in code points. A text cut at an expression's matches,
and the matches themselves, give every match its start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAUSE_MOST = 6            # trigrams of a clause, spread over its string; fewer only let more candidates through
ALTERNATIVES_MOST = 64     # of literal strings followed through an expression; beyond, a query only gets weaker


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str             # understood alike by Java and Python
    group: int = 0         # the group whose length counts
    least: int = 0         # matches with a shorter group are dropped
    base: bool = False


# A private key from its BEGIN line on: up to 64 header lines of any length, then all up to the
# END line, or where that is missing the base64 lines: any number that begin their line, 201 indented or
# quoted ones (a key of 16,384 bits), of 16 characters at least but for a padded last one. Escaped line ends and
# quote marks may stand between. No repeated group is unbounded, as Java recurses into these; classes alone run on.
_LONG = "[A-Za-z0-9+/=]" * 16 + "+"
_PEM = (r"""-----BEGIN (?:RSA |EC |OPENSSH |DSA |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"""
        r"""(?:[\r\n\\][\x20\t\r\n\\>]*[A-Za-z][A-Za-z0-9-]{2,}:\x20[^\r\n\\]*){0,64}"""
        r"""(?:[^-]*-----END (?:RSA |EC |OPENSSH |DSA |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"""
        r"""|[\x20\t\r\n\\>]{0,80}[A-Za-z0-9+/=\r\n\\]*[A-Za-z0-9+/=]{16,}(?:[\x20\t\r\n\\>]+""" + _LONG + r"""){0,200}"""
        r"""(?:[\x20\t\r\n\\>]+[A-Za-z0-9+/]+={1,2})?(?:[\x20\t\r\n\\>]+=[A-Za-z0-9+/]{4})?)?""")

# The three kinds of the contract, then shapes that issuers document.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # A run shorter than 24 is dropped and no part of a longer one is lost by asking for 24 at once.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", _PEM),
)


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams: every match holds all of one clause. No
    clause at all: the expression has no mandatory trigrams."""
    from re import _constants as op, _parser

    def literal(node) -> list[str] | None:
        """All strings that the node can match, None if they are too many."""
        kind, value = node
        if kind is op.LITERAL:
            return [chr(value)]
        if kind is op.IN and value[0][0] is not op.NEGATE:
            out = []
            for k, v in value:
                if k is op.LITERAL:
                    out.append(chr(v))
                elif k is op.RANGE and v[1] - v[0] < 8:
                    out += map(chr, range(v[0], v[1] + 1))
                else:
                    return None
            return out
        if kind is op.SUBPATTERN:
            return literals(value[3])
        if kind is op.BRANCH:
            parts = [literals(x) for x in value[1]]
            return None if None in parts else [s for p in parts for s in p]
        if kind is op.MAX_REPEAT and value[1] <= 1:
            inner = literals(value[2])
            return None if inner is None else inner + [""] * (value[0] == 0)
        return None

    def literals(nodes) -> list[str] | None:
        out = [""]
        for node in nodes:
            one = literal(node)
            if one is None or len(out) * len(one) > ALTERNATIVES_MOST:
                return None
            out = [a + b for a in out for b in one]
        return out

    runs, run = [], [""]
    for node in _parser.parse(regex):
        one = literal(node)
        if one is not None and len(run) * len(one) <= ALTERNATIVES_MOST:
            run = [a + b for a in run for b in one]
            continue
        runs.append(run)
        run = one if one is not None else [""]
    runs.append(run)
    best: list[frozenset[str]] = []
    for run in runs:
        clauses = {frozenset(low[i:i + 3] for i in range(0, len(low) - 2, max(1, -(-(len(low) - 2) // CLAUSE_MOST)))) for low in map(str.lower, run)}
        clauses = [c for c in clauses if not any(d < c for d in clauses)]
        if clauses and frozenset() not in clauses and (not best or min(map(len, clauses)) > min(map(len, best))):
            best = clauses
    return sorted(best, key=sorted)


BITS = 62                  # of a long that hold postings


def with_candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``__rules``: the kinds whose trigram query the text meets, of
    the rules that have one; null texts meet none."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    wanted = sorted({t for q in queries.values() for c in q for t in c})
    longs = range(-(-len(wanted) // BITS))
    # Postings: the index's trigrams in the text, as bits.
    rows = docs.withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    for w in longs:
        held = F.lit(0).cast("long")
        for i, t in enumerate(wanted[w * BITS:(w + 1) * BITS]):
            held = held.bitwiseOR(F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        rows = rows.withColumn(f"__held{w}", held)

    def holds(clause: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in longs:
            bits = sum(1 << i for i, t in enumerate(wanted[w * BITS:(w + 1) * BITS]) if t in clause)
            out = out & (F.col(f"__held{w}").bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long")) if bits else out
        return out

    met = []
    for kind, query in queries.items():
        any_clause = F.lit(False)
        for clause in query:
            any_clause = any_clause | holds(clause)
        met.append(F.when(any_clause, F.lit(kind)))
    return rows.withColumn("__rules", F.array_compact(F.array(*met))).drop("__low", *(f"__held{w}" for w in longs))


def _spans(rule: Rule, place: int) -> Column:
    """Array of (start, place, end, kind) of the rule's matches that count."""
    text, regex = F.col("__text"), F.lit(rule.regex)
    parts = F.arrays_zip(F.split(text, rule.regex, -1).alias("a"), F.regexp_extract_all(text, regex, F.lit(0)).alias("b"),
                         F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("c"))
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["a"])
        end = start + F.length(F.coalesce(x["b"], F.lit("")))
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        counts = x["b"].isNotNull() & (F.length(x["c"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(counts, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPANS)
    begun = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.regexp_like(text, regex), F.aggregate(parts, begun, step, lambda acc: acc["out"])).otherwise(none)


SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with ``secrets`` (or another column ``into``), an array of (start,
    place, end, kind) ordered by start, then by the rules' order: leftmost
    non-overlapping matches per kind, in code points, ends exclusive.

    Null texts count as empty and have none. Every row is answered by itself, so
    repeated rows come out alike and as often, and null keys are like any other; an
    empty table gives an empty table. Extra columns stay; one named as ``into`` is
    replaced.
    """
    kept = [c for c in docs.columns if c != into]
    rows = with_candidates(docs.select(*kept), rules, text).withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    spans = []
    for place, rule in enumerate(rules):
        own = _spans(rule, place)
        if trigram_query(rule.regex):
            own = F.when(F.array_contains("__rules", rule.kind), own).otherwise(F.array().cast(SPANS))
        spans.append(own)
    return rows.select(*kept, F.array_sort(F.concat(*spans)).alias(into))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: key, number of matches of each base kind, SHA-256 of the base
    matches' list and the list of all."""
    base = [r.kind for r in rules if r.base]
    found = find_secrets(docs.select(key, text), rules, key, text)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    of_base = F.filter("secrets", lambda s: s["kind"].isin(base))
    return found.select(key, *[count(k).alias(f"n_{k}") for k in base], F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, overlapping
    spans by the first one's; all other text and all columns stay, whatever their
    names, and ``n_chars`` follows the text. Null texts stay null, an empty table
    gives an empty table."""
    columns = docs.columns
    found = find_secrets(docs, rules, key, text, into="__secrets")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(before, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"]).alias("out"))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rebuilt = F.aggregate("__secrets", begun, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    out = found.withColumn(text, F.when(F.size("__secrets") > 0, rebuilt).otherwise(F.col(text)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def _matches_sql(rule: Rule) -> str:
    regex = rule.regex.replace("'", "''")
    return f"""SELECT rid, '{rule.kind}' AS kind, {[r.kind for r in RULES].index(rule.kind)} AS place, unnest(list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{
        's': coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0),
        'n': length(ms[i]), 'g': length(gs[i])}}), lambda x: x.g >= {rule.least})) AS m
      FROM (SELECT rid, regexp_extract_all(t, '{regex}', 0) AS ms, regexp_extract_all(t, '{regex}', {rule.group}) AS gs, string_split_regex(t, '{regex}') AS ps FROM d)"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(r) for r in RULES)}),
l AS (SELECT rid, kind, place, m.s AS s, kind || ':' || m.s || ':' || (m.s + m.n) AS span FROM m)
SELECT doc_id, {", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(string_agg(span, ',' ORDER BY s, place) FILTER (kind IN ({", ".join(f"'{r.kind}'" for r in RULES if r.base)})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, place), '') AS spans
FROM d LEFT JOIN l USING (rid) GROUP BY rid, doc_id
"""
