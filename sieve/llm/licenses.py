"""License scans by a positional index of rare words.

The index posts every word of every template as (template, offset). The document
frequencies of all licence words are counted over the whole corpus. A file's own
licence words are looked up from the highest inverse document frequency down,
until each template whose mandatory words the file has was met at one of them: that
word's places, less its offsets, are where the template may stand. There the
mandatory key phrases must stand in full, and the other words in a given share.

A place with its key phrases in full holds all of their words, so whichever of
these is looked up leads to it: the frequencies decide how many places are looked
at, never what is found, and a file's labels don't depend on other files.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import WORD_TABLE, pieces

# Phrases and labels of the contract, then passages of well-known public licences.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
MORE = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit",
     ("permission is hereby granted free of charge", "obtaining a copy")),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2",
     ("you may not use this file except in compliance with the license",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd",
     ("redistribution and use in source and binary forms",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc",
     ("with or without fee is hereby granted",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("mozilla public license",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("free and unencumbered software",)),
    ("gnu general public license version 2", "gpl-2", ("gnu general public license version 2",)),
    ("gnu general public license version 3", "gpl-3", ("gnu general public license version 3",)),
    ("gnu lesser general public license", "lgpl", ("gnu lesser general public license",)),
    ("gnu affero general public license", "agpl", ("gnu affero general public license",)),
    ("creative commons attribution", "cc-by", ("creative commons attribution",)),
    ("cc by sa", "cc-by-sa", ("cc by sa",)),
    ("cc0 1 0 universal", "cc0", ("cc0 1 0 universal",)),
)
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    keys: tuple[tuple[int, int], ...]    # spans that must stand in full
    base: bool


def _template(phrase: str, label: str, keys: tuple[str, ...], base: bool) -> Template:
    words = tuple(w.encode() for w in phrase.split())
    spans = []
    for key in keys:
        part = tuple(w.encode() for w in key.split())
        at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
        spans.append((at, at + len(part)))
    return Template(words, label, tuple(spans), base)


TEMPLATES = tuple(_template(p, name, (p,), True) for p, name in BASE) + tuple(_template(p, name, keys, False) for p, name, keys in MORE)
LONGEST = max(len(t.words) for t in TEMPLATES)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, piece by piece: runs of ASCII letters and
    digits and of all other characters beyond ASCII, A-Z lower-cased."""
    for piece in pieces((text or "").encode()):
        yield piece.translate(WORD_TABLE).split()


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and for each licence word how many rows hold it, over all rows.
    Every task counts its own rows first, so a few rows a task are moved."""
    vocabulary = frozenset(POSTINGS)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, Counter()
        for b in batches:
            for value in b[text]:
                n += 1
                own: set[bytes] = set()
                for words in words_of(value):
                    own |= vocabulary.intersection(words)
                found.update(own)
        yield pd.DataFrame({"word": ["", *(w.decode() for w in found)], "n": [n, *found.values()]})

    got = {r["word"].encode(): r["n"] for r in docs.select(text).mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(b"", 0), got


#: word -> (template, offset) of every place of the word in a template's key phrases: one of these places must be met.
POSTINGS: dict[bytes, list[tuple[int, int]]] = {}
for _t, _template_ in enumerate(TEMPLATES):
    for _at in sorted({i for a, b in _template_.keys for i in range(a, b)}):
        POSTINGS.setdefault(_template_.words[_at], []).append((_t, _at))
MANDATORY = tuple(frozenset(w for a, b in t.keys for w in t.words[a:b]) for t in TEMPLATES)


def rarity(n: int, frequency: dict[bytes, int]) -> dict[bytes, float]:
    """Inverse document frequency of the mandatory licence words."""
    return {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) for w in POSTINGS}


def looked_up(words: set[bytes], idf: dict[bytes, float]) -> dict[bytes, list[tuple[int, int]]]:
    """The postings to follow in a file with these words: for each template whose
    mandatory words it has, those of its rarest one. Ties go to the word earlier in
    order, a word that occurs twice in a template is followed at its first place."""
    own = words.intersection(idf)
    open_ = {t for t, need in enumerate(MANDATORY) if need <= own}
    out: dict[bytes, list[tuple[int, int]]] = {}
    for w in sorted(own, key=lambda w: (-idf[w], w)) if open_ else ():
        for t, at in POSTINGS[w]:
            if t in open_:
                open_.discard(t)
                out.setdefault(w, []).append((t, at))
        if not open_:
            break
    return out


def scan(text: str | None, idf: dict[bytes, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and (start, template, share of words) of every verified
    place, in a whole text. A very long text is looked through in stretches that
    overlap by the longest template."""
    found, held, offset = [], [], 0

    def look(words: list[bytes], until: int) -> None:
        index = looked_up(set(words), idf)
        for p in [p for p, w in enumerate(words) if w in index] if index else ():
            for t, at in index[words[p]]:
                start, template = p - at, TEMPLATES[t]
                if not 0 <= start < until:
                    continue
                here = tuple(words[start:start + len(template.words)])
                if all(here[a:b] == template.words[a:b] for a, b in template.keys):
                    share = sum(x == y for x, y in zip(here, template.words)) / len(template.words)
                    if share >= SHARE:
                        found.append((offset + start, t, share))

    for words in words_of(text):
        held += words
        if (until := len(held) - LONGEST + 1) > 0:
            look(held, until)
            held = held[until:]
            offset += until
    look(held, len(held))
    return offset + len(held), sorted(found)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_words``, ``n_base`` (places of base phrases),
    ``first_word`` and ``last_word`` (smallest and largest start of those, else
    null), ``base_labels``, ``labels`` (distinct, sorted, comma-joined), ``score``
    (the largest share of a template's words found in place, 0 without a match)
    and ``places``, an array of (start, label, share) of all verified places.
    A row's result depends on its own text alone.

    A null text counts as empty: no words, no labels. Repeated rows come out
    alike and as often; an empty table gives an empty table; columns besides key
    and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity(*document_frequency(docs, text)))
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "places array<struct<start:long,label:string,share:double>>")

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = shared.value
        for b in batches:
            out = []
            for value in b[text]:
                n, found = scan(value, idf)
                base = [start for start, t, _ in found if TEMPLATES[t].base]
                out.append((n, len(base), min(base, default=None), max(base, default=None),
                            ",".join(sorted({TEMPLATES[t].label for _, t, _ in found if TEMPLATES[t].base})),
                            ",".join(sorted({TEMPLATES[t].label for _, t, _ in found})), max((share for *_, share in found), default=0.0),
                            [{"start": s, "label": TEMPLATES[t].label, "share": share} for s, t, share in found]))
            made = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])
            for name in ("first_word", "last_word"):
                made[name] = made[name].astype("Int64")
            made.insert(0, key, b[key].to_numpy(dtype=object))
            yield made

    return docs.select(key, text).mapInPandas(scanned, schema)


def _sql() -> str:
    """The same by brute force: every template at every word of every text."""
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"                                     # noqa: E731
    tables = []
    for n, t in enumerate(TEMPLATES):
        keys = " AND ".join(f"w[s + {a}:s + {b - 1}] = {listed(t.words[a:b])}" for a, b in t.keys)
        same = f"list_count(list_filter(list_zip(w[s:s + {len(t.words) - 1}], {listed(t.words)}), lambda z: z[1] = z[2]))"
        first = t.words[t.keys[0][0]].decode()
        starts = f"list_filter(list_transform(list_filter(range(1, len(w) + 1), lambda p: w[p] = '{first}'), lambda p: p - {t.keys[0][0]}), lambda s: s > 0)"
        tables.append(f"""SELECT r, s - 1 AS start, {n} AS t, '{t.label}' AS label, {t.base} AS base, {same} / {len(t.words)} AS share
  FROM (SELECT r, w, unnest({starts}) AS s FROM d WHERE list_contains(w, '{first}')) WHERE {keys} AND {same} / {len(t.words)} >= {SHARE}""")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS ({" UNION ALL ".join(tables)}),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN per USING (r)
"""


ORACLE_SQL = _sql()
