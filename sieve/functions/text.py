"""Scalar text expressions (built-in Column functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace Python's str.strip() removes in ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"
# ASCII punctuation (Python's string.punctuation), removed by the
# answer normaliser.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Words dropped by the answer normaliser.
ARTICLES = ("a", "an", "the")
# Stop strings that end a generated function body.
CODE_STOPS = ["\nclass", "\nassert", '\n"""', "\nprint", "\nif", "\n<|/", "\n```"]
# Number pattern of the last-number extractor.
NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"


# character class of the punctuation above (every character escaped)
PUNCTUATION_CLASS = "[" + "".join("\\" + ch for ch in PUNCTUATION) + "]"


def drop_punctuation(c) -> Column:
    """Remove ASCII punctuation (a regex class is faster than ``translate``)."""
    return F.regexp_replace(col(c), PUNCTUATION_CLASS, "")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace (``trim`` alone strips spaces only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def lstrip(c) -> Column:
    """Python ``str.lstrip()`` on ASCII whitespace."""
    return F.ltrim(col(c), F.lit(WHITESPACE))


def ends_with_any(c, suffixes) -> Column:
    c = col(c)
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | c.endswith(s)
    return cond


def suffix_cue(c, cue: str) -> Column:
    """Append a cue, with a space unless the text already ends in newline or space."""
    c = col(c)
    return F.concat(c, F.when(ends_with_any(c, ("\n", " ")), F.lit("")).otherwise(F.lit(" ")), F.lit(cue))


def strip_digit_commas(c) -> Column:
    """``(\\d),(\\d)`` -> ``\\1\\2`` in one left-to-right pass (so ``1,2,3`` -> ``12,3``)."""
    return F.regexp_replace(col(c), r"(\d),(\d)", "$1$2")


def last_number(c) -> Column:
    """Last match of the number pattern, else the text itself."""
    c = col(c)
    found = F.regexp_extract_all(c, F.lit(NUMBER_PATTERN), 0)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(c)


def gsm_gold(answer) -> Column:
    """Text after ``####``, stripped, digit commas removed (a gold 0 is valid)."""
    tail = F.element_at(F.split(col(answer), "####"), -1)
    return strip_digit_commas(strip(tail))


def norm_answer(c) -> Column:
    """Lower case, drop ASCII punctuation, drop the words a/an/the, collapse
    whitespace. Articles are removed by filtering whitespace tokens, which equals
    the usual word-boundary rule except next to non-ASCII punctuation."""
    lowered = F.lower(col(c))
    no_punct = drop_punctuation(lowered)
    tokens = F.filter(F.split(F.btrim(no_punct, F.lit(WHITESPACE)), r"[ \t\n\r\x0b\x0c]+"),
                      lambda t: (t != "") & ~t.isin(*ARTICLES))
    return F.array_join(tokens, " ")


def answer_tokens(c) -> Column:
    """Whitespace tokens of the normalised answer (empty array for empty text)."""
    n = norm_answer(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def cut_at_stop(c, stops) -> Column:
    """Prefix before the earliest occurrence of any stop string."""
    c = col(c)
    positions = [F.instr(c, s) for s in stops]
    nonzero = F.array_min(F.filter(F.array(*positions), lambda p: p > 0))
    return F.when(nonzero.isNull(), c).otherwise(F.substring(c, F.lit(1), nonzero - 1))


def code_signature(c) -> Column:
    """Code up to (not including) the first ``:``."""
    return F.substring_index(col(c), ":", 1)


def first_line(c) -> Column:
    return F.substring_index(col(c), "\n", 1)
