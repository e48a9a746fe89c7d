"""Spelling variants, quality rules and the divergence audit: against SQL, brute
force and edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import duck

from sieve.llm import divergence, rules, variants
from sieve.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, score double, term string, shard int, count long, value long"
CLASH = (1, "w", 0.5, "t", 3, 4, 5)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_quality_rules", "op13_source_divergence"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = Q.QUERIES[name](spark, sf)
    expected = duck(sf).execute(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    rows = list(map(tuple, got.collect()))
    assert Counter(rows) == Counter(expected) and rows


# Spelling variants.

def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by the definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 7))): rng.randint(3, 9) for _ in range(400)} | {"aaaaa": 30, "aaaaaa": 30, "aaaaaaa": 61}
    got = {r["word"]: (r["n_near"], -r["best"]["minus"], r["best"]["word"]) for r in variants.neighbours(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    expected = {}
    for w in words:
        if found := sorted((-words[x], x) for x in words if near(w, x)):
            expected[w] = (len(found), -found[0][0], found[0][1])
    assert got == expected and len(got) > 300


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w20"), ("y", "z")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.roots(forms).collect()}
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37", "y": "z"}
    assert variants.roots(forms.limit(0)).count() == 0


def test_variants_of_edge_rows(spark):
    rows = [(1, "Hello hello HELLO hallo", "en", "a"), (1, "Hello hello HELLO hallo", "en", "a"), (None, "hallo hallo x1hallo2", None, None), (2, None, None, None), (3, "", "", ""),
            (4, "Äpfel äpfel äpfel äpfel " * 2, None, None), (5, "tasks " * 70_000 + "tasky " * 3, None, None), (6, "abcd " * 9, None, None)]
    expected = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            expected[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 5 and n >= 3}
    got = {r["word"]: r for r in variants.spelling_variants(table(spark, rows)).collect()}
    assert {w: r["n"] for w, r in got.items()} == expected and {"hello", "hallo", "tasks", "tasky", "äpfel"} <= set(got) and "Äpfel" not in got
    for w, r in got.items():
        best = sorted((-expected[x], x) for x in expected if near(w, x))
        form = best[0][1] if best and -best[0][0] >= 2 * expected[w] else None
        assert (r["form"], r["form_n"], r["n_near"], r["root"]) == (form, expected.get(form), len(best), form or w)
    assert got["tasky"]["form"] == "tasks"
    assert variants.spelling_variants(table(spark, rows).limit(0)).count() == 0
    assert variants.spelling_variants(table(spark, rows[3:5])).count() == 0


# Quality rules.

def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


PROSE = ["the river runs past old stone houses and quiet gardens under a pale morning sky", "she carried warm bread home along the narrow lane while children played near the gate",
         "later that evening they talked about music and work until the small lamp went out"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE).split()[rng.randrange(8)] for _ in range(n))


def test_base_rules_by_definition(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x x x x x", "é🙂 ß\n\né🙂 ß\n é🙂 ß\n", "a|b<c>#*$%&\n|\n|", "l\r\nl\r\nl", " ".join("ab"[i % 2] for i in range(99)),
             *[" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(60)],
             *["\n".join(rng.choices(["w w", "", " ", "v u t", "#"], k=9)) for _ in range(10)], " ".join(map(str, range(250_000))) + " 7 8 9 10"]
    got = {r["doc_id"]: r for r in rules.judge(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), spark.createDataFrame([(5,)], "doc_id long")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), t and t[:80]


def test_verdict_of_the_ratio(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 120), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!! $$$" for w in prose(rng, 60).split()), "en", "a") for i in range(60)]
    docs = table(spark, good + junk + good[:1] + [(None, good[0][1], None, None)])
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(0,), (None,), (9999,)], "doc_id long")
    got = rules.judge(docs, trusted).collect()
    assert len(got) == 362 and len({r["threshold"] for r in got}) == 1
    kept = [r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and not r["base_failed"]]
    assert sum(kept) >= 0.97 * len(kept) > 200
    assert not any(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000)
    same = [(r["score"], r["kept"]) for r in got if r["doc_id"] in (None, 0)]
    assert len(same) == 3 and len(set(same)) == 1
    again = rules.judge(docs.repartition(5), trusted)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)
    untold = rules.judge(docs, trusted.limit(0)).collect()
    assert all(r["threshold"] is None and r["kept"] != r["base_failed"] for r in untold)
    assert rules.judge(docs.limit(0), trusted).count() == 0


def test_many_trusted_ids_are_joined_by_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    docs = table(spark, [(i, prose(rng, 70), "en", "a") for i in range(80)])
    trusted = spark.range(0, 80, 3).toDF("doc_id")
    few = sorted(map(tuple, rules.judge(docs, trusted).collect()))
    monkeypatch.setattr(rules, "TRUSTED_BROADCAST", 0)
    assert sorted(map(tuple, rules.judge(docs, trusted).collect())) == few


# Divergence audit.

def audited(rows, least, top):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        def share(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept}
        sources = [s for x, s in counts if x == lang]
        p, q = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, i + 1) for part, of in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(of)}
    return out


@pytest.mark.parametrize("block", [25, 400_000])
def test_audit_by_definition(spark, monkeypatch, block):
    """Small blocks, chunks and tiles spill, merge and flush many times."""
    if block < 100:
        monkeypatch.setattr(divergence, "CHUNK", 3)
        monkeypatch.setattr(divergence, "STEP", 9)
        monkeypatch.setattr(divergence, "PAIRS", 7)
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["é", "Été", "ßx", "🙂", "Wa"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(25)], k=rng.randint(0, 30))), rng.choice(["en", "en", "de"]), f"s{rng.randrange(7)}") for i in range(200)]
    rows += [(300, None, "en", "quiet"), (301, "", "xx", "only"), (302, "wa", "yy", "a"), (303, "wb", "yy", "b"), (None, "wa wb", None, None), (304, "wa", "", "z"), (7, "wa\x00wb-wc1WD ", "de", None)]
    rows += rows[:3] + [(305, "wa wb " * 300_000, "de", "s1")]
    got = [tuple(r) for r in divergence.audit(table(spark, rows), least=4, top=3, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, 4, 3)
    assert divergence.audit(table(spark, rows).limit(0)).count() == 0


def test_audit_of_large_counts(spark):
    """Shares are exact where count times scale leaves 64 bits."""
    row = spark.createDataFrame([(10**12, 7 * 10**12 + 1, 12345)], "c long, t long, v long").select(divergence._share("c", "t", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**12 + 2) // (7 * 10**12 + 1 + 2 * 12345)


def test_groups_joined_by_shuffle(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("abcdef", k=9)), "en", f"s{i % 5}") for i in range(60)]
    monkeypatch.setattr(divergence, "GROUPS_BROADCAST", 0)
    assert {tuple(r) for r in divergence.audit(table(spark, rows)).collect()} == audited(rows, 10, 10)
