"""Source divergence audit: how the words of a language's sources differ.

Term counts come from single-pass in-memory indexing. A task counts its texts
into a block of postings, term to source to occurrences. When the block is full
it is spilled as a run: rows of up to ``CHUNK`` postings, sorted by hash shard,
language and term. Runs are shuffled by shard and sorted by each chunk's first
term, so that a shard's task can merge them with a heap as they stream in. The
heap holds the open chunks by their next term. All terms before the first term of
the next chunk to come are complete: chunks that begin before it are taken from
the heap, cut there, merged at once, and put back if something is left. Terms in
too few documents go before their postings are looked at.

For two sources g and h the sum over all V kept terms is split. If neither source
holds a term, its summand is the same for all such terms: V times that is the
base. A term that g holds corrects it as if h didn't, which depends on its count
in g only, so the histogram of g's counts gives these corrections; the same for h.
Terms that both hold correct the corrections. These are streamed: a task goes
through merged postings with NumPy and keeps one sum per pair of sources. All
numbers are integers, so the result doesn't depend on any order.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import pieces
from sieve.session import ensure_checkpoint_dir

LEAST_DOCUMENTS = 10        # of a language, for a term to be kept
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK = 400_000             # postings (term, source) of a task's block, about 60 MB
CHUNK = 4096                # postings of a row of a run, unless one term has more
STEP = 200_000              # postings that are opened before a merge, if the shard and language have so many
PAIRS = 1_000_000           # pairs of postings that are looked at, and sums that are kept, at a time
GROUPS_BROADCAST = 50_000   # groups of language and source; beyond, they are joined by shuffle
_NO_TERM = bytes(range(0x00, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TERM_TABLE = bytes(32 if b in _NO_TERM else b + 32 if 65 <= b <= 90 else b for b in range(256))
RUN = "shard int, lang string, first binary, terms array<binary>, docs array<long>, sizes array<int>, sources array<string>, counts array<long>"
MERGED = "lang string, term string, docs long, sources array<string>, counts array<long>"
_RUN_SCHEMA = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())),
                         ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_MERGED_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_SUM_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


class Block:
    """Postings of a task: occurrences by language, source and term, documents
    by language and term."""

    def __init__(self, shards: int):
        self.shards, self.counts, self.docs, self.postings = shards, {}, {}, 0

    def add(self, text: str, lang: str, source: str) -> None:
        counts, docs = self.counts.setdefault((lang, source), Counter()), self.docs.setdefault(lang, Counter())
        before, seen = len(counts), set()
        for piece in pieces(text.encode().translate(_TERM_TABLE)):
            terms = piece.split()
            counts.update(terms)
            new = set(terms) - seen if seen else set(terms)
            docs.update(new)
            if len(piece) >= len(text):
                break
            seen |= new
        self.postings += len(counts) - before

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block's rows, one batch per language, in order of shard and term;
        empties it."""
        for lang, held in self.docs.items():
            if held:
                yield self._rows(lang, held, {source: c for (of, source), c in self.counts.items() if of == lang and c})
        self.__init__(self.shards)

    def _rows(self, lang: str, held: Counter, counts: dict[str, Counter]) -> pa.RecordBatch:
        terms = sorted(held)
        number = {t: i for i, t in enumerate(terms)}
        begun = zlib.crc32(lang.encode())
        shard = np.fromiter((zlib.crc32(t, begun) for t in terms), np.int64, len(terms)) % self.shards
        # Postings in order of shard, then term.
        of = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for c in counts.values()])
        source = np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()])
        count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts.values()])
        order = np.argsort(shard[of] * len(terms) + of, kind="stable")
        listed = np.argsort(shard * len(terms) + np.arange(len(terms)), kind="stable")
        sizes = np.bincount(of, minlength=len(terms))[listed]
        # Chunks: a new one with every shard, and where a shard's postings pass another multiple of CHUNK.
        ends = np.cumsum(sizes)
        own = shard[listed]
        begins = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        within = (ends - sizes) - np.repeat((ends - sizes)[begins], np.diff(np.r_[begins, len(terms)]))
        part = own * (int(within.max()) // CHUNK + 1) + within // CHUNK
        first = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1]
        to = np.r_[first, len(terms)]
        of_postings = np.r_[0, ends][to]
        sorted_terms = pa.array(terms, pa.binary()).take(pa.array(listed))
        documents = np.fromiter(map(held.__getitem__, terms), np.int64, len(terms))[listed]
        columns = [pa.array(own[first].astype(np.int32)), pa.array([lang] * len(first), pa.string()), sorted_terms.take(pa.array(first)), _lists(to, sorted_terms),
                   _lists(to, pa.array(documents)), _lists(to, pa.array(sizes.astype(np.int32))), _lists(of_postings, pa.array(list(counts), pa.string()).take(pa.array(source[order]))),
                   _lists(of_postings, pa.array(count[order]))]
        return pa.RecordBatch.from_arrays(columns, schema=_RUN_SCHEMA)


def _index(shards: int, block: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block(shards)

        def spill() -> Iterator[pa.RecordBatch]:
            for rows in held.run():
                for at in range(0, rows.num_rows, 256):
                    yield rows.slice(at, 256)
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3))):
                held.add(text.as_py(), lang.as_py(), source.as_py())
                if held.postings >= block:
                    yield from spill()
        yield from spill()
    return index


class _Chunk:
    """Some consecutive terms of a run, with their documents and postings."""

    def __init__(self, terms: pa.Array, docs: np.ndarray, sizes: np.ndarray, sources: pa.Array, counts: np.ndarray):
        self.terms, self.docs, self.sizes, self.sources, self.counts = terms, docs, sizes, sources, counts

    def cut(self, limit: bytes | None) -> tuple[_Chunk, _Chunk | None]:
        """The terms before ``limit`` (None: all), and what is left."""
        n = len(self.terms) if limit is None else bisect_left(range(len(self.terms)), limit, key=lambda i: self.terms[i].as_py())
        if n == len(self.terms):
            return self, None
        at = int(self.sizes[:n].sum())
        return (_Chunk(self.terms.slice(0, n), self.docs[:n], self.sizes[:n], self.sources.slice(0, at), self.counts[:at]),
                _Chunk(self.terms.slice(n), self.docs[n:], self.sizes[n:], self.sources.slice(at), self.counts[at:]))


def _merged(lang: str, chunks: list[_Chunk], least: int) -> pa.RecordBatch:
    """Complete terms with all their postings, those in too few documents left out."""
    terms = pa.concat_arrays([c.terms for c in chunks]).dictionary_encode()
    code = terms.indices.to_numpy()
    docs = np.zeros(len(terms.dictionary), np.int64)
    np.add.at(docs, code, np.concatenate([c.docs for c in chunks]))
    kept = docs >= least
    of = np.repeat(code, np.concatenate([c.sizes for c in chunks]))
    used = np.flatnonzero(kept[of])
    sources = pa.concat_arrays([c.sources for c in chunks]).take(pa.array(used)).dictionary_encode()
    key, place = np.unique(of[used].astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy(), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, np.concatenate([c.counts for c in chunks])[used])
    term, source = np.divmod(key, max(1, len(sources.dictionary)))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(key) else np.empty(0, np.int64)
    offsets = np.r_[first, len(key)]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(first), pa.string()), terms.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array(docs[term[first]]),
         _lists(offsets, sources.dictionary.take(pa.array(source))), _lists(offsets, pa.array(total))], schema=_MERGED_SCHEMA)


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[bytes, int, _Chunk]] = []          # open chunks by their next term
        of, opened, serial = None, 0, 0

        def complete(limit: bytes | None) -> Iterator[pa.RecordBatch]:
            done = []
            while heap and (limit is None or heap[0][0] < limit):
                _, number, chunk = heapq.heappop(heap)
                before, rest = chunk.cut(limit)
                done.append(before)
                if rest is not None:
                    heapq.heappush(heap, (rest.terms[0].as_py(), number, rest))
            if done:
                rows = _merged(of[1], done, least)
                for at in range(0, rows.num_rows, 4096):
                    yield rows.slice(at, 4096)

        for batch in batches:
            shards, langs, firsts = (batch.column(i).to_pylist() for i in range(3))
            lists = [batch.column(i) for i in range(3, 8)]
            for i in range(batch.num_rows):
                terms, docs, sizes, sources, counts = (x[i].values for x in lists)
                if of != (shards[i], langs[i]) or opened >= STEP:
                    yield from complete(firsts[i] if of == (shards[i], langs[i]) else None)
                    of, opened = (shards[i], langs[i]), sum(len(c.counts) for _, _, c in heap)
                heapq.heappush(heap, (firsts[i], serial, _Chunk(terms, docs.to_numpy(), sizes.to_numpy(), sources, counts.to_numpy())))
                opened, serial = opened + len(counts), serial + 1
        yield from complete(None)
    return merge


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                least: int = LEAST_DOCUMENTS, block: int = BLOCK) -> DataFrame:
    """``lang, term, docs, sources, counts``: each language's terms in ``least``
    of its documents or more, with their occurrences by source."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, lang, source)))
    runs = whole.mapInArrow(_index(shards, block), RUN)
    return (runs.repartition(shards // 4, "shard").sortWithinPartitions("shard", "lang", "first")
            .mapInArrow(_merge(least), MERGED))


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _share(count: str, total: str, kept: str) -> Column:
    """p of a count; decimals, as the product leaves a long beyond 9e9."""
    return F.expr(f"1 + CAST(CAST({count} + 2 AS DECIMAL(20, 0)) * {SCALE} div CAST({total} + 2 * {kept} AS DECIMAL(20, 0)) AS BIGINT)")


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, by language and pair of sources, of what terms that both hold add to
    the corrections by histogram. Rows: lang, and per posting source, p, p0."""
    names: dict[str, int] = {}
    sums: dict[str, dict[int, int]] = {}
    wide = 1 << 31

    def out() -> pa.RecordBatch:
        listed = list(names)
        rows = [(lang, *pair, value) for lang, of in sums.items() for code, value in of.items()
                for pair in ((listed[code // wide], listed[code % wide]), (listed[code % wide], listed[code // wide]))]
        sums.clear()
        names.clear()
        return _rows(_SUM_SCHEMA, rows)

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        langs, lists = batch.column(0).to_pylist(), batch.column(1)
        fields = lists.flatten()
        source = np.array([names.setdefault(s, len(names)) for s in fields.field(0).to_pylist()], np.int64)
        p, p0 = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        sizes = np.diff(lists.offsets.to_numpy())
        last = np.repeat(np.cumsum(sizes), sizes)               # where a posting's term ends
        partners = last - np.arange(len(p)) - 1
        lang_of = np.repeat(np.array([*map({x: i for i, x in enumerate(dict.fromkeys(langs))}.get, langs)], np.int64), sizes)
        languages = list(dict.fromkeys(langs))
        ends = np.cumsum(partners)
        start = 0
        while start < len(p):                                   # postings with up to PAIRS pairs together, one posting at least
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n = partners[start:stop]
            left = np.repeat(np.arange(start, stop), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            add = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            low, high = np.minimum(source[left], source[right]), np.maximum(source[left], source[right])
            order = np.lexsort((high, low, lang_of[left]))
            l, a, b, add = lang_of[left][order], low[order], high[order], add[order]
            if len(l):
                first = np.flatnonzero(np.r_[True, (l[1:] != l[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                for k, x, y, value in zip(l[first].tolist(), a[first].tolist(), b[first].tolist(), np.add.reduceat(add, first).tolist()):
                    of = sums.setdefault(languages[k], {})
                    of[x * wide + y] = of.get(x * wide + y, 0) + value
            start = stop
        if sum(map(len, sums.values())) >= PAIRS:
            yield out()
    yield out()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group of language and
    source its other sources by divergence (``pair``, all ranks), and the terms
    that stand out against the language (``term``, ranks to ``top``).

    Null texts, languages and sources count as empty strings; an empty text still
    makes its group. Repeated rows are documents of their own. Equal values rank
    by item. A language without kept terms has pairs of value 0 and no terms; one
    with a single source has no pairs. An empty table gives no rows. Other
    columns are not read. A task holds one block, and of one text the distinct
    terms and a piece of words; a shard's task the chunks that overlap.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    merged = frequencies(docs, text, lang, source, least, block).checkpoint()
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    language = merged.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("lang_total"))
    postings = merged.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("lang_count"),
                             F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "lang_count", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    groups = (named.distinct().join(postings.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
              .join(language, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
              .withColumn("p0", F.when(F.col("kept") > 0, _share("0", "total", "kept"))).checkpoint())
    small = F.broadcast(groups) if groups.count() <= GROUPS_BROADCAST else groups
    shared = (postings.join(small, ["lang", "source"]).withColumn("p", _share("count", "total", "kept")))

    # Terms that stand out.
    out = shared.withColumn("q", _share("lang_count", "lang_total", "kept")).where(F.col("p") > F.col("q")).withColumn("value", _difference("p", "q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = (out.select("lang", "source", "term", "value", F.row_number().over(best).alias("rank")).where(F.col("rank") <= top)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))

    # Pairs: the base, corrections by histogram in both directions, corrections of terms that both hold.
    other = small.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = (groups.join(other, "lang").where(F.col("source") != F.col("item"))
            .select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * _difference("p0", "q0")).otherwise(0).cast("long").alias("value")))
    histogram = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    once = (histogram.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item")
            .agg(F.sum(F.col("n") * (_difference("p", "q0") - _difference("p0", "q0"))).alias("value")))
    both = (shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings"))
            .select("lang", "postings").mapInArrow(_corrections, "lang string, source string, item string, value long"))
    total = base.unionByName(once).unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(both)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")))
    return pairs.unionByName(terms)


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, lang_count, coalesce(n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + {SCALE} * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS p,
  1 + {SCALE} * (lang_count + 2) // (sum(lang_count) OVER g + 2 * count(*) OVER g) AS q FROM cells WINDOW g AS (PARTITION BY lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
