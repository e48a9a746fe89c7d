"""Chat formatting by linking quotations to the messages they come from.

A message's lines carry nested quote levels as leading ">" marks. Runs of lines
of one level make a passage. Passages, and all messages' own text line by line
and paragraph by paragraph, are normalised and hashed. A quoted passage is hashed
whole, by paragraph and by line too, and joined to the messages that said any of
these; of them the one that holds most of its lines is its source, ties to the
earliest. A message replies to
the source of its shallowest linked passage; without one it begins a thread. A
conversation in reply order is thread after thread, every message behind the one
it replies to, and none with quotes; a message's place there is counted over a
range-partitioned sort, so that a conversation may be larger than a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.session import ensure_checkpoint_dir

_MARKS = r"^\s*((?:>\s?)+)"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)


def _parsed(text: Column) -> Column:
    """Array of (level, said) of the lines, quote marks removed."""
    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("said"))
    return F.transform(_lines(text), one)


def _runs(lines: Column) -> Column:
    """Array of (level, said, lines): neighbouring lines of one level joined by spaces, and by themselves."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
    said = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(
        F.get(lines, r["a"])["level"].alias("level"),
        F.transform(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), lambda x: x["said"]).alias("lines")))
    return F.transform(said, lambda r: F.struct(r["level"].alias("level"), F.array_join(r["lines"], " ").alias("said"), r["lines"].alias("lines")))


def normalised(said: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(said), r"[^\p{L}\p{N}]+", " "))


def _worded(lines: Column) -> Column:
    """The lines' normalised forms, those without words left out."""
    return F.filter(F.transform(lines, normalised), lambda x: x != "")


def _sources_of(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``c, t, at, run, source_turn`` of the passages that have a source.

    A passage of one line goes to the earliest message that said it, so one row
    a line meets these. Longer ones meet all earlier messages that said one of
    their pieces, as lines are counted by message.
    """
    key = ["c", "t", "at", "run"]
    runs = quoted.select(*key, "lines", _worded(F.col("lines")).alias("worded")).dropDuplicates(key)
    one = runs.where(F.size("worded") == 1).select(*key, F.col("worded")[0].alias("norm"))
    many = runs.where(F.size("worded") > 1).withColumn("n", F.size("worded"))
    # A piece: its paragraph (-1: the whole passage), how many lines it has, and whether it is one line of a paragraph.
    whole = many.select(*key, F.lit(-1).alias("par"), F.col("n").alias("held"), F.lit(False).alias("line"), F.array_join("worded", " ").alias("norm"))
    pars = (many.select(*key, "n", F.posexplode(F.split(F.array_join("lines", "\n"), r"\n\s*\n")).alias("par", "text"))
            .select(*key, "n", "par", _worded(F.split("text", "\n")).alias("worded")))
    par = (pars.where((F.size("worded") > 1) & (F.size("worded") < F.col("n")))
           .select(*key, "par", F.size("worded").alias("held"), F.lit(False).alias("line"), F.array_join("worded", " ").alias("norm")))
    line = pars.select(*key, "par", F.lit(1).alias("held"), F.lit(True).alias("line"), F.explode("worded").alias("norm"))

    def met(pieces: DataFrame, by: DataFrame) -> DataFrame:
        q, s = pieces.withColumn("hash", F.xxhash64("norm")).alias("q"), by.alias("s")
        hit = (F.col("q.c").eqNullSafe(F.col("s.c")) & (F.col("q.hash") == F.col("s.hash")) & (F.col("q.norm") == F.col("s.norm")) & (F.col("s.source_turn") < F.col("q.t")))
        return q.join(s, hit).select("q.*", "s.source_turn")

    earliest = said.groupBy("c", "hash", "norm").agg(F.min("source_turn").alias("source_turn"))
    found = met(whole.unionByName(par).unionByName(line), said.distinct())
    # A paragraph said as a whole holds all of its lines, the whole passage those of all paragraphs.
    by_par = found.groupBy(*key, "source_turn", "par").agg(F.greatest(F.sum(F.when(F.col("line"), F.col("held"))), F.max(F.when(~F.col("line"), F.col("held")))).alias("held"))
    by_source = by_par.groupBy(*key, "source_turn").agg(F.greatest(F.sum(F.when(F.col("par") >= 0, F.col("held"))), F.max(F.when(F.col("par") < 0, F.col("held")))).alias("held"))
    most = by_source.groupBy(*key).agg(F.min(F.struct((-F.col("held")).alias("held"), "source_turn"))["source_turn"].alias("source_turn"))
    return met(one, earliest).select(*key, "source_turn").unionByName(most)


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv, turn, at, level, passage, source_turn``: every quoted passage with
    words, and the earlier message of its conversation that holds most of its
    lines among its own (unquoted) ones, ties to the earliest; null where none
    holds any. Lines that a message said as a paragraph or whole text of its own
    count as held however they are broken; a part of a paragraph must keep its
    lines.

    Passages whose normalised form is empty are no passages, and lines without
    words count for nothing. A level-n passage links to the message that wrote
    it, not to those that quoted it. A message repeated in conversation and turn
    counts as one message that said all of its rows' texts.
    """
    rows = messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), _parsed(F.col(text)).alias("lines"))
    runs = rows.select("c", "t", "lines", _runs(F.col("lines")).alias("runs"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    said = F.array_union(F.transform(own, lambda x: x["said"]), F.array_union(
        F.transform(F.filter("runs", lambda x: x["level"] == 0), lambda x: x["said"]),
        F.array_union(F.split(F.array_join(F.transform(own, lambda x: x["said"]), "\n"), r"\n\s*\n"),
                      F.array(F.array_join(F.transform(own, lambda x: x["said"]), " ")))))
    quoted = (runs.select("c", "t", F.posexplode(F.filter("runs", lambda x: x["level"] > 0)).alias("at", "run"))
              .select("c", "t", "at", F.col("run.level").alias("level"), F.col("run.said").alias("passage"), F.col("run.lines").alias("lines"))
              .where(normalised(F.col("passage")) != "").withColumn("run", F.xxhash64("level", "lines")))
    # Only what conversations with quotes said is hashed.
    quoting = quoted.select("c").distinct()
    sources = (runs.join(quoting, runs["c"].eqNullSafe(quoting["c"]), "left_semi").select("c", F.col("t").alias("source_turn"), F.explode(said).alias("s"))
               .withColumn("norm", normalised(F.col("s"))).where("norm <> ''")
               .select("c", "source_turn", F.xxhash64("norm").alias("hash"), "norm"))
    q, s = quoted.alias("q"), _sources_of(quoted, sources).alias("s")
    same = F.col("q.c").eqNullSafe(F.col("s.c")) & (F.col("q.t") == F.col("s.t")) & (F.col("q.at") == F.col("s.at")) & (F.col("q.run") == F.col("s.run"))
    return q.join(s, same, "left").select(F.col("q.c").alias(conv), F.col("q.t").alias(turn), "q.at", "q.level", "q.passage", "s.source_turn")


def unquoted(text: Column) -> Column:
    """The text's own lines, quoted ones and the blank edges removed."""
    own = F.transform(F.filter(_parsed(text), lambda x: x["level"] == 0), lambda x: x["said"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def reply_ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: ``conv_id, turn, role, reply_to, thread, depth,
    body, n_quotes, n_linked, place``. ``place`` (from 0) is the message's in its
    conversation's reply order, by thread, then turn; null threads come first, and
    repeated messages are put in order of role and body.

    ``reply_to`` is the turn that its shallowest, then first, linked passage
    comes from (null: none), ``thread`` the turn at the root of its replies,
    ``depth`` the number of replies from there, ``body`` the text without quotes
    (null texts: empty). Messages repeated in conversation and turn keep their
    rows, with the reply and thread of their turn. Null conversations form one
    conversation; null turns reply to nothing. An empty table gives an empty
    table; other columns are not read.

    Roots are found by doubling: every round each message takes over what its
    furthest known ancestor knows, so a chain of n replies takes log2(n) joins.
    Nothing is gathered by conversation: joins are on conversation and turn, or
    conversation and passage, and places are counted by range.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    first = (link_quotes(messages, conv, turn, text).groupBy(F.col(conv).alias("c"), F.col(turn).alias("t"))
             .agg(F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"),
                  F.min(F.when(F.col("source_turn").isNotNull(), F.struct("level", "at", "source_turn"))).alias("first"))
             .select("c", "t", "n_quotes", "n_linked", F.col("first.source_turn").alias("reply_to")).checkpoint())
    nodes = first.where(F.col("reply_to").isNotNull()).select("c", "t", F.col("reply_to").alias("up"), F.lit(1).alias("hops"), F.lit(False).alias("done"))
    while nodes.where(~F.col("done")).limit(1).count():
        x, y = nodes.alias("x"), nodes.select("c", "t", F.col("up").alias("next"), F.col("hops").alias("more"), F.col("done").alias("last")).alias("y")
        nodes = (x.join(y, F.col("x.c").eqNullSafe(F.col("y.c")) & (F.col("x.up") == F.col("y.t")) & ~F.col("x.done"), "left")
                 .select("x.c", "x.t", F.coalesce("y.next", "x.up").alias("up"), (F.col("x.hops") + F.coalesce("y.more", F.lit(0))).alias("hops"),
                         F.coalesce("y.last", F.lit(True)).alias("done")).checkpoint())
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), unquoted(F.col(text)).alias("body")).alias("m")
    rows = (m.join(first.alias("f"), F.col("m.conv_id").eqNullSafe(F.col("f.c")) & F.col("m.turn").eqNullSafe(F.col("f.t")), "left")
            .join(nodes.alias("n"), F.col("m.conv_id").eqNullSafe(F.col("n.c")) & (F.col("m.turn") == F.col("n.t")), "left"))
    return _placed(rows.select(
        "m.conv_id", "m.turn", "m.role", "f.reply_to", F.coalesce("n.up", "m.turn").alias("thread"), F.coalesce("n.hops", F.lit(0)).alias("depth"),
        "m.body", F.coalesce("f.n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("f.n_linked", F.lit(0)).alias("n_linked")))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with each message's place in its conversation. Rows are dealt by
    range, so a conversation may lie in several partitions; a row's place is its
    number within its partition plus the conversation's rows in earlier ones, of
    which there is one count for each partition. The sorted rows are kept, as ranges
    that are sampled anew would be others."""
    order = ["thread", "turn", "role", "body"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(earlier, F.lit(0)).alias("before"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)))
    joined = numbered.join(before, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - 1).cast("long").alias("place"))
