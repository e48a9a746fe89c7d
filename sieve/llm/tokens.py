"""Token counts under a unigram vocabulary, by a trie of pre-tokens.

A text is split at ASCII white space into pre-tokens, each led by the
vocabulary's space mark. The distinct pre-tokens of a task go into a trie of
characters. A node's forward score, the best score of any segmentation of its
prefix, needs only its ancestors, so it is computed once however many
pre-tokens share the prefix; the number of tokens on that best path is kept
with it and is the count of the pre-token that ends there. A pre-token is taken
into the trie up to a depth; beyond it the same step goes on over the last scores
alone, as many as the longest piece has characters, so a pre-token of any length
takes bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import pieces

SPACE = "▁"
NODES_MOST = 1_000_000     # of a task's trie, some 200 bytes each; beyond it starts anew, which loses only time
DEPTH_MOST = 1_024         # characters of a pre-token in the trie
UNKNOWN_GAP = 10.0         # an unknown character scores so much less than the least piece


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    unknown: float
    byte_fallback: bool


def load_vocabulary(path: str, scores: str = "zipf") -> Vocabulary:
    """Pieces of a public sentencepiece file. ``scores``: "file" takes the
    file's own; "zipf" takes the log probability of the piece's place among the
    file's pieces under Zipf's law, as the public files at hand hold merge ranks
    rather than unigram scores. Read on the driver; the size of the vocabulary
    bounds what is broadcast. Pieces with white space inside never match."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(model))]
    ids = [i for i in range(len(model)) if not special[i] and SPACE not in model.id_to_piece(i)[1:]]
    norm = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    value = {model.id_to_piece(i): model.get_score(i) if scores == "file" else -math.log(r) - norm for r, i in enumerate(ids, 1)}
    return Vocabulary(value, min(value.values(), default=0.0) - UNKNOWN_GAP,
                      any(model.is_byte(i) for i in range(len(model))))


class Trie:
    """Nodes are numbers from 0, the root; ``child`` maps node and character to
    node, and each node has its forward score, tokens and whether it ends in an
    unknown character. Plain numbers in a few long lists, rather than objects
    for each node, keep a large trie small and cheap to build."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # Lengths, longest first, of the pieces that end in three given characters: of longer pieces only these are looked up.
        ends: dict[str, set[int]] = {}
        for piece in vocabulary.scores:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in ends.items()}
        self.longest = max(map(len, vocabulary.scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens, self.unknown = [0.0], [0], bytearray(1)

    @property
    def nodes(self) -> int:
        return len(self.score)

    def count(self, word: str) -> int:
        """Tokens of the pre-token: inserts it, computing what is new. Of equal
        scores the longest last piece wins. An unknown character costs its
        UTF-8 bytes with byte fallback; without it a run of them costs one."""
        if len(word) > DEPTH_MOST:
            return self._beyond(word)
        child, node, path = self.child, 0, [0]
        for char in word:
            after = child.get(node << 21 | ord(char))
            if after is None:
                return self._insert(word, path)
            path.append(after)
            node = after
        return self.tokens[node]

    def _beyond(self, word: str) -> int:
        """Tokens of a long pre-token: its first characters by the trie, then the
        forward step over a window of the last scores."""
        head, reach = word[:DEPTH_MOST], max(self.longest, 2)
        self.count(head)
        node, path = 0, [0]
        for char in head:
            node = self.child[node << 21 | ord(char)]
            path.append(node)
        path = path[-reach:]
        score, tokens, strange = [self.score[i] for i in path], [self.tokens[i] for i in path], self.unknown[node]
        lengths, piece_score, least = self.lengths.get, self.vocabulary.scores.get, self.vocabulary.unknown
        for end in range(DEPTH_MOST + 1, len(word) + 1):
            best, count, unknown = -math.inf, 0, 0
            for n in (*lengths(word[end - 3:end], ()), 2, 1):                   # score[-n] is that of the prefix n characters shorter
                if (piece := piece_score(word[end - n:end])) is not None and (piece := piece + score[-n]) > best:
                    best, count = piece, tokens[-n] + 1
            char = word[end - 1]
            if piece_score(char) is None and least + score[-1] > best:
                best, unknown = least + score[-1], 1
                count = tokens[-1] + (len(char.encode()) if self.vocabulary.byte_fallback else 1 - strange)
            strange = unknown
            score.append(best)
            tokens.append(count)
            if len(score) > 4 * reach:
                del score[:-reach], tokens[:-reach]
        return tokens[-1]

    def _insert(self, word: str, path: list[int]) -> int:
        """Adds the nodes beyond ``path``, those of the known prefix, with the
        forward step of each: over the pieces that end there."""
        lengths, piece_score, child = self.lengths.get, self.vocabulary.scores.get, self.child
        fallback, least, none = self.vocabulary.byte_fallback, self.vocabulary.unknown, -math.inf
        all_scores, all_tokens, all_unknown = self.score, self.tokens, self.unknown
        score, tokens = [all_scores[i] for i in path], [all_tokens[i] for i in path]
        node, after, start = path[-1], len(all_scores), len(path)
        for end in range(start, len(word) + 1):
            best, count, strange, i = none, 0, 0, end - 1
            if i > 1:
                for n in lengths(word[end - 3:end], ()):
                    if n <= end and (piece := piece_score(word[end - n:end])) is not None and (piece := piece + score[end - n]) > best:
                        best, count = piece, tokens[end - n] + 1
            if i and (piece := piece_score(word[end - 2:end])) is not None and (piece := piece + score[end - 2]) > best:
                best, count = piece, tokens[end - 2] + 1
            char = word[i]
            if (piece := piece_score(char)) is not None:
                if (piece := piece + score[i]) > best:
                    best, count = piece, tokens[i] + 1
            elif least + score[i] > best:
                best, strange = least + score[i], 1
                count = tokens[i] + (len(char.encode()) if fallback else 1 - all_unknown[node])
            child[node << 21 | ord(char)] = node = after
            after += 1
            score.append(best)
            tokens.append(count)
            all_unknown.append(strange)
        all_scores += score[start:]
        all_tokens += tokens[start:]
        return tokens[-1]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> Column:
    """Column of structs (n_pretokens, n_tokens) of every whole text; null and
    empty texts have none of either. A pre-token of any length takes the memory
    of a text piece and of ``DEPTH_MOST`` nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, known = Trie(shared.value), {}
        for texts in batches:
            out = []
            for value in texts:
                words = tokens = 0
                for piece in pieces((value or "").encode()):
                    parts = piece.split()
                    for new in set(parts).difference(known):
                        known[new] = trie.count(SPACE + new.decode())       # the terminal's count
                    words += len(parts)
                    tokens += sum(map(known.__getitem__, parts))
                    if trie.nodes > NODES_MOST:
                        trie.clear()
                        known.clear()
                out.append((words, tokens))
            yield pd.DataFrame(out, columns=["n_pretokens", "n_tokens"], dtype="int64")

    return counted(F.col(text))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, ``n_pretokens`` and ``n_tokens``. Repeated rows come out
    alike and as often; an empty table gives an empty table; columns besides key
    and text are not read."""
    return docs.select(F.col(key), count_tokens(docs, vocabulary, text).alias("n")).select(key, "n.n_pretokens", "n.n_tokens")
