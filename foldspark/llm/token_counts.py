"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is cut into pre-tokens: one begins at the start and at every space or line feed. Each distinct pre-token is
inserted in a trie, and the forward score of a node (the best sum of piece scores over all ways to spell the path to
it) is computed once, from the nodes above it, however many pre-tokens share it. The node where a pre-token ends
stores its token count; a document's count is the sum over its pre-tokens.

A long pre-token, such as a line of a script without spaces, is cut first where no piece of the vocabulary that occurs in it reaches
across: every way to spell it passes there, so its tokens are those of the parts, and parts share the trie as words do.

The vocabulary is a public file of byte pieces in rank order; a piece's score is its log probability under Zipf's law,
-log(rank + 1) up to a constant for each token, so ``score = -log(rank + 1) - log(sum of 1 / (rank + 1))``. Every byte is
a piece, so every text can be spelled.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import pieces

#: Bytes of a pre-token that is not cut, and of a part that is kept in the trie.
LONG = 256
_tries: dict[str, "Trie"] = {}


def load_pieces(path: str) -> dict[bytes, float]:
    """Piece -> score, from lines of (base64 piece, rank)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - norm for p, r in ranks.items()}


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; none of an empty one."""
    if not text:
        return []
    head, *rest = text.replace("\n", " \n").split(" ")
    return [head] * bool(head) + [x if x[:1] == "\n" else " " + x for x in rest]


class Trie:
    """Token counts of pre-tokens. Nodes are [forward score, tokens on that way, children].

    Of equal scores the way with fewer tokens counts. ``limit`` bounds the nodes (about 300 bytes each) and the stored
    counts; beyond it they are begun anew. A pre-token longer than ``LONG`` bytes is cut into parts (``parts``); a part that is still longer,
    pieces overlapping all along it, shares too little to be kept: its scores are worked out in a window of the longest piece.
    """

    def __init__(self, scores: dict[bytes, float], limit: int = 400_000):
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores))
        #: Every ending of a piece: where none matches, no longer piece can.
        self.endings = {p[k:] for p in scores for k in range(len(p))}
        #: Every beginning of a piece.
        self.beginnings = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self.terminal: dict[str, int] = {}
        self.of_part: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.root: list = [0.0, 0, {}]
        self.nodes = 0

    def _best(self, word: bytes, end: int, states: list, base: int = 0) -> tuple[float, int]:
        """Best score of the first ``end`` bytes and its number of tokens; states: of the starts from ``base`` on."""
        scores, endings = self.scores, self.endings
        best, count = -math.inf, 0
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            s = scores.get(piece)
            if s is not None:
                last = states[start - base]
                s += last[0]
                if s > best or (s == best and last[1] + 1 < count):
                    best, count = s, last[1] + 1
            elif piece not in endings:
                break
        return best, count

    def _long(self, word: bytes) -> int:
        states, base = [(0.0, 0)], 0
        for end in range(1, len(word) + 1):
            states.append(self._best(word, end, states, base))
            if len(states) > 8 * self.longest:
                base += len(states) - self.longest
                del states[: -self.longest]
        return states[-1][1]

    def insert(self, token: str) -> int:
        """Tokens of a pre-token, which is stored."""
        word = token.encode()
        self.terminal[token] = self._walk(word) if len(word) <= LONG else sum(map(self._part, self.parts(word)))
        return self.terminal[token]

    def parts(self, word: bytes) -> list[bytes]:
        """The word, cut at each place that no piece occurring in it crosses."""
        scores, beginnings = self.scores, self.beginnings
        out, begin, reach = [], 0, 0
        for start in range(len(word)):
            if start == reach and start:
                out.append(word[begin:start])
                begin = start
            end = start + 1
            while end <= len(word) and word[start:end] in beginnings:
                if end > reach and word[start:end] in scores:
                    reach = end
                end += 1
        return [*out, word[begin:]]

    def _part(self, word: bytes) -> int:
        if len(word) > LONG:
            return self._long(word)
        n = self.of_part.get(word)
        if n is None:
            if len(self.of_part) > self.limit:
                self.of_part.clear()
            n = self.of_part[word] = self._walk(word)
        return n

    def _walk(self, word: bytes) -> int:
        """Tokens of a word by the path of its bytes in the trie, which is made where it is new."""
        if self.nodes > self.limit:
            self.clear()
        path, node = [self.root], self.root
        for byte in word:
            node = node[2].get(byte)
            if node is None:
                break
            path.append(node)
        for end in range(len(path), len(word) + 1):
            child = [*self._best(word, end, path), {}]
            path[-1][2][word[end - 1]] = child
            path.append(child)
            self.nodes += 1
        return path[-1][1]

    def counts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Of each text, the number of its pre-tokens and of its tokens."""
        if len(self.terminal) > self.limit:
            self.terminal.clear()
        cut = [pre_tokens(t) for t in texts]
        fresh = sorted(set().union(*cut).difference(self.terminal))
        for token in fresh:
            self.insert(token)
        get = self.terminal.__getitem__
        out = [len(x) for x in cut], [sum(map(get, x)) for x in cut]
        for token in fresh:
            if len(token) > LONG:  # not worth the memory
                del self.terminal[token]
        return out


def token_counts(docs: DataFrame, pieces_path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of (doc_id, text), whole texts.

    Null and empty text have none; a null doc_id stays null; repeated rows are counted each; an empty table gives no
    rows; extra columns are ignored. Tasks need nothing from one another, so nothing is shuffled.
    """

    def count(batches):
        if pieces_path not in _tries:
            _tries[pieces_path] = Trie(load_pieces(pieces_path))
        trie = _tries[pieces_path]
        for batch in batches:
            for ids, texts in pieces(batch):
                n, tokens = trie.counts(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_pretokens": pa.array(np.array(n, np.int64)), "n_tokens": pa.array(np.array(tokens, np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
