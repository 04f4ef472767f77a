"""Vector bin packing of token pieces into sequences, by the dot-product heuristic.

A piece has a demand in three dimensions: tokens, one segment, and loss-bearing tokens. A sequence has a limit in
each. Into the open sequence goes, of the pieces in view that fit, the one with the largest dot product of its demand
and what is left of the sequence (both as shares of the limits); when none fits, a piece is cut to what is left.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import released

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence. view: pieces the heuristic chooses among, which bounds a task's memory."""

    tokens: int = 4096
    segments: int = 4096
    loss_tokens: int = 4096
    view: int = 256


@dataclass
class Packer:
    """Places documents, given as (name, ids, number of loss-bearing tokens), into sequences one after another.

    ``add`` and ``finish`` return placed pieces (name, start, ids, tokens of the document, sequence, offset). A piece's
    loss-bearing tokens are the document's last ones. Sequences are filled to their token limit by cutting a piece
    where none fits whole, unless the limit on segments or loss-bearing tokens ends them. A sequence that ends partly
    filled is laid out anew as sequences whose lengths are powers of two, which need no padding.
    """

    limits: Limits = field(default_factory=Limits)
    sequence: int = 0
    waiting: list = field(default_factory=list)
    open: list = field(default_factory=list)
    used: list = field(default_factory=lambda: [0, 0, 0])
    # Tokens and loss-bearing tokens of the waiting pieces, place by place, kept up as these come and go.
    demands: np.ndarray = field(default_factory=lambda: np.zeros((2, 512), np.int64))

    def add(self, name, ids: np.ndarray, loss: int) -> list:
        """Takes a document up; places pieces as soon as more than ``view`` are waiting."""
        total, out, start = len(ids), [], 0
        free = total - loss  # tokens before the loss-bearing ones
        full = self.limits.tokens
        while total - start >= full and self.limits.loss_tokens >= full and self.limits.segments:
            out.append((name, start, ids[start : start + full], total, self.sequence, 0))
            self.sequence, start = self.sequence + 1, start + full
        if start < total:
            self.waiting.append((name, start, ids[start:], total, free))
            if len(self.waiting) > self.demands.shape[1]:
                self.demands = np.concatenate([self.demands, np.zeros_like(self.demands)], 1)
            self._note(len(self.waiting) - 1)
        while len(self.waiting) > self.limits.view:
            out += self._place()
        return out

    def finish(self) -> list:
        out = []
        while self.waiting:
            out += self._place()
        return out + self._close()

    def _note(self, at: int) -> None:
        _, start, ids, _, free = self.waiting[at]
        self.demands[:, at] = len(ids), len(ids) - min(max(free - start, 0), len(ids))

    def _place(self) -> list:
        cap = self.limits.tokens, self.limits.segments, self.limits.loss_tokens
        left = [c - u for c, u in zip(cap, self.used)]
        if min(left) <= 0:
            return self._close()
        tokens, bearing = self.demands[:, : len(self.waiting)]
        fits = (tokens <= left[0]) & (bearing <= left[2])
        if fits.any():  # one segment each, so that dimension ranks no piece before another
            gain = tokens * (left[0] / cap[0] ** 2) + bearing * (left[2] / cap[2] ** 2)
            at = int(np.where(fits, gain, -1).argmax())
            self._take(at, int(tokens[at]), (tokens[at], 1, bearing[at]))
        else:  # cut the largest piece; what is left of it waits
            at = int(tokens.argmax())
            name, start, ids, total, free = self.waiting[at]
            n = int(min(left[0], max(0, free - start) + left[2]))
            self._take(at, n, (n, 1, n - min(n, max(0, free - start))))
        return self._close() if self.used[0] == cap[0] else []

    def _take(self, at: int, n: int, demand) -> None:
        name, start, ids, total, free = self.waiting[at]
        self.used = [u + int(d) for u, d in zip(self.used, demand)]
        self.open.append((name, start, ids[:n], total))
        if n < len(ids):
            self.waiting[at] = (name, start + n, ids[n:], total, free)
            self._note(at)
        else:
            self.demands[:, at] = self.demands[:, len(self.waiting) - 1]
            self.waiting[at] = self.waiting[-1]
            self.waiting.pop()

    def _close(self) -> list:
        out, total = [], sum(len(p[2]) for p in self.open)
        last = total < self.limits.tokens
        room = 1 << (total.bit_length() - 1) if last and total else total
        offset = 0
        for name, start, ids, whole in self.open:
            while len(ids):
                n = min(len(ids), room - offset)
                out.append((name, start, ids[:n], whole, self.sequence, offset))
                start, ids, offset = start + n, ids[n:], offset + n
                if offset == room:
                    total -= room
                    room = 1 << (total.bit_length() - 1) if last and total else total
                    self.sequence, offset = self.sequence + 1, 0
        self.open, self.used = [], [0, 0, 0]
        return out


def _emit(batches, tokenizer_path: str, end_id: int, limits: Limits, row, schema: pa.Schema):
    """Placed pieces of a task's documents (doc_id, text, loss-bearing tokens or null), turned to rows by row(piece, sequence_id)."""
    tokens, packer = encoder(tokenizer_path), Packer(limits)
    base = TaskContext.get().partitionId() << 40

    def rows(placed):
        columns = zip(*(row(p, base + p[4]) for p in placed))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in released(batches):
        names, loss = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for a, b, ids, sizes in tokens.slices(batch.column(1)):
            placed, start = [], 0
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4", copy=False)
            for i, n in zip(range(a, b), (sizes + 1).tolist()):
                mine = ids[start : start + n]
                placed += packer.add(names[i], mine, n if loss[i] is None else min(max(loss[i], 0), n))
                start += n
            if placed:
                yield rows(placed)
    if placed := packer.finish():
        yield rows(placed)


def _documents(docs: DataFrame, loss: str | None) -> DataFrame:
    bearing = F.col(loss).cast("long") if loss else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), bearing.alias("loss"))


def pack_digest(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """Where each piece of each document lies: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input task packs its own documents, so nothing is shuffled and a lost task is simply read and packed again;
    sequence ids hold the task's number. Null text is empty (its end id only), repeated rows are packed each, a null
    doc_id stays null, an empty table gives no rows, other columns are ignored. loss: a column with the number of each
    document's last tokens, the end id among them, that bear loss (null, or without the column: all of them).
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def row(p, sequence):
        return p[0], p[1], len(p[2]), zlib.crc32(p[2]), p[3], sequence, p[5]

    return _documents(docs, loss).mapInArrow(lambda b: _emit(b, tokenizer_path, end_id, limits, row, schema), PIECE_SCHEMA)


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """The pieces themselves: sequence_id, offset, doc_id, start and ids; a sequence's pieces follow one another.

    As ``pack_digest`` in all else.
    """
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def row(p, sequence):
        return sequence, p[5], p[0], p[1], p[2].tolist()

    return _documents(docs, loss).mapInArrow(lambda b: _emit(b, tokenizer_path, end_id, limits, row, schema), "sequence_id long, offset long, doc_id long, start long, ids array<long>")
