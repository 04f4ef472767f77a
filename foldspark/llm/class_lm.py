"""LM scoring with a Brown class-based bigram model.

p(word | previous) = p(class | previous class) * p(word | class). Classes come from exchange clustering:

1. Documents are coded once into chunks of some MB: a chunk has its own distinct words and its documents as sequences
   of their numbers. Words are 64-bit hashes. Training counts of all words are summed over all chunks.
2. The ``seeds`` most frequent words are clustered by the exchange algorithm on their full bigram counts: each word in
   turn moves to the class that raises the mutual information of adjacent classes most, until none moves. Their table
   of bigrams has a fixed size, so this runs on the driver.
3. From there the exchange goes on over all words of the training text, distributed: sweep by sweep each chunk counts the
   classes next to its words, the counts of a word from the whole corpus decide the class in which the mutual
   information is largest, and the new classes go back to the chunks. Half of the words move in a sweep; sweeps end when
   a turn of all words raises the information by a small share of it at most.
4. Each chunk gets counts and classes of its words back by a join, never by a broadcast vocabulary.
5. Transitions between classes are counted over the whole training text, in which words seen once also stand for
   words never seen.
"""

from __future__ import annotations

from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, partitions
from ._text import hash_words, slices

CHUNK = 24 << 20
END_WORD = -1  # hash kept for the end token
_FLAG = 128
NONE = 255  # class of a word that has none yet
_REACH = 2  # sweeps in which classes spread from word to word
FEWEST = 64  # a share of the words: where moving one in so many raises nothing, the exchange has ended
_SMALL = 32  # counts whose changes are tabulated
_BLOCK, _WORDS = 1024, 1024  # contexts and words taken together, so that what is made of them stays in a processor's cache


def _squeeze(ids: np.ndarray) -> bytes:
    """Numbers below 2**24 (or 2**32) as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _expand(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    out = planes[0].astype(np.uint32)
    for i in (1, 2, 3):
        if planes[i].any():
            out |= planes[i].astype(np.uint32) << np.uint32(8 * i)
    return out


CHUNK_SCHEMA = "chunk long, payload binary, words array<long>, counts array<long>"


def _pack(doc_ids: list, held: list, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A chunk's documents as one value: a table of them, then their tokens."""
    table = pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "length": pa.array(lengths, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    head = sink.getvalue().to_pybytes()
    return len(head).to_bytes(8, "little") + head + _squeeze(tokens)


def _unpack(payload) -> tuple[pa.RecordBatch, np.ndarray]:
    payload = memoryview(payload)
    n = int.from_bytes(payload[:8], "little")
    with pa.ipc.open_stream(pa.py_buffer(payload[8 : 8 + n])) as reader:
        table = reader.read_next_batch()
    return table, _expand(bytes(payload[8 + n :])).astype(np.int64)


def _rows(batch: pa.RecordBatch):
    """(payload, words) of each chunk of a batch."""
    payload, words = batch.column("payload"), batch.column("words")
    for i in range(batch.num_rows):
        yield payload[i].as_buffer(), words[i].values.to_numpy()


def code_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, held_out, text): documents as numbers of the chunk's words, frequent words first.

    counts: of each word in the chunk's documents that are not held out. A document longer than a chunk is one of its own.
    """

    def chunk(held_ids, held_flags, hashes, lengths, number):
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        coded = pa.array(words, pa.int64()).dictionary_encode()
        distinct, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.lexsort((distinct, -np.bincount(of, minlength=len(distinct))))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        coded, training = rank[of], np.repeat(~np.array(held_flags, bool), lengths)
        counts = np.bincount(coded[training], minlength=len(distinct))
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 32) + number], pa.int64()), "payload": pa.array([_pack(held_ids, held_flags, lengths, coded)], pa.binary()), "words": pa.array([distinct[order]], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64()))})

    def code(batches):
        ids, flags, hashes, lengths, size, number = [], [], [], [], 0, 0
        for batch in batches:
            names, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, data, offsets in slices(batch.column(2)):
                h, n = hash_words(data, offsets)
                ends = np.cumsum(n)
                ids += names[a:b]
                flags += held[a:b]
                hashes.append(np.insert(h.view(np.int64), ends, END_WORD))
                lengths.append(n + 1)
                size += len(data) + (b - a)
                if size >= CHUNK:
                    yield chunk(ids, flags, hashes, lengths, number)
                    ids, flags, hashes, lengths, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield chunk(ids, flags, hashes, lengths, number)

    return docs.select("doc_id", "held_out", "text").mapInArrow(code, CHUNK_SCHEMA)


def _pairs(of_word: np.ndarray, payload, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """of_word of each training token's predecessor (end's before the first), of the token, and the token itself."""
    table, tokens = _unpack(payload)
    lengths = table.column("length").to_numpy()
    training = np.repeat(~table.column("held_out").to_numpy(zero_copy_only=False), lengths)
    value = of_word[tokens]
    before = np.empty_like(value)
    before[1:] = value[:-1]
    before[np.cumsum(lengths) - lengths] = end
    return before[training], value[training], tokens[training]


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of (i, v) by i, v being int64 vectors in bytes: a size x width matrix. Only sums reach the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(v, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(sums), pa.int32()), "v": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((size, size), np.int64)
    for r in rows.repartition(min(size, partitions(rows.sparkSession)), "i").mapInArrow(add, "i int, v binary").collect():
        out[r["i"]] = np.frombuffer(r["v"], np.int64)
    return out


def _matrix_rows(table: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(table.any(1))
    return pa.RecordBatch.from_pydict({"i": pa.array(used, pa.int32()), "v": pa.array([table[i].tobytes() for i in used], pa.binary())})


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word by exchange clustering; the last word (the end token) is a class of its own, number ``classes``.

    A sweep takes the words in order and moves each to the class with the largest mutual information of adjacent
    classes; sweeps end when no word moves.
    """
    n = len(bigrams) - 1
    of = np.append(np.arange(n) % classes, classes)
    size = classes + 1
    b = bigrams.astype(float)
    member = np.zeros((n + 1, size))
    member[np.arange(n + 1), of] = 1
    right, left = b @ member, (member.T @ b).T  # counts of each word before and after each class
    table = member.T @ b @ member
    least = 1e-12 * float(_f(max(b.sum(), 1.0)))  # a move has to gain more than sums are off by
    moved = True
    while moved:
        moved = False
        for w in range(n):
            own, twin = of[w], b[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[own] -= twin
            l[own] -= twin
            table[own] -= r
            table[:, own] -= l
            table[own, own] -= twin
            rows, cols = table.sum(1) + l, table.sum(0) + r  # its neighbours' counts don't depend on its class
            k = np.arange(classes)
            gain = (_f(table[:classes] + r) - _f(table[:classes])).sum(1) + (_f(table[:, :classes] + l[:, None]) - _f(table[:, :classes])).sum(0)
            cell = table[k, k]
            gain += _f(cell + r[k] + l[k] + twin) + _f(cell) - _f(cell + r[k]) - _f(cell + l[k])
            r_all, l_all = r.sum() + twin, l.sum() + twin
            gain -= _f(rows[k] + r_all) - _f(rows[k]) + _f(cols[k] + l_all) - _f(cols[k])
            best = int(gain.argmax())
            if gain[best] <= gain[own] + max(1e-9, least):
                best = own
            table[best] += r
            table[:, best] += l
            table[best, best] += twin
            if best != own:
                moved = True
                of[w] = best
                right[:, own] -= b[:, w]
                right[:, best] += b[:, w]
                left[:, own] -= b[w]
                left[:, best] += b[w]
    return of


def _seed_bigrams(chunks: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """Bigram counts among the seeds (sorted hashes) and the end token, over all training text."""
    n = len(seeds)

    def count(batches):
        table = np.zeros((n + 1) ** 2, np.int64)
        for batch in batches:
            for payload, words in _rows(batch):
                a, b, _ = _pairs(_seed_numbers(words, seeds), payload, n)
                both = (a >= 0) & (b >= 0)
                table += np.bincount(a[both] * (n + 1) + b[both], minlength=len(table))
        yield _matrix_rows(table.reshape(n + 1, n + 1))

    return _summed(chunks.mapInArrow(count, "i int, v binary"), n + 1)


def _seed_numbers(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(seeds, words), len(seeds) - 1) if len(seeds) else np.zeros(len(words), np.int64)
    of = np.where(seeds[at] == words, at, -1) if len(seeds) else np.full(len(words), -1)
    of[words == END_WORD] = len(seeds)
    return of


def _steps(table: np.ndarray, classes: int) -> tuple:
    """(counts, f of them, f(count + n) - f(count) by n up to ``_SMALL``) by context and class: for classes in front, and for classes behind."""
    n = np.arange(_SMALL + 1.0)[:, None, None]
    return tuple((held, _f(held), _f(held + n) - _f(held)) for held in (table[:, :classes].astype(float), table[:classes].T.astype(float)))


def _looked_up(step: np.ndarray, row: np.ndarray, context: np.ndarray, counts: np.ndarray, which: np.ndarray, words: int) -> np.ndarray:
    """Sum of step[count, context] by row (ascending), over the entries asked for: first entries of all rows, then second ones."""
    out, row = np.zeros((words, step.shape[2])), row[which]
    if len(row):
        each = np.bincount(row, minlength=words)
        by_size = np.argsort(-each, kind="stable")
        rank = np.empty(words, np.int64)
        rank[by_size] = np.arange(words)
        at = np.zeros((each.max(), words), np.int64)
        at[np.arange(len(row)) - (np.cumsum(each) - each)[row], rank[row]] = counts[which].astype(np.int64) * step.shape[1] + context[which]
        flat, left = step.reshape(-1, step.shape[2]), np.searchsorted(-each[by_size], -np.arange(len(at)), "left")
        for x, n in zip(at, left.tolist()):
            out[:n] += flat.take(x[:n], 0)
        out = out[rank]
    return out


def _changes(keys: np.ndarray, counts: np.ndarray, of: np.ndarray, table: np.ndarray, classes: int, steps: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words that have contexts (places in ``of``), and the change of mutual information for each of them in each class.

    keys: sorted, place * (2 * size + 1) + context, size being classes + 1: a class before it, size + a class behind it, or 2 * size where
    it follows itself. of: its class now, or NONE. table: counts of adjacent classes, with the word where it is now. A
    word is first taken out of its class, as in ``exchange``, so the largest change is also the best class to stay in. steps:
    of the table (see ``_steps``); most counts are small, and what they change is looked up.
    """
    size = classes + 1
    place, context = np.divmod(keys, 2 * size + 1)
    new = np.append(True, place[1:] != place[:-1])
    words, row = place[new], np.cumsum(new) - 1
    dense = np.bincount(row * (2 * size + 1) + context, weights=counts, minlength=len(words) * (2 * size + 1)).reshape(len(words), -1)
    left, right, twin = dense[:, :size], dense[:, size : 2 * size], dense[:, 2 * size]
    own, table = of[words].astype(np.int64), table.astype(float)
    placed = own != NONE
    seated, seat = np.flatnonzero(placed), own[placed]
    change = np.zeros((len(words), classes))
    for side, other, (held, whole, step) in zip((0, size), (right, left), steps or _steps(table, classes)):
        at = np.flatnonzero((context >= side) & (context < side + size))
        r, c, n = row[at], context[at] - side, counts[at].astype(float)
        home = c == own[r]  # the neighbours are in its own class, which it leaves
        gain = _looked_up(step, r, c, n, ~home & (n <= _SMALL), len(words))
        many = np.flatnonzero(~home & (n > _SMALL))
        for x in (many[i : i + _BLOCK] for i in range(0, len(many), _BLOCK)):
            starts = np.flatnonzero(np.append(True, r[x][1:] != r[x][:-1]))
            gain[r[x][starts]] += np.add.reduceat(_f(held[c[x]] + n[x, None]) - whole[c[x]], starts)
        here = np.flatnonzero(placed[r] & ~home)
        rest = np.maximum(held[c[here], own[r[here]]] - n[here], 0)  # its own class without it
        gain[seated, seat] = np.bincount(r[here], _f(rest + n[here]) - _f(rest), len(words))[seated]
        x, n = r[home], n[home]
        cell, mine = held[own[x]] - other[x, :classes], (np.arange(len(x)), own[x])
        cell[mine] -= n + twin[x]
        cell = np.maximum(cell, 0)
        gain[x] += _f(cell + n[:, None]) - _f(cell)
        change += gain
    before, behind = left[:, :classes], right[:, :classes]
    r, k = np.nonzero(((before > 0) & (behind > 0)) | (twin > 0)[:, None])  # else the cell of a class and itself adds nothing
    cell, a, b, t = table[k, k], before[r, k], behind[r, k], twin[r]
    cell -= np.where(own[r] == k, a + b + t, 0)
    change[r, k] += _f(cell + a + b + t) + _f(cell) - _f(cell + a) - _f(cell + b)
    for sums, own_sum in ((table.sum(1)[:classes], right.sum(1) + twin), (table.sum(0)[:classes], left.sum(1) + twin)):
        some, at = np.unique(own_sum, return_inverse=True)
        rise = (_f(sums + some[:, None]) - _f(sums))[at]
        rest = np.maximum(sums[seat] - own_sum[seated], 0)
        rise[seated, seat] = _f(rest + own_sum[seated]) - _f(rest)
        change -= rise
    return words, change


def _alone(table: np.ndarray, classes: int, steps: tuple) -> tuple[np.ndarray, ...]:
    """What ``_changes`` says of any word with at most one token before it and one behind, none of them of its own class.

    Its changes depend only on those two classes (the number size: none): by the pair, the best class, its change, the second
    best class, its change. Its own class, from which it is taken out, alone differs: by neighbour and class what it adds
    before it and behind it, then by class what its sums take.
    """
    size, (front, back) = classes + 1, steps
    rows, cols = table.sum(1)[:classes].astype(float), table.sum(0)[:classes].astype(float)
    rise = lambda x: _f(x + 1) - _f(x)
    change = np.zeros((size + 1, size + 1, classes))
    change[:size] += front[2][1][:, None]
    change[:, :size] += back[2][1]
    k = np.arange(classes)
    cell = np.diag(table)[:classes].astype(float)
    change[k, k, k] += _f(cell + 1 + 1) + _f(cell) - _f(cell + 1) - _f(cell + 1)
    change[:, :size] -= rise(rows)
    change[:size] -= rise(cols)
    change = change.reshape(-1, classes)
    best, at = change.argmax(1), np.arange(len(change))
    value = change[at, best]
    change[at, best] = -np.inf
    second = change.argmax(1)
    none = np.zeros((1, classes))
    stay = [np.concatenate([rise(np.maximum(held - 1, 0)), none]) for held in (front[0], back[0])]
    return best, value, second, change[at, second], *stay, rise(np.maximum(rows - 1, 0)), rise(np.maximum(cols - 1, 0))


def _moved(keys: np.ndarray, counts: np.ndarray, of: np.ndarray, table: np.ndarray, classes: int, steps: tuple, alone: tuple, least: float) -> np.ndarray:
    """Class of each word, moved to that of the largest change (see ``_changes``) if it is more than least above its own class's."""
    size, new = classes + 1, of.copy()
    width = 2 * size + 1
    place, context = np.divmod(keys, width)
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(keys) else np.zeros(0, np.int64)
    entries = np.diff(np.append(start, len(keys)))
    last = start + entries - 1
    first, other = context[start], context[last]
    before = np.where(first < size, first, size)
    behind = np.where((other >= size) & (other < 2 * size), other - size, size)
    own = of[place[start]].astype(np.int64)
    plain = (counts[start] == 1) & (counts[last] == 1) & (entries == (before < size).astype(int) + (behind < size)) & (before != own) & (behind != own)
    word, a, b, own = place[start[plain]], before[plain], behind[plain], own[plain]
    best, value, second, value2, stay_front, stay_back, stay_rows, stay_cols = alone
    pair, o = a * (size + 1) + b, np.where(own == NONE, 0, own)
    ahead = (best[pair] != own) | (classes < 2)
    to, gain = np.where(ahead, best[pair], second[pair]), np.where(ahead, value[pair], value2[pair])
    stays = stay_front[a, o] + stay_back[b, o] - np.where(b < size, stay_rows[o], 0) - np.where(a < size, stay_cols[o], 0)
    new[word] = np.where((own != NONE) & ~(gain > stays + least), own, to)
    rest = np.repeat(~plain, entries)
    keys, counts, place = keys[rest], counts[rest], place[rest]
    cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1]))[::_WORDS], len(keys)) if len(keys) else np.zeros(1, np.int64)
    for x, y in zip(cuts[:-1], cuts[1:]):
        who, change = _changes(keys[x:y], counts[x:y], of, table, classes, steps)
        best, own, rows = change.argmax(1), of[who], np.arange(len(who))
        stays = (own != NONE) & (change[rows, best] <= change[rows, np.where(own == NONE, 0, own)] + least)
        new[who] = np.where(stays, own, best)
    return new


def _information(table: np.ndarray) -> float:
    """Mutual information of adjacent classes, in nats a token."""
    table = table.astype(float)
    n = max(table.sum(), 1.0)
    return float((_f(table).sum() - _f(table.sum(1)).sum() - _f(table.sum(0)).sum() + _f(n)) / n)


def _turn(words: np.ndarray, sweep: int, turns: int) -> np.ndarray:
    """The words that move in a sweep, one of ``turns`` (a power of two) shares of them by hash."""
    return ((words >> 7) & (turns - 1)) == sweep % turns


REQUEST_SCHEMA = "part int, chunk long, words binary, keys binary, counts binary"
ANSWER_SCHEMA = "part int, chunk long, words binary, counts binary, classes binary, moved long, left long"


def _sweeps(scratch: Scratch, chunks: DataFrame, vocabulary: DataFrame, distinct: int, seeds: np.ndarray, of_seed: np.ndarray, classes: int, least_rise: float) -> DataFrame:
    """(word, n, class) of all training words by exchange over the whole text, begun from the seeds' classes.

    Words are dealt into parts by hash. In a sweep each chunk counts the classes next to its words and sends each part
    one value; a part sums its words' neighbours over all chunks, moves each word whose turn it is to the class of
    largest mutual information, and sends each chunk the classes of its words. Words without a class are taken in the first
    ``_REACH`` sweeps, in which classes spread from the seeds and the end token; those that no class has reached, as in the
    middle of a document of words that occur once, then begin in any class and are moved by the turns that follow, of
    which at least one is whole. Half of the words take turns; where their moving at once has not raised the
    information, a share half as large, down to one in ``FEWEST``. Sweeps end when all words have a class and a turn of
    all words moved none, or raised the information by at most a share ``least_rise`` of it, or no share raised it. With
    ``least_rise`` 0 shares go down to a single word.
    """
    spark = chunks.sparkSession
    parts, size = partitions(spark), classes + 1
    width = 2 * size + 1

    def first(words):
        number = _seed_numbers(words, seeds)
        return np.where(number >= 0, of_seed[number], NONE).astype(np.uint8)

    def dealt(words):
        """Places of a chunk's words in order of the hash, and the bounds of the parts, which are ranges of it (see ``part``)."""
        order = np.argsort(words.view(np.uint64))
        share = (words[order].view(np.uint64) >> np.uint64(33)).astype(np.int64) * parts >> 31
        return order, np.searchsorted(share, np.arange(parts + 1))

    def lexicon(batches):
        held: dict[int, list] = {}
        for batch in batches:
            part, word, n = (batch.column(i).to_numpy() for i in range(3))
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append((word[part == p], n[part == p]))
        for p, rows in held.items():
            word, n = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(word.view(np.uint64))
            yield answer(p, -1, word[order].tobytes(), n[order].tobytes(), first(word[order]), 0, 0)

    def answer(part, chunk, words, counts, of, moved, left):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([words], pa.binary()), pa.array([counts], pa.binary()), pa.array([of.tobytes()], pa.binary()), pa.array([moved], pa.int64()), pa.array([left], pa.int64())], names=["part", "chunk", "words", "counts", "classes", "moved", "left"])

    def as_bytes(batches):
        for batch in batches:
            chunk = batch.column("chunk")
            for i, (payload, words) in enumerate(_rows(batch)):
                yield pa.RecordBatch.from_arrays([chunk[i : i + 1], pa.array([2**31 - 1], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([payload.to_pybytes()], pa.binary())], names=["chunk", "part", "data", "payload"])

    def tallied(keys, rank):
        """Distinct keys and their counts, by rank of the word: dense for frequent words, which have the low numbers."""
        bound = min(len(rank), 1 << 14) * width
        dense = np.bincount(keys[keys < bound], minlength=bound)
        some = np.flatnonzero(dense)
        rare, n = np.unique(keys[keys >= bound], return_counts=True)
        keys, n = np.concatenate([some, rare]), np.concatenate([dense[some], n])
        place, context = np.divmod(keys, width)
        keys = rank[place] * width + context
        order = np.argsort(keys)
        return keys[order], n[order]

    def requests(chunk, payload, words, order, bounds, of, sweep, turns):
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        before, own, tokens = _pairs(of, payload, classes)
        both = np.bincount(before.astype(np.int32) << 8 | own, minlength=1 << 16).reshape(256, 256)
        rows = _matrix_rows(both[:size, :size])
        none = pa.nulls(rows.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, -1), pa.int32()), rows.column(0).cast(pa.int64()), rows.column(1), none, none], names=["part", "chunk", "words", "keys", "counts"])
        asked = ((of == NONE) | _turn(words, sweep, turns)) & (words != END_WORD)
        end = np.flatnonzero(words == END_WORD)
        twin = np.zeros(len(tokens) + 1, bool)  # the token is the one before it again, in one document
        twin[1:-1] = tokens[1:] == tokens[:-1]
        for e in end.tolist():
            twin[:-1] &= tokens != e
        at = np.flatnonzero(asked[tokens])
        base, front, back = tokens[at] * width, before[at], np.append(own, np.uint8(NONE))[at + 1]
        again, again_behind = twin[at], twin[at + 1]
        a, b = (front != NONE) & ~again, (back != NONE) & ~again_behind
        keys, n = tallied(np.concatenate([base[a] + front[a], base[b] + (size + back[b].astype(np.int64)), base[again] + 2 * size]), rank)
        cuts = np.searchsorted(keys, bounds * width)
        full = np.flatnonzero(np.diff(bounds)).tolist()
        told = [words[order[bounds[p] : bounds[p + 1]]].tobytes() for p in full]
        steps = [_squeeze(np.diff(keys[cuts[p] : cuts[p + 1]] - bounds[p] * width, prepend=0)) for p in full]
        sums = [_squeeze(n[cuts[p] : cuts[p + 1]]) for p in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(told, pa.binary()), pa.array(steps, pa.binary()), pa.array(sums, pa.binary())], names=["part", "chunk", "words", "keys", "counts"])

    def count(sweep, turns):
        def run(batches):
            got: list[bytes] = []
            for batch in batches:
                chunk, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for i in range(batch.num_rows):
                    if part[i] < 2**31 - 1:
                        got.append(batch.column(2)[i].as_py())
                        continue
                    words = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                    order, bounds = dealt(words)
                    if sweep:
                        of = np.empty(len(words), np.uint8)
                        of[order] = np.frombuffer(b"".join(got), np.uint8)
                    else:
                        of = first(words)
                    got = []
                    yield from requests(int(chunk[i]), batch.column(3)[i].as_buffer(), words, order, bounds, of, sweep, turns)

        return run

    def choose(table, sweep):
        least, steps = 1e-12 * float(_f(np.array(max(table.sum(), 1.0)))), _steps(table, classes)
        alone = _alone(table, classes, steps)

        def part_done(part, words, counts, of, asked):
            keys, n = (np.concatenate([x[i] for x in asked]) if asked else np.zeros(0, np.int64) for i in (2, 3))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            keys, n = keys[starts], np.add.reduceat(n, starts) if len(starts) else n
            new = _moved(keys, n, of, table, classes, steps, alone, least)
            if sweep + 1 >= _REACH:
                new = np.where((new == NONE) & (words != END_WORD), (words >> 13) % classes, new).astype(np.uint8)
            yield answer(part, -1, words.tobytes(), counts, new, int((new != of).sum()), int((new == NONE).sum()))
            told = [np.where(found >= 0, new[found], NONE).astype(np.uint8).tobytes() if len(new) else bytes([NONE]) * len(found) for _, found, _, _ in asked]
            none, zero = pa.nulls(len(told), pa.binary()), pa.array(np.zeros(len(told), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(told), pa.int32()), pa.array([x[0] for x in asked], pa.int64()), none, none, pa.array(told, pa.binary()), zero, zero], names=["part", "chunk", "words", "counts", "classes", "moved", "left"])

        def run(batches):
            now = None
            for batch in batches:
                for i in range(batch.num_rows):
                    part, chunk = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    words = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                    if now is None or now[0] != part:
                        if now is not None:
                            yield from part_done(*now)
                        known = chunk < 0
                        now = (part, words if known else words[:0], batch.column(4)[i].as_py() if known else b"", np.frombuffer(batch.column(5)[i].as_py(), np.uint8) if known else np.zeros(0, np.uint8), [])
                        if known:
                            continue
                    at = np.minimum(np.searchsorted(now[1].view(np.uint64), words.view(np.uint64)), max(len(now[1]) - 1, 0))
                    found = np.where(now[1][at] == words, at, -1) if len(now[1]) else np.full(len(words), -1)  # -1: only in held-out text
                    keys, n = np.cumsum(_expand(batch.column(3)[i].as_py()).astype(np.int64)), _expand(batch.column(4)[i].as_py()).astype(np.int64)
                    place, context = np.divmod(keys, width)
                    now[4].append((chunk, found, found[place] * width + context, n))
            if now is not None:
                yield from part_done(*now)

        return run

    part = F.shiftright(F.shiftrightunsigned("word", 33) * F.lit(parts).cast("long"), 31).cast("int")
    rows = vocabulary.select(part.alias("part"), "word", "n").repartition(parts, "part").mapInArrow(lexicon, ANSWER_SCHEMA)
    answers, sequences = scratch.write(rows, "classes-0"), chunks.select("chunk", "payload", "words").mapInArrow(as_bytes, "chunk long, part int, data binary, payload binary")
    moves, known, turns, left = [], [], 2, distinct  # words moved, and the information where all words had classes
    for sweep in count_up():
        told = sequences
        if sweep:
            sent = answers.filter("chunk >= 0").select("chunk", "part", F.col("classes").alias("data"), F.lit(None).cast("binary").alias("payload"))
            told = sent.unionByName(sequences).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
        asked = scratch.write(told.mapInArrow(count(sweep, turns), REQUEST_SCHEMA), f"neighbours-{sweep}", "uncompressed")
        table = _summed(asked.filter("part < 0").select(F.col("chunk").cast("int").alias("i"), F.col("words").alias("v")), size)
        if not left:
            known.append(_information(table))
        held = answers.filter("chunk < 0").select("part", "chunk", "words", F.lit(None).cast("binary").alias("keys"), "counts", "classes")
        both = held.unionByName(asked.filter("part >= 0").withColumn("classes", F.lit(None).cast("binary"))).repartition(parts, "part").sortWithinPartitions("part", "chunk")
        new = scratch.write(both.mapInArrow(choose(table, sweep), ANSWER_SCHEMA), f"classes-{sweep + 1}")
        scratch.drop(f"classes-{sweep}", f"neighbours-{sweep}")
        answers = new
        moved, left = answers.filter("chunk < 0").agg(F.coalesce(F.sum("moved"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0))).first()
        moves.append(moved)
        spark._jvm.System.gc()  # lets Spark remove the shuffles of the sweep
        if not left and len(moves) >= turns and not sum(moves[-turns:]):
            break
        rise = known[-1] - known[-1 - turns] if len(known) > turns else None
        if rise is not None and 0 < rise <= least_rise * known[-1]:
            break
        if rise is not None and rise <= 0:
            moves, known, turns = [], [], turns * 2
            if turns > (2 * distinct if least_rise == 0 else FEWEST):
                break

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, n, of = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((0, np.int64), (1, np.int64), (2, np.uint8)))
                yield pa.RecordBatch.from_pydict({"word": pa.array(words), "n": pa.array(n), "class": pa.array(of, pa.int32())})

    return answers.filter("chunk < 0").select("words", "counts", "classes").mapInArrow(rows_of, "word long, n long, class int")


def class_scores(docs: DataFrame, classes: int = 64, seeds: int = 512, alpha: float = 0.1, least_rise: float = 0.01) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, held_out, text).

    Tokens are the words and one end; null text is empty. Learned from the rows that are not held out. base_score is
    the unigram log10 probability with alpha added to each count and one unseen word; score that of the class model:
    unseen words are a class of their own that words seen once stand for, classes follow one another with counts plus
    alpha, and words within a class have their counts plus alpha. An empty table gives no rows; without training rows
    every token is unseen. The exchange ends when a turn of all words raises the information of adjacent classes by at most
    a share ``least_rise`` of it (see ``_sweeps``), which at 0.01 takes 7 to 11 sweeps instead of some hundred; at 0, when no word is better off in another class. Rows that repeat a doc_id are scored each.
    """
    if classes + 2 > _FLAG:
        raise ValueError("classes and two more must fit 7 bits")
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    chunks = scratch.write(code_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))), "chunks", "uncompressed")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    vocabulary = scratch.write(each.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.filter(F.col("word") != END_WORD).orderBy(F.desc("n"), "word").limit(seeds).collect()
    # Frequent words first in the exchange; sorted by hash for lookup.
    by_count = np.array([r["word"] for r in top], np.int64)
    order = np.argsort(by_count)
    sorted_seeds = by_count[order]
    bigrams = _seed_bigrams(chunks, sorted_seeds)
    frequent = np.argsort(order)  # of the i-th most frequent word: its place in sorted order
    full = np.append(frequent, len(by_count))
    of = exchange(bigrams[np.ix_(full, full)], classes)
    of_seed = np.empty_like(of)
    of_seed[full] = of
    lexicon = scratch.write(_sweeps(scratch, chunks, vocabulary, distinct, sorted_seeds, of_seed, classes, least_rise), "lexicon")
    totals, kinds = np.zeros(classes + 2), np.zeros(classes + 2)
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        totals[r["class"]], kinds[r["class"]] = r["n"], r["v"]

    # Arrow's list vectors are slow where most rows are null, so what belongs to a chunk is one binary value.
    answers = each.select("chunk", "place", "word").join(lexicon, "word").select("chunk", "place", "n", "class", F.lit(None).cast("binary").alias("payload"))
    sequences = chunks.select("chunk", F.lit(2**31 - 1).alias("place"), F.size("words").cast("long").alias("n"), F.lit(0).alias("class"), "payload")
    gathered = answers.unionByName(sequences).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "place")
    unseen, base_all = classes + 1, tokens + alpha * (distinct + 1)

    def read(batches):
        places, counts, kinds_of, at = [], [], [], None
        for batch in batches:
            chunk, place, n, kind = (batch.column(i).to_numpy() for i in range(4))
            last = np.flatnonzero(place == 2**31 - 1)
            begin = 0
            for end in [*last.tolist(), batch.num_rows]:
                if begin < end:
                    places.append(place[begin:end])
                    counts.append(n[begin:end])
                    kinds_of.append(kind[begin:end])
                if end < batch.num_rows:
                    count, of = np.zeros(int(n[end]), np.int64), np.full(int(n[end]), unseen)
                    if places:
                        p = np.concatenate(places)
                        count[p], of[p] = np.concatenate(counts), np.concatenate(kinds_of)
                    places, counts, kinds_of = [], [], []
                    yield documents(batch.column(4)[int(end)].as_buffer(), count, of)
                begin = end + 1

    def documents(payload, count, of):
        table, tokens = _unpack(payload)
        lengths = table.column("length").to_numpy()
        starts = np.cumsum(lengths) - lengths
        base = np.log10((count + alpha) / base_all)
        emission = np.where(of == unseen, 0.0, np.log10((count + alpha) / np.maximum(totals[of] + alpha * kinds[of], 1e-300)))
        code = (of | np.where(count == 1, _FLAG, 0)).astype(np.uint8)[tokens].tobytes()
        ends = (starts + lengths).tolist()
        add = lambda x: np.add.reduceat(x[tokens], starts)
        return pa.RecordBatch.from_pydict({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(lengths), "n_known": pa.array(add((count > 0).astype(np.int64))), "base_score": pa.array(add(base)), "emission": pa.array(add(emission)), "classes": pa.array([code[a:b] for a, b in zip(starts.tolist(), ends)], pa.binary())})

    scored = scratch.write(gathered.mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"), "scored")
    scratch.drop_all_but("scored")
    size = classes + 2

    def follow(data: list[bytes]):
        """Class before each token, class of each token, and which are of words seen once, before and now."""
        code = np.frombuffer(b"".join(data), np.uint8)
        lengths = np.array([len(x) for x in data], np.int64)
        own, once = (code & (_FLAG - 1)).astype(np.int64), code >= _FLAG
        before, once_before = np.empty_like(own), np.empty_like(once)
        before[1:], once_before[1:] = own[:-1], once[:-1]
        starts = np.cumsum(lengths) - lengths
        before[starts], once_before[starts] = classes, False
        return before, own, once_before, once, starts

    def transitions(batches):
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            if batch.num_rows:
                a, b, a_once, b_once, _ = follow(batch.column(0).to_pylist())
                once_a, once_b = np.where(a_once, unseen, a), np.where(b_once, unseen, b)
                for x, y, rows in ((a, b, slice(None)), (a, once_b, b_once), (once_a, b, a_once), (once_a, once_b, a_once & b_once)):
                    table += np.bincount(x[rows] * size + y[rows], minlength=size * size)
        yield _matrix_rows(table.reshape(size, size))

    moves = _summed(scored.filter(~F.col("held_out")).select("classes").mapInArrow(transitions, "i int, v binary"), size) + alpha
    log_move = np.log10(moves / moves.sum(1, keepdims=True)).ravel()

    def total(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, _, _, starts = follow(batch.column(6).to_pylist())
                score = np.add.reduceat(log_move[a * size + b], starts) + batch.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(batch.num_rows, tokens)), batch.column(4), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored.mapInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
