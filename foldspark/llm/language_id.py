"""Language identification by hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1 of its own. The vector of three letters in a row is the product of their vectors,
each rotated by its place; a document is the sum of the vectors of its trigrams; a language's prototype is the sum of
its documents. A document gets the language whose prototype has the largest cosine with it.

Sums are linear, so a document's vector is its trigram counts times a table of trigram vectors, and a prototype is
summed from counts alone, task by task; only one vector for each language and task is moved. Trigram vectors are made
from the letters' when needed, a block at a time, so a worker's memory doesn't depend on how varied the letters are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import numbered
from ._shared import Scratch, released
from ._text import slices

DIMENSIONS = 2048
#: Trigrams whose vectors are held at once, and rows whose vectors are.
BLOCK = 1024
#: Letters whose vectors a worker keeps (2 KB each); beyond it they are made anew.
LETTERS = 8192
#: Languages that a worker holds prototypes of at a time; texts go through a pass for each so many.
LANGUAGES = 4096
UNKNOWN = "und"


@cache
def _lowered() -> np.ndarray:
    """Letter of each code point below 0x3000, lower-cased where that is one letter; 0 for what is no letter."""
    return np.array([_letter(cp) for cp in range(0x3000)], np.uint32)


def _letter(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalpha():
        return 0
    low = ch.lower()
    return ord(low) if len(low) == 1 else cp


def _letters_of(points: np.ndarray) -> np.ndarray:
    table = _lowered()
    out = table[np.minimum(points, len(table) - 1)]
    if len(points) and points.max() >= len(table):
        far = points >= len(table)
        distinct, place = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_letter(int(cp)) for cp in distinct], np.uint32)[place]
    return out


_made: dict[tuple[int, int], np.ndarray] = {}


def letter_vectors(letters: np.ndarray, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each letter, drawn from the letter's code point and the seed alone."""
    if len(_made) + len(letters) > LETTERS:
        _made.clear()
    out = np.empty((len(letters), DIMENSIONS), np.int8)
    for i, cp in enumerate(letters.tolist()):
        v = _made.get((seed, cp))
        if v is None:
            v = np.random.default_rng([seed, cp]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
            if len(_made) < LETTERS:
                _made[seed, cp] = v
        out[i] = v
    return out


def trigram_vectors(trigrams: np.ndarray, letters: np.ndarray, seed: int) -> np.ndarray:
    """Vectors of trigrams given by three places in letters each: their letters' vectors rotated and multiplied."""
    used, place = np.unique(trigrams, return_inverse=True)
    v, place = letter_vectors(letters[used], seed), place.reshape(trigrams.shape)
    return np.roll(v, 2, 1)[place[:, 0]] * np.roll(v, 1, 1)[place[:, 1]] * v[place[:, 2]]


def trigram_codes(texts: pa.Array):
    """(first row, end row, letters, trigram codes, row of each code, has letters) of slices of a text column.

    A code is three places in the slice's sorted letters, as digits. Runs of what is no letter are one symbol, as are the start
    and the end of a text. Texts are taken whole.
    """
    for a, b, data, offsets in slices(texts):
        if not len(data):
            yield a, b, np.zeros(1, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(b - a, bool)
            continue
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
        ends = np.concatenate([np.zeros(1, np.int32), heads])[offsets]  # character offsets of the rows
        found = _letters_of(points)
        top = int(found.max()) + 1
        seen = np.zeros(top, bool)
        seen[found] = True
        seen[0] = True
        letters = np.flatnonzero(seen)
        place = np.zeros(top, np.int32)
        place[letters] = np.arange(len(letters))
        # A row becomes: gap, its letters, gap.
        n = np.diff(ends)
        row = np.repeat(np.arange(b - a, dtype=np.int32), n + 2)
        padded = np.zeros(len(points) + 2 * (b - a), np.int32)
        padded[np.arange(len(points)) + 2 * np.repeat(np.arange(b - a), n) + 1] = place[found]
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0) | (row[1:] != row[:-1])
        padded, row = padded[keep], row[keep]
        base = np.int64(len(letters))
        codes = (padded[:-2] * base + padded[1:-1]) * base + padded[2:]
        inside = row[:-2] == row[2:]
        has = np.zeros(b - a, bool)
        has[row[padded != 0]] = True
        yield a, b, letters.astype(np.uint32), codes[inside], row[:-2][inside], has


def _group(codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (all below top), and the place of each code among them."""
    if top > 1 << 22:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(top, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[codes]


def bundles(rows: np.ndarray, n: int, codes: np.ndarray, letters: np.ndarray, seed: int) -> np.ndarray:
    """Sum of the trigram vectors of each of n rows; rows and codes go together. Vectors are made ``BLOCK`` at a time."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    if not len(codes):
        return out
    base = len(letters)
    distinct, place = _group(codes, base**3)
    block = place // BLOCK
    order = np.argsort(block.astype(np.uint16) if len(distinct) <= BLOCK << 16 else block, kind="stable") if len(distinct) > BLOCK else slice(None)
    rows, place = rows[order].astype(np.int64), place[order]
    cuts = np.searchsorted(place // BLOCK, np.arange(-(-len(distinct) // BLOCK) + 1))
    for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        some = distinct[k * BLOCK : (k + 1) * BLOCK]
        trigrams = np.stack([some // base**2, some // base % base, some % base], 1)
        counts = np.bincount(rows[x:y] * len(some) + place[x:y] - k * BLOCK, minlength=n * len(some)).reshape(n, len(some))
        out += counts.astype(np.float32) @ trigram_vectors(trigrams, letters, seed).astype(np.float32)
    return out


def _summed(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of (lang, salt, v) by keys, v being float64 vectors in bytes; rows of a key are added as they come."""

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for lang, salt, v in zip(*(c.to_pylist() for c in batch.columns)):
                key = (lang, salt if len(keys) > 1 else 0)
                sums[key] = sums.get(key, 0) + np.frombuffer(v)
        for (lang, salt), v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "salt": pa.array([salt], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    return vectors.repartition(*keys).mapInArrow(add, vectors.schema)


Prototypes = dict[str, np.ndarray]


def prototype_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, v): the prototype of each language of (text, lang), from all rows whose lang is not null, as a written table.

    A task sends one vector for each language it meets; they are added in two steps. Repeated rows count each; an empty table gives
    no prototypes.
    """
    rows = docs.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % 64

        def flush():
            for name, v in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name]), "salt": pa.array([salt], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})
            sums.clear()

        for batch in released(batches):
            langs = batch.column(1).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for a, b, letters, codes, row, _ in trigram_codes(batch.column(0)):
                here, index = np.unique(of[a:b], return_inverse=True)
                for x in range(0, len(here), BLOCK):
                    mine = index[row]
                    part = (mine >= x) & (mine < x + BLOCK)
                    found = bundles(mine[part] - x, min(BLOCK, len(here) - x), codes[part], letters, seed)
                    for i, v in zip(here[x : x + BLOCK].tolist(), found):
                        sums[names[i]] = sums.get(names[i], 0) + v.astype(np.float64)
                    if len(sums) > BLOCK:
                        yield from flush()
        yield from flush()

    parts = _summed(rows.mapInArrow(bundle, "lang string, salt int, v binary"), ["lang", "salt"])
    return Scratch(docs.sparkSession, "language").write(_summed(parts, ["lang"]).select("lang", "v"), "prototypes")


def fit_prototypes(docs: DataFrame, seed: int = 0) -> list[Prototypes]:
    """``prototype_table`` in blocks of ``LANGUAGES`` languages, ascending; see ``prototype_blocks``."""
    return list(prototype_blocks(prototype_table(docs, seed)))


def prototype_blocks(table: DataFrame) -> Iterator[Prototypes]:
    """The prototypes in ascending order of language, ``LANGUAGES`` at a time: that is all of them that the driver holds. At least one block."""
    n = table.count()
    ordered = numbered(table, ["lang"]) if n > LANGUAGES else None
    for a in range(0, max(n, 1), LANGUAGES):
        block = ordered.filter(F.col("number").between(a, a + LANGUAGES - 1)) if ordered is not None else table
        yield {r["lang"]: np.frombuffer(r["v"]) for r in block.select("lang", "v").collect()}


def predict_language(docs: DataFrame, prototypes: Prototypes | Iterable[Prototypes], seed: int = 0, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and lang_pred, score: the language of the largest cosine, and that cosine, 0 to 1.

    ``und`` with score 0 where text is null or has no letters, or nothing was learned. Equal cosines go to the
    language first in order. Repeated rows are rows each, an empty table gives no rows. A column of docs that is named
    lang_pred or score is replaced. Prototypes in several blocks are gone through one pass after another, each of which keeps the better
    language of its own and the passes before.
    """
    blocks = [prototypes] if isinstance(prototypes, dict) else list(prototypes)
    kept = keep or [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if len(blocks) == 1:
        return _predicted(docs, blocks[0], seed, text, kept)
    shown = docs.select(*(F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(kept)), F.col(f"`{text}`").cast("string").alias("whole text"))
    names = shown.columns
    best = shown.withColumns({"best lang": F.lit(UNKNOWN), "best score": F.lit(-1.0).cast("double")})
    for block in blocks:
        new = _predicted(best, block, seed, "whole text", best.columns)
        better = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > F.col("best score"))
        best = new.select(*names, F.when(better, F.col("lang_pred")).otherwise(F.col("best lang")).alias("best lang"), F.when(better, F.col("score")).otherwise(F.col("best score")).alias("best score"))
    return best.select(*(F.col(f"kept {i}").alias(c) for i, c in enumerate(kept)), F.col("best lang").alias("lang_pred"), F.greatest(F.lit(0.0), F.col("best score")).alias("score"))


def _predicted(docs: DataFrame, prototypes: Prototypes, seed: int, text: str, keep: list[str]) -> DataFrame:
    """One pass: the columns ``keep``, lang_pred and score by one block of prototypes."""
    names = sorted(prototypes)
    norms = [np.linalg.norm(prototypes[x]) or 1.0 for x in names]
    weights = np.stack([prototypes[x] / n for x, n in zip(names, norms)], 1).astype(np.float32) if names else np.zeros((DIMENSIONS, 0), np.float32)
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    # The text goes to the workers once: as the column it is, or behind the others where it isn't among them.
    own = text in kept.columns and isinstance(kept.schema[text].dataType, T.StringType)
    at = kept.columns.index(text) if own else len(kept.columns)
    rows = kept if own else docs.select(*(F.col(f"`{c}`") for c in kept.columns), F.col(text).cast("string").alias("whole text"))

    made = [*kept.columns, "lang_pred", "score"]

    def predict(batches):
        answers = pa.array([*names, UNKNOWN])
        for batch in released(batches):
            for a, b, letters, codes, row, has in trigram_codes(batch.column(at)):
                best, score = np.full(b - a, len(names)), np.zeros(b - a)
                first = np.searchsorted(row, np.arange(b - a + 1))
                for x in range(0, b - a, BLOCK) if names else ():
                    y = min(b - a, x + BLOCK)
                    part = slice(first[x], first[y])
                    h = bundles(row[part] - x, y - x, codes[part], letters, seed)
                    norm = np.linalg.norm(h, axis=1)
                    cosine = (h @ weights) / np.where(norm > 0, norm, 1)[:, None]
                    top = cosine.argmax(1)
                    best[x:y] = np.where(has[x:y], top, len(names))
                    score[x:y] = np.where(has[x:y], np.clip(cosine[np.arange(y - x), top], 0, 1), 0)
                columns = [c for i, c in enumerate(batch.slice(a, b - a).columns) if own or i != at]
                yield pa.RecordBatch.from_arrays([*columns, answers.take(pa.array(best)), pa.array(score)], names=made)

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def split_of(doc_id: Column, folds: int) -> Column:
    """True where crc32 of doc_id as text is divisible by folds; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of (doc_id, text, lang); learned from the rows that are not held out.

    A null doc_id is not held out. Repeated rows are rows each; an empty table gives no rows; extra columns are ignored.
    """
    held = split_of(F.col("doc_id"), folds)
    prototypes = fit_prototypes(docs.filter(~held))
    return predict_language(docs.select("doc_id", held.alias("held_out"), "text"), prototypes, keep=["doc_id", "held_out"])
