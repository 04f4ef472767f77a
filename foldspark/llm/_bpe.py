"""Exact token ids from a public tokenizer file, with one library call for each distinct piece of text.

Both kinds of file split a text before the vocabulary is applied, and that split never joins characters across
some places: for byte-level files before a single space (or at a single line feed) between two characters that are
no white space, for files that drop white space at any space or line feed. The texts of a slice are cut there and turned to
a dictionary of distinct parts by Arrow; each part not yet known is encoded once by the tokenizers library, and the
ids of all texts are gathered from the parts' ids in one step. A text with any other white space arrangement is
encoded whole, and a file of an unknown kind always is.
"""

from __future__ import annotations

import codecs
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that are one code point in any normal form and case, then punctuation that no rule joins to a letter: both kinds
#: of file split between the two. (Tested for each letter against the library.)
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of a text to be encoded at a time; a longer document is taken alone.
SLICE = 4 << 20
_encoders: dict[str, "PartEncoder"] = {}


def encoder(path: str) -> "PartEncoder":
    """The worker's encoder for a file; its parts stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec.get("post_processor") and spec["post_processor"]["type"] != "ByteLevel":
        return "whole"
    if pre.get("type") == "ByteLevel" and not norm and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = pre.get("pretokenizers") or [{}]
    if [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed":
        return "word"
    return "whole"


def pieces(batch, limit: int = SLICE):
    """(first column's values, texts of the second column) of consecutive rows with about limit characters."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield ids[a : i + 1], texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(ids):
        yield ids[a:], texts[a:]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(other)}


class PartEncoder:
    """``encode(texts)``: token ids of an Arrow column of texts, as one array, and the number of each text's.

    ``limit`` bounds the known parts (about 200 bytes each); beyond it they are forgotten and learned anew.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.limit = Tokenizer.from_file(path), _kind(path), limit
        self.tokenize, letters = self.tokenizer.model.tokenize, _byte_letters() | {10: "\n"}  # line feeds part words
        self.letters = "".join(letters.get(b, chr(b)) for b in range(256))
        self.lead = " " if self.kind == "byte" else ""
        self._clear()

    def _clear(self) -> None:
        """No parts are known but number 0, which has no ids. A number below 0: a part that can't stand alone."""
        self.known: dict[str, int] = {}
        self.opening: dict[str, int] = {} if self.lead else self.known  # parts at the start of a text
        self.tails: dict[str, list[int]] = {}
        self.pool, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.parts, self.ids = 1, 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _tail(self, tail: str) -> list[int]:
        if tail not in self.tails:
            if len(self.tails) > 100_000:
                self.tails.clear()
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]

    def _stems(self, words: list[str], lead: str) -> list[list[int]]:
        """Ids of words of plain letters, straight from the vocabulary: no rule splits them. They are rewritten together."""
        text = "\n".join(words)
        if self.kind == "word":
            text = text.lower()
        if not text.isascii():
            text = codecs.charmap_decode(text.encode(), "strict", self.letters)[0]
        front = "Ġ" if lead else ""
        return [[t.id for t in self.tokenize(front + w)] for w in text.split("\n")] if words else []

    def _add(self, found: list[list[int]]) -> int:
        """Appends parts' ids to the pool; the number of the first."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = self.parts, int(sizes.sum())
        while self.parts + len(found) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.ids + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.ids : self.ids + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.starts[first : first + len(found)], self.sizes[first : first + len(found)] = self.ids + np.cumsum(sizes) - sizes, sizes
        self.parts, self.ids = first + len(found), self.ids + total
        return first

    def _learn(self, parts: list[str], store: dict[str, int], lead: str) -> np.ndarray:
        """Puts unknown parts, all different, into the store, each as encoded behind lead; their numbers."""
        numbers = np.zeros(len(parts), np.int64)
        hard: list[int] = []
        plain, lines = [], []  # (place, letters, punctuation) of parts without and with a line feed in front, which only byte-level files have
        for i, (p, m) in enumerate(zip(parts, map(_WORD.fullmatch, parts))):
            if m:
                plain.append((i, *m.groups()))
            elif not p:
                store[p] = numbers[i] = -1 if self.lead else 0
            elif p[0] == "\n" and (m := _WORD.fullmatch(p, 1)):
                lines.append((i, *m.groups()))
            elif self.lead and (p[-1].isspace() or p[1:2].isspace() or (p[0] != "\n" and p[0].isspace())):
                store[p] = numbers[i] = -1
            else:
                hard.append(i)
        at, found = [i for i, _, _ in plain] + [i for i, _, _ in lines] + hard, []
        for rows, own, front in ((plain, lead, []), (lines, "", self._tail("\n") if lines else [])):
            here = dict.fromkeys(stem for _, stem, _ in rows)
            here = dict(zip(here, self._stems(list(here), own)))
            found += [[*front, *here[stem], *self._tail(tail)] if tail or front else here[stem] for _, stem, tail in rows]
        if hard:
            keys = [p if p[0] == "\n" else lead + p for p in map(parts.__getitem__, hard)]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]
        if found:
            first = self._add(found)
            numbers[at] = np.arange(first, first + len(at))
            store.update(zip(map(parts.__getitem__, at), range(first, first + len(at))))
        return numbers

    def _numbers(self, parts: list[str], store: dict[str, int], lead: str) -> np.ndarray:
        """Numbers of distinct parts."""
        out = list(map(store.get, parts))
        fresh = [i for i, k in enumerate(out) if k is None]
        if not fresh:
            return np.fromiter(out, np.int64, len(out))
        numbers = self._learn([parts[i] for i in fresh], store, lead)
        whole = np.fromiter((k or 0 for k in out), np.int64, len(out))
        whole[fresh] = numbers
        return whole

    def slices(self, column: pa.Array):
        """(first row, end row, ids, number of ids of each row) of slices of a text column of about ``SLICE`` bytes."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            yield a, b, *self.encode(column.slice(a, b - a))
            a = b

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and how many each has."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.kind == "whole":
            found = [self.whole(t) if t else np.zeros(0, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        if len(self.known) + len(self.opening) > self.limit:
            self._clear()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.lead else " "), " ")
        bounds = np.frombuffer(cut.buffers()[1], np.int32 if pa.types.is_list(cut.type) else np.int64)[cut.offset : cut.offset + len(cut) + 1].astype(np.int64)
        parts = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        place = parts.indices.to_numpy()
        number = np.zeros(len(place), np.int64)
        if len(place):
            rest = np.ones(len(place), bool)
            rest[bounds[:-1]] = not self.lead
            wanted = np.zeros(len(parts.dictionary), bool)
            wanted[place[rest]] = True
            wanted = np.flatnonzero(wanted)
            table = np.zeros(len(parts.dictionary), np.int64)
            table[wanted] = self._numbers(parts.dictionary.take(pa.array(wanted)).to_numpy(zero_copy_only=False).tolist(), self.known, self.lead)
            number = table[place]
            if self.lead:  # the first part of a text has no space in front
                opening, at = np.unique(place[bounds[:-1]], return_inverse=True)
                number[bounds[:-1]] = self._numbers(parts.dictionary.take(pa.array(opening)).to_numpy(zero_copy_only=False).tolist(), self.opening, "")[at]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        number[bounds[:-1][empty]] = 0
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(number < 0), "right") - 1)
        kept = self.parts, self.ids
        for i in odd.tolist():
            number[bounds[i] : bounds[i + 1]] = 0
            number[bounds[i]] = self._add([self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids])
        sizes = self.sizes[number]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[number] - ends[:-1], sizes) + np.arange(ends[-1])]
        self.parts, self.ids = kept  # whole texts are not kept
        return ids, np.diff(ends[bounds])
