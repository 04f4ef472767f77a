"""BPE by a deterministic automaton made from the merge list.

The automaton's arcs are tokens, and it accepts a sequence of tokens exactly if it is the encoding of the text that it
spells. It starts as one state with a loop for each base symbol. The merges follow in their order, each as a
gadget: for (a, b) -> ab the state behind a loses its arc b, and every state with an arc a gets an arc ab to where b
led. A state that other tokens lead to as well is copied first, so all arcs of a token end in one state and there are
at most as many states as merges and one.

A prefix of an encoding is the encoding of its own text, so just one arc of a right path ends at each place of a word:
words are encoded by walking forward through the tables, a trie of the tokens' bytes and a bit for each (token, state), and
the path is read backwards. Texts are normalised and split into words by the rules of the tokenizer file before that.
Decoding puts out the labels of the arcs.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._bpe import _WORD, PartEncoder, _byte_letters

#: Words up to this many bytes are walked together, longer ones one by one.
SHORT = 48
#: Words walked at a time, and ids spelled at a time.
TOGETHER = 1 << 15
TOKENS = 1 << 20
_encoders: dict[str, "AutomatonEncoder"] = {}


class MergeAutomaton:
    """Tables of the automaton of ``merges``, (left, right, merged) token ids in order of rank, over ``spelled``, the bytes of each id.

    ``ends`` are the ids that only the end of a word can be. A merge must come after the merges that make its parts.
    """

    def __init__(self, spelled: dict[int, bytes], ends: set[int], merges: list[tuple[int, int, int]], whole_words: bool):
        made = {m for _, _, m in merges}
        self.tokens = np.array([*sorted(set(spelled) - made), *(m for _, _, m in merges)], np.int64)  # in the order in which they are made
        row = {token: i for i, token in enumerate(self.tokens.tolist())}
        base = len(row) - len(merges)
        steps = [(row.get(a, len(row)), row.get(b, len(row)), row.get(m)) for a, b, m in merges]
        if len(row) < len(self.tokens) or any(m != base + i or max(a, b) >= m for i, (a, b, m) in enumerate(steps)):
            raise ValueError("a merge has to follow the merges of its parts, and no two may make one token")
        target, leading = [0] * len(row), [base]
        self.arcs = arcs = np.zeros((len(row), 64), np.uint8)
        arcs[:base, 0] = 1
        for a, b, ab in steps:
            behind, after = target[a], target[b]
            if not arcs[b, behind >> 3] >> (behind & 7) & 1:
                continue  # b never follows a: an earlier merge takes one of them
            if behind == 0 or leading[behind] > 1 or a == b:  # others lead here: a state of its own, with the same arcs
                leading[behind] -= 1
                new = len(leading)
                if new >> 3 == arcs.shape[1]:
                    self.arcs = arcs = np.pad(arcs, ((0, 0), (0, 256)))
                arcs[:ab, new >> 3] |= (arcs[:ab, behind >> 3] >> (behind & 7) & 1) << (new & 7)
                leading.append(1)
                behind = target[a] = new
            arcs[b, behind >> 3] &= 255 - (1 << (behind & 7))
            arcs[ab] = arcs[a]
            target[ab] = after
            leading[after] += 1
        self.states, self.target = len(leading), np.array(target, np.int32)
        self._trie(spelled, ends, whole_words, row)

    def _trie(self, spelled: dict[int, bytes], ends: set[int], whole_words: bool, row: dict[int, int]) -> None:
        children: list[dict[int, int]] = [{}]
        inside, closing = [-1], [-1]
        for token, letters in spelled.items():
            node = 0
            for x in letters:
                if x not in children[node]:
                    children[node][x] = len(children)
                    children.append({})
                    inside.append(-1)
                    closing.append(-1)
                node = children[node][x]
            for ids, right in ((inside, token not in ends), (closing, token in ends or not whole_words)):
                if right:
                    ids[node] = row[token]
        # Nodes with children come first; only they have a row of the table.
        number = np.empty(len(children), np.int32)
        has = np.array([bool(c) for c in children])
        number[has] = np.arange(has.sum())
        number[~has] = np.arange(has.sum(), len(children))
        self.inner = max(1, int(has.sum()))
        self.go = np.full((self.inner, 256), -1, np.int32)
        for i, c in enumerate(children):
            for x, child in c.items():
                self.go[number[i], x] = number[child]
        self.inside, self.closing = np.full(len(children), -1, np.int32), np.full(len(children), -1, np.int32)
        self.inside[number], self.closing[number] = inside, closing
        self.length = np.array([len(spelled[t]) for t in self.tokens.tolist()], np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; a word without a path (a byte is no token) is an error."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[np.searchsorted(sizes[order], 1) :]
        short = int(np.searchsorted(sizes[order], SHORT, "right"))
        for a in range(0, short, TOGETHER):
            some = order[a : min(short, a + TOGETHER)]
            for i, ids in zip(some.tolist(), self._together([words[i] for i in some.tolist()], sizes[some])):
                out[i] = ids
        for i in order[short:].tolist():
            out[i] = self._alone(words[i])
        return [x or [] for x in out]

    def _together(self, words: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        """Words in ascending length: one step of the walk for all words at once."""
        count, longest = len(words), int(sizes[-1])
        letters = np.zeros((longest, count), np.uint8)
        letters.T[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        state, taken = np.full((longest + 1, count), -1, np.int32), np.full((longest + 1, count), -1, np.int32)
        state[0] = 0
        for i in range(longest):
            rows = np.arange(np.searchsorted(sizes, i, "right"), count)
            rows = rows[state[i, rows] >= 0]
            here, node, j = state[i, rows], np.zeros(len(rows), np.int32), i
            while len(rows):
                node = self.go[node, letters[j, rows]]
                known = node >= 0
                rows, here, node = rows[known], here[known], node[known]
                j += 1
                last = sizes[rows] == j
                token = np.where(last, self.closing[node], self.inside[node])
                fits = (token >= 0) & ((self.arcs[token, here >> 3] >> (here & 7).astype(np.uint8) & 1) == 1)
                to, arc = rows[fits], token[fits]
                state[j, to], taken[j, to] = self.target[arc], arc
                on = ~last & (node < self.inner)
                rows, here, node = rows[on], here[on], node[on]
        place, rows = sizes.copy(), np.arange(count)
        steps = []
        while len(rows):
            arc = taken[place[rows], rows]
            if (arc < 0).any():
                raise ValueError("a word has letters that are no token")
            steps.append((rows, arc))
            place[rows] -= self.length[arc]
            rows = rows[place[rows] > 0]
        many = np.zeros(count, np.int64)
        for rows, _ in steps:
            many[rows] += 1
        ends = np.cumsum(many)
        ids = np.zeros(int(ends[-1]), np.int64)
        for k, (rows, arc) in enumerate(steps):
            ids[ends[rows] - 1 - k] = arc
        flat = self.tokens[ids].tolist()
        return [flat[b - m : b] for b, m in zip(ends.tolist(), many.tolist())]

    def _alone(self, word: bytes) -> list[int]:
        n = len(word)
        state, taken = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = 0
        for i in range(n):
            here, node = state[i], 0
            if here < 0:
                continue
            for j in range(i, n):
                node = self.go.item(node, word[j])
                if node < 0:
                    break
                token = (self.closing if j + 1 == n else self.inside).item(node)
                if token >= 0 and self.arcs.item(token, here >> 3) >> (here & 7) & 1:
                    state[j + 1], taken[j + 1] = self.target.item(token), token
                if node >= self.inner:
                    break
        out, place = [], n
        while place:
            if taken[place] < 0:
                raise ValueError("a word has letters that are no token")
            out.append(self.tokens.item(taken[place]))
            place -= self.length.item(taken[place])
        return out[::-1]


class AutomatonEncoder(PartEncoder):
    """``encode(texts)`` as of ``PartEncoder``, each distinct word by the automaton; ``decode(ids)`` as its inverse.

    For files of a BPE model over byte letters; others are refused. Strings of added tokens in a text are those tokens.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__(path, limit)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec.get("pre_tokenizer") or {}
        last = (steps.get("pretokenizers") or [steps])[-1]
        decoder = (spec.get("decoder") or {}).get("type")
        if model.get("type") != "BPE" or last.get("type") != "ByteLevel" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or decoder not in (None, "ByteLevel"):
            raise ValueError("the automaton is for BPE over byte letters")
        self.spaced = decoder is None
        if self.kind != "word":  # texts are split by the library's rules, whole
            self.kind, self.lead = "whole", ""
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self.raw = {ord(c): b for b, c in _byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []):
            raise ValueError("added tokens have to stand for their own letters")
        self.added = sorted(added.items(), key=lambda t: -len(t[0]))
        spelled, ends = {}, set()
        for token, i in vocab.items():
            if token not in added:
                plain = token.removesuffix(suffix) if suffix else token
                spelled[i] = self._bytes(plain)
                if plain != token:
                    ends.add(i)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = MergeAutomaton(spelled, ends, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], bool(suffix))
        labels: list = [None] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            labels[i] = token if self.spaced else token.encode() if token in added else self._bytes(token)
        self.labels = pa.array(labels, pa.string() if self.spaced else pa.binary())

    def _bytes(self, letters: str) -> bytes:
        return letters.translate(self.raw).encode("latin-1")

    def split(self, text: str) -> list:
        """The words of a text as bytes, and ids of added tokens between them."""
        if self.kind == "word" and (plain := _WORD.fullmatch(text)):
            stem, tail = plain.groups()
            return [stem.lower().encode(), tail.encode()] if tail else [stem.lower().encode()]
        first = min(((p, -len(s), i) for s, i in self.added if (p := text.find(s)) >= 0), default=None)
        if first:
            place, size, token = first
            return [*self.split(text[:place]), token, *self.split(text[place - size :])]
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [self._bytes(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        words = list({w: None for words in split for w in words if isinstance(w, bytes)})
        known = dict(zip(words, self.automaton.encode(words)))
        return [known[words[0]] if len(words) == 1 and isinstance(words[0], bytes) else [i for w in words for i in ([w] if isinstance(w, int) else known[w])] for words in split]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._ids([text])[0], np.uint32)

    def _learn(self, parts: list[str], store: dict[str, int], lead: str) -> np.ndarray:
        first = self._add(self._ids(parts))
        store.update(zip(parts, range(first, first + len(parts))))
        if "" in store:
            store[""] = 0
        return np.fromiter(map(store.get, parts), np.int64, len(parts))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, null for null; ids that are no token are left out."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        out, a = [], 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
            out.append(self._spell(ids.slice(a, b - a), sizes[a:b]))
            a = b
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def _spell(self, ids: pa.ListArray, sizes: np.ndarray) -> pa.Array:
        place = pc.fill_null(ids.flatten(), -1).to_numpy().astype(np.int64)
        known = (place >= 0) & (place < len(self.labels))
        labels = self.labels.take(pa.array(place, mask=~known))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        if labels.null_count:
            there = labels.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(there)])[offsets]
            labels = labels.drop_null()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), labels), " " if self.spaced else b"")
        if not self.spaced:
            joined = pa.array([t.decode("utf-8", "replace") for t in joined.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string()))


def encoder(path: str) -> AutomatonEncoder:
    """The worker's tables for a file, compiled once."""
    if path not in _encoders:
        _encoders[path] = AutomatonEncoder(path)
    return _encoders[path]


def bpe_encode(docs: DataFrame, tokenizer_path: str, spell: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every document's whole text; with ``spell`` also ``decoded``, the text that the ids spell.

    A null or empty text has no ids; null and repeated doc_ids are documents each; an empty table gives no rows; other
    columns are ignored.
    """

    def encode(batches):
        for batch in batches:
            tables = encoder(tokenizer_path)
            for a, b, ids, each in tables.slices(batch.column(1)):
                offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                columns = {"doc_id": batch.column(0).slice(a, b - a), "ids": lists} | ({"decoded": tables.decode(lists)} if spell else {})
                yield pa.RecordBatch.from_pydict(columns)

    kinds = "doc_id long, ids array<int>" + (", decoded string" if spell else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, kinds)


def bpe_decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the column ``ids`` (arrays of ints) replaced by the text it spells, in a column ``text``.

    No ids are an empty text, a null array is null; ids that are no token are left out, as the library does. All other
    columns are kept.
    """
    others = [c for c in rows.columns if c not in (ids, text)]
    plain = [*(f"c{i}" for i in range(len(others))), "ids"]  # names that need no quotes
    kinds = [StructField(c, f.dataType) for c, f in zip(plain, (f for f in rows.schema.fields if f.name in others))]

    def decode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], encoder(tokenizer_path).decode(batch.column(len(others)))], plain)

    return rows.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{ids}`").cast("array<int>")).toDF(*plain).mapInArrow(decode, StructType([*kinds, StructField("ids", StringType())])).toDF(*others, text)


def bpe_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of each document; see ``bpe_encode``."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    rows = bpe_encode(docs, tokenizer_path, spell=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
