"""The merge automaton against plain merging of all short words, and its encoder against the tokenizers library."""

import hashlib
import itertools
import random

import pyarrow as pa
import pytest
from test_operators import ODD, docs, empty

from foldspark.llm.bpe_automaton import AutomatonEncoder, MergeAutomaton, bpe_decode, bpe_digest, bpe_encode
from foldspark.llm.queries import tokenizer_path


def plain(word, merges):
    """The lowest-ranked pair first, its leftmost place first."""
    rank = {(a, b): (r, m) for r, (a, b, m) in enumerate(merges)}
    ids = list(word)
    while pairs := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
        (_, made), i = min(pairs)
        ids[i : i + 2] = [made]
    return ids


@pytest.mark.parametrize("seed", range(30))
def test_automaton_accepts_encodings_alone(seed):
    rnd = random.Random(seed)
    spelled, merges = {0: b"\0", 1: b"\1", 2: b"\2"}, []
    while len(merges) < 14:
        a, b = rnd.choices(list(spelled), k=2)
        if spelled[a] + spelled[b] not in spelled.values():
            merges.append((a, b, len(spelled)))
            spelled[len(spelled)] = spelled[a] + spelled[b]
    made = MergeAutomaton(spelled, set(), merges, False)
    assert made.states <= len(merges) + 1
    words = [bytes(w) for n in range(8) for w in itertools.product(range(3), repeat=n)]
    assert made.encode(words) == [plain(w, merges) for w in words]
    long = bytes(rnd.choices(range(3), k=200))
    assert made.encode([long]) == [plain(long, merges)]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="parts"):
        MergeAutomaton({0: b"a", 1: b"aa", 2: b"aaa"}, set(), [(1, 0, 2), (0, 0, 1)], False)
    with pytest.raises(ValueError, match="no token"):
        MergeAutomaton({0: b"a"}, set(), [], False).encode([b"ab"])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    e = AutomatonEncoder(tokenizer_path(name), limit=50)
    library, rnd = e.tokenizer, random.Random(name)
    signs = "aeinrstlhdoué́ßΣİ's日本한 \n\t.,!?-0123<|>‍\xa0"
    texts = ODD + ["a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ", "the" * 100]
    texts += ["".join(rnd.choices(signs, k=rnd.randint(1, 60))) for _ in range(1500)]
    ids, sizes = e.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w]
    assert sizes.tolist() == [len(w) for w in want]
    lists = pa.array([*want, None, [], [10**6, 5, -1]], pa.list_(pa.int32()))
    assert e.decode(lists).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want] + [None, "", library.decode([5], skip_special_tokens=False)]


def test_digest_of_documents(spark):
    path = tokenizer_path("word_bpe_49k.json")
    library = AutomatonEncoder(path).tokenizer
    texts = ODD + ["same text"] * 3 + ["hello world " * 4000]
    df = docs(spark, texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in [*enumerate(texts), (None, "null id here")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe_digest(df, path).collect()), key=repr) == sorted(want, key=repr)
    assert bpe_digest(empty(spark), path).collect() == []
    # Other columns stay beside the decoded text, whatever their names.
    rows = bpe_encode(df, path).selectExpr("doc_id as `text.id`", "ids", "'x' as decoded")
    assert bpe_decode(rows, path).columns == ["text.id", "decoded"]
    assert {r[0]: r[1] for r in bpe_decode(rows, path).collect()}[4] == "a</w>"
