"""Operators against brute force, exact round trips and awkward inputs, on tiny tables."""

import cProfile
import math
import pstats
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from foldspark.llm import chat_rotation, class_lm, exact_dedup, exact_topk, language_id, mixing, near_dedup, packing, token_binary, token_counts
from foldspark.llm._bpe import PartEncoder
from foldspark.llm._text import hash_words, slices
from foldspark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

ODD = [None, "", " ", "\n", "a", "A b", "a\n\nb ", " x  y", "don't stop, it's. we'll", "é\xa0z ÉB!", "x\x1cy \x85z", "<|endoftext|> a", "日本 語", "z" * 5000, "word " * 3000, "\tq\r\n"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), 0) for i, t in enumerate(texts)]
    rows.append((None, "null id here", None, None, None, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    return df if extra else df.drop("score")


def empty(spark):
    return docs(spark, []).filter("false")


def test_words():
    column = pa.array(ODD)
    for a, b, data, offsets in slices(column, 64):
        h, n = hash_words(data, offsets)
        words = [WORD.findall(lower(t)) for t in ODD[a:b]]
        assert n.tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    e = PartEncoder(tokenizer_path(name))

    def same(texts):
        ids, sizes = e.encode(pa.array(texts, pa.string()))
        found = np.split(ids, np.cumsum(sizes)[:-1])
        for t, got in zip(texts, found):
            assert got.tolist() == (e.whole(t).tolist() if t else []), repr(t)

    for _ in range(2):  # the second time from what is known
        same(ODD)
    same(ODD[5:])
    # Every letter, alone in a word and before punctuation; every other code point that there is, within words.
    points = [c for c in map(chr, range(1, 0x3000)) if c.isalpha()]
    same([f"a{c}. {c}! b{c}" for c in points])
    same([f"x {chr(c)} y{chr(c)}, z{chr(c)}w {chr(c)}\n{chr(c)}" for c in [*range(1, 0x3000, 3), *range(0x3000, 0x11000, 97)] if not 0xD800 <= c < 0xE000])
    rng = np.random.default_rng(11)
    alphabet = list("abcXYZ .,!?'\"\n\t$-09") + ["é", "ß", "İ", "ſ", "ı", "\u0301", "\u0338", "日", "\xa0", "\x1c", " ", "'s", "<|endoftext|>", "Ǆ", "ﬁ"]
    same(["".join(rng.choice(alphabet, int(rng.integers(0, 30)))) for _ in range(3000)])
    e.limit = 10
    same(ODD)
    same(ODD)


def test_simple8b():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [0] * 200, [1 << 63, 5, (1 << 60) - 1, 1 << 60, 0, 7], rng.integers(0, 50_000, 3000), rng.integers(0, 3, 500)):
        a = np.array(ids, np.uint64)
        assert (token_binary.decode_words(token_binary.encode_words(a), len(a)) == a).all()


def test_token_binary(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    e, start = PartEncoder(path), 0
    rows = sorted(token_binary.token_binary(docs(spark, ODD), path, 0).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *range(len(ODD))]
    for r, t in zip(rows, ["null id here", *ODD]):
        data = (e.whole(t).tobytes() if t else b"") + bytes(4)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    assert token_binary.token_binary(empty(spark), path, 0).count() == 0
    # Repeated ids, repeated rows and null ids, over several shards; a document longer than a block.
    long = " ".join(f"w{i}" for i in range(40_000))
    many = [(1, "b"), (1, "a"), (1, "a"), (None, "x"), (None, None), (2, long), (0, "z")] * 3
    table = spark.createDataFrame(many, "doc_id long, text string")
    rows = sorted(token_binary.token_binary(table, path, 0).collect(), key=lambda r: r["start"])
    crc = lambda t: zlib.crc32((e.whole(t).tobytes() if t else b"") + bytes(4))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == Counter((i, crc(t)) for i, t in many)
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert max(r["n_tokens"] for r in rows) > token_binary.BLOCK_IDS


def check_packed(rows, ids, limit=4096):
    places = {}
    for k, whole in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(whole[4 * at : 4 * (at + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] * 4 == len(whole)
            at += r["length"]
        assert at * 4 == len(whole)
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= limit and (at == limit or at & (at - 1) == 0)


def test_packing(spark):
    path = tokenizer_path("word_bpe_49k.json")
    e = PartEncoder(path)
    end = np.array([2], "<u4").tobytes()
    whole = {i: (e.whole(t).tobytes() if t else b"") + end for i, t in enumerate(ODD)} | {None: e.whole("null id here").tobytes() + end}
    check_packed(packing.pack_digest(docs(spark, ODD), path, 2).collect(), whole)
    assert packing.pack_digest(empty(spark), path, 2).count() == 0
    assert packing.pack_digest(docs(spark, ODD).union(docs(spark, ODD)), path, 2).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> 2 * `max(doc_tokens)`").count() == 0
    # Limits on segments and on loss-bearing tokens that bind: an end id bears no loss, nor does any token of even ids.
    limits = packing.Limits(4096, 4, 1500)
    loss = docs(spark, ODD).coalesce(1).withColumn("bearing", F.when(F.col("doc_id") % 2 == 0, 0))
    rows = packing.pack_digest(loss, path, 2, limits, "bearing").collect()
    check_packed(rows, whole)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    bearing = [sum(r["length"] for r in g if r["doc_id"] is None or r["doc_id"] % 2) for g in sequences.values()]
    assert max(bearing) <= 1500 and max(map(len, sequences.values())) == 4
    assert max(sum(r["length"] for r in g) for g in sequences.values()) > 1500
    made = packing.pack_sequences(loss, path, 2, limits, "bearing").collect()
    assert {(r["sequence_id"], r["offset"], r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4"))) for r in made} == {(r["sequence_id"], r["offset"], r["doc_id"], r["ids_crc32"]) for r in rows}


def test_packer_limits():
    rng = np.random.default_rng(1)
    packer, limits = packing.Packer(packing.Limits(100, 4, 60, 16)), packing.Limits(100, 4, 60, 16)
    placed, loss = [], {}
    for k in range(300):
        n = int(rng.integers(1, 180))
        loss[k] = (n, int(rng.integers(0, n + 1)))
        packer.limits = limits
        placed += packer.add(k, np.arange(n, dtype="<u4"), loss[k][1])
    placed += packer.finish()
    seen, bins = Counter(), {}
    for name, start, ids, total, sequence, offset in placed:
        assert ids.tolist() == list(range(start, start + len(ids)))
        seen[name] += len(ids)
        bins.setdefault(sequence, []).append((len(ids), max(0, min(len(ids), start + len(ids) - (loss[name][0] - loss[name][1])))))
    assert all(seen[k] == n for k, (n, _) in loss.items())
    for b in bins.values():
        assert sum(n for n, _ in b) <= 100 and len(b) <= 4 and sum(x for _, x in b) <= 60


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    texts = [*ODD, "Same", "same", "SAME", "sÀme", "same", "same", "same", "same", *["again"] * 20]
    groups = {}
    for i, t in [*enumerate(texts), (None, "null id here")]:
        groups.setdefault(lower(t), []).append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        rows = exact_dedup.mark_duplicates(docs(spark, texts), keep).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            g = groups[lower(texts[r["doc_id"]] if r["doc_id"] is not None else "null id here")]
            assert r["group_size"] == len(g) and r["keep_id"] == (best(g) if g != [None] else None) and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.drop_duplicates(docs(spark, texts)).columns == docs(spark, []).columns
    marked = sorted(map(tuple, exact_dedup.mark_duplicates(docs(spark, texts)).collect()), key=repr)
    monkeypatch.setattr(exact_dedup, "BROADCAST_TEXTS", 0)  # hot texts by subgroup, without a broadcast
    assert sorted(map(tuple, exact_dedup.mark_duplicates(docs(spark, texts)).collect()), key=repr) == marked
    twice = docs(spark, ["x"]).union(docs(spark, ["x"]))
    assert sorted(r["kept"] for r in exact_dedup.mark_duplicates(twice).collect()) == [False, False, True, True]
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0


def brute_components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    of = {i: i for i in sets}
    names = sorted(sets)
    for x in names:
        for y in names:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and of[x] != of[y]:
                a, b = sorted((of[x], of[y]))
                of = {k: a if v == b else v for k, v in of.items()}
    return sets, of


@pytest.mark.parametrize("block", [4, 256])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    texts = list(ODD) + ["one two three", "One two  three", "one two"]
    base = [f"w{k}" for k in rng.integers(0, 500, 60)]
    for step in range(40):  # a chain: each differs a little from an earlier one, so hubs alone can't join them
        words = list(base if step % 7 else [f"v{k}" for k in rng.integers(0, 500, 60)])
        words[int(rng.integers(0, 60))] = f"n{step}"
        base = words
        texts.append(" ".join(words))
    texts += texts[-3:]
    texts += [" ".join(base + [f"more{k}" for k in range(n)]) for n in range(0, 60, 2)]  # sets of growing size
    sets, of = brute_components(dict(enumerate(texts)), 85)
    rows = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), of[r["doc_id"]], of[r["doc_id"]] == r["doc_id"])
    if block == 4:
        assert near_dedup.near_duplicates(empty(spark)).count() == 0
        # Rows that share a doc_id are linked by their own texts; equal rows are rows each.
        a, b = texts[-1], "quite another text of seven words here"
        made = near_dedup.near_duplicates(spark.createDataFrame([(5, a), (5, b), (3, a + " end"), (7, b), (7, b), (9, None), (None, a)], "doc_id long, text string"))
        assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in made.collect()) == Counter([(5, 3, False), (3, 3, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True), (None, None, True)])


def test_pairs_at_the_limit_share_a_bucket():
    """Of many set pairs at the least linked similarity none is without a shared bucket."""
    rng, missed = np.random.default_rng(12), 0
    for _ in range(40):
        sets = []
        for _ in range(50):
            both, x, y = np.split(rng.integers(0, 1 << 63, 200, np.uint64), [170, 185])
            sets += [np.sort(np.concatenate([both, x])), np.sort(np.concatenate([both, y]))]
        keys = near_dedup.band_keys(near_dedup.signatures(sets, 26 * 5), 26, 5)
        missed += int((~(keys[::2] == keys[1::2]).any(1)).sum())
    assert missed == 0


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50, n).astype(np.uint64)) for n in (1, 5, 30, 60, 60)]
    assert near_dedup.intersections(sets, sets[1:], 16).tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]


def test_mixing(spark):
    rng = np.random.default_rng(4)
    texts = ["w " * int(n) for n in rng.lognormal(3, 1, 400)] + [None, ""]
    rows = mixing.balanced_mix(docs(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.balanced_mix(docs(spark, texts).repartition(7)).collect()))
    by = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for g in by.values():
        assert g[0]["target"] <= 2 * g[0]["source_size"] and abs(sum(r["taken"] for r in g) - g[0]["target"]) <= 2
    assert mixing.balanced_mix(empty(spark)).count() == 0
    assert mixing.balanced_mix(empty(spark)).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    # Targets worked out anew: weights 5, 2, 1 in turn over sources in order, null last, none above twice its size.
    size = {}
    for i, t in enumerate([*texts]):
        s = f"s{i % 3}" if i % 5 else None
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    size[None] += 3
    order, left, target = [*sorted(s for s in size if s), None], 1.5 * sum(size.values()), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while any(s not in target and left * weight[s] / sum(weight[x] for x in order if x not in target) > 2 * size[s] for s in order):
        whole = sum(weight[x] for x in order if x not in target)
        for s in [s for s in order if s not in target and left * weight[s] / whole > 2 * size[s]]:
            target[s] = 2.0 * size[s]
        left = 1.5 * sum(size.values()) - sum(target.values())
    rest = sum(weight[x] for x in order if x not in target)
    assert {s: g[0]["target"] for s, g in by.items()} == pytest.approx({s: target.get(s, left * weight[s] / rest if rest else 0) for s in order})
    # Repeated rows: written copies are the copies decided.
    again = docs(spark, texts[:60]).union(docs(spark, texts[:60])).union(docs(spark, texts[:10]))
    decided = mixing.balanced_mix(again).groupBy("doc_id").agg(F.sum("copies")).filter("`sum(copies)` > 0").collect()
    assert {tuple(r) for r in mixing.mixed_rows(again).groupBy("doc_id").count().collect()} == {tuple(r) for r in decided}
    p = mixing.flight(np.sort(rng.integers(1, 99, 200))[::-1], np.full(200, 0.3), np.random.default_rng(0))
    assert ((p > 0) & (p < 1)).sum() <= 2 and p.sum() == pytest.approx(60)


def test_targets_of_many_sources(spark):
    """Targets by rounds of sums are those of dealing the excess again, over hundreds of sources of very different sizes."""
    rng = np.random.default_rng(16)
    sizes = {f"s{i:03}": int(n) for i, n in enumerate(np.exp(rng.normal(3, 2, 300)))} | {"é": 50, "Z": 40, "": 30, None: 20}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.balanced_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight, rest, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while weight:
        unit = rest / sum(weight.values())
        over = [s for s in weight if unit * weight[s] > 2 * sizes[s]]
        want |= {s: 2.0 * sizes[s] for s in over} if over else {s: unit * w for s, w in weight.items()}
        rest -= sum(2.0 * sizes[s] for s in over)
        weight = {s: w for s, w in weight.items() if s not in over} if over else {}
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want)
    assert 0 < sum(want[s] == 2 * sizes[s] for s in sizes) < len(sizes)


def test_language(spark):
    rows = QUERIES["op2_language_id"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    made = language_id.language_id(docs(spark, ODD)).collect()
    for r in made:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else "null id here"
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
    assert language_id.language_id(empty(spark)).count() == 0


def test_hypervectors_match_counts():
    """A document's vector is the sum of its trigrams' bound vectors, each letter of any script having its own."""
    texts = ["Ab, c", "é日本 Ж", None, "1"]
    [(a, b, letters, codes, row, has)] = language_id.trigram_codes(pa.array(texts))
    made = language_id.bundles(row, 4, codes, letters, 0)
    vector = lambda ch: language_id.letter_vectors(np.array([ord(ch) if ch else 0]), 0)[0].astype(int)
    for i, symbols in enumerate([["", "a", "b", "", "c", ""], ["", "é", "日", "本", "", "ж", ""], [], []]):
        v = [vector(ch) for ch in symbols]
        expected = sum((np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in zip(v, v[1:], v[2:])), np.zeros(language_id.DIMENSIONS))
        assert (made[i] == expected).all()
    assert has.tolist() == [True, True, False, False]
    assert abs(vector("ü") @ vector("š")) < 300


def test_language_brute_force(spark, monkeypatch):
    """Predictions are those of cosines worked out letter by letter."""
    texts = ["the cat sat on the mat", "der Hund läuft im Wald", "le chat est là", "der Wald", "the mat", "le là", "", None, "123", "žluťoučký kůň"] * 3
    rows = [(i, t, ["en", "de", "fr"][i % 10] if i % 10 < 3 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vector = lambda cp: language_id.letter_vectors(np.array([cp]), 0)[0].astype(float)

    def bundle(t):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        v = [vector(0), *(vector(ord(c)) if c != " " else vector(0) for c in " ".join(words)), vector(0)] if words else []
        return sum((np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in zip(v, v[1:], v[2:])), np.zeros(language_id.DIMENSIONS))

    prototypes = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            prototypes[lang] = prototypes.get(lang, 0) + bundle(t)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        cosine = {k: unit(bundle(t)) @ unit(p) for k, p in prototypes.items()}
        best = min(cosine, key=lambda k: (-cosine[k], k)) if bundle(t).any() else "und"
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(max(0, cosine.get(best, 0)), abs=1e-5)
    twice = language_id.language_id(df.union(df))
    assert twice.count() == 2 * len(rows)
    # Languages in blocks, one pass for each, are what all at once are.
    for languages in (1, 2):
        monkeypatch.setattr(language_id, "LANGUAGES", languages)
        blocks = language_id.fit_prototypes(df)
        assert [list(b) for b in blocks] == [["de"], ["en"], ["fr"]] if languages == 1 else [["de", "en"], ["fr"]]
        again = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
        assert again.keys() == got.keys()
        for i, r in again.items():
            assert r["lang_pred"] == got[i]["lang_pred"] and r["held_out"] == got[i]["held_out"] and r["score"] == pytest.approx(got[i]["score"], abs=1e-6)


def test_language_memory_is_bounded():
    """A text of very many different letters takes no more memory than a block of vectors."""
    import tracemalloc

    rng = np.random.default_rng(10)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 350_000).tolist()))
    list(language_id.trigram_codes(pa.array(["warm up"])))
    tracemalloc.start()
    for a, b, letters, codes, row, _ in language_id.trigram_codes(pa.array([text])):
        keep = codes < np.partition(codes, 20_000)[20_000]  # vectors of a share of them: all take long, and no more memory
        language_id.bundles(row[keep], b - a, codes[keep], letters, 0)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_class_lm(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c"] if i % 2 else ["x", "y", "z"], 30)) + f" rare{i}" for i in range(60)] + ODD
    df = docs(spark, texts)
    df = df.withColumn("held_out", language_id.split_of(df["doc_id"], 10))
    rows = class_lm.class_scores(df.select("doc_id", "held_out", "text"), classes=4, seeds=6).collect()
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in enumerate(texts)} | {None: ["null", "id", "here", None]}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    test = [r for r in rows if r["held_out"] and r["doc_id"] < 60]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert class_lm.class_scores(df.filter("false").select("doc_id", "held_out", "text")).count() == 0


def test_class_scores_from_the_lexicon(spark, monkeypatch):
    """Scores worked out word by word from the classes that the exchange gave: transitions, emissions, unseen words."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["the", "a", "dog", "cat", "runs", "sits", "Red", "blue", f"once{i}"], rng.integers(0, 25))) for i in range(40)] + [None, "", "never seen words", "the the the"]
    rows = [(i, i % 4 == 1 or i >= 41, t) for i, t in enumerate(texts)]
    seen, sweeps = [], class_lm._sweeps

    def kept(*args):
        out = sweeps(*args)
        seen.extend(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(class_lm, "_sweeps", kept)
    classes, alpha = 5, 0.1
    got = {r["doc_id"]: r for r in class_lm.class_scores(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), classes, 8, alpha).collect()}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, _, t in rows}
    distinct = sorted({w for ts in tokens.values() for w in ts if w})
    column = pa.array(distinct)
    [(_, _, data, offsets)] = list(slices(column))
    name = dict(zip(distinct, hash_words(data, offsets)[0].astype(np.int64).tolist())) | {None: class_lm.END_WORD}
    train = Counter(name[w] for i, held, _ in rows if not held for w in tokens[i])
    assert {w: n for w, n, _ in seen} == dict(train)
    of, end, unseen = {w: k for w, _, k in seen}, classes, classes + 1
    assert of[class_lm.END_WORD] == end and all(0 <= k < classes for w, k in of.items() if w != class_lm.END_WORD)
    moves = np.full((classes + 2, classes + 2), alpha)
    for i, held, _ in rows:
        before = (end, False)
        for w in tokens[i] if not held else ():
            own = (of[name[w]], train[name[w]] == 1)
            for a in {before[0], unseen if before[1] else before[0]}:
                for b in {own[0], unseen if own[1] else own[0]}:
                    moves[a, b] += 1
            before = own
    moves /= moves.sum(1, keepdims=True)
    for i, held, _ in rows:
        want, before = 0.0, end
        for w in tokens[i]:
            k, n = of.get(name[w], unseen), train[name[w]]
            want += math.log10(moves[before, k])
            if k != unseen:
                mine = [v for v, c in of.items() if c == k]
                want += math.log10((n + alpha) / (sum(train[v] for v in mine) + alpha * len(mine)))
            before = k
        assert got[i]["score"] == pytest.approx(want) and got[i]["n_tokens"] == len(tokens[i])


def test_exchange_finds_classes():
    rng = np.random.default_rng(6)
    b = np.zeros((13, 13), int)
    for i in range(12):
        for j in range(12):
            b[i, j] = rng.poisson(40 if (i + 1) % 3 == j % 3 else 1)
    of = class_lm.exchange(b, 3)
    assert all((of[i] == of[j]) == (i % 3 == j % 3) for i in range(12) for j in range(12)) and of[12] == 3


def information(pairs, of, size):
    t = np.zeros((size, size))
    for (a, b), n in pairs.items():
        t[of[a], of[b]] += n
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(t) - f(t.sum(1)) - f(t.sum(0)), t


def test_changes_of_information():
    rng, classes = np.random.default_rng(8), 4
    text = [12, *rng.integers(0, 12, 300).tolist(), 12]
    pairs = Counter(zip(text, text[1:]))
    of = np.append(rng.integers(0, classes, 12), classes)
    _, table = information(pairs, of, classes + 1)
    keys = Counter()
    for (a, b), n in pairs.items():
        for w, context in ((b, of[a]), (a, classes + 1 + of[b])) if a != b else ((a, 2 * classes + 2),):
            keys[w * (2 * classes + 3) + context] += n * (w != 12)
    k = np.array(sorted(x for x in keys if keys[x]))
    words, change = class_lm._changes(k, np.array([keys[x] for x in k]), of.astype(np.uint8), table, classes)
    assert words.tolist() == list(range(12))
    for w in words:
        moved = [information(pairs, np.where(np.arange(13) == w, c, of), classes + 1)[0] for c in range(classes)]
        assert change[w] - change[w, 0] == pytest.approx(np.array(moved) - moved[0], abs=1e-8)


def test_class_lm_clusters_all_words(spark, monkeypatch):
    """Words with no frequent word beside them get classes by the text too, and at the end no word is better off elsewhere."""
    rng, tables = np.random.default_rng(9), {}
    texts = [" ".join(f"{k}{rng.integers(3)}" for k in "abc") for _ in range(100)]
    df = docs(spark, texts).filter("doc_id is not null").selectExpr("doc_id", "false held_out", "text")
    write = class_lm.Scratch.write
    monkeypatch.setattr(class_lm.Scratch, "write", lambda self, df, name, *a: tables.setdefault(name, write(self, df, name, *a)))
    monkeypatch.setattr(class_lm.Scratch, "drop_all_but", lambda self, *names: None)
    class_lm.class_scores(df, classes=3, seeds=1, least_rise=0)
    found = {r["word"]: r["class"] for r in tables["lexicon"].collect()}
    names = sorted({w for t in texts for w in t.split()})
    [(_, _, data, offsets)] = slices(pa.array(names))
    of = {w: found[h] for w, h in zip(names, hash_words(data, offsets)[0].view(np.int64).tolist())} | {None: 3}
    assert len(found) == len(of) and found[class_lm.END_WORD] == 3
    pairs = Counter(p for t in texts for p in zip([None, *t.split()], [*t.split(), None]))
    best = information(pairs, of, 4)[0]
    assert all(information(pairs, of | {w: c}, 4)[0] <= best + 1e-6 for w in names for c in range(3))


def test_token_counts(spark):
    scores = token_counts.load_pieces(tokenizer_path("byte_bpe_50k.tiktoken"))
    longest = max(map(len, scores))

    def plain(token):
        w, f = token.encode(), [(0.0, 0)]
        for e in range(1, len(w) + 1):
            s, k = max((f[a][0] + scores[w[a:e]], -(f[a][1] + 1)) for a in range(max(0, e - longest), e) if w[a:e] in scores)
            f.append((s, -k))
        return f[-1][1]

    assert token_counts.token_counts(empty(spark), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0
    assert token_counts.token_counts(docs(spark, ["a b"]).union(docs(spark, ["a b"])), tokenizer_path("byte_bpe_50k.tiktoken")).filter("doc_id = 0").count() == 2
    for r in token_counts.token_counts(docs(spark, ODD), tokenizer_path("byte_bpe_50k.tiktoken")).collect():
        cut = token_counts.pre_tokens(ODD[r["doc_id"]] if r["doc_id"] is not None else "null id here")
        assert "".join(cut) == ((ODD[r["doc_id"]] or "") if r["doc_id"] is not None else "null id here")
        assert (r["n_pretokens"], r["n_tokens"]) == (len(cut), sum(map(plain, cut)))


def test_long_pretokens_need_no_nodes():
    trie = token_counts.Trie(token_counts.load_pieces(tokenizer_path("byte_bpe_50k.tiktoken")), limit=1000)
    rng = np.random.default_rng(13)
    long = "".join(rng.choice(list("abcdeé"), 200_000))
    short = long[:200]
    [(n, m)] = [trie.counts([f"{long} {short}"])]
    assert n == [2] and m[0] > 1 and trie.nodes <= 1000 + 256
    whole, token_counts.LONG = token_counts.LONG, 100
    try:
        assert token_counts.Trie(trie.scores).counts([short]) == trie.counts([short])  # by the window, and by the trie
    finally:
        token_counts.LONG = whole
    many = [" ".join("".join(rng.choice(list("abcdefgh"), 12)) for _ in range(2000))]
    assert trie.counts(many) == token_counts.Trie(trie.scores).counts(many) and trie.nodes <= 1000 + 256


def test_long_pretokens_are_cut():
    """Text without spaces goes through the trie in parts, with the counts of the whole."""
    trie = token_counts.Trie(token_counts.load_pieces(tokenizer_path("byte_bpe_50k.tiktoken")))
    rng = np.random.default_rng(15)
    signs = [*"日本語の文章は空白で分けられていませんภาษาไทย。、", "한국", "the", "ing", "é", "1"]
    for n in (100, 400, 3000):
        line = "".join(rng.choice(signs, n))
        word = line.encode()
        parts = trie.parts(word)
        assert b"".join(parts) == word and len(parts) > n / 10
        ends = set(np.cumsum([len(p) for p in parts]).tolist()) - {len(word)}
        crossed = {e for a in range(len(word)) for b in range(a + 2, min(len(word), a + trie.longest) + 1) if word[a:b] in trie.scores for e in range(a + 1, b)}
        assert ends == set(range(1, len(word))) - crossed
        assert trie.counts([line])[1] == [trie._long(word)]
    assert 0 < len(trie.of_part) < 3000


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (1, 300, "ann", "bye"), (None, 0, "cy", "x"), (2, None, None, "y"), (2, 1, "dan", "z"), (3, 0, "system", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat_rotation.rotate(table.filter("false")).count() == 0
    clashing = table.withColumn("start", F.lit("x")).withColumn("seat", F.lit(1)).withColumn("perspective", F.lit(None).cast("string"))
    assert sorted(map(repr, chat_rotation.rotate(clashing).collect())) == sorted(map(repr, chat_rotation.rotate(table).collect()))
    made = chat_rotation.rotate(table).collect()
    assert len(made) == 5 * 2 + 1 + 2
    for conv in {(r["conv_id"], r["perspective"]) for r in made}:
        mine = sorted((r for r in made if (r["conv_id"], r["perspective"]) == conv), key=lambda r: r["segment"])
        whole = "".join(r["rendered"] for r in mine)
        assert [r["segment"] for r in mine] == list(range(len(mine)))
        for r in mine:
            assert whole[r["start"] : r["start"] + r["length"]] == r["rendered"]
            if r["role"] == conv[1]:
                assert whole[r["loss_start"] : r["loss_start"] + r["loss_length"]].endswith("<|im_end|>\n") and "<|im_start|>assistant" in r["rendered"]
            else:
                assert r["loss_start"] == -1 and r["loss_length"] == 0


def test_topk(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], "x") for i in range(120)]
    vectors += [(200, None, "n"), (250, [float("nan")] * 6, "n"), (300, [None] * 6, "n"), (301, vectors[50][1], "copy"), (None, vectors[50][1], "n")]
    vectors += [vectors[50], (50, vectors[7][1], "same id"), (350, [], "n"), (351, [1.0] * 9, "longer")]
    got = exact_topk.exact_topk(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")).collect()
    q = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v, _) in enumerate(vectors) if i is not None and v is not None and None not in v and not any(map(math.isnan, v))]
    expected = []
    for n, i, v in q:
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for m, j, w in q if m != n)[:5]
            expected += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    with pytest.raises(Exception, match="too long"):
        exact_topk.exact_topk(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))
    table = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>, score string")
    assert exact_topk.exact_topk(table.filter("false")).count() == 0
    assert sorted(r["vec_id"] for r in exact_topk.exact_topk(table).collect()) == [1, 2]  # fewer candidates than asked for


@pytest.fixture
def planted(spark, tmp_path):
    rng = np.random.default_rng(14)
    words = lambda n, k: " ".join(f"{k}{x}" for x in rng.integers(0, 400, n))
    base = words(60, "alpha")
    near = base.replace(base.split()[10], "changed", 1)
    at80 = base.split()[:55] + words(4, "tail").split()
    texts = [base, near, base.upper(), " ".join(at80), None, "", "123 456", words(60, "beta"), words(60, "gamma"), "short one", "Short One", words(9000, "long"), "z" * 3000]
    rows = [(i, t, "en", f"s{i % 2}" if i % 4 else None, len(t or ""), "kept as it is") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    return df, str(tmp_path), texts


def test_pipeline_stages_against_brute_force(spark, planted):
    """Every stage on its own input, and run() with its handover, on planted copies; empty tables too."""
    pipeline = pytest.importorskip("corpus_pipeline")
    df, folder, texts = planted
    left = {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    kept = pipeline.language(spark, df, "")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(left)
    exact = {}
    for i, t in left.items():
        exact[lower(t)] = max(i, exact.get(lower(t), -1))
    left = {i: left[i] for i in exact.values()}
    kept = pipeline.exact(spark, kept, "")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(left)
    _, of = brute_components(left, 80)
    left = {i: t for i, t in left.items() if of[i] == i}
    kept = pipeline.near(spark, kept, "")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(left) and 2 not in left
    decided = {r["doc_id"]: r["copies"] for r in mixing.balanced_mix(kept).collect() if r["copies"]}
    mixed = pipeline.mix(spark, kept, "")
    assert mixed.columns == df.columns and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == decided
    e = PartEncoder(tokenizer_path("word_bpe_49k.json"))
    rows = pipeline.run(spark, f"file://{folder}").collect()
    tokens = {i: len(e.whole(texts[i])) + 1 for i in decided}
    assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in decided} == {i: n * tokens[i] for i, n in decided.items()} and {r["doc_id"] for r in rows} == set(decided)
    docs = df.filter("false")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = docs(spark, [*ODD, "Same", "same"], extra=False)
    kept = corpus_pipeline.exact(spark, corpus_pipeline.language(spark, base, ""), "")
    assert kept.columns == base.columns
    ids = {r["doc_id"] for r in kept.collect()}
    texts = dict(enumerate([*ODD, "Same", "same"])) | {None: "null id here"}
    assert ids == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")} - {len(ODD)}
    mixed = corpus_pipeline.mix(spark, kept, "")
    assert mixed.columns == base.columns and {r["doc_id"] for r in mixed.collect()} <= ids


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns that are called as the stages call their own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["lang_pred", "own lang_pred", "score", "gone id", "gone hash", "id", "hash", "row", "c0", "text_hash", "kept", "mix_row", "copies", "size", "target", "nth", "p", "bucket", "norm", "salt", "a.b"]
    base = docs(spark, ["Same words of a text here", "same words of a text here", "one two three four five six", None, "1 2"], extra=False)
    wide = base.withColumns({n: F.lit(n) for n in names})
    for stage in (pipeline.language, pipeline.exact, pipeline.near, pipeline.mix):
        plain, named = stage(spark, base, ""), stage(spark, wide, "")
        assert named.columns == wide.columns
        assert sorted(map(tuple, named.select(*base.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        assert all(r[n] == n for r in named.collect() for n in names)
    assert pipeline.pack(spark, wide, "").count() > 0
    for make in (lambda d: near_dedup.near_duplicates(d), lambda d: exact_dedup.mark_duplicates(d), lambda d: language_id.language_id(d), lambda d: mixing.balanced_mix(d), lambda d: token_counts.token_counts(d, tokenizer_path("byte_bpe_50k.tiktoken"))):
        assert make(wide).count() == 6


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    d = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        d.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return d


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, duck, name):
    """The queries with SQL give DuckDB's rows."""
    rows = lambda df: sorted(map(repr, ([None if x is None or x != x else x for x in r] for r in df[sorted(df.columns)].astype(object).values.tolist())))
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("placed", [True, False])
def test_words_with_few_contexts_move_alike(placed, monkeypatch):
    """The class a word moves to, by the changes of each; their logarithms are few where words have few contexts."""
    rng, classes = np.random.default_rng(3), 8
    size, words = classes + 1, 3000
    table = rng.integers(0, 60, (size, size)) ** 2
    table[3], table[:, 5] = table[3] // 900, table[:, 5] // 900
    of = np.where(rng.random(words) < (1 if placed else 0.4), rng.integers(0, classes, words), class_lm.NONE).astype(np.uint8)
    found = Counter()
    for w in range(words):
        for _ in range(1 if w < 2400 else int(rng.integers(2, 90))):
            for side in rng.choice([0, size], int(rng.integers(1, 3)), replace=False):
                found[w * (2 * size + 1) + int(side) + int(rng.integers(0, size))] += 1
            if w % 50 == 0:
                found[w * (2 * size + 1) + 2 * size] += 1
    keys = np.array(sorted(found))
    counts = np.array([found[k] for k in keys.tolist()])
    steps = class_lm._steps(table, classes)
    who, change = class_lm._changes(keys, counts, of, table, classes, steps)
    own, at = of[who].astype(int), np.arange(len(who))
    stays = (own != class_lm.NONE) & (change.max(1) <= change[at, np.where(own == class_lm.NONE, 0, own)] + 1e-9)
    wanted = of.copy()
    wanted[who] = np.where(stays, own, change.argmax(1))
    alone, f, logs = class_lm._alone(table, classes, steps), class_lm._f, []
    monkeypatch.setattr(class_lm, "_f", lambda x: logs.append(np.size(x)) or f(x))
    assert class_lm._moved(keys, counts, of, table, classes, steps, alone, 1e-9).tolist() == wanted.tolist()
    assert 0.1 < (wanted != of).mean() and sum(logs) < 30 * words
    assert class_lm._moved(keys[:0], counts[:0], of, table, classes, steps, alone, 1e-9).tolist() == of.tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_calls_are_few_for_each_new_word_and_piece(name):
    """Distinct words are looked up and rewritten together, waiting pieces keep their demands: no Python for each of them again and again."""
    def calls(f):
        profile = cProfile.Profile()
        out = profile.runcall(f)
        return out, pstats.Stats(profile).total_calls

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeßüÄÉstORT"), int(rng.integers(3, 9)))) + (".", ",", "", "")[i % 4] for i in range(4000)]
    texts = [" ".join(words[:2000]), "\n".join(words[2000:]), "", " a\n\n b", *words[:50], None, "x\ny 1,2 ok\n"]
    tokens = PartEncoder(tokenizer_path(name))
    (ids, sizes), n = calls(lambda: tokens.encode(pa.array(texts)))
    wanted = [tokens.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for w in wanted for x in w] and sizes.tolist() == [len(w) for w in wanted]
    assert n < 8 * len(words)
    packer = packing.Packer(packing.Limits(segments=64))
    lengths = rng.integers(1, 900, 1500)
    placed, n = calls(lambda: [p for i, k in enumerate(lengths.tolist()) for p in packer.add(i, np.arange(k), k)] + packer.finish())
    assert n < 100 * len(lengths)
    found = Counter()
    for p in placed:
        found[p[0]] += len(p[2])
    assert [found[i] for i in range(len(lengths))] == lengths.tolist()
