"""Tokens, packing, shared spans, leakage, overlaps, neighbours: against brute force and awkward cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.llm import keyfilter, leakage, neighbours, overlap, packing, spans, tokens
from tracequarry.llm.words import edits_within, words_of

RANKS = tokens.read_ranks(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}")


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=RANKS, special_tokens={})


ODD = ["", "<|endoftext|> a", "a  b\n\n  c", "İstanbul ß ﬁ 😀😀", "x" * 5000, "don't we'll", "​﻿", "日本語 テスト", " ", "a" + " " * 3000 + "b"]


def test_encoding_of_odd_texts(spark):
    ref = reference_encoding()
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(ODD)] + [(99, None, None), (99, None, None), (None, "a", None)], "doc_id bigint, text string, ids array<int>")
    got = tokens.encode_corpus(df).collect()
    assert len(got) == len(ODD) + 3 and tokens.encode_corpus(df.where("false")).count() == 0
    for r in got:
        assert list(r["ids"]) == (ref.encode_ordinary(ODD[r["doc_id"]]) if r["doc_id"] is not None and r["doc_id"] < 99 else ref.encode_ordinary("a") if r["doc_id"] is None else [])


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_scan_and_heap_agree(word):
    assert tokens.merge_scan(word, RANKS) == tokens.merge_heap(word, RANKS)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    memo, back = tokens.WordMemo(RANKS), {v: k for k, v in RANKS.items()}
    ids = [i for w in tokens.word_finder()(text) for i in memo[w]]
    assert b"".join(back[i] for i in ids).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.booleans())
def test_packing_invariants(lengths, fill):
    bins = packing.harmonic_bins(np.array(lengths, dtype=np.int64), 50, fill)
    held: dict[int, list[int]] = {}
    for b, n in zip(bins, lengths):
        held.setdefault(int(b), []).append(n)
    assert all(sum(v) <= 50 for v in held.values()) and sorted(held) == list(range(len(held)))
    short = []
    for v in held.values():  # k items of the container's class k, the smallest in it; one container of a class may hold fewer
        k = 50 // max(v)
        count = sum(50 // n == k for n in v)
        assert count <= k and (fill or count == len(v))
        short += [k] * (count < k)
    assert len(short) == len(set(short))
    if fill:  # no space that a smaller class could still have taken
        later = {b: max(held[b]) for b in held}
        for b, v in held.items():
            assert all(not (50 // n > 50 // later[b] and n <= 50 - sum(v)) for c in held if c > b for n in held[c])


def greedy_bins(lengths, capacity):
    """Always the longest item that fits, container by container."""
    left, out, number = sorted(range(len(lengths)), key=lambda i: -lengths[i]), {}, 0
    while left:
        space, rest = capacity, []
        for i in left:
            if lengths[i] <= space:
                space -= lengths[i]
                out[i] = number
            else:
                rest.append(i)
        left, number = rest, number + 1
    return [out[i] for i in range(len(lengths))]


def test_packing_is_by_class_and_not_greedy():
    lengths = [34, 50, 20, 50, 34, 20, 60]
    assert packing.harmonic_bins(np.array(lengths), 100).tolist() == [1, 1, 2, 2, 0, 2, 0]
    assert packing.harmonic_bins(np.array(lengths), 100, fill=False).tolist() == [1, 1, 3, 2, 2, 3, 0]
    assert greedy_bins(lengths, 100) == [0, 1, 2, 1, 2, 2, 0]
    rng = random.Random(3)
    groups = lambda bins: {frozenset(i for i, b in enumerate(bins) if b == x) for x in set(bins)}
    differ = 0
    for _ in range(50):
        lengths = [rng.randint(1, 60) for _ in range(60)]
        differ += groups(packing.harmonic_bins(np.array(lengths), 100).tolist()) != groups(greedy_bins(lengths, 100))
    assert differ == 50
    # a class keeps its containers whatever other classes arrive between its items
    a = packing.harmonic_bins(np.array([40, 45, 36, 50]), 100).tolist()
    b = packing.harmonic_bins(np.array([40, 90, 45, 80, 36, 50]), 100).tolist()
    assert a == [0, 0, 1, 1] and [b[i] - b[0] for i in (0, 2, 4, 5)] == a


def test_packing_rejects_bad_lengths():
    with pytest.raises(ValueError):
        packing.harmonic_bins(np.array([0]), 10)
    with pytest.raises(ValueError):
        packing.harmonic_bins(np.array([11]), 10)


def test_pack_documents(spark):
    texts = ["word " * n for n in (1, 5, 5, 40, 1000, 7000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (None, "a b")], "doc_id bigint, text string").withColumn("piece", F.lit(1))
    rows = packing.pack_documents(df).collect()
    ref = reference_encoding()
    total: dict[int, int] = {}
    for r in rows:
        total[r["container_id"]] = total.get(r["container_id"], 0) + r["n_tokens"]
    assert max(total.values()) <= packing.CAPACITY
    for i, t in enumerate(texts):
        own = sorted((r["piece"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        n = len(ref.encode_ordinary(t))
        assert sum(x for _, x in own) == n and len(own) == -(-n // packing.CAPACITY) and [p for p, _ in own] == list(range(len(own)))
    assert {r["doc_id"] for r in rows} == {*range(6), None}
    assert packing.pack_documents(df.where("false")).count() == 0


def brute_spans(docs, width):
    seen: dict[str, set] = {}
    for d, t in docs:
        for i in range(len(t or "") - width + 1):
            seen.setdefault(t[i : i + width], set()).add(d)
    out = set()
    for d, t in docs:
        shared = set()
        for i in range(len(t or "") - width + 1):
            if len(seen[t[i : i + width]]) > 1:
                shared.update(range(i, i + width))
        for p in sorted(shared):
            if p - 1 not in shared:
                start = p
            if p + 1 not in shared:
                out.add((d, start, p + 1))
    return out


def span_rows(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("d", F.lit(1)).withColumn("t", F.lit("x"))
    return {(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.shared_spans(df, **kw).collect()}


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        pool = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(10, 60))) for _ in range(5)]
        docs = [(i, "".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 6)))) for i in range(14)]
        docs += [(90, "ab" * 60), (91, "ab" * 80), (92, "ab" * 60), (93, None), (94, "")]
        assert span_rows(spark, docs, width=20, inner=7) == brute_spans(docs, 20)


def test_shared_spans_production_width(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    notice, long = text(260), text(30_000)
    docs = [(i, text(150) + notice + text(150)) for i in range(30)] + [(100, long), (101, long[:15_000] + "!" + long[15_001:]), (102, text(199)), (103, text(100) * 5), (None, long)]
    assert span_rows(spark, docs) == {x for x in brute_spans([d for d in docs if d[0] is not None], 200)}
    assert span_rows(spark, []) == set()


def test_shared_spans_of_texts_hashed_in_pieces(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(30, 90))) for _ in range(4)]
    docs = [(i, "".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(2, 9)))) for i in range(12)] + [(50, "ab" * 200), (51, "ab" * 90)]
    assert max(len(t) for _, t in docs) > 4 * 64 and span_rows(spark, docs, width=20, inner=7, chunk=64) == brute_spans(docs, 20)


def test_shared_share(spark):
    df = spark.createDataFrame([(1, "x" * 250), (2, "x" * 200), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["shared_share"]) for r in spans.shared_share(df).collect()}
    assert got == {1: (250, 250, 1.0), 2: (200, 200, 1.0), 4: (0, 0, 0.0)}


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 7, 300):
        assert spans.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(300 - w + 1)]


ITEMS = "odoc_id bigint, question string, answer string"
CORPUS = "corpus_id bigint, snippet string"


def test_leakage(spark):
    eight = "one two three four five six seven eight"
    items = [(1, f"{eight} nine", None), (2, "a b c d", "e f g h"), (3, f"x {eight}", eight), (1, f"{eight} nine", None), (4, None, ""), (5, eight.replace("four", "FOUR!"), None)]
    corpus = [(10, f"so -- {eight.upper()}."), (10, f"so -- {eight.upper()}."), (11, "one two three four five six seven"), (12, None), (13, ""), (14, "a b c d e f g h"), (15, ("z " * 20_000) + eight), (16, "eight seven six five four three two one")]
    c = spark.createDataFrame(corpus, CORPUS).withColumn("t", F.lit("x")).withColumn("k", F.lit(1))
    i = spark.createDataFrame(items, ITEMS).withColumn("i_id", F.lit(1))
    got = sorted((r["corpus_id"], r["odoc_id"]) for r in leakage.leaked_items(c, i, "corpus_id", "snippet", "odoc_id", ["question", "answer"]).collect())
    assert got == [(a, b) for a in (10, 15) for b in (1, 3, 5)]
    assert leakage.leaked_items(c.where("false"), i, "corpus_id", "snippet", "odoc_id", ["question", "answer"]).count() == 0


def test_leakage_inside_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK", 50)
    text = " ".join(f"w{i}" for i in range(400))
    c = spark.createDataFrame([(1, text)], CORPUS)
    i = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 8)), None) for k in range(0, 393)], ITEMS)
    assert leakage.leaked_items(c, i, "corpus_id", "snippet", "odoc_id", ["question", "answer"]).count() == 393


def test_hamming_keys_find_everything_within_the_radius():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    from tracequarry.llm.words import WordHashes

    hashes = WordHashes()
    base = [rng.choice(vocabulary) for _ in range(400)]
    a = leakage.fingerprints(hashes.array(base), 8)
    assert a.size == 393 and a[5] == leakage.fingerprints(hashes.array(base[5:13]), 8)[0]
    for radius in (0, 1, 2, 3):
        masks = leakage.hamming_keys(radius)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for _ in range(rng.randint(0, radius)):
                y ^= 1 << rng.randrange(64)
            u, v = (leakage.key_values(np.array([z], np.uint64), masks)[0] for z in (x, y))
            assert (u == v).any() and [i for i, m in enumerate(masks) if not (x ^ y) & m] == np.flatnonzero(u == v).tolist()


def test_key_filter_loses_nothing(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**63), 2**63 - 1, 5000)
    keys = keyfilter.KeyFilter.of(spark.createDataFrame([(int(x),) for x in v], "v bigint"))
    assert keys.holds(v.view(np.uint64)).all() and keys.holds(rng.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.05
    assert not keyfilter.KeyFilter.of(spark.createDataFrame([], "v bigint")).holds(v.view(np.uint64)).any()


def test_leakage_below_equality(spark):
    """A similarity below 1 takes windows whose words are in another order, which equality leaves out."""
    base = "one two three one two four one two"
    other = "one two four one two three one two"  # the same words and pairs
    assert leakage.shingle_similarity(base.split(), other.split()) == 1.0
    c, i = spark.createDataFrame([(1, other), (2, base), (3, "five " * 8)], CORPUS), spark.createDataFrame([(7, base, None)], ITEMS)
    run = lambda least: sorted(r["corpus_id"] for r in leakage.leaked_items(c, i, "corpus_id", "snippet", "odoc_id", ["question", "answer"], least=least).collect())
    assert run(1.0) == [2] and run(0.99) == [1, 2]


def brute_near(corpus, items, least=0.8):
    out = set()
    for c, t in corpus:
        w = words_of(t)
        eights = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for o, *texts in items:
            for x in map(words_of, texts):
                if not eights & {tuple(x[i : i + 8]) for i in range(len(x) - 7)}:
                    continue
                if any(leakage.near_similarity(w[i : i + len(x)], x) >= least for i in range(max(0, len(w) - len(x)) + 1)):
                    out.add((c, o))
    return out


def test_near_items_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 60))), None if i % 3 else " ".join(rng.choice(words) for _ in range(30))) for i in range(40)]
    corpus = []
    for c in range(160):
        own = words_of(rng.choice([t for x in items for t in x[1:] if t]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.5:
            own = own[rng.randint(0, 2) : len(own) - rng.randint(0, 3)]
        corpus.append((c, " ".join([rng.choice(words) for _ in range(rng.choice([0, 3, 40]))] + own + [rng.choice(words) for _ in range(rng.choice([0, 5, 90]))])))
    corpus += [(900, None), (901, ""), (902, "w1 w2")]
    c, i = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(items, ITEMS)
    got = {(r["corpus_id"], r["odoc_id"]) for r in leakage.near_items(c, i, "corpus_id", "snippet", "odoc_id", ["question", "answer"]).collect()}
    want = brute_near(corpus, items)
    assert got == want and 40 < len(want) < 160
    assert leakage.near_items(c.where("false"), i, "corpus_id", "snippet", "odoc_id", ["question", "answer"]).count() == 0


def brute_overlaps(rows):
    clean = lambda x: x.strip().lower() if x is not None else None
    out = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] not in ("train", None):
                near = a[2] is not None and b[2] is not None and levenshtein(words_of(a[2]), words_of(b[2])) <= 2
                if near or (clean(a[1]) is not None and clean(a[1]) == clean(b[1])):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    words = "red fox hall mint tower old new by of the".split()
    rows = [(i, rng.choice([None, "A1", " a1 ", f"s{i}"]), rng.choice([None, "", "?!"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(20)]), rng.choice(["train", "train", "test", "validation", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, sample_id string, question string, split string").withColumn("words", F.lit("x")).withColumn("k", F.lit(2)).withColumn("train", F.lit(False))
    got = {(r["row_id_a"], r["row_id_b"]) for r in overlap.split_overlaps(df).collect()}
    assert got == brute_overlaps(rows)
    assert overlap.split_overlaps(df.where("false")).count() == 0


def test_overlaps_in_many_shards_and_long_questions(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randint(0, 40)) for _ in range(12)) for _ in range(60)]
    train = [(i, t) for i, t in enumerate(texts)]
    held = [(i, t.replace(t.split()[3], "x", 1)) for i, t in enumerate(texts)] + [(99, "long " * 3000)]
    make = lambda rows: spark.createDataFrame(rows, "k bigint, words string")
    got = {(r["tk"], r["hk"]) for r in overlap.near_questions(make(train), make(held), 2, shard=7, block=11).collect()}
    assert got == {(a, b) for a, t in train for b, h in held if levenshtein(t.split(), h.split()) <= 2}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=7), min_size=1, max_size=12), st.lists(st.lists(st.integers(0, 4), max_size=7), min_size=1, max_size=6))
def test_index_search(held, train):
    arr = lambda rows: [np.array(r, dtype=np.uint64) for r in rows]
    got = overlap.match_block(arr(train), arr(held), 2)
    assert got == [(i, j) for i, t in enumerate(train) for j, h in enumerate(held) if levenshtein(t, h) <= 2 and max(len(t), len(h)) > 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=3, max_size=9), st.lists(st.tuples(st.integers(0, 8), st.sampled_from("abcdefghxyz"), st.sampled_from("ird")), max_size=2))
def test_texts_within_the_distance_share_a_key(a, edits):
    b = list(a)
    for at, w, kind in edits:
        if kind == "i":
            b.insert(at, w)
        elif b:
            b[min(at, len(b) - 1) : min(at, len(b) - 1) + 1] = [w] if kind == "r" else []
    from tracequarry.llm.words import WordHashes

    hashes = WordHashes()
    for common in ({}, {"a": 9, "b": 5, "c": 1}):
        assert set(overlap.rare_keys(a, hashes, common, 2)) & set(overlap.rare_keys(b, hashes, common, 2))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 5))
def test_edits_within(a, b, limit):
    assert edits_within(a, b, limit) == min(levenshtein(a, b), limit + 1)


def test_long_questions_on_both_sides():
    rng = np.random.default_rng(3)
    train = [rng.integers(0, 50, n).astype(np.uint64) for n in (70, 200, 200, 5000)]
    held = [np.delete(t, 10) for t in train] + [np.concatenate([t[:60], [99, 98, 97], t[60:]]).astype(np.uint64) for t in train]
    assert overlap.match_block(train, held, 2) == [(i, i) for i in range(4)]


def picture_rows(rng, n):
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            base = rows[rng.randrange(len(rows))]
            bits, hist = list(base[1]), list(base[2])
            for _ in range(rng.randint(0, 5)):
                bits[rng.randrange(64)] ^= 1
        else:
            bits, hist = [rng.randint(0, 1) for _ in range(64)], [rng.random() for _ in range(24)]
            total = sum(hist)
            hist = [h / total for h in hist]
        rows.append((i, bits, hist))
    return rows


def brute_pairs(rows, k=5, least=0.9):
    bits = np.array([r[1] for r in rows])
    hist = np.array([r[2] for r in rows])
    ids = np.array([r[0] for r in rows])
    out = set()
    for i in range(len(rows)):
        s = np.round(0.7 * (bits == bits[i]).mean(axis=1) + 0.3 * np.minimum(hist, hist[i]).sum(axis=1), 9)
        s[i] = -1
        for j in np.lexsort((ids, -s))[:k]:
            if s[j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("cell", [10_000, 60])
def test_neighbours_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "QUERIES", cell)
    rows = picture_rows(random.Random(7), 400)
    odd = [(900, None, rows[0][2]), (901, rows[0][1][:63], rows[0][2]), (902, [None] + rows[0][1][1:], rows[0][2]), (903, rows[0][1], None), (904, rows[0][1], rows[0][2][:-1] + [None])]
    df = spark.createDataFrame(rows + odd, "odoc_id bigint, image_dhash array<int>, image_hist array<double>").withColumn("c", F.lit(1)).withColumn("bits", F.lit(1))
    got = {(r["odoc_id_a"], r["odoc_id_b"]) for r in neighbours.similar_pairs(df).collect()}
    want = brute_pairs(rows)
    assert len(want) > 100 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_neighbours_of_copies_and_nothing(spark):
    bits, hist = [1] * 64, [1 / 24] * 24
    df = spark.createDataFrame([(i, bits, hist) for i in range(50)], "odoc_id bigint, image_dhash array<int>, image_hist array<double>")
    got = {(r["odoc_id_a"], r["odoc_id_b"]) for r in neighbours.similar_pairs(df).collect()}
    assert got == brute_pairs([(i, bits, hist) for i in range(50)])
    assert neighbours.similar_pairs(df.where("false")).count() == 0


def test_signed_bits_are_counted_as_they_are():
    assert neighbours.differing(np.array([-1]), np.array([0])).tolist() == [64.0]
