"""Evaluation texts leaking into training text (problem 3).

Method: every window of ``width`` words of the held-out texts and of the corpus gets a 64-bit SimHash of its
weighted shingles (words and neighbouring pairs). A window is as large as the least passage that counts. The fingerprint
is cut into blocks, and every choice of as many of them as must agree within ``radius`` is a key: two fingerprints within
the radius agree in one key at least, so an equi-join by key finds all of them (multi-index Hamming search). Candidates
are then compared exactly: the weighted-shingle similarity of the two windows must reach ``least``; at 1 the words must
also be the same in the same order. ``near_items`` compares item-sized windows around the candidates: a held-out text of n
words leaks nearly if n consecutive words of the corpus text (or all of a shorter one) reach the similarity in five-word
shingles weighted by their letters.

Plan: the held side is reduced to distinct texts; its keys fill a Bloom filter of bounded size (``FILTER_BITS`` at most,
built in slices of which each is one task, so the driver sees the filter and never the keys). The corpus is scanned once and
not shuffled: only windows with a key in the filter leave the scan, with the words that the check needs. A filter too small
for the held side lets more windows through and loses none. Then an equi-join by key that AQE may split where a window is
frequent, the exact check in ``mapInArrow``, and a join back to the items by a 128-bit text key. No group is collected.

Defined results: null, empty and short texts (fewer words than the window) match nothing; question and answer
of an item are separate texts; repeated rows each count; ids may be null and are passed on; other columns are
ignored; an empty side gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.keyfilter import KeyFilter
from tracequarry.llm.spans import mix
from tracequarry.llm.words import WordHashes, words_of
from tracequarry.session import staged

WIDTH = 8
RADIUS = 1
#: Words fingerprinted at once (about 600 bytes each while at work).
CHUNK = 20_000
#: Words of a shingle, and of an item, in the search for near copies; longer items are compared in pieces.
SHINGLE, LONGEST, NEAR = 5, 64, 0.8


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1


def fingerprints(h: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of ``width`` word hashes; words weigh 1, neighbouring pairs 1."""
    n = h.size - width + 1
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    total = np.zeros((n, 64), dtype=np.int32)
    for of, size in ((mix(h), width), (pairs, width - 1)):
        if size:
            run = np.zeros((of.size + 1, 64), dtype=np.int32)
            np.cumsum(_signs(of), axis=0, out=run[1:])
            total += run[size : size + n] - run[:n]
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def shingle_similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard similarity of the shingles (words and neighbouring pairs, weighted by their letters)."""
    def bag(w: list[str]) -> Counter:
        c: Counter = Counter()
        for x in w:
            c[x] += len(x)
        for x, y in zip(w, w[1:]):
            c[x, y] += len(x) + len(y)
        return c

    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def near_similarity(a: list[str], b: list[str], shingle: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingles of ``shingle`` words, weighted by their letters."""
    x, y = (Counter(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) for w in (a, b))
    weight = lambda c: sum(n * sum(map(len, k)) for k, n in c.items())
    union = weight(x | y)
    return weight(x & y) / union if union else 0.0


def hamming_keys(radius: int) -> list[int]:
    """Masks of the keys: any two fingerprints within the radius agree on all bits of one of them.

    Of ``blocks`` blocks at least ``blocks - radius`` agree. Keys keep about half of the bits, so that they select.
    """
    blocks = 2 * radius if radius > 1 else radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def key_values(f: np.ndarray, masks: list[int]) -> np.ndarray:
    """[window, key]: a hash of the masked fingerprint and the key's number."""
    with np.errstate(over="ignore"):
        return np.stack([mix((f & np.uint64(m)) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)) for i, m in enumerate(masks)], axis=1)


def first_key(xor: Column, masks: list[int]) -> Column:
    """Number of the first key on which two fingerprints agree, so that a pair is met once."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.coalesce(*[F.when(xor.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(signed)])


def text_windows(texts: DataFrame, width: int, masks: list[int], around: int = 0, keep: KeyFilter | None = None) -> DataFrame:
    """(k, f, w, at, key, v): the distinct windows of each text t with key k, once per Hamming key.

    w are the words from ``around`` before the window to ``around`` after it, ``at`` the place of the window in them. Windows
    of which ``keep`` holds no key are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(keep) if keep is not None else None  # bounded by FILTER_BITS
    key_type = texts.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held = shared.value if shared is not None else None
        for batch in batches:
            owners, words, starts, ends = [], [], [0], []

            def flush() -> pa.RecordBatch:
                h = hashes.array(words)
                f = fingerprints(h, width)
                at = np.asarray(starts)
                of = np.searchsorted(at, np.arange(f.size), side="right") - 1
                place = np.flatnonzero(np.arange(f.size) + width <= at[of + 1])
                v = key_values(f[place], masks)
                row, key = np.nonzero(held.holds(v)) if held is not None else np.nonzero(np.ones(v.shape, bool))
                place, v = place[row], v[row, key]
                exact = window_hashes(h, width)[place]
                _, first = np.unique(np.stack([np.asarray(owners)[of[place]], f[place].view(np.int64), exact.view(np.int64), key]), axis=1, return_index=True)
                place, v, key = place[first], v[first], key[first]
                low = np.maximum(at[of[place]], place - around)
                high = np.minimum(at[of[place] + 1], place + width + around)
                cols = [
                    batch.column(0).take(pa.array(np.asarray(owners, dtype=np.int64)[of[place]])), pa.array(f[place].view(np.int64)), pa.array([" ".join(words[x:y]) for x, y in zip(low, high)], type=pa.string()),
                    pa.array((place - low).astype(np.int32)), pa.array(key.astype(np.int32)), pa.array(v.view(np.int64)),
                ]
                return pa.RecordBatch.from_arrays(cols, names=["k", "f", "w", "at", "key", "v"])

            for n, text in enumerate(batch.column(1).to_pylist()):
                w = words_of(text)
                for at in range(0, max(0, len(w) - width + 1), CHUNK):  # a very long text in overlapping pieces
                    owners.append(n)
                    words.extend(w[max(0, at - around) : at + CHUNK + width - 1 + around])
                    starts.append(len(words))
                    if len(words) >= CHUNK:
                        yield flush()
                        owners, words, starts = [], [], [0]
            if owners:
                yield flush()

    return texts.select("k", "t").mapInArrow(run, f"k {key_type}, f bigint, w string, at int, key int, v bigint")


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window, in which the order of the words counts."""
    out = np.zeros(h.size - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + out.size])
    return out


def _text_key(column: str) -> Column:
    return F.unhex(F.md5(column))


def _candidates(corpus: DataFrame, items: DataFrame, corpus_id: str, corpus_text: str, item_id: str, item_texts: list[str], width: int, radius: int, around: int) -> tuple[DataFrame, DataFrame]:
    """(c_id, cw, cat, ik, iw, iat) of the window pairs within the radius, and (i_id, ik) of the items."""
    rows = corpus.select(corpus[corpus_id].alias("k"), corpus[corpus_text].alias("t")).where("length(t) > 0")
    held = items.select(items[item_id].alias("i_id"), F.explode(F.array(*[items[c] for c in item_texts])).alias("t")).where("length(t) > 0").withColumn("k", _text_key("t"))
    masks = hamming_keys(radius)
    b = staged(text_windows(held.groupBy("k").agg(F.min("t").alias("t")), width, masks, around))
    a = text_windows(rows, width, masks, around, KeyFilter.of(b))
    near = a.select(F.col("k").alias("c_id"), F.col("f").alias("cf"), F.col("w").alias("cw"), F.col("at").alias("cat"), "key", "v").join(
        b.select(F.col("k").alias("ik"), F.col("f").alias("if"), F.col("w").alias("iw"), F.col("at").alias("iat"), "key", "v"), ["key", "v"]
    )
    xor = F.col("cf").bitwiseXOR(F.col("if"))
    return near.where((F.bit_count(xor) <= radius) & (first_key(xor, masks) == F.col("key"))).select("c_id", "cw", "cat", "ik", "iw", "iat"), held.select("i_id", F.col("k").alias("ik")).distinct()


def _verified(near: DataFrame, items: DataFrame, same, corpus_id: str, item_id: str) -> DataFrame:
    id_type = near.schema["c_id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, bool] = {}
        for batch in batches:
            ok = []
            for key in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5))):
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = same(key[0].split(" "), key[1], key[2].split(" "), key[3])
                ok.append(memo[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["c_id", "ik"]).filter(pa.array(ok, type=pa.bool_()))

    found = near.mapInArrow(verify, f"c_id {id_type}, ik binary").distinct()
    return found.join(items, "ik").select(F.col("c_id").alias(corpus_id), F.col("i_id").alias(item_id)).distinct()


def leaked_items(
    corpus: DataFrame, items: DataFrame, corpus_id: str, corpus_text: str, item_id: str, item_texts: list[str], width: int = WIDTH, radius: int = RADIUS, least: float = 1.0
) -> DataFrame:
    """(corpus_id, item_id): the corpus rows and the items of which they hold a passage of ``width`` words."""
    near, held = _candidates(corpus, items, corpus_id, corpus_text, item_id, item_texts, width, radius, 0)

    def same(a: list[str], _: int, b: list[str], __: int) -> bool:
        return shingle_similarity(a, b) >= least - 1e-12 and (least < 1.0 or a == b)

    return _verified(near, held, same, corpus_id, item_id)


def near_window(text: list[str], at: int, item: list[str], least: float) -> bool:
    """True if some window of the text as long as the item reaches the similarity; that aligned with ``at`` is tried first."""
    last = max(0, len(text) - len(item))
    return any(near_similarity(text[i : i + len(item)], item) >= least for i in sorted(range(last + 1), key=lambda i: abs(i - at)))


def near_items(corpus: DataFrame, items: DataFrame, corpus_id: str, corpus_text: str, item_id: str, item_texts: list[str], least: float = NEAR) -> DataFrame:
    """(corpus_id, item_id): the corpus rows that hold an item-sized window similar to a text of the item.

    Candidates share a window of ``WIDTH`` words within ``RADIUS``; items of more than ``LONGEST`` words count by their pieces of
    that size around the candidate.
    """
    near, held = _candidates(corpus, items, corpus_id, corpus_text, item_id, item_texts, WIDTH, RADIUS, LONGEST)

    def same(a: list[str], at: int, b: list[str], held_at: int) -> bool:
        low = max(0, min(held_at - (LONGEST - WIDTH) // 2, len(b) - LONGEST))
        item = b[low : low + LONGEST]
        return near_window(a, at - (held_at - low), item, least)

    return _verified(near, held, same, corpus_id, item_id)


def leak_report(pairs: DataFrame, items: DataFrame, item_id: str, split_col: str) -> DataFrame:
    """(item_id, split, n_rows): how many corpus rows hold a passage of each leaked item."""
    count = pairs.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_rows"))
    return count.join(items.select(item_id, split_col).distinct(), item_id)
