"""Same or near-same records across splits (problem 5).

Method: a compressed full-text index of evaluation shards. The distinct evaluation questions are cut into shards
of bounded size; each shard is indexed by words (suffix array, Burrows-Wheeler transform and rank lists).
Training questions are streamed through backward search, which yields for every stretch of words the interval
of its occurrences, so the longest stretches that still occur (maximal matches) and their counts are known. A
question within ``edits`` word edits of another shares one of any ``edits + 1`` pieces with it unchanged; the
pieces are chosen so that their counts sum to the least, their occurrences are merged into candidate pairs,
and the word edit distance decides. Nothing within the distance is lost.

Copies are compared once: rows are reduced to distinct word sequences, results brought back to all rows.

Which shards a question meets: two texts within ``edits`` word edits have all words of the longer one but ``edits`` in common, so
the ``edits + 2`` rarest words of each, in any common order, have two in common (texts of at most ``edits + 1`` words one; unless
both have at most ``edits`` words, then they always match). The evaluation questions are sharded by these pairs of words, so a
training question goes to a fixed number of shards at most however many there are, and the work grows with the number of
questions, not with its square; a filter of the evaluation side's pairs keeps it from shards that cannot hold a match. The order is by counts in a bounded sample (``ORDER_SAMPLE`` questions,
``COMMON`` words), then by hash; it decides how even the shards are, not what is found.

Plan: words and keys in the JVM, staged once; partial aggregates to distinct questions; a cogroup of (shard, part, block) keys,
in which a shard with more than ``SHARD_QUESTIONS`` is split into parts and training is streamed past it in blocks of fixed
size, so a task's memory does not depend on the input; equi-joins back to rows by 128-bit text keys.

Defined results: a null id equals nothing, ids are compared without case and outer blanks; a null question
equals nothing, a question without words has zero words; a row without split is neither training nor
evaluation; repeated rows each count; other columns are ignored; an empty side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.keyfilter import KeyFilter
from tracequarry.llm.words import WordHashes, edits_within, hashed_sample
from tracequarry.session import staged

EDITS = 2
SHARD_QUESTIONS = 5000
BLOCK_QUESTIONS = 50_000
#: Bounds of the sample and of the words that order the words of a question.
ORDER_SAMPLE, COMMON = 20_000, 5_000
#: Tasks among which pairs of texts too short to differ are spread.
SHORT_PARTS = 32
#: Questions with more words are cut into equal pieces.
LONG_QUESTION = 64


class WordIndex:
    """Full-text index of word sequences: suffix array, rank lists of the transform, document boundaries."""

    def __init__(self, documents: list[np.ndarray]):
        sizes = np.fromiter((d.size for d in documents), dtype=np.int64, count=len(documents))
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)])  # each is followed by its own end mark
        n = int(self.start[-1])
        flat = np.concatenate(documents) if n > len(documents) else np.zeros(0, np.uint64)
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        text = np.empty(n, dtype=np.int64)
        ends = self.start[1:] - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        text[ends] = np.arange(len(documents))  # distinct end marks, below all words
        text[inner] = codes + len(documents)
        self.first_word = len(documents)
        self.n = n
        self.suffix = self._sort(text, int(sizes.max(initial=0)) + 1)
        before = text[self.suffix - 1]
        # occurrences in the transform, by symbol and place: one binary search is a step of backward search
        order = np.argsort(before, kind="stable")
        self.occurs = before[order] * (n + 1) + order

    @staticmethod
    def _sort(text: np.ndarray, longest: int) -> np.ndarray:
        """Suffix array by prefix doubling up to the longest document."""
        n = text.size
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        width = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else rank[order]
            width *= 2
            if width >= longest or n == 0 or rank[order[-1]] == n - 1:
                return order

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words, -1 where a word does not occur."""
        if not self.alphabet.size:
            return np.full(words.shape, -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), self.alphabet.size - 1)
        return np.where(self.alphabet[at] == words, at + self.first_word, -1)

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals at once."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.occurs, base + lo), np.searchsorted(self.occurs, base + hi)

    def intervals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo, hi [question, i, j] of the stretch [i, j) of each row of an (questions x words) array."""
        g, m = words.shape
        symbol = self.symbols(words)
        lo, hi = np.zeros((g, m, m + 1), np.int64), np.zeros((g, m, m + 1), np.int64)
        for j in range(1, m + 1):
            live = np.arange(g)
            a, b = np.zeros(g, np.int64), np.full(g, self.n, np.int64)
            for i in range(j - 1, -1, -1):
                s = symbol[live, i]
                ok = s >= 0
                live, s, a, b = live[ok], s[ok], a[ok], b[ok]
                if not live.size:
                    break
                a, b = self.back(s, a, b)
                ok = b > a
                live, a, b = live[ok], a[ok], b[ok]
                lo[live, i, j], hi[live, i, j] = a, b
        return lo, hi

    def stretch(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo, hi of the whole of each row (an empty interval where it does not occur)."""
        symbol = self.symbols(words)
        lo, hi = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, a, b = np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for i in range(words.shape[1] - 1, -1, -1):
            s = symbol[live, i]
            ok = s >= 0
            live, s, a, b = live[ok], s[ok], a[ok], b[ok]
            a, b = self.back(s, a, b)
            ok = b > a
            live, a, b = live[ok], a[ok], b[ok]
        lo[live], hi[live] = a, b
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the interval, document, offset within it) of every occurrence."""
        size = hi - lo
        of = np.repeat(np.arange(lo.size), size)
        at = self.suffix[np.repeat(lo, size) + np.arange(of.size) - np.repeat(np.cumsum(size) - size, size)]
        document = np.searchsorted(self.start, at, side="right") - 1
        return of, document, at - self.start[document]


def cheapest_pieces(count: np.ndarray, pieces: int) -> np.ndarray:
    """Bounds (question x pieces+1) of the cut of all words into pieces with the least total count."""
    g, m, _ = count.shape
    best = np.full((g, pieces + 1, m + 1), np.iinfo(np.int64).max // 4)
    back = np.zeros((g, pieces + 1, m + 1), np.int64)
    best[:, 0, 0] = 0
    for p in range(1, pieces + 1):
        for j in range(p, m + 1):
            options = best[:, p - 1, p - 1 : j] + count[:, p - 1 : j, j]
            pick = np.argmin(options, axis=1)
            best[:, p, j] = options[np.arange(g), pick]
            back[:, p, j] = pick + p - 1
    bounds = np.zeros((g, pieces + 1), np.int64)
    bounds[:, pieces] = m
    for p in range(pieces, 0, -1):
        bounds[:, p - 1] = back[np.arange(g), p, bounds[:, p]]
    return bounds


def within_edits(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Word edit distance (insert, remove, replace) at most ``edits``."""
    n, m = a.size, b.size
    if abs(n - m) > edits:
        return False
    k = min(n, m)
    same = a[:k] == b[:k]
    head = k if same.all() else int(np.argmin(same))
    return edits_within(a[head:].tolist(), b[head:].tolist(), edits) <= edits


def match_block(train: list[np.ndarray], held: list[np.ndarray], edits: int) -> list[tuple[int, int]]:
    """(training number, held number) of all pairs within the distance, but for pairs of which both have at most ``edits``
    words: those always are."""
    index = WordIndex(held)
    sizes = np.fromiter((t.size for t in train), dtype=np.int64, count=len(train))
    found: set[tuple[int, int]] = set()
    held_sizes = np.fromiter((h.size for h in held), dtype=np.int64, count=len(held))
    for m in np.unique(sizes):
        numbers = np.flatnonzero(sizes == m)
        if m <= edits:  # too short for the pieces: compared with the texts that share a word and are short enough
            words = np.unique(np.concatenate([train[t] for t in numbers])) if m else np.zeros(0, np.uint64)
            near = np.flatnonzero((held_sizes <= m + edits) & (held_sizes > edits))
            holders: dict[int, set[int]] = {}
            for h in near:
                for w in held[h][np.isin(held[h], words)].tolist():
                    holders.setdefault(w, set()).add(int(h))
            for t in numbers:
                near_t = set().union(*(holders.get(w, set()) for w in train[t].tolist()))
                found.update((int(t), h) for h in near_t if within_edits(train[t], held[h], edits))
            continue
        step = max(1, 4_000_000 // int(m * (min(m, LONG_QUESTION) + 1)))
        for at in range(0, numbers.size, step):
            own = numbers[at : at + step]
            words = np.stack([train[t] for t in own])
            q = np.arange(own.size)
            if m <= LONG_QUESTION:
                lo, hi = index.intervals(words)
                bounds = cheapest_pieces(hi - lo, edits + 1)
            else:  # long pieces are rare wherever they are cut
                bounds = np.tile(np.linspace(0, m, edits + 2).astype(np.int64), (own.size, 1))
            for p in range(edits + 1):
                if m <= LONG_QUESTION:
                    a, b = lo[q, bounds[:, p], bounds[:, p + 1]], hi[q, bounds[:, p], bounds[:, p + 1]]
                else:
                    a, b = index.stretch(words[:, bounds[0, p] : bounds[0, p + 1]])
                for part in _runs(b - a, 2_000_000):
                    of, document, offset = index.locate(a[part], b[part])
                    close = (np.abs(offset - bounds[part][of, p]) <= edits) & (np.abs(held_sizes[document] - m) <= edits)
                    pairs = np.unique(np.stack([own[part][of[close]], document[close]]), axis=1)
                    found.update(pair for pair in zip(*pairs.tolist()) if pair not in found and within_edits(train[pair[0]], held[pair[1]], edits))
    return sorted(found)


def _runs(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers in runs whose sizes sum to about ``most``."""
    group = np.cumsum(sizes) // most
    for g in np.unique(group):
        yield np.flatnonzero(group == g)


def common_words(texts: DataFrame, size: int) -> dict[str, int]:
    """Counts of the most frequent words of a bounded sample of texts (column words)."""
    count: Counter = Counter()
    for (words,) in hashed_sample(texts.select("words"), F.xxhash64("words"), ORDER_SAMPLE, size).collect():
        count.update(set(words.split()))
    return dict(count.most_common(COMMON))


def rare_keys(words: list[str], hashes: WordHashes, common: dict[str, int], edits: int) -> list[int]:
    """Keys of which two texts within ``edits`` share one: the pairs of their ``edits + 2`` rarest words, and the single words of
    texts with at most ``edits + 1``. A word that occurs again is another one."""
    seen: Counter = Counter()
    order = []
    for w in words:
        n = seen[w]
        seen[w] += 1
        order.append((common.get(w, 0) >> (2 * n), (hashes[w] + n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    rare = sorted(h for _, h in sorted(order)[: edits + 2])
    pairs = [(x * 0xBF58476D1CE4E5B9 + (y ^ (y >> 29)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF for x, y in combinations(rare, 2)]
    return pairs + (rare if len(words) <= edits + 1 else [])


def near_questions(train: DataFrame, held: DataFrame, edits: int = EDITS, shard: int = SHARD_QUESTIONS, block: int = BLOCK_QUESTIONS) -> DataFrame:
    """(tk, hk): keys of the distinct word sequences (columns k, words) within ``edits`` word edits of each other."""
    key_type = train.schema["k"].dataType.simpleString()
    n_held = held.count()
    n_keys = math.comb(edits + 2, 2) * n_held  # at least, and few more
    shards = max(1, math.ceil(n_keys / shard))
    common = common_words(held, n_held)

    def keyed(x: DataFrame, held_keys: KeyFilter | None = None) -> DataFrame:
        shared = x.sparkSession.sparkContext.broadcast(held_keys) if held_keys is not None else None  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                own = [rare_keys(w.split(), hashes, common, edits) for w in batch.column(1).to_pylist()]
                flat = np.fromiter((h for x in own for h in x), dtype=np.uint64)
                ends = np.cumsum([0, *map(len, own)])
                if shared is not None:
                    keep = shared.value.holds(flat)
                    flat, ends = flat[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["k", "words", "keys"])

        return x.select("k", "words").mapInArrow(run, f"k {key_type}, words string, keys array<bigint>")

    routed = lambda x: x.select("k", "words", F.explode(F.array_distinct(F.transform("keys", lambda v: F.pmod(v, F.lit(shards)).cast("int")))).alias("shard"))
    own = staged(keyed(held))
    h, t = routed(own), staged(routed(keyed(train, KeyFilter.of(own.select(F.explode("keys").alias("v")), n_keys))))
    # one row a shard: the parts of its held side and the blocks of its training side
    size = lambda x, c, most: x.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(c))
    sizes = staged(size(h, "parts", shard).join(size(t, "blocks", block), "shard"))
    of = lambda n: F.pmod(F.xxhash64("k", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    h = h.join(sizes, "shard").select("k", "words", "shard", of("parts").alias("part"), every("blocks").alias("block"))
    t = t.join(sizes, "shard").select("k", "words", "shard", every("parts").alias("part"), of("blocks").alias("block"))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        pairs = match_block([hashes.array(w.split()) for w in a["words"]], [hashes.array(w.split()) for w in b["words"]], edits) if len(a) and len(b) else []
        x = np.asarray(pairs, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"tk": a["k"].to_numpy()[x[:, 0]], "hk": b["k"].to_numpy()[x[:, 1]]})

    keys = ["shard", "part", "block"]
    schema = f"tk {key_type}, hk {key_type}"
    found = t.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInPandas(match, schema)
    # texts of at most ``edits`` words each are never farther apart
    few = lambda x, k: x.where(F.size(F.filter(F.split("words", " "), lambda w: w != "")) <= edits).select(F.col("k").alias(k))
    salt = F.lit(SHORT_PARTS)
    short = few(train, "tk").withColumn("s", F.pmod(F.xxhash64("tk"), salt)).join(few(held, "hk").withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), (salt - 1).cast("bigint")))), "s").select("tk", "hk")
    return found.unionByName(short).distinct()


def split_overlaps(df: DataFrame, id_col: str = "row_id", sample_col: str = "sample_id", question_col: str = "question", split_col: str = "split", train: str = "train", edits: int = EDITS) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: a training row and another whose ids are equal or whose questions are
    within ``edits`` words."""
    words = F.array_join(F.regexp_extract_all(F.lower(df[question_col]), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    src = df.select(df[id_col].alias("id"), F.lower(F.regexp_replace(df[sample_col], r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("sample"), words.alias("words"), (df[split_col] == train).alias("train")).where("train is not null")
    asked = staged(src.where("words is not null").select("id", "words", "train", F.unhex(F.md5("words")).alias("k")))
    a, b = asked.where("train"), asked.where("not train")
    once = staged(asked.groupBy("k").agg(F.min("words").alias("words"), F.bool_or("train").alias("train"), F.bool_or(~F.col("train")).alias("held")))
    near = near_questions(once.where("train").select("k", "words"), once.where("held").select("k", "words"), edits)
    by_question = near.join(a.select(F.col("k").alias("tk"), F.col("id").alias("x")), "tk").join(b.select(F.col("k").alias("hk"), F.col("id").alias("y")), "hk").select("x", "y")
    ids = src.where("sample is not null")
    by_id = ids.where("train").select("sample", F.col("id").alias("x")).join(ids.where("not train").select("sample", F.col("id").alias("y")), "sample").select("x", "y")
    return by_question.unionByName(by_id).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def overlap_counts(pairs: DataFrame, df: DataFrame, id_col: str = "row_id", split_col: str = "split", source_col: str = "data_source") -> DataFrame:
    """(split, data_source, n_rows): rows with an overlap, per split and source."""
    hit = pairs.select(F.explode(F.array("row_id_a", "row_id_b")).alias(id_col)).distinct()
    return df.select(id_col, split_col, source_col).join(hit, id_col, "left_semi").groupBy(split_col, source_col).agg(F.count(F.lit(1)).alias("n_rows"))
