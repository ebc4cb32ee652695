"""Words as the training-data operators count them: maximal runs of letters and digits, in lower case."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

find_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


def hashed_sample(rows: DataFrame, key: Column, most: int, size: int | None = None) -> DataFrame:
    """At most ``most`` rows, those with the least hashes ``key`` among a share that holds about four times as many, so that
    few rows leave the scan whatever the number of its partitions. ``size`` is the number of rows where it is known. For fitting
    only: the same rows at every run."""
    names = rows.columns
    keep = max(1, (rows.count() if size is None else size) // (4 * most))
    return rows.withColumn("_key", key).where(F.pmod("_key", F.lit(keep)) == 0).orderBy("_key").limit(most).select(*names)


class WordHashes(dict):
    """word -> stable 64-bit hash, remembered per worker (bounded)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def edits_within(a: list, b: list, limit: int) -> int:
    """Elements inserted, removed or replaced between two lists, up to limit + 1.

    Equal heads and tails are skipped and only a band of the table is filled, so that long lists that differ
    little cost little.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    head, short = 0, min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return min(limit + 1, max(len(a), len(b)))
    far = limit + 1
    row = [j if j <= limit else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - limit), min(len(b), i + limit)
        before = row[low - 1]
        row[low - 1] = i if low == 1 and i <= limit else far
        best = row[low - 1]
        for j in range(low, high + 1):
            now = before if x == b[j - 1] else 1 + min(before, row[j] if j < i + limit else far, row[j - 1])
            before, row[j] = row[j], min(now, far)
            best = min(best, row[j])
        if best > limit:
            return far
    return row[-1]
