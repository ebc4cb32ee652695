"""Balanced partitions of a batch's items (sequence lengths or workloads).

The cores work on one batch, whose size is the training batch size and so bounded; ``by_batch`` applies one to
every batch of a table at once (one group per batch).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def workload(n: int) -> int:
    return 24576 * n + n * n


def _key(parts: list[tuple]) -> tuple:
    """Heap order: the largest spread first, then the largest first part."""
    total, size, items = parts[0]
    return (parts[-1][0] - total, -total, -size, tuple((-i, -v) for i, v in items))


def differencing(values: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing method (Karmarkar and Karp): k parts of indices, sorted, none empty.

    A state is k parts (sum, size, items) in descending order; the two states of largest spread are combined,
    largest part with smallest. With ``equal_size`` all parts get the same number of items.
    """
    n = len(values)
    if n < k:
        raise ValueError(f"{n} items for {k} parts")
    if equal_size and n % k:
        raise ValueError(f"{n} items do not divide into {k} parts")
    ranked = sorted(range(n), key=lambda i: (values[i], i))
    groups = [ranked[a : a + k] for a in range(0, n, k)] if equal_size else [[i] for i in ranked]
    heap: list[tuple] = []
    for number, group in enumerate(groups):
        parts = [(values[i], 1, [(i, values[i])]) for i in group] + [(0, 0, [])] * (k - len(group))
        parts.sort(reverse=True)
        heap.append((_key(parts), number, parts))
    heapq.heapify(heap)
    number = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (_key(parts), number, parts))
        number += 1
    out = [sorted(i for i, _ in items) for _, _, items in heap[0][2]]
    if not all(out):
        raise ValueError("a part is empty")
    return out


def greedy(values: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item in turn to the part with the smallest sum so far (the first of equals)."""
    bias = sum(values) + 1 if equal_size else 0
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, j) for j in range(k)]
    for i, v in enumerate(values):
        total, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (total + v + bias, j))
    return parts


def micro_batches(lengths: Sequence[int], most: int, divisor: int = 1, least: int = 1) -> list[list[int]]:
    """As few micro-batches as ``most`` tokens each allow on average, balanced by workload, small ones at both ends."""
    if max(lengths) > most:
        raise ValueError("an item exceeds the micro-batch")
    count = max(least, min(len(lengths), math.ceil(sum(lengths) / most)))
    count = math.ceil(count / divisor) * divisor
    work = [workload(n) for n in lengths]
    parts = sorted(differencing(work, count), key=lambda p: (sum(work[i] for i in p), p[0]), reverse=True)
    return parts[::2][::-1] + parts[1::2]


def keep_groups(lengths: Sequence[int], groups: Sequence, k: int) -> list[list[int]]:
    """k parts with the same number of runs of equal group id, each run whole."""
    runs: list[list[int]] = []
    for i, g in enumerate(groups):
        if i and g == groups[i - 1]:
            runs[-1].append(i)
        else:
            runs.append([i])
    return [sorted(i for r in part for i in runs[r]) for part in differencing([sum(workload(lengths[i]) for i in r) for r in runs], k, equal_size=True)]


def balance_batch(lengths: Sequence[int], k: int, groups: Sequence | None = None, minibatch: int | None = None) -> list[list[int]]:
    """k parts of equal size for k workers, in the order in which each works.

    Plain: parts of equal size and similar workload. ``minibatch``: each run of so many items is balanced on its own, so that
    a worker's part is in minibatches. ``groups``: runs of equal group stay whole, the number of runs must divide. But for
    groups, small items stand at both ends of a part.
    """
    work = [workload(n) for n in lengths]
    if groups is not None:
        return keep_groups(lengths, groups, k)
    if minibatch:
        if len(lengths) % minibatch:
            raise ValueError(f"{len(lengths)} items do not divide into minibatches of {minibatch}")
        parts: list[list[int]] = [[] for _ in range(k)]
        for at in range(0, len(lengths), minibatch):
            for j, own in enumerate(differencing(work[at : at + minibatch], k, equal_size=True)):
                parts[j] += [at + i for i in own]
    else:
        parts = differencing(work, k, equal_size=True)
    ranked = [sorted(p, key=lambda i: (work[i], i)) for p in parts]
    return [p[::2] + p[1::2][::-1] for p in ranked]


def by_batch(df: DataFrame, batch: str, item: str, value: str, parts: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """(batch, item, part, place): items of every batch, in order of item, assigned by a core above; ``place`` is that within
    the part. An item that is in no part, or in two, raises."""
    src = df.select(batch, item, value)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item).reset_index(drop=True)
        found = [(i, p, at) for p, members in enumerate(parts(pdf[value].astype(int).tolist())) for at, i in enumerate(members)]
        if sorted(i for i, _, _ in found) != list(range(len(pdf))):
            raise ValueError("every item must be in one part")
        found.sort()
        return pdf[[batch, item]].assign(part=[p for _, p, _ in found], place=[at for _, _, at in found])

    return src.groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {item} {kinds[item]}, part int, place int")
