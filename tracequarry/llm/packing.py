"""Filling fixed-capacity containers with documents (problem 9).

Method: harmonic packing. An item of n tokens belongs to class k = floor(capacity / n), so any k items of the
class fit together. Each worker fills the containers of each class with the fixed number k of its items, in the order in
which they arrive, independently of every other class and worker: one ``mapInArrow``, fused with the token count,
without a shuffle. Only the last container of a class may hold fewer than k of it.

Plain harmonic containers leave up to 1/(k+1) of their space free. In a second step that space takes items of smaller
classes (those of larger k) of the same worker, the longest that fits first; the number of its own class in a container
stays k. Items used so leave their class before its containers are formed. Items longer than the capacity are cut into full
pieces and a rest; the rest is an ordinary item.

Defined results: null and empty texts are left out; every other document occurs once (or once per piece);
no container exceeds the capacity; ties between equal lengths are broken by input order. A null id keeps
its row. Container ids are (worker, number) pairs in one bigint, stable when a task is run again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracequarry.llm.tokens import TOKENIZER_DIR, WordMemo, broadcast_ranks, word_finder

CAPACITY = 2048
#: Lengths a worker holds at once (12 bytes each); larger partitions are packed in runs of this many.
RUN_ITEMS = 500_000


def harmonic_bins(lengths: np.ndarray, capacity: int = CAPACITY, fill: bool = True) -> np.ndarray:
    """Container number of each item. Items must be 1..capacity long.

    Class by class from the longest items, k consecutive items of class k to a container; with ``fill`` the space left
    takes items of smaller classes.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if lengths.size and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("an item must have between 1 and capacity tokens")
    out = np.full(lengths.size, -1, dtype=np.int64)
    classes = capacity // lengths
    by_class = np.argsort(classes, kind="stable")
    kinds, first = np.unique(classes[by_class], return_index=True)
    by_length = np.argsort(lengths, kind="stable")
    start = np.searchsorted(lengths[by_length], np.arange(capacity + 2))  # first place of each length
    free = np.diff(start, append=lengths.size)  # the items of a length that no container took as filler are its first ones
    below = np.arange(capacity + 2)  # the longest length <= n that still has items: union-find over used lengths
    below[1:][free[1:] == 0] -= 1

    def longest(n: int) -> int:
        root = n
        while below[root] != root:
            root = below[root]
        while below[n] != root:
            below[n], n = root, below[n]
        return int(root)

    number = 0
    for k, a, b in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), lengths.size]):
        own = by_class[a:b]
        own = own[out[own] < 0]
        bins = -(-own.size // k)
        of = np.arange(own.size) // k
        out[own] = number + of
        if fill:
            smaller = capacity // (k + 1)  # the longest item of the classes that follow
            for j, space in enumerate((capacity - np.bincount(of, lengths[own], bins).astype(np.int64)).tolist()):
                while (n := longest(min(space, smaller))) > 0:
                    free[n] -= 1
                    out[by_length[start[n] + free[n]]] = number + j
                    space -= n
                    if free[n] == 0:
                        below[n] = n - 1
        number += bins
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, piece, n_tokens, container_id): where every document, or piece of one, is packed."""
    shared = broadcast_ranks(df, tokenizer_dir)
    src = df.select(df[id_col], df[text_col])
    schema = T.StructType(
        [T.StructField(id_col, src.schema[0].dataType), T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("container_id", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memo = word_finder(), WordMemo(shared.value, count=True)
        get = memo.__getitem__
        worker, number = TaskContext.get().partitionId() << 40, 0
        held: dict[str, list] = defaultdict(list)

        def flush() -> pa.RecordBatch:
            nonlocal number
            sizes = np.asarray(held["size"], dtype=np.int64)
            bins = harmonic_bins(sizes, capacity) if sizes.size else np.zeros(0, np.int64)
            cols = [pa.array(held["id"], type=id_type), pa.array(held["piece"], type=pa.int32()), pa.array(sizes, type=pa.int32()), pa.array(bins + (worker + number), type=pa.int64())]
            number += int(bins.max()) + 1 if sizes.size else 0
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "n_tokens", "container_id"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                total = sum(map(get, find(text)))
                for piece, at in enumerate(range(0, total, capacity)):
                    held["id"].append(key)
                    held["piece"].append(piece)
                    held["size"].append(min(capacity, total - at))
            if len(held["id"]) >= RUN_ITEMS:
                yield flush()
        if held["id"]:
            yield flush()

    return src.mapInArrow(run, schema)
