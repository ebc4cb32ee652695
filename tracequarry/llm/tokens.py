"""Whole-corpus encoding with a public byte-level BPE vocabulary (problem 8).

Method: contiguous rank array. Each short word keeps its part boundaries and the ranks of adjacent part
pairs in two flat lists; the smallest rank is found by a scan, its boundary is deleted and the two
neighbouring ranks are refreshed. Words over ``LONG_WORD`` bytes give the same ids through a heap, so that
a text without spaces stays near-linear.

Plan: one ``mapInArrow`` over the scan, no shuffle. The vocabulary (a file of fixed size, about 0.8 MB) is
read on the driver and broadcast; its path is a parameter.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; the id column passes through unchanged, nulls and repeats included; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("TQ_TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of this vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 2000
#: Words remembered per Python worker; the memo is emptied when full, results do not depend on it.
MEMO_WORDS = 400_000
_NO_RANK = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string to rank, from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    adjacent = [get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NO_RANK:
            break
        i = adjacent.index(least)
        del adjacent[i], bounds[i + 1]
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], _NO_RANK)
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a very long word: linked parts and a heap of (rank, place)."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    get = ranks.get

    def pair(i: int) -> int:
        j = end[i]
        return get(word[i : end[j]], _NO_RANK) if j < n else _NO_RANK

    heap = [(r, i) for i in range(n - 1) if (r := pair(i)) < _NO_RANK]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or pair(i) != r:
            continue
        j = end[i]
        alive[j], end[i] = False, end[j]
        if end[i] < n:
            before[end[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (q := pair(k)) < _NO_RANK:
                heapq.heappush(heap, (q, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class WordMemo(dict):
    """word -> ids (or their number); a missing word is encoded once."""

    def __init__(self, ranks: dict[bytes, int], count: bool = False):
        super().__init__()
        self.ranks, self.count = ranks, count

    def __missing__(self, word: str):
        raw = word.encode("utf-8")
        one = self.ranks.get(raw)
        if one is not None:
            ids = (one,)
        else:
            ids = tuple((merge_scan if len(raw) <= LONG_WORD else merge_heap)(raw, self.ranks))
        value = len(ids) if self.count else ids
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def broadcast_ranks(df: DataFrame, directory: str, name: str = VOCABULARY) -> Broadcast:
    """The vocabulary as a broadcast of fixed size."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(os.path.join(directory, name)))


def word_finder():
    import regex

    return regex.compile(WORD_PATTERN).findall


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids array<int>): the ids of every text exactly as stored."""
    shared = broadcast_ranks(df, tokenizer_dir)
    src = df.select(df[id_col], df[text_col])
    kind = src.schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memo = word_finder(), WordMemo(shared.value)
        get = memo.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat: list[np.ndarray] = []
                sizes = np.zeros(part.num_rows + 1, dtype=np.int32)
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text:
                        ids = np.fromiter(chain.from_iterable(map(get, find(text))), dtype=np.int32)
                        flat.append(ids)
                        sizes[i + 1] = len(ids)
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), type=pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return src.mapInArrow(run, schema)
