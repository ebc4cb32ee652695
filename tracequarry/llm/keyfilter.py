"""A Bloom filter of bounded size over the keys of one side of a join, applied before the other side is shuffled.

It loses no key. Where the keys are more than the filter is made for, it lets more of the other side through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of the filter a key, and in all (32 MB); slices in which it is built.
BITS_A_KEY, FILTER_BITS, SLICES = 16, 1 << 28, 16


class KeyFilter:
    """Bloom filter over key values: two bits each."""

    def __init__(self, slices: dict[int, bytes], bits: int):
        self.bits = np.uint64(bits)
        size = bits // 8 // SLICES
        self.map = np.frombuffer(b"".join(slices.get(i, b"\0" * size) for i in range(SLICES)), dtype=np.uint8)

    @staticmethod
    def places(v: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return v % bits, (v >> np.uint64(32)) % bits

    def holds(self, v: np.ndarray) -> np.ndarray:
        out = np.ones(v.shape, bool)
        for at in self.places(v, self.bits):
            out &= (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, size: int | None = None) -> KeyFilter:
        """The filter of a table with a bigint column v; ``size`` is about the number of its rows where it is known."""
        bits = 1 << max(16, math.ceil(math.log2(max(1, keys.count() if size is None else size) * BITS_A_KEY)))
        bits = min(bits, FILTER_BITS)
        part = bits // SLICES

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(cls.places(batch.column(0).to_numpy().view(np.uint64), np.uint64(bits))))
                yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(part)).astype(np.int32)), pa.array(at.astype(np.int64))], names=["slice", "at"])

        def fill(own: pd.DataFrame) -> pd.DataFrame:
            n = int(own["slice"].iloc[0])
            on = np.zeros(part, np.uint8)
            on[own["at"].to_numpy() - n * part] = 1
            return pd.DataFrame({"slice": [n], "map": [np.packbits(on, bitorder="little").tobytes()]})

        # distinct bits: a slice has at most ``part`` rows
        spots = keys.select("v").mapInArrow(places, "slice int, at bigint").distinct()
        return cls({r["slice"]: bytes(r["map"]) for r in spots.groupBy("slice").applyInPandas(fill, "slice int, map binary").collect()}, bits)
