"""Counterfactual observations from a pool of all steps of the same tool, hard negatives first.

The pool holds each (tool, step, action) once, by its smallest key. For a step the others of its tool are ranked by
hard negative, equal item count, nearest length and key; the first k are taken, missing ones are masked.

Plan: the pool is cut into blocks of ``BLOCK`` rows and the steps into chunks of ``CHUNK``; each chunk meets each
block of its tool, which returns its k best, and a window takes the k best of all blocks. Inside a block nothing is
paired as a whole: rows are met outwards from the step's length until k are found, and where few rows share a
word with the step these are looked up instead.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, CHUNK, FEW = 50_000, 20_000, 400
FIELDS = ("key", "tool", "items", "size", "step", "action", "evidence", "answer", "semantic", "image")


def entity_tokens(action: str | None, evidence: str | None) -> frozenset[str]:
    return frozenset(t.lower() for t in f"{action or ''} {evidence or ''}".replace("_", " ").split() if len(t) > 2)


def hard_negative(tool: str | None, a: dict, b: dict) -> bool:
    """Looks relevant to the step and still says something else; what that means depends on the tool."""
    if a["answer"] and b["answer"] and a["answer"] != b["answer"]:
        return True
    if tool in ("text_search", "ocr"):
        return (a["evidence"] or "") != (b["evidence"] or "") and not a["tokens"].isdisjoint(b["tokens"])
    if tool == "image_search":
        return a["semantic"] != b["semantic"] and not a["tokens"].isdisjoint(b["tokens"])
    if tool == "select":
        return (a["action"] or "") != (b["action"] or "")
    return tool == "crop" and a["image"] == b["image"]


def _rows(frame: pd.DataFrame) -> list[dict]:
    rows = frame[list(FIELDS)].astype(object).where(frame[list(FIELDS)].notna(), None).to_dict("records")
    for r in rows:
        r["tokens"] = entity_tokens(r["action"], r["evidence"])
    return rows


class Block:
    """Pool rows of one tool, by item count and length, with the rows of each word."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: (r["size"], r["key"]))
        self.of: dict[int, list[int]] = {}
        self.having: dict[str, list[int]] = {}
        self.image: dict[str | None, list[int]] = {}
        for i, r in enumerate(self.rows):
            self.of.setdefault(r["items"], []).append(i)
            self.image.setdefault(r["image"], []).append(i)
            for t in r["tokens"]:
                self.having.setdefault(t, []).append(i)
        self.sizes = {n: np.array([self.rows[i]["size"] for i in own]) for n, own in self.of.items()}
        self.answers, self.semantics = {r["answer"] for r in self.rows}, {r["semantic"] for r in self.rows}

    def outwards(self, items: int, size: int) -> Iterator[tuple[int, int, int]]:
        """(distance, key, row) of the rows of an item count, nearest length first, then by key."""
        own, sizes = self.of[items], self.sizes[items]
        left = right = int(np.searchsorted(sizes, size))
        entry = lambda d, i: (d, self.rows[own[i]]["key"], own[i])
        while left > 0 or right < len(own):
            d = min(size - int(sizes[left - 1]) if left else math.inf, int(sizes[right]) - size if right < len(own) else math.inf)
            low, high = int(np.searchsorted(sizes, size - d)), int(np.searchsorted(sizes, size + d, side="right"))
            yield from heapq.merge((entry(d, i) for i in range(low, left)), (entry(d, i) for i in range(right, high)))
            left, right = low, high

    def ranked(self, q: dict) -> Iterator[tuple[int, int, int, int]]:
        """(1 if the item count differs, distance, key, row) in order."""
        if q["items"] in self.of:
            yield from ((0, *x) for x in self.outwards(q["items"], q["size"]))
        yield from ((1, *x) for x in heapq.merge(*[self.outwards(n, q["size"]) for n in self.of if n != q["items"]]))

    def few_hard(self, q: dict) -> set[int] | None:
        """A small set that holds all hard negatives; None if it is not small."""
        if q["answer"] and self.answers - {None, q["answer"]}:
            return None
        if q["tool"] in ("text_search", "ocr", "image_search"):
            if q["tool"] == "image_search" and not self.semantics - {q["semantic"]}:
                return set()
            lists = [self.having.get(t, ()) for t in q["tokens"]]
            return set(chain(*lists)) if sum(map(len, lists)) <= FEW else None
        if q["tool"] == "crop":
            own = self.image.get(q["image"], ())
            return set(own) if len(own) <= FEW else None
        return None if q["tool"] == "select" else set()

    def best(self, q: dict, k: int) -> list[tuple[int, int, int, int]]:
        """(0 if hard, 1 if the item count differs, distance, key) of the k best."""
        allowed: Callable[[int], bool] = lambda i: not (self.rows[i]["step"] == q["step"] and self.rows[i]["action"] == q["action"])
        hard = lambda i: hard_negative(q["tool"], q, self.rows[i])
        few = self.few_hard(q)
        if few is None:
            found = [(0, *x[:3]) for x in islice((x for x in self.ranked(q) if allowed(x[3]) and hard(x[3])), k)]
        else:
            found = sorted((0, int(r["items"] != q["items"]), abs(r["size"] - q["size"]), r["key"]) for i in few if allowed(i) and hard(i) for r in (self.rows[i],))[:k]
        if len(found) < k:
            found += [(1, *x[:3]) for x in islice((x for x in self.ranked(q) if allowed(x[3]) and not hard(x[3])), k - len(found))]
        return found


def typed_counterfactuals(df: DataFrame, k: int) -> DataFrame:
    """(key, other, rank, hard, masked): exactly k rows for each step; ``other`` is null where the pool is too small.

    ``df`` has the columns FIELDS; keys are unique bigints, ``items`` and ``size`` not null.
    """
    df = df.select(F.col("key").cast("bigint").alias("key"), "tool", F.col("items").cast("bigint").alias("items"), F.greatest(F.col("size").cast("bigint"), F.lit(1)).alias("size"), *[c for c in FIELDS[4:]])
    pool = df.groupBy("tool", "step", "action").agg(F.min_by(F.struct(*FIELDS), "key").alias("r")).select("r.*")
    most = lambda x, size: max(1, math.ceil((x.groupBy("tool").count().agg(F.max("count")).first()[0] or 0) / size))
    blocks, chunks = most(pool, BLOCK), most(df, CHUNK)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = pool.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))
    asked = df.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))

    def match(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            block = Block(_rows(p))
            for row in _rows(q):
                out += [(row["key"], *x) for x in block.best(row, k)]
        return pd.DataFrame(out, columns=["key", "soft", "differs", "distance", "other"])

    keys = ["tool", "block", "chunk"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(match, "key bigint, soft int, differs int, distance bigint, other bigint")
    w = W.partitionBy("key").orderBy("soft", "differs", "distance", "other")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("key", "rank", "other", (F.col("soft") == 0).alias("hard"))
    slots = df.select("key", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(top, ["key", "rank"], "left").select("key", "other", "rank", F.coalesce("hard", F.lit(False)).alias("hard"), F.col("other").isNull().alias("masked"))
