"""Operators along the tokens of a rollout.

Two interchangeable shapes: *long* (one row per token: rollout, position) for statistics across rollouts, and
*wide* (arrays) for recurrences, which are one pass over a row's arrays in Arrow batches, without a shuffle.
Null values count as missing; an empty array gives an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_wide(df: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    """(key, one array per column in order of position)."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *columns))).alias("_t"))
    return g.select(key, *[F.col(f"_t.{c}").alias(c) for c in columns])


def to_long(df: DataFrame, key: str, columns: list[str], pos: str = "pos") -> DataFrame:
    """The inverse: one row per token."""
    return df.select(key, F.posexplode(F.arrays_zip(*columns)).alias(pos, "_t")).select(key, pos, *[F.col(f"_t.{c}").alias(c) for c in columns])


def _scan(start: Callable[[int], tuple], step: Callable[..., tuple], *arrays: Column, backwards: bool) -> Column:
    """One pass over arrays of equal length, all rows of a batch at once: ``step`` takes the state and the values at one
    place and gives the new state and the result there. Numbers are doubles; a null element counts as 0, a null array
    gives null. Time is in proportion to the length."""

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        absent = np.zeros(len(columns[0]), bool)
        for c in columns:
            absent |= c.is_null().to_numpy(zero_copy_only=False)
        keep = pa.array(~absent)
        lists = [c.filter(keep) for c in columns]
        size = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = [x.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for x in lists]
        ends = np.cumsum(size)
        order = np.argsort(-size, kind="stable")  # the longest first: those that go on are a prefix
        out, going = np.zeros(ends[-1] if size.size else 0), size[order]
        state = tuple(np.asarray(x, dtype=np.float64) for x in start(size.size))
        place = (ends - 1 if backwards else ends - size)[order]
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-going, -t, side="left"))  # rows longer than t
            at = place[:n] - t if backwards else place[:n] + t
            state, out[at] = step(tuple(x[:n] for x in state), *(v[at] for v in values))
        offsets = np.zeros(len(absent) + 1, np.int32)
        offsets[1:][~absent] = size
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(out), mask=pa.array(absent)) if len(absent) else pa.array([], type=pa.list_(pa.float64()))

    return run(*[F.transform(a, lambda x: x.cast("double")) for a in arrays])


def discounted_returns(reward: Column, mask: Column, gamma: float) -> Column:
    """G_t = r_t + gamma * G_{t+1}, reset to 0 after a position outside the mask; arrays in, array out."""

    def step(state, r, m):
        now = r + gamma * state[0]
        return (now * m,), now

    return _scan(lambda n: (np.zeros(n),), step, reward, mask, backwards=True)


def gae(reward: Column, value: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening: outside the mask both the next value and the running advantage are
    held, not updated."""

    def step(state, r, own, m):
        v, a = state
        a = np.where(m != 0, r + gamma * v - own + gamma * lam * a, a)
        return (np.where(m != 0, own, v), a), a

    return _scan(lambda n: (np.zeros(n), np.zeros(n)), step, reward, value, mask, backwards=True)


def suffix_sum(df: DataFrame, value: Column, key: str = "rid", pos: str = "pos", out: str = "ret") -> DataFrame:
    """Sum from each position to the end of its rollout."""
    return df.withColumn(out, F.sum(value).over(W.partitionBy(key).orderBy(pos).rowsBetween(0, W.unboundedFollowing)))


def eos_mask(df: DataFrame, is_end: Column, key: str = "rid", pos: str = "pos", out: str = "eos_mask") -> DataFrame:
    """1 up to and including the first end token."""
    before = F.coalesce(F.sum(is_end.cast("int")).over(W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(out, (before == 0).cast("int"))


def mask_segments(df: DataFrame, mask: str = "mask", key: str = "rid", pos: str = "pos") -> DataFrame:
    """(key, segment, seg_start, seg_end): runs of masked positions, end exclusive, numbered from 0."""
    w = W.partitionBy(key).orderBy(pos)
    begins = (F.col(mask) == 1) & (F.coalesce(F.lag(mask).over(w), F.lit(0)) != 1)
    s = df.select(key, pos, mask, begins.cast("int").alias("_b")).withColumn("_s", F.sum("_b").over(w)).where(F.col(mask) == 1)
    return s.groupBy(key, (F.col("_s") - 1).cast("int").alias("segment")).agg(F.min(pos).alias("seg_start"), (F.max(pos) + 1).alias("seg_end"))


def optimal_token_baseline(df: DataFrame, weight: Column, group: str = "uid", key: str = "rid", pos: str = "pos", mask: str = "mask", reward: str = "reward", compact: bool = False) -> DataFrame:
    """Advantage of each token against the variance-optimal baseline of its group and position.

    W_t is the running sum of the token weights (masked), G_t the return from t on; the baseline of a position is
    sum(G W m) / (sum(W m) + 1e-8) over the group, 0 for a group of one rollout. ``compact`` numbers the masked
    tokens only, so that the turns of different rollouts meet.
    """
    by_key = W.partitionBy(key).orderBy(pos)
    m = F.col(mask).cast("double")
    x = df.withColumn("_g", F.sum(F.col(reward) * m).over(by_key.rowsBetween(0, W.unboundedFollowing))).withColumn("_w", F.sum(weight * m).over(by_key.rowsBetween(W.unboundedPreceding, 0)))
    slot = pos
    if compact:
        x = x.withColumn("_slot", F.sum(F.col(mask)).over(by_key.rowsBetween(W.unboundedPreceding, 0)))
        slot = "_slot"
    sizes = df.select(group, key).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    at = x.groupBy(group, slot).agg((F.sum(F.col("_g") * F.col("_w") * m) / (F.sum(F.col("_w") * m) + 1e-8)).alias("_b"))
    x = x.join(at, [group, slot]).join(sizes, group).withColumn("base", F.when(F.col("_n") > 1, F.col("_b")).otherwise(0.0))
    return x.withColumn("adv", (F.col("_g") - F.col("base")) * m)


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """k1, abs, k2 (mse) or k3 (low variance, clamped) estimate of the divergence per token."""
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        e = F.greatest(F.least(ref - logp, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(e) - e - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"unknown estimate {kind!r}")


def adaptive_coefficient(kls: Column, start: float, target: float, horizon: float, n: float) -> Column:
    """The coefficient after each step: multiplied by 1 + clip(kl / target - 1, +-0.2) * n / horizon. Arrays in step order."""

    def step(state, kl):
        now = state[0] * (1 + np.clip(kl / target - 1, -0.2, 0.2) * (n / horizon))
        return (now,), now

    return _scan(lambda rows: (np.full(rows, float(start)),), step, kls, backwards=False)
