"""Rewards of ordered tool steps: information gains, propagation to the next step, spreading over tokens.

Step rows carry a rollout key and a position. Windows run per rollout, whose length bounds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.functions.textnorm import word_tokens

# Cost of a call by tool; any other tool costs 1.
TOOL_COSTS = {"text_search": 1.0, "image_search": 1.5, "crop": 0.5, "ocr": 0.8, "select": 0.2, "stop": 0.0}


def tool_cost(tool: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOL_COSTS.items() for x in kv]), tool), F.lit(1.0))


def lexical_logprob(context: Column, target: Column) -> Column:
    """ln(.05 + .9 * coverage) - .02 * missing over target tokens; 0 for an empty target; null context is empty."""
    known, want = F.array_distinct(word_tokens(F.coalesce(F.lower(context), F.lit("")))), word_tokens(F.coalesce(F.lower(target), F.lit("")))
    n = F.size(want)
    hit = F.size(F.filter(want, lambda t: F.array_contains(known, t)))
    return F.when(n == 0, 0.0).otherwise(F.log(0.05 + 0.9 * F.coalesce(F.try_divide(hit, n), F.lit(0.0))) - 0.02 * (n - hit))


def local_gain(real: Column, counterfactual: Column, dead_zone: float = 0.02, negative_scale: float = 0.25) -> Column:
    """Difference with a dead zone, negatives scaled down, clipped to +-2."""
    d = real - counterfactual
    d = F.when(F.abs(d) < dead_zone, 0.0).otherwise(d)
    d = F.when(d < 0, d * negative_scale).otherwise(d)
    return F.greatest(F.least(d, F.lit(2.0)), F.lit(-2.0))


def future_gain(real: Column, counterfactual: Column, dead_zone: float = 0.02) -> Column:
    """Positive part only, with the same dead zone, clipped at 2."""
    d = real - counterfactual
    return F.least(F.greatest(F.when(F.abs(d) < dead_zone, 0.0).otherwise(d), F.lit(0.0)), F.lit(2.0))


def propagated(df: DataFrame, gain: str, link: Column, lam: float, key: str = "key", pos: str = "pos", out: str = "ret") -> DataFrame:
    """gain + lam * link * max(next gain, 0); the last step keeps its gain. One hop only."""
    nxt = F.lead(gain).over(W.partitionBy(key).orderBy(pos))
    return df.withColumn(out, F.col(gain) + F.coalesce(lam * link * F.greatest(nxt, F.lit(0.0)), F.lit(0.0)))


def step_total(df: DataFrame, ret: str, gate: Column, tool: str, alpha: float, beta: float, gamma: float, out: str = "total") -> DataFrame:
    return df.withColumn(out, alpha * F.col(ret) + beta * gate - gamma * tool_cost(F.col(tool)))


def spread_over_tokens(df: DataFrame, key: str, start: Column, end: Column, total: Column, length: int | Column) -> DataFrame:
    """(key, pos, reward): each span's total divided evenly over its positions within [0, length); spans may
    overlap and add up; empty spans give nothing. ``length`` is the number of tokens of the span's rollout."""
    s, e = F.greatest(start, F.lit(0)), F.least(end, length if isinstance(length, Column) else F.lit(length))
    x = df.select(key, s.alias("s"), e.alias("e"), total.alias("t")).where("e > s")
    return x.select(key, F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"), (F.col("t") / (F.col("e") - F.col("s"))).alias("r")).groupBy(key, "pos").agg(F.sum("r").alias("reward"))


def context_before(df: DataFrame, key: str, pos: str, line: Column, out: str = "context") -> DataFrame:
    """Ordered lines of all earlier steps of the rollout."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.array_join(F.collect_list(line).over(w), "\n"), F.lit("")))


def overlong_penalty(n: Column, longest: int, buffer: int, factor: float) -> Column:
    """0 up to longest - buffer, then falling linearly by ``factor`` per buffer."""
    return F.least(-(n - (longest - buffer)) / buffer * factor, F.lit(0.0))


def counterfactuals(df: DataFrame, k: int, key: str, tool: str, size: str, items: str, text: str) -> DataFrame:
    """(key, other, rank): for each step the k best observations of other steps of the same tool, by equal item count,
    then similar length, then id.

    Candidates are the nearest in length among those of equal count: steps are grouped by (tool, count, length)
    and each length meets the lengths around it, so no bucket is paired with itself as a whole. Ties in length go
    to the smaller id; per length the k + 1 smallest ids suffice.
    """
    w = W.partitionBy(tool, items, size).orderBy(key)
    few = df.select(key, tool, items, size, text).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    lengths = few.groupBy(tool, items, size).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    near = W.partitionBy(tool, items).orderBy(size).rowsBetween(-k - 1, k + 1)
    around = lengths.withColumn("near", F.collect_list(F.struct(F.col(size).alias("len"), "ids")).over(near)).select(tool, items, size, "near")
    c = df.select(key, tool, items, size).join(around, [tool, items, size])
    flat = c.select(key, size, F.explode(F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(i.alias("other"), x["len"].alias("len")))))).alias("o")).where(F.col("o.other") != F.col(key))
    best = W.partitionBy(key).orderBy(F.abs(F.col("o.len") - F.col(size)), "o.other")
    return flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(key, F.col("o.other").alias("other"), "rank")
