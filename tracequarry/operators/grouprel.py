"""Group-relative statistics: advantages of rollouts against the other rollouts of their prompt.

Every operator takes one row per rollout and adds columns. Statistics of a group are partial aggregates joined
back to its rows, not windows, so that a group with a third of all rows costs no more than any other. A null score gives a null advantage and does not count in its group. Degenerate groups
follow the named estimator: see each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.operators.batch import with_row_number

EPS = 1e-6


def with_group(df: DataFrame, group: str | list[str], **aggregates: Column) -> DataFrame:
    """Adds statistics of each row's group. They come from partial aggregates and are joined back, so a group of
    any size is never gathered in one task: AQE broadcasts a small side or splits a skewed one. Null is a group."""
    keys = [group] if isinstance(group, str) else group
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        same = c if same is None else same & c
    return df.join(stats, same).drop(*[f"_g_{k}" for k in keys])


def group_stats(df: DataFrame, group: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """(group, mean, std, n): sample variance floored at ``eps`` before the root; a single row has mean 0, std 1."""
    s = F.col(score)
    g = df.where(s.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("m"), F.var_samp(s).alias("v"))
    return g.select(group, F.when(F.col("n") > 1, F.col("m")).otherwise(0.0).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest("v", F.lit(eps)))).otherwise(1.0).alias("std"), "n")


def grpo(df: DataFrame, group: str = "uid", score: str = "score", normalize: bool = True, eps: float = EPS, out: str = "adv") -> DataFrame:
    """(score - mean) / (std + eps) with the sample deviation; a single row has mean 0 and std 1. Without
    ``normalize`` only the mean is subtracted."""
    return grpo_scores(df, {out: score}, group, normalize, eps)


def grpo_scores(df: DataFrame, scores: dict[str, str], group: str = "uid", normalize: bool = True, eps: float = EPS, **aggregates: Column) -> DataFrame:
    """``grpo`` of several score columns (by output column), and further statistics of the group, in one aggregate and join."""
    own = {f"_{k}{i}": f(c) for i, c in enumerate(scores.values()) for k, f in (("n", F.count), ("m", F.avg), ("d", F.stddev_samp))}
    x = with_group(df, group, **own, **aggregates)
    for i, (out, score) in enumerate(scores.items()):
        n = F.col(f"_n{i}")
        centred = F.col(score) - F.when(n > 1, F.col(f"_m{i}")).otherwise(0.0)
        x = x.withColumn(out, centred / (F.when(n > 1, F.col(f"_d{i}")).otherwise(1.0) + eps) if normalize else centred)
    return x.drop(*own)


def grpo_floored(df: DataFrame, group: str = "uid", score: str = "score", normalize: bool = True, eps: float = EPS, out: str = "adv") -> DataFrame:
    """As ``grpo``, but the variance is floored at ``eps`` before the root."""
    s, n = F.col(score), F.col("_n")
    x = with_group(df, group, _n=F.count(s), _m=F.avg(s), _v=F.var_samp(s))
    centred = s - F.when(n > 1, F.col("_m")).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.greatest("_v", F.lit(eps)))).otherwise(1.0)
    return x.withColumn(out, centred / (std + eps) if normalize else centred).drop("_n", "_m", "_v")


def pass_at_k(df: DataFrame, group: str = "uid", score: str = "score", order: str = "rid", normalize: bool = True, eps: float = EPS, out: str = "adv") -> DataFrame:
    """Only the best row of a group gets best - second best (by the sample deviation); ties go to the lowest
    ``order``; a group with fewer than two rows is an error in the estimator and gives null here.

    The two best rows of each group are found with a limit that runs before the shuffle.
    """
    s = F.col(score)
    two = df.select(group, score, order).where(s.isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), order))).where("_r <= 2")
    best = two.groupBy(group).agg(F.min_by(order, "_r").alias("_best"), F.max(F.when(F.col("_r") == 2, s)).alias("_second")).withColumnsRenamed({group: "_g"})
    x = with_group(df, group, _n=F.count(s), _d=F.stddev_samp(s)).join(best, F.col(group).eqNullSafe(F.col("_g")), "left")
    gain = s - F.col("_second")
    if normalize:
        gain = gain / (F.col("_d") + eps)
    return x.withColumn(out, F.when(F.col("_n") < 2, F.lit(None)).when(F.col(order) == F.col("_best"), gain).otherwise(0.0)).drop("_n", "_d", "_best", "_second", "_g")


def rloo(df: DataFrame, group: str = "uid", score: str = "score", out: str = "adv") -> DataFrame:
    """Leave-one-out baseline; a single row keeps its score."""
    s, n = F.col(score), F.col("_n")
    x = with_group(df, group, _n=F.count(s), _m=F.avg(s))
    return x.withColumn(out, F.when(n > 1, s * n / (n - 1) - F.col("_m") * n / (n - 1)).otherwise(s)).drop("_n", "_m")


def rloo_batched(df: DataFrame, group: str = "uid", score: str = "score", out: str = "adv") -> DataFrame:
    """The batched form: a single row gets 0."""
    s, n = F.col(score), F.col("_n")
    x = with_group(df, group, _n=F.count(s), _t=F.sum(s))
    return x.withColumn(out, F.when(n > 1, (n * s - F.col("_t")) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)).drop("_n", "_t")


def opo(df: DataFrame, length: str, group: str = "uid", score: str = "score", out: str = "adv") -> DataFrame:
    """Baseline is the length-weighted mean of the group; a single row has baseline 0."""
    s = F.col(score)
    x = with_group(df, group, _n=F.count(s), _b=F.try_divide(F.sum(F.col(length) * s), F.sum(length)))
    return x.withColumn(out, s - F.when(F.col("_n") > 1, F.col("_b")).otherwise(0.0)).drop("_n", "_b")


def gpg(df: DataFrame, group: str = "uid", score: str = "score", f_norm: float = 1.0, out: str = "adv") -> DataFrame:
    """alpha * (score - mean) / f_norm with alpha = rows / max(rows with a score other than 0, 1)."""
    s = F.col(score)
    total = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(s != 0), F.lit(1))).alias("_alpha"))  # one row
    return mean_baseline(df, group, score, "_c").join(F.broadcast(total)).withColumn(out, F.col("_alpha") * F.col("_c") / f_norm).drop("_alpha", "_c")


def mean_baseline(df: DataFrame, group: str = "uid", score: str = "score", out: str = "adv") -> DataFrame:
    """score - group mean; a single row has baseline 0."""
    return grpo(df, group, score, normalize=False, out=out)


def varied_groups(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """Rows of groups whose scores differ (population deviation above 0)."""
    return with_group(df, group, _s=F.stddev_pop(score)).where("_s > 0").drop("_s")


def label_codes(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Codes 0.. of the sorted distinct labels. The labels are ranked alone and joined back."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = with_row_number(codes, label, out=out).withColumn(out, F.col(out).cast("int"))
    return df.join(codes, label, "left")


def masked_moments(value: Column, mask: Column) -> dict[str, Column]:
    """Sums behind a masked mean and variance; values outside the mask, NaN included, are ignored."""
    m = mask.cast("double")
    x = F.when(mask != 0, value)
    return {"n": F.sum(m), "s": F.sum(x * m), "q": F.sum(x * x * m)}


def whiten(df: DataFrame, value: str, mask: str, out: str = "white", shift: bool = True) -> DataFrame:
    """(x - mean) * rsqrt(var + 1e-8) over all masked rows, variance with Bessel's correction; null if fewer than
    two rows are masked. Two aggregates of one row each; the rows are not shuffled."""
    m, x = F.col(mask).cast("double"), F.when(F.col(mask) != 0, F.col(value))
    mean = df.agg((F.sum(x * m) / (F.sum(m) + 1e-8)).alias("_mean"), F.sum(m).alias("_n"))
    centred = df.join(F.broadcast(mean))
    var = centred.agg((F.sum(F.pow(F.when(F.col(mask) != 0, F.col(value) - F.col("_mean")), 2) * m) / (F.first("_n") + 1e-8) * F.try_divide(F.first("_n"), F.first("_n") - 1)).alias("_var"))
    z = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)
    return centred.join(F.broadcast(var)).withColumn(out, z if shift else z + F.col("_mean")).drop("_mean", "_n", "_var")
