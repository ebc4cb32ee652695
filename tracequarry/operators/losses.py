"""Policy losses as conditional aggregates over token rows, and off-policy diagnostics.

Token rows carry (key, mask, logp, old_logp, adv). Every loss is a token column; ``aggregate_loss`` reduces it
with one of four denominators in two partial aggregates (per rollout, then one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CLAMP = 20.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def log_ratio(logp: str = "logp", old: str = "old_logp") -> Column:
    return clamp(F.col(logp) - F.col(old), -CLAMP, CLAMP)


def aggregate_loss(df: DataFrame, loss: Column, mode: str = "token-mean", key: str = "rid", mask: str = "mask", horizon: int | None = None) -> DataFrame:
    """One row ``loss``. Fully masked rollouts do not count in the sequence modes; no masked token gives null."""
    m = F.col(mask).cast("double")
    seq = df.groupBy(key).agg(F.sum(F.when(F.col(mask) != 0, loss)).alias("s"), F.sum(m).alias("n"))
    live = F.when(F.col("n") > 0, F.lit(1.0))
    if mode == "token-mean":
        out = F.try_divide(F.sum("s"), F.sum("n"))
    elif mode == "seq-mean-token-sum":
        out = F.try_divide(F.sum(live * F.col("s")), F.sum(live))
    elif mode == "seq-mean-token-mean":
        out = F.try_divide(F.sum(live * F.try_divide(F.col("s"), F.col("n"))), F.sum(live))
    elif mode == "seq-mean-token-sum-norm":
        out = F.try_divide(F.sum("s"), F.lit(float(horizon)) if horizon else F.max("n"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return seq.agg(out.alias("loss"))


def ppo_token(adv: Column, low: float = 0.2, high: float = 0.2, dual: float | None = 3.0) -> Column:
    """Clipped surrogate; with ``dual`` the loss of negative advantages is bounded by -adv * dual."""
    ratio = F.exp(log_ratio())
    loss = F.greatest(-adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(loss, -adv * dual)).otherwise(loss) if dual else loss


def gpg_token(adv: Column) -> Column:
    return -F.col("logp") * adv


def cispo_token(adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    return -clamp(F.exp(log_ratio()), 1 - low, 1 + high) * adv * F.col("logp")


def sapo_token(adv: Column, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """Smooth gate: sigmoid(tau * (ratio - 1)) * 4 / tau in place of a clip."""
    tau = F.when(adv > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    gate = 1 / (1 + F.exp(-tau * (F.exp(log_ratio()) - 1))) * (4.0 / tau)
    return -gate * adv


def dppo_tv_token(adv: Column, low: float = 0.2, high: float = 0.2, cap: float = 20.0) -> Column:
    """Tokens whose probability moved beyond the bound in the direction of the advantage are left out."""
    p, q = F.exp("logp"), F.exp("old_logp")
    valid = F.when(adv > 0, p - q <= high).otherwise(p - q >= -low)
    return -adv * F.least(F.exp(log_ratio()), F.lit(cap)) * F.col("logp") * valid.cast("double")


def dppo_kl_token(adv: Column, bound: float = 0.05, cap: float = 20.0) -> Column:
    """The same with a bound on the binary divergence."""
    p, q = F.exp("logp"), F.exp("old_logp")
    kl = q * (F.col("old_logp") - F.col("logp")) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
    safe = F.when(adv > 0, p <= q).otherwise(p >= q)
    return -adv * F.least(F.exp(log_ratio()), F.lit(cap)) * F.col("logp") * ((kl <= bound) | safe).cast("double")


def value_token(value: str, old_value: str, ret: Column, clip: float = 0.5) -> Column:
    """Half the larger squared error of the value and of the clipped value."""
    v, o = F.col(value), F.col(old_value)
    clipped = F.greatest(F.least(v, o + clip), o - clip)
    return 0.5 * F.greatest(F.pow(v - ret, 2), F.pow(clipped - ret, 2))


def with_sequence_ratio(df: DataFrame, key: str = "rid", mask: str = "mask", cap: float = 10.0, out: str = "seq_ratio") -> DataFrame:
    """exp(masked mean log ratio), the log clamped at ``cap``."""
    w = W.partitionBy(key)
    mean = F.sum(F.when(F.col(mask) != 0, F.col("logp") - F.col("old_logp"))).over(w) / F.greatest(F.sum(F.col(mask)).over(w), F.lit(1))
    return df.withColumn(out, F.exp(F.least(F.coalesce(mean, F.lit(0.0)), F.lit(cap))))


def clipped_ratio_token(ratio: str, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    r = F.col(ratio)
    return F.greatest(-adv * r, -adv * clamp(r, 1 - low, 1 + high))


def importance_weights(df: DataFrame, level: str = "token", cap: float = 2.0, key: str = "rid", mask: str = "mask", out: str = "w") -> DataFrame:
    """Truncated importance weights, times the mask: per token, or per rollout from the clamped sum."""
    d = F.col("old_logp") - F.col("rollout_logp")
    if level == "token":
        w = F.exp(clamp(d, -CLAMP, CLAMP))
    else:
        w = F.exp(clamp(F.sum(F.when(F.col(mask) != 0, d)).over(W.partitionBy(key)), -CLAMP, CLAMP))
    return df.withColumn(out, F.least(w, F.lit(float(cap))) * F.col(mask))


def rejection(df: DataFrame, level: str, kind: str, lower: float | None, upper: float, key: str = "rid", mask: str = "mask", out: str = "keep") -> DataFrame:
    """keep = mask where the divergence is within bounds, per token, or for the sum, mean or maximum of a rollout.

    k1 is compared with logarithms of the bounds (a single value u means 1/u..u), k2 and k3 with the upper bound.
    """
    d = clamp(F.col("old_logp") - F.col("rollout_logp"), -CLAMP, CLAMP)
    value = {"k1": d, "k2": 0.5 * d * d, "k3": F.exp(d) - 1 - d}[kind]
    w = W.partitionBy(key)
    m = F.col(mask)
    x = F.when(m != 0, value)
    if level == "token":
        stat = value
    elif level == "seq_sum":
        stat = F.sum(x).over(w)
    elif level == "seq_mean":
        stat = F.try_divide(F.sum(x).over(w), F.sum(m).over(w))
    else:
        stat = F.max(x).over(w)
    if kind == "k1":
        low, high = F.log(F.lit(lower if lower is not None else 1 / upper)), F.log(F.lit(upper))
        ok = (stat >= low) & (stat <= high)
    else:
        ok = stat <= upper
    return df.withColumn(out, F.coalesce(ok, F.lit(False)).cast("int") * m)


def bypass(df: DataFrame, level: str, kind: str, lower: float | None, upper: float, cap: float = 2.0, key: str = "rid", mask: str = "mask", out: str = "w") -> DataFrame:
    """Where the old log-probabilities are those of the rollout: the mask without rejected tokens, and importance weights of the
    current against the rollout policy. A REINFORCE loss takes the weights, a clipped one the mask only, as its ratio has them."""
    x = df.withColumn("rollout_logp", F.col("old_logp")).withColumn("old_logp", F.col("logp"))
    x = rejection(importance_weights(x, "token", cap, key, mask, out), level, kind, lower, upper, key, mask, "_keep")
    return x.withColumn(mask, F.col("_keep")).withColumn("old_logp", F.col("rollout_logp")).drop("_keep", "rollout_logp")
