"""Queries along tokens: returns, masks, divergences, losses, off-policy diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.operators import losses as L
from tracequarry.operators import sampling as P
from tracequarry.operators import seqscan as S
from tracequarry.operators.batch import with_row_number
from tracequarry.plans.registry import Registry
from tracequarry.plans.views import ROLLOUTS_SQL, TOKENS_SQL, rollouts, tokens

R = Registry()
_T = f"WITH {TOKENS_SQL}"


def r6(c, name):
    return F.round(c, 6).alias(name)


def wide(s, d):
    return S.to_wide(tokens(s, d), "rid", "pos", ["reward", "value", "mask"])


R.add(
    "w12_gae",
    lambda s, d: S.to_long(wide(s, d).select("rid", S.gae(F.col("reward"), F.col("value"), F.col("mask"), 0.99, 0.95).alias("a"), "value"), "rid", ["a", "value"]).select("rid", "pos", r6(F.col("a"), "adv"), r6(F.col("a") + F.col("value"), "ret")),
    f"""WITH RECURSIVE {TOKENS_SQL}, n AS (SELECT rid, max(pos) AS last FROM tokens GROUP BY rid),
g AS (SELECT t.rid, t.pos, CASE WHEN mask <> 0 THEN value ELSE 0.0 END AS v, CASE WHEN mask <> 0 THEN reward - value ELSE 0.0 END AS a, value FROM tokens t JOIN n ON t.rid = n.rid AND t.pos = n.last
UNION ALL SELECT t.rid, t.pos, CASE WHEN t.mask <> 0 THEN t.value ELSE g.v END, CASE WHEN t.mask <> 0 THEN t.reward + 0.99 * g.v - t.value + 0.99 * 0.95 * g.a ELSE g.a END, t.value FROM g JOIN tokens t ON t.rid = g.rid AND t.pos = g.pos - 1)
SELECT rid, pos, round(a, 6) AS adv, round(a + value, 6) AS ret FROM g""",
)
R.add(
    "w13_discounted_returns",
    lambda s, d: S.to_long(wide(s, d).select("rid", S.discounted_returns(F.col("reward"), F.col("mask"), 0.9).alias("g")), "rid", ["g"]).select("rid", "pos", r6(F.col("g"), "ret")),
    f"""WITH RECURSIVE {TOKENS_SQL}, n AS (SELECT rid, max(pos) AS last FROM tokens GROUP BY rid),
g AS (SELECT t.rid, t.pos, reward AS g, mask FROM tokens t JOIN n ON t.rid = n.rid AND t.pos = n.last
UNION ALL SELECT t.rid, t.pos, t.reward + 0.9 * g.g * g.mask, t.mask FROM g JOIN tokens t ON t.rid = g.rid AND t.pos = g.pos - 1) SELECT rid, pos, round(g, 6) AS ret FROM g""",
)
R.add(
    "w14_remax",
    lambda s, d: S.suffix_sum(tokens(s, d), F.col("reward") * F.col("mask")).select("rid", "pos", r6(F.col("ret"), "ret"), r6(F.col("ret") - 0.05 * F.col("mask"), "adv")),
    _T + ", g AS (SELECT rid, pos, mask, sum(reward * mask) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tokens) SELECT rid, pos, round(ret, 6) AS ret, round(ret - 0.05 * mask, 6) AS adv FROM g",
)


def otb(s, d, compact):
    t = tokens(s, d).join(rollouts(s, d).select("rid", "uid"), "rid")
    weight = 1 - 2 * F.exp("logp") + F.exp(2 * F.col("logp"))
    x = S.optimal_token_baseline(t, weight, compact=compact)
    return x.where("mask = 1").select("rid", "pos", r6(F.col("base"), "base"), r6(F.col("adv"), "adv"))


def _otb_sql(slot: str) -> str:
    return f"""WITH {ROLLOUTS_SQL}, {TOKENS_SQL}, t AS (SELECT k.*, r.uid, sum(reward * mask) OVER (PARTITION BY k.rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
sum((1 - 2 * exp(logp) + exp(2 * logp)) * mask) OVER (PARTITION BY k.rid ORDER BY pos) AS w, sum(mask) OVER (PARTITION BY k.rid ORDER BY pos) AS slot FROM tokens k JOIN rollouts r USING (rid)),
n AS (SELECT uid, count(DISTINCT rid) AS n FROM t GROUP BY uid),
b AS (SELECT t.*, CASE WHEN n > 1 THEN sum(g * w * mask) OVER p / (sum(w * mask) OVER p + 1e-8) ELSE 0 END AS base FROM t JOIN n USING (uid) WINDOW p AS (PARTITION BY uid, {slot}))
SELECT rid, pos, round(base, 6) AS base, round((g - base) * mask, 6) AS adv FROM b WHERE mask = 1"""


R.add("w15_optimal_token_baseline", lambda s, d: otb(s, d, False), _otb_sql("pos"))
R.add("w16_multi_turn_baseline", lambda s, d: otb(s, d, True), _otb_sql("slot"))
R.add(
    "w18_masked_moments",
    lambda s, d: tokens(s, d).groupBy("rid").agg(
        r6(F.sum(F.when(F.col("mask") != 0, F.col("reward"))), "s"), r6(F.sum(F.when(F.col("mask") != 0, F.col("reward"))) / (F.sum("mask") + 1e-8), "mean"), F.round(F.var_samp(F.when(F.col("mask") != 0, F.col("reward"))), 6).alias("var")
    ),
    _T + " SELECT rid, round(sum(reward) FILTER (WHERE mask <> 0), 6) AS s, round(sum(reward) FILTER (WHERE mask <> 0) / (sum(mask) + 1e-8), 6) AS mean, round(var_samp(reward) FILTER (WHERE mask <> 0), 6) AS var FROM tokens GROUP BY rid",
)
R.add(
    "w19_eos_mask",
    lambda s, d: S.eos_mask(tokens(s, d), F.col("mask") == 0).select("rid", "pos", "eos_mask"),
    _T + " SELECT rid, pos, (coalesce(sum((mask = 0)::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS eos_mask FROM tokens",
)
R.add(
    "w20_mask_slice",
    lambda s, d: wide(s, d).select("rid", F.expr("array_join(slice(mask, -least(3, size(mask)), 3), ',')").alias("tail")),
    _T + " SELECT rid, string_agg(mask::VARCHAR, ',' ORDER BY pos) AS tail FROM (SELECT *, max(pos) OVER (PARTITION BY rid) AS last FROM tokens) WHERE pos > last - 3 GROUP BY rid",
)
R.add(
    "w21_kl_shaping",
    lambda s, d: tokens(s, d).select("rid", "pos", *[r6(F.col("reward") - 0.1 * S.kl_estimate(F.col("logp"), F.col("old_logp"), k) * F.col("mask"), k) for k in ("k1", "abs", "k2", "k3")]),
    _T
    + """ SELECT rid, pos, round(reward - 0.1 * d * mask, 6) AS k1, round(reward - 0.1 * abs(d) * mask, 6) AS abs, round(reward - 0.1 * 0.5 * d * d * mask, 6) AS k2,
round(reward - 0.1 * greatest(least(exp(e) - e - 1, 10), -10) * mask, 6) AS k3 FROM (SELECT *, logp - old_logp AS d, greatest(least(old_logp - logp, 20), -20) AS e FROM tokens)""",
)
R.add(
    "w22_kl_in_reward",
    lambda s, d: tokens(s, d).select("rid", "pos", r6(F.col("reward") - (F.col("old_logp") - F.col("logp")) * 0.2, "shaped")),
    _T + " SELECT rid, pos, round(reward - (old_logp - logp) * 0.2, 6) AS shaped FROM tokens",
)


@R.query(
    "w23_adaptive_kl",
    f"""WITH RECURSIVE {TOKENS_SQL}, k AS (SELECT pos, avg(abs(logp - old_logp)) AS kl FROM tokens GROUP BY pos),
b AS (SELECT pos, 0.1 * (1 + greatest(least(kl / 0.05 - 1, 0.2), -0.2) * 8 / 100) AS beta FROM k WHERE pos = 0
UNION ALL SELECT k.pos, b.beta * (1 + greatest(least(k.kl / 0.05 - 1, 0.2), -0.2) * 8 / 100) FROM b JOIN k ON k.pos = b.pos + 1) SELECT pos, round(beta, 9) AS beta FROM b""",
)
def adaptive_kl(s, d):
    k = tokens(s, d).groupBy("pos").agg(F.avg(F.abs(F.col("logp") - F.col("old_logp"))).alias("kl"))
    one = k.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kl"))), lambda x: x["kl"]).alias("kls"))
    return one.select(F.posexplode(S.adaptive_coefficient(F.col("kls"), 0.1, 0.05, 100, 8)).alias("pos", "beta")).select("pos", F.round("beta", 9).alias("beta"))


R.add(
    "w24_mask_segments",
    lambda s, d: S.mask_segments(tokens(s, d)),
    _T
    + """, b AS (SELECT *, (mask = 1 AND coalesce(lag(mask) OVER w, 0) <> 1)::INT AS b FROM tokens WINDOW w AS (PARTITION BY rid ORDER BY pos)), c AS (SELECT *, sum(b) OVER (PARTITION BY rid ORDER BY pos) AS k FROM b)
SELECT rid, (k - 1)::INT AS segment, min(pos) AS seg_start, max(pos) + 1 AS seg_end FROM c WHERE mask = 1 GROUP BY rid, k""",
)

_ADV = "(reward - 0.05)"
_AGG = {
    "token-mean": "sum(s) / sum(n)",
    "seq-mean-token-sum": "sum(s) FILTER (WHERE n > 0) / count(*) FILTER (WHERE n > 0)",
    "seq-mean-token-mean": "sum(s / n) FILTER (WHERE n > 0) / count(*) FILTER (WHERE n > 0)",
    "seq-mean-token-sum-norm": "sum(s) / max(n)",
}
_LR = "greatest(least(logp - old_logp, 20), -20)"


def loss(name: str, column, sql: str, mode: str = "token-mean", prepare=lambda x: x, extra: str = "", source: str = "tokens") -> None:
    R.add(
        name,
        lambda s, d: L.aggregate_loss(prepare(tokens(s, d)), column(F.col("reward") - 0.05), mode).select(r6(F.col("loss"), "loss")),
        f"WITH {TOKENS_SQL}{extra}, l AS (SELECT rid, mask, {sql} AS x FROM {source}), q AS (SELECT rid, sum(x) FILTER (WHERE mask <> 0) AS s, sum(mask) AS n FROM l GROUP BY rid) SELECT round({_AGG[mode]}, 6) AS loss FROM q",
    )


_PPO = f"greatest(-{_ADV} * exp({_LR}), -{_ADV} * greatest(least(exp({_LR}), 1.2), 0.8))"
for _mode in _AGG:
    loss("l00_agg_" + _mode.replace("-", "_"), lambda a: L.ppo_token(a, dual=None), _PPO, _mode)
loss("l01_ppo_dual_clip", L.ppo_token, f"CASE WHEN {_ADV} < 0 THEN least({_PPO}, -{_ADV} * 3) ELSE {_PPO} END")
loss("l06_gpg", L.gpg_token, f"-logp * {_ADV}")
loss("l10_cispo", L.cispo_token, f"-greatest(least(exp({_LR}), 1.2), 0.8) * {_ADV} * logp")
loss("l05_sapo", L.sapo_token, f"-(1 / (1 + exp(-(CASE WHEN {_ADV} > 0 THEN 1.0 ELSE 1.05 END) * (exp({_LR}) - 1))) * 4 / (CASE WHEN {_ADV} > 0 THEN 1.0 ELSE 1.05 END)) * {_ADV}")
loss("l03_dppo_tv", lambda a: L.dppo_tv_token(a, 0.03, 0.03), f"-{_ADV} * least(exp({_LR}), 20) * logp * (CASE WHEN {_ADV} > 0 THEN exp(logp) - exp(old_logp) <= 0.03 ELSE exp(logp) - exp(old_logp) >= -0.03 END)::INT")
loss(
    "l03_dppo_kl",
    lambda a: L.dppo_kl_token(a, 0.01),
    f"""-{_ADV} * least(exp({_LR}), 20) * logp * (exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * ln((1 - exp(old_logp) + 1e-8) / (1 - exp(logp) + 1e-8)) <= 0.01
OR CASE WHEN {_ADV} > 0 THEN exp(logp) <= exp(old_logp) ELSE exp(logp) >= exp(old_logp) END)::INT""",
)
_SEQ = ", z AS (SELECT *, exp(least(coalesce(sum(logp - old_logp) FILTER (WHERE mask <> 0) OVER (PARTITION BY rid) / greatest(sum(mask) OVER (PARTITION BY rid), 1), 0), {cap})) AS r FROM tokens)"
loss("l04_gspo", lambda a: L.clipped_ratio_token("seq_ratio", a, 0.01, 0.02), f"greatest(-{_ADV} * r, -{_ADV} * greatest(least(r, 1.02), 0.99))", "seq-mean-token-mean", L.with_sequence_ratio, _SEQ.format(cap=10), "z")
loss("l09_geo_mean", lambda a: -F.col("seq_ratio") * a, f"-r * {_ADV}", "seq-mean-token-mean", lambda x: L.with_sequence_ratio(x, cap=0.4), _SEQ.format(cap=0.4), "z")
loss("l11_value", lambda a: L.value_token("value", "reward", F.col("qty") / 50, 0.01), "0.5 * greatest((value - qty / 50) ** 2, (greatest(least(value, reward + 0.01), reward - 0.01) - qty / 50) ** 2)")
loss("l11_entropy", lambda a: -(F.exp("logp") * F.col("logp")), "-(exp(logp) * logp)")
loss("l12_reinforce_weighted", lambda a: -a * F.col("logp") * F.least(F.exp(L.log_ratio("old_logp", "logp")), F.lit(2.0)), f"-{_ADV} * logp * least(exp(greatest(least(old_logp - logp, 20), -20)), 2)")


_BYPASS = ", y AS (SELECT * REPLACE (mask * (round(logp - old_logp, 12) BETWEEN round(ln(0.95), 12) AND round(ln(1.05), 12))::INT AS mask) FROM tokens)"


def bypassed(x):
    return L.bypass(x, "token", "k1", 0.95, 1.05)


loss("l12_bypass_reinforce", lambda a: -a * F.col("logp") * F.col("w"), f"-{_ADV} * logp * least(exp(greatest(least(logp - old_logp, 20), -20)), 2)", "token-mean", bypassed, _BYPASS, "y")
loss("l12_bypass_clipped", lambda a: L.ppo_token(a, dual=None), _PPO, "token-mean", bypassed, _BYPASS, "y")


@R.query(
    "l02_trajectory_ppo",
    f"""WITH {TOKENS_SQL}, q AS (SELECT rid, greatest(least(sum(logp - old_logp) FILTER (WHERE mask <> 0), 20), -20) AS lr, arg_min(reward - 0.05, pos) FILTER (WHERE mask <> 0 AND reward - 0.05 <> 0) AS adv FROM tokens GROUP BY rid)
SELECT round(avg(greatest(-adv * exp(lr), -adv * greatest(least(exp(lr), 1.2), 0.8))), 6) AS loss FROM q""",
)
def trajectory_ppo(s, d):
    live = F.col("mask") != 0
    a = F.col("reward") - 0.05
    q = tokens(s, d).groupBy("rid").agg(L.clamp(F.sum(F.when(live, F.col("logp") - F.col("old_logp"))), -20, 20).alias("lr"), F.min_by(a, F.when(live & (a != 0), F.col("pos"))).alias("adv"))
    r = F.exp("lr")
    return q.agg(r6(F.avg(F.greatest(-F.col("adv") * r, -F.col("adv") * L.clamp(r, 0.8, 1.2))), "loss"))


@R.query(
    "l08_kl_cov",
    f"""WITH {TOKENS_SQL}, m AS (SELECT avg(reward) AS ma, avg(logp) AS ml, count(*) AS n FROM tokens WHERE mask <> 0),
c AS (SELECT rid, pos, row_number() OVER (ORDER BY round((reward - ma) * (logp - ml), 9) DESC, rid, pos) AS rn, n FROM tokens, m WHERE mask <> 0) SELECT rid, pos FROM c WHERE rn <= ceil(0.01 * n)""",
)
def kl_cov(s, d):
    """Tokens with the largest covariance of advantage and log-probability (the top 1 %)."""
    t = tokens(s, d).where("mask <> 0")
    m = t.agg(F.avg("reward").alias("ma"), F.avg("logp").alias("ml"), F.ceil(0.01 * F.count(F.lit(1))).cast("int").alias("k"))
    k = m.first()["k"]
    c = t.join(F.broadcast(m)).withColumn("cov", F.round((F.col("reward") - F.col("ma")) * (F.col("logp") - F.col("ml")), 9))
    return with_row_number(c, F.desc("cov"), "rid", "pos").where(F.col("i") < k).select("rid", "pos")


@R.query(
    "l07_clip_cov",
    f"""WITH {TOKENS_SQL}, m AS (SELECT avg(reward) AS ma, avg(logp) AS ml, greatest(floor(0.01 * count(*)), 1) AS k FROM tokens WHERE mask <> 0),
c AS (SELECT rid, pos, k, row_number() OVER (ORDER BY md5('42|' || rid || '|' || pos)) AS rn FROM tokens, m WHERE mask <> 0 AND round((reward - ma) * (logp - ml), 9) BETWEEN -0.002 AND -0.0005) SELECT rid, pos FROM c WHERE rn <= k""",
)
def clip_cov(s, d):
    """As many tokens as 1 % of all, at random, of those inside a band of covariance."""
    t = tokens(s, d).where("mask <> 0")
    m = t.agg(F.avg("reward").alias("ma"), F.avg("logp").alias("ml"), F.greatest(F.floor(0.01 * F.count(F.lit(1))), F.lit(1)).alias("k"))
    c = t.join(F.broadcast(m)).withColumn("cov", F.round((F.col("reward") - F.col("ma")) * (F.col("logp") - F.col("ml")), 9)).where("cov between -0.002 and -0.0005")
    return P.seeded_order(c, 42, "rid", "pos").where("i < k").select("rid", "pos")


_OFF = f"WITH {TOKENS_SQL}, t AS (SELECT *, logp AS rollout_logp, greatest(least(old_logp - logp, 20), -20) AS dl FROM tokens), m AS (SELECT * FROM t WHERE mask <> 0), "


def off_tokens(s, d):
    return tokens(s, d).withColumn("rollout_logp", F.col("logp"))


@R.query(
    "w39_offpolicy_metrics",
    _OFF
    + """q AS (SELECT rid, exp(-avg(old_logp)) AS ppl, exp(-avg(rollout_logp)) AS rppl, avg(old_logp) - avg(rollout_logp) AS lppl, exp(greatest(least(2 * sum(dl), 20), -20)) AS chi FROM m GROUP BY rid)
SELECT round(avg(ppl), 6) AS training_ppl, round(avg(rppl), 6) AS rollout_ppl, round(avg(lppl), 6) AS log_ppl_diff, round(max(lppl), 6) AS log_ppl_diff_max, round(avg(chi) - 1, 6) AS chi2_seq,
(SELECT round(avg(rollout_logp - old_logp), 6) FROM m) AS kl, (SELECT round(avg(exp(dl) - dl - 1), 6) FROM m) AS k3_kl, (SELECT round(avg(exp(2 * dl)) - 1, 6) FROM m) AS chi2_token FROM q""",
)
def offpolicy(s, d):
    dl = L.log_ratio("old_logp", "rollout_logp")
    q = off_tokens(s, d).where("mask <> 0").groupBy("rid").agg(
        F.exp(-F.avg("old_logp")).alias("ppl"), F.exp(-F.avg("rollout_logp")).alias("rppl"), (F.avg("old_logp") - F.avg("rollout_logp")).alias("lppl"), F.exp(L.clamp(2 * F.sum(dl), -20, 20)).alias("chi"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rollout_logp") - F.col("old_logp")).alias("kl"), F.sum(F.exp(dl) - dl - 1).alias("k3"), F.sum(F.exp(2 * dl)).alias("c2"),
    )
    return q.agg(
        r6(F.avg("ppl"), "training_ppl"), r6(F.avg("rppl"), "rollout_ppl"), r6(F.avg("lppl"), "log_ppl_diff"), r6(F.max("lppl"), "log_ppl_diff_max"), r6(F.avg("chi") - 1, "chi2_seq"),
        r6(F.sum("kl") / F.sum("n"), "kl"), r6(F.sum("k3") / F.sum("n"), "k3_kl"), r6(F.sum("c2") / F.sum("n") - 1, "chi2_token"),
    )


for _level, _stat in (("token", "v"), ("seq_sum", "sum(v) FILTER (WHERE mask <> 0) OVER p"), ("seq_mean", "sum(v) FILTER (WHERE mask <> 0) OVER p / nullif(sum(mask) OVER p, 0)"), ("seq_max", "max(v) FILTER (WHERE mask <> 0) OVER p")):
    for _kind, _v, _ok in (("k1", "dl", "x BETWEEN ln(0.95) AND ln(1.05)"), ("k2", "0.5 * dl * dl", "x <= 0.00103"), ("k3", "exp(dl) - 1 - dl", "x <= 0.00103")):
        if (_level, _kind) == ("seq_max", "k1"):
            continue
        R.add(
            f"w40_reject_{_level}_{_kind}",
            lambda s, d, a=_level, k=_kind: L.rejection(off_tokens(s, d), a, k, 0.95 if k == "k1" else None, 1.05 if k == "k1" else 0.00103).select("rid", "pos", "keep"),
            _OFF + f"u AS (SELECT *, {_v} AS v FROM t), x AS (SELECT rid, pos, mask, round({_stat}, 12) AS x FROM u WINDOW p AS (PARTITION BY rid)) SELECT rid, pos, coalesce({_ok}, FALSE)::INT * mask AS keep FROM x",
        )


@R.query(
    "w41_rejection_metrics",
    _OFF + "z AS (SELECT round(avg(dl), 6) AS mean, round(max(dl), 6) AS max, round(min(dl), 6) AS min, round(stddev_pop(dl), 6) AS std, round(avg((dl > 0.04)::INT), 6) AS frac_high, round(avg((dl < -0.04)::INT), 6) AS frac_low FROM m) SELECT * FROM z",
)
def rejection_metrics(s, d):
    t = off_tokens(s, d).where("mask <> 0").withColumn("dl", L.log_ratio("old_logp", "rollout_logp"))
    return t.agg(r6(F.avg("dl"), "mean"), r6(F.max("dl"), "max"), r6(F.min("dl"), "min"), r6(F.stddev_pop("dl"), "std"), r6(F.avg((F.col("dl") > 0.04).cast("int")), "frac_high"), r6(F.avg((F.col("dl") < -0.04).cast("int")), "frac_low"))


R.add("w42_is_weights_token", lambda s, d: L.importance_weights(off_tokens(s, d), "token", 1.03).select("rid", "pos", r6(F.col("w"), "w")), _OFF + "z AS (SELECT rid, pos, round(least(exp(dl), 1.03) * mask, 6) AS w FROM t) SELECT * FROM z")
R.add(
    "w42_is_weights_sequence",
    lambda s, d: L.importance_weights(off_tokens(s, d), "sequence", 1.1).select("rid", "pos", r6(F.coalesce("w", F.lit(0.0)), "w")),
    _OFF + "z AS (SELECT rid, pos, round(coalesce(least(exp(greatest(least(sum(old_logp - logp) FILTER (WHERE mask <> 0) OVER (PARTITION BY rid), 20), -20)), 1.1) * mask, 0), 6) AS w FROM t) SELECT * FROM z",
)
R.add(
    "w43_effective_sample_size",
    lambda s, d: off_tokens(s, d).where("mask <> 0").select(F.exp(L.log_ratio("old_logp", "rollout_logp")).alias("w")).agg(r6(F.avg("w"), "mean"), r6(F.pow(F.avg("w"), 2) / F.avg(F.col("w") * F.col("w")), "ess")),
    _OFF + "z AS (SELECT exp(dl) AS w FROM m) SELECT round(avg(w), 6) AS mean, round(avg(w) ** 2 / avg(w * w), 6) AS ess FROM z",
)
