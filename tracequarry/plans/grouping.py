"""Queries of the group-relative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.operators import grouprel as G
from tracequarry.plans.registry import Registry
from tracequarry.plans.views import ROLLOUTS_SQL, TOKENS_SQL, rollouts, tokens

R = Registry()


@R.query(
    "flagship_grpo_rollup",
    f"""WITH {ROLLOUTS_SQL}, g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS sd, stddev_pop(score) OVER w AS sp FROM rollouts WINDOW w AS (PARTITION BY uid)),
a AS (SELECT *, CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (sd + 1e-6) END AS adv FROM g)
SELECT source AS data_source, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(abs(adv)), 6) AS mean_abs_adv,
    round(avg(CASE WHEN n > 1 AND sp > 0 THEN 1.0 ELSE 0.0 END), 6) AS kept_ratio FROM a GROUP BY source""",
)
def flagship(s, d):
    a = G.grpo_scores(rollouts(s, d), {"adv": "score"}, kept=(F.stddev_pop("score") > 0).cast("double"))
    return a.groupBy(F.col("source").alias("data_source")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg(F.abs("adv")), 6).alias("mean_abs_adv"), F.round(F.avg(F.coalesce("kept", F.lit(0.0))), 6).alias("kept_ratio")
    )


_ADV = "WITH " + ROLLOUTS_SQL + ", g AS (SELECT *, count(score) OVER w AS n, avg(score) OVER w AS m, sum(score) OVER w AS sm, stddev_samp(score) OVER w AS sd, var_samp(score) OVER w AS v FROM rollouts WINDOW w AS (PARTITION BY uid)) "


def advantage(name: str, run, sql: str) -> None:
    R.add(name, lambda s, d: run(rollouts(s, d)).select("rid", F.round("adv", 6).alias("adv")), _ADV + f"SELECT rid, round({sql}, 6) AS adv FROM g")


advantage("w01_grpo", G.grpo, "CASE WHEN n > 1 THEN (score - m) / (sd + 1e-6) ELSE score / (1 + 1e-6) END")
advantage("w02_grpo_floored", G.grpo_floored, "CASE WHEN n > 1 THEN (score - m) / (sqrt(greatest(v, 1e-6)) + 1e-6) ELSE score / (1 + 1e-6) END")
advantage("w03_grpo_switch_off", lambda x: G.grpo(x, normalize=False), "CASE WHEN n > 1 THEN score - m ELSE score END")
advantage("w04_mean_only", G.mean_baseline, "CASE WHEN n > 1 THEN score - m ELSE score END")
advantage("w08_rloo", G.rloo, "CASE WHEN n > 1 THEN score * n / (n - 1) - m * n / (n - 1) ELSE score END")
advantage("w09_rloo_batched", G.rloo_batched, "CASE WHEN n > 1 THEN (n * score - sm) / greatest(n - 1, 1) ELSE 0 END")
advantage("w11_gpg", G.gpg, "(SELECT count(*)::DOUBLE / greatest(count(*) FILTER (WHERE score <> 0), 1) FROM rollouts) * CASE WHEN n > 1 THEN score - m ELSE score END")

_RANKED = "WITH " + ROLLOUTS_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rid) AS rn, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd FROM rollouts WINDOW w AS (PARTITION BY uid)), q AS (SELECT *, max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY uid) AS s2 FROM r) "
R.add(
    "w06_pass_at_k",
    lambda s, d: G.pass_at_k(rollouts(s, d)).select("rid", F.round("adv", 6).alias("adv")),
    _RANKED + "SELECT rid, round(CASE WHEN n < 2 THEN NULL WHEN rn = 1 THEN (score - s2) / (sd + 1e-6) ELSE 0 END, 6) AS adv FROM q",
)
R.add(
    "w10_opo",
    lambda s, d: G.opo(rollouts(s, d).withColumn("len", F.col("rid") % 7 + 1), "len").select("rid", F.round("adv", 6).alias("adv")),
    "WITH " + ROLLOUTS_SQL + ", g AS (SELECT rid, score, count(*) OVER w AS n, sum((rid % 7 + 1) * score) OVER w / sum(rid % 7 + 1) OVER w AS b FROM rollouts WINDOW w AS (PARTITION BY uid)) SELECT rid, round(CASE WHEN n > 1 THEN score - b ELSE score END, 6) AS adv FROM g",
)
R.add(
    "a34_group_stats",
    lambda s, d: G.group_stats(rollouts(s, d)).select("uid", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n"),
    "WITH " + ROLLOUTS_SQL + " SELECT uid, round(CASE WHEN count(*) > 1 THEN avg(score) ELSE 0 END, 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(greatest(var_samp(score), 1e-6)) ELSE 1 END, 6) AS std, count(*) AS n FROM rollouts GROUP BY uid",
)
R.add(
    "p20_varied_groups",
    lambda s, d: G.varied_groups(rollouts(s, d)).select("uid", "rid"),
    "WITH " + ROLLOUTS_SQL + ", g AS (SELECT uid, rid, stddev_pop(score) OVER (PARTITION BY uid) AS sp FROM rollouts) SELECT uid, rid FROM g WHERE sp > 0",
)
R.add(
    "a35_label_codes",
    lambda s, d: G.label_codes(rollouts(s, d), "source").select("rid", "code"),
    "WITH " + ROLLOUTS_SQL + " SELECT rid, (dense_rank() OVER (ORDER BY source) - 1)::INT AS code FROM rollouts",
)
_WHITE = """, mm AS (SELECT sum(x) FILTER (WHERE mask <> 0) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM v),
vv AS (SELECT sum((x - mean) ** 2) FILTER (WHERE mask <> 0) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM v, mm)"""
R.add(
    "w17_whiten",
    lambda s, d: G.whiten(tokens(s, d), "reward", "mask").select("rid", "pos", F.round("white", 6).alias("white")),
    f"WITH {TOKENS_SQL}, v AS (SELECT *, reward AS x FROM tokens){_WHITE} SELECT rid, pos, round((x - mean) / sqrt(var + 1e-8), 6) AS white FROM v, mm, vv",
)


@R.query(
    "w05_gdpo",
    f"""WITH {ROLLOUTS_SQL}, k AS (SELECT *, (rid % 11)::DOUBLE AS r2 FROM rollouts), g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m1, stddev_samp(score) OVER w AS s1, avg(r2) OVER w AS m2, stddev_samp(r2) OVER w AS s2 FROM k WINDOW w AS (PARTITION BY uid)),
a AS (SELECT rid, 0.7 * CASE WHEN n > 1 THEN (score - m1) / (s1 + 1e-6) ELSE score / (1 + 1e-6) END + 0.3 * CASE WHEN n > 1 THEN (r2 - m2) / (s2 + 1e-6) ELSE r2 / (1 + 1e-6) END AS a FROM g),
{TOKENS_SQL}, v AS (SELECT t.rid, t.pos, t.mask, a.a AS x FROM tokens t JOIN a USING (rid)){_WHITE}
SELECT rid, pos, round((x - mean) / sqrt(var + 1e-8) * mask, 6) AS adv FROM v, mm, vv""",
)
def gdpo(s, d):
    r = rollouts(s, d).withColumn("r2", (F.col("rid") % 11).cast("double"))
    r = G.grpo_scores(r, {"a1": "score", "a2": "r2"}).select("rid", (0.7 * F.col("a1") + 0.3 * F.col("a2")).alias("x"))
    t = tokens(s, d).select("rid", "pos", "mask").join(r, "rid")
    return G.whiten(t, "x", "mask").select("rid", "pos", F.round(F.col("white") * F.col("mask"), 6).alias("adv"))


R.add(
    "w07_reinforce_baseline",
    lambda s, d: G.whiten(tokens(s, d).select("rid", "pos", "mask").join(G.mean_baseline(rollouts(s, d)).select("rid", "adv"), "rid"), "adv", "mask").select("rid", "pos", F.round(F.col("white") * F.col("mask"), 6).alias("adv")),
    f"""WITH {ROLLOUTS_SQL}, g AS (SELECT rid, score, count(*) OVER w AS n, avg(score) OVER w AS m FROM rollouts WINDOW w AS (PARTITION BY uid)), {TOKENS_SQL},
v AS (SELECT t.rid, t.pos, t.mask, CASE WHEN n > 1 THEN score - m ELSE score END AS x FROM tokens t JOIN g USING (rid)){_WHITE} SELECT rid, pos, round((x - mean) / sqrt(var + 1e-8) * mask, 6) AS adv FROM v, mm, vv""",
)
