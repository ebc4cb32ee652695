"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.operators import rollup as A
from tracequarry.operators.batch import exact_quantiles
from tracequarry.plans.registry import Registry
from tracequarry.plans.views import ROLLOUTS_SQL, STEPS_SQL, TOKENS_SQL, rollout_rows, rollouts, steps, tokens
from tracequarry.session import table

R = Registry()
_P = "prompted_search_smoke"


def r6(c, name):
    return F.round(c, 6).alias(name)


def expr(sql: str):
    return F.expr(sql)


@R.query(
    "a01_rollout_aggregate",
    f"""WITH p AS (SELECT method, coalesce(final_correct, FALSE)::INT AS ok, coalesce(len(steps), 0) AS n, latency, coalesce(len(list_filter(steps, lambda s: coalesce(s.success, TRUE))), 0) AS good FROM {_P})
SELECT method, count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(n), 6) AS avg_steps, round(avg(latency), 6) AS avg_latency, round(avg((n > 2 AND ok = 1)::INT), 6) AS over_search, round(avg((n <= 1 AND ok = 0)::INT), 6) AS under_search,
round(sum(good) / greatest(1, sum(n)), 6) AS step_success, round(avg(ok) / greatest(1, avg(n)), 6) AS answer_per_tool_call FROM p GROUP BY method""",
)
def rollout_aggregate(s, d):
    n, ok = expr("greatest(coalesce(size(steps), 0), 0)"), expr("cast(coalesce(final_correct, false) as int)")
    p = rollout_rows(s, d).select("method", ok.alias("ok"), n.alias("n"), "latency", expr("greatest(coalesce(size(filter(steps, s -> coalesce(s.success, true))), 0), 0)").alias("good"))
    return p.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("ok"), "accuracy"), r6(F.avg("n"), "avg_steps"), r6(F.avg("latency"), "avg_latency"), r6(F.avg(expr("cast(n > 2 and ok = 1 as int)")), "over_search"), r6(F.avg(expr("cast(n <= 1 and ok = 0 as int)")), "under_search"),
        r6(F.sum("good") / F.greatest(F.lit(1), F.sum("n")), "step_success"), r6(F.avg("ok") / F.greatest(F.lit(1.0), F.avg("n")), "answer_per_tool_call"),
    )


R.add(
    "a02_tool_counts",
    lambda s, d: steps(s, d).groupBy("row_id").pivot("tool_type", ["text_search", "image_search", "crop", "stop"]).count().na.fill(0).withColumnsRenamed({k: f"num_{k}" for k in ("text_search", "image_search", "crop", "stop")}),
    f"WITH {STEPS_SQL} SELECT row_id, count(*) FILTER (WHERE tool_type = 'text_search') AS num_text_search, count(*) FILTER (WHERE tool_type = 'image_search') AS num_image_search, count(*) FILTER (WHERE tool_type = 'crop') AS num_crop, count(*) FILTER (WHERE tool_type = 'stop') AS num_stop FROM steps GROUP BY row_id",
)
_EV = "WITH e AS (SELECT *, value - 20 AS g FROM events) "


def events(s, d):
    return table(s, d, "events").withColumn("g", F.col("value") - 20)


R.add(
    "a03_reward_diagnostics",
    lambda s, d: events(s, d).groupBy("event_type").agg(r6(A.mean0(F.col("g")), "mean"), r6(A.std0(F.col("g")), "std"), r6(A.rate(F.col("g") > 0), "positive"), r6(A.pearson(F.col("g"), (F.col("user_id") % 2).cast("double")), "corr")),
    _EV + "SELECT event_type, round(coalesce(avg(g), 0), 6) AS mean, round(coalesce(stddev_pop(g), 0), 6) AS std, round(avg((g > 0)::INT), 6) AS positive, round(coalesce(corr(g, (user_id % 2)::DOUBLE), 0), 6) AS corr FROM e GROUP BY event_type",
)
R.add("a04_mean_std", lambda s, d: events(s, d).where("value < 0").agg(A.mean0(F.col("g")).alias("mean"), A.std0(F.col("g")).alias("std")), "SELECT coalesce(avg(value - 20), 0)::DOUBLE AS mean, coalesce(stddev_pop(value - 20), 0)::DOUBLE AS std FROM events WHERE value < 0")
R.add("a05_pearson_guarded", lambda s, d: events(s, d).groupBy("user_id").agg(r6(A.pearson(F.col("g"), F.lit(1.0)), "constant"), r6(A.pearson(F.col("g"), F.col("event_id").cast("double")), "corr")), "SELECT user_id, 0.0::DOUBLE AS constant, round(CASE WHEN count(*) < 2 THEN 0 ELSE corr(value, event_id::DOUBLE) END, 6) AS corr FROM events GROUP BY user_id")
R.add(
    "a06_logprob_differences",
    lambda s, d: tokens(s, d).where("mask <> 0").select(F.exp("logp").alias("p"), F.exp("old_logp").alias("q")).agg(r6(A.pearson(F.col("p"), F.col("q")), "corr"), r6(F.max(F.abs(F.col("p") - F.col("q"))), "max"), r6(F.avg(F.abs(F.col("p") - F.col("q"))), "mean"), r6(F.stddev_samp(F.abs(F.col("p") - F.col("q"))), "std")),
    f"WITH {TOKENS_SQL}, m AS (SELECT exp(logp) AS p, exp(old_logp) AS q FROM tokens WHERE mask <> 0) SELECT round(corr(p, q), 6) AS corr, round(max(abs(p - q)), 6) AS max, round(avg(abs(p - q)), 6) AS mean, round(stddev_samp(abs(p - q)), 6) AS std FROM m",
)
R.add(
    "a07_mean_of_means",
    lambda s, d: rollouts(s, d).groupBy("source", "uid").agg(F.avg("score").alias("m")).groupBy("source").agg(r6(F.avg("m"), "score")),
    f"WITH {ROLLOUTS_SQL} SELECT source, round(avg(m), 6) AS score FROM (SELECT source, uid, avg(score) AS m FROM rollouts GROUP BY source, uid) GROUP BY source",
)
R.add(
    "a08_validation_by_source",
    lambda s, d: rollout_rows(s, d).select("data_source", expr("0.9 * cast(coalesce(final_correct, false) as double) + 0.1").alias("r"), expr("coalesce(tool_stats['num_text_search'], 0) > 0").alias("t"), expr("coalesce(tool_stats['num_image_search'], 0) > 0").alias("i")).groupBy("data_source").agg(
        r6(F.avg("r"), "reward"), r6(A.rate(F.col("r") > 0.1 + 1e-4), "accuracy"), r6(A.rate(expr("t and not i")), "text_only"), r6(A.rate(expr("i and not t")), "image_only"), r6(A.rate(expr("i and t")), "both"), r6(F.sum(expr("cast(t and r <= 0.1001 as int)")) / (F.sum(expr("cast(t as int)")) + 1e-5), "text_fail")
    ),
    f"""WITH p AS (SELECT data_source, 0.9 * coalesce(final_correct, FALSE)::INT + 0.1 AS r, coalesce(tool_stats['num_text_search'], 0) > 0 AS t, coalesce(tool_stats['num_image_search'], 0) > 0 AS i FROM {_P})
SELECT data_source, round(avg(r::DOUBLE), 6) AS reward, round(avg((r > 0.1001)::INT), 6) AS accuracy, round(avg((t AND NOT i)::INT), 6) AS text_only, round(avg((i AND NOT t)::INT), 6) AS image_only, round(avg((i AND t)::INT), 6) AS both, round(sum((t AND r <= 0.1001)::INT) / (sum(t::INT) + 1e-5), 6) AS text_fail FROM p GROUP BY data_source""",
)


@R.query(
    "a10_data_metrics",
    f"""WITH {ROLLOUTS_SQL}, {TOKENS_SQL}, q AS (SELECT rid, sum(mask) AS len, sum(reward * mask) AS score FROM tokens GROUP BY rid), t AS (SELECT sum((x - m) ** 2) / (count(*) - 1) AS v FROM (SELECT (reward - value) AS x, avg(reward - value) OVER () AS m FROM tokens WHERE mask <> 0)),
u AS (SELECT var_samp(reward) AS v FROM tokens WHERE mask <> 0)
SELECT round(avg(score) FILTER (WHERE len > 0), 6) AS score_mean, round(max(score) FILTER (WHERE len > 0), 6) AS score_max, round(min(score) FILTER (WHERE len > 0), 6) AS score_min, round(avg(len), 6) AS len_mean, round(avg((len = 0)::INT), 6) AS aborted, round(avg((len >= 6)::INT), 6) AS clip_ratio,
(SELECT round(1 - t.v / (u.v + 1e-5), 6) FROM t, u) AS explained_var FROM q""",
)
def data_metrics(s, d):
    t = tokens(s, d)
    q = t.groupBy("rid").agg(F.sum("mask").alias("len"), F.sum(F.col("reward") * F.col("mask")).alias("score"))
    live = F.when(F.col("len") > 0, F.col("score"))
    v = t.where("mask <> 0").agg(r6(1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5), "explained_var"))
    return q.agg(r6(F.avg(live), "score_mean"), r6(F.max(live), "score_max"), r6(F.min(live), "score_min"), r6(F.avg("len"), "len_mean"), r6(A.rate(F.col("len") == 0), "aborted"), r6(A.rate(F.col("len") >= 6), "clip_ratio")).join(F.broadcast(v))


R.add(
    "a11_timing_per_token",
    lambda s, d: tokens(s, d).agg(F.sum("mask").alias("resp"), F.count(F.lit(1)).alias("total")).select(F.explode(F.expr("array(struct('gen' as name, 2.5D as sec), struct('adv' as name, 0.75D as sec), struct('update' as name, 4.25D as sec))")).alias("t"), "resp", "total").select("t.name", F.round(F.col("t.sec") * 1000 / F.when(F.col("t.name") == "gen", F.col("resp")).otherwise(F.col("total")), 9).alias("ms_per_token")),
    f"WITH {TOKENS_SQL}, n AS (SELECT sum(mask) AS resp, count(*) AS total FROM tokens) SELECT name, round(sec * 1000 / CASE WHEN name = 'gen' THEN resp ELSE total END, 9) AS ms_per_token FROM (VALUES ('gen', 2.5::DOUBLE), ('adv', 0.75::DOUBLE), ('update', 4.25::DOUBLE)) v(name, sec), n",
)
R.add("a12_throughput", lambda s, d: tokens(s, d).agg(F.count(F.lit(1)).alias("total_tokens"), r6(F.count(F.lit(1)) / (7.5 * 8), "throughput")), f"WITH {TOKENS_SQL} SELECT count(*) AS total_tokens, round(count(*) / (7.5 * 8)::DOUBLE, 6) AS throughput FROM tokens")
R.add(
    "a13_variance_proxies",
    lambda s, d: tokens(s, d).select("rid", "mask", (F.col("reward") - 0.05).alias("a"), (1 - 2 * F.exp("logp") + F.exp(2 * F.col("logp"))).alias("w")).groupBy("rid").agg(F.sum(F.col("w") * F.col("mask")).alias("w"), F.avg("a").alias("a"), F.sum("mask").alias("n")).agg(
        r6(F.avg(F.col("a") * F.col("a") * F.col("w")), "proxy1"), r6(F.avg(F.greatest(F.col("w"), F.lit(0.0))), "proxy2"), r6(F.avg(F.col("a")), "expected_a")
    ),
    f"WITH {TOKENS_SQL}, q AS (SELECT rid, sum((1 - 2 * exp(logp) + exp(2 * logp)) * mask) AS w, avg(reward - 0.05) AS a FROM tokens GROUP BY rid) SELECT round(avg(a * a * w), 6) AS proxy1, round(avg(greatest(w, 0)), 6) AS proxy2, round(avg(a), 6) AS expected_a FROM q",
)
_RO = f"WITH {ROLLOUTS_SQL} "
R.add(
    "a14_two_level_validation",
    lambda s, d: rollouts(s, d).groupBy("source", "uid").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.stddev_pop("score").alias("sd")).groupBy("source", F.concat(F.lit("mean@"), F.col("n")).alias("metric")).agg(r6(F.avg("m"), "mean"), r6(F.avg("sd"), "std"), F.count(F.lit(1)).alias("groups")),
    _RO + ", g AS (SELECT source, uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS sd FROM rollouts GROUP BY source, uid) SELECT source, 'mean@' || n AS metric, round(avg(m), 6) AS mean, round(avg(sd), 6) AS std, count(*) AS groups FROM g GROUP BY source, n",
)


@R.query(
    "a15_best_of_n",
    _RO
    + """, r AS (SELECT source, uid, score, row_number() OVER (PARTITION BY source, uid ORDER BY score) AS i, row_number() OVER (PARTITION BY source, uid ORDER BY score DESC) AS j, count(*) OVER (PARTITION BY source, uid) AS n FROM rollouts),
g AS (SELECT source, uid, sum(score * (pow(i / n, 2) - pow((i - 1) / n, 2))) AS best2, sum(score * (pow(i / n, 4) - pow((i - 1) / n, 4))) AS best4, sum(score * (pow(j / n, 4) - pow((j - 1) / n, 4))) AS worst4 FROM r GROUP BY source, uid)
SELECT source, round(avg(best2), 6) AS best2, round(avg(best4), 6) AS best4, round(avg(worst4), 6) AS worst4 FROM g GROUP BY source""",
)
def best_of_n(s, d):
    x = rollouts(s, d).withColumn("g", F.concat_ws("|", "source", "uid"))
    g = A.best_of(x, {"best2": (2, False), "best4": (4, False), "worst4": (4, True)}, "score", "g", "rid")
    return g.groupBy(F.substring_index("g", "|", 1).alias("source")).agg(*[r6(F.avg(c), c) for c in ("best2", "best4", "worst4")])


R.add(
    "a16_majority_value",
    lambda s, d: A.majority_value(rollouts(s, d), ["uid"], "pred", "score", "rid").select("uid", r6(F.col("maj"), "maj")),
    _RO + ", v AS (SELECT uid, pred, count(*) AS n, min(rid) AS o, arg_min(score, rid) AS v FROM rollouts GROUP BY uid, pred) SELECT uid, round(v, 6) AS maj FROM v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, o) = 1",
)
_METRIC = "SELECT event_type || CASE user_id % 4 WHEN 0 THEN '/mean' WHEN 1 THEN '/max' WHEN 2 THEN '/min' ELSE '/x' END AS key, value, event_id AS step, user_id FROM events"


def metrics(s, d):
    return table(s, d, "events").select(expr("event_type || case user_id % 4 when 0 then '/mean' when 1 then '/max' when 2 then '/min' else '/x' end").alias("key"), "value", F.col("event_id").alias("step"), "user_id")


R.add(
    "a17_section_routing",
    lambda s, d: rollouts(s, d).select("source", expr("case when uid % 2 = 0 then 'acc' else 'reward' end").alias("var"), expr("array('mean', 'maj', 'best', 'worst')[uid % 4]").alias("kind"), (F.col("uid") % 3 * 2 + 2).alias("n")).distinct().withColumn("top", F.max("n").over(W.partitionBy("source"))).select(
        "source", "var", "kind", "n", expr("case when var = 'acc' and kind in ('mean', 'maj', 'best') and n = top then 'val-core' else 'val-aux' end").alias("section")
    ),
    _RO + ", x AS (SELECT DISTINCT source, CASE WHEN uid % 2 = 0 THEN 'acc' ELSE 'reward' END AS var, ['mean', 'maj', 'best', 'worst'][uid % 4 + 1] AS kind, uid % 3 * 2 + 2 AS n FROM rollouts) SELECT source, var, kind, n, CASE WHEN var = 'acc' AND kind IN ('mean', 'maj', 'best') AND n = max(n) OVER (PARTITION BY source) THEN 'val-core' ELSE 'val-aux' END AS section FROM x",
)
R.add("a18_named_reduction", lambda s, d: A.named_reduction(metrics(s, d), "key", "value").withColumn("value", F.round("value", 6)), f"SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM ({_METRIC}) GROUP BY key")
R.add(
    "a19_ranked_metric",
    lambda s, d: A.ranks_then_all(table(s, d, "events").withColumn("slot", F.col("event_id") % 5), "event_type", "slot", "value", "sum").withColumn("value", F.round("value", 6)),
    "SELECT event_type, round(sum(v), 6) AS value FROM (SELECT event_type, event_id % 5 AS slot, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type",
)
R.add(
    "a20_cross_step",
    lambda s, d: A.cross_step(metrics(s, d), "key", "value", "step").withColumn("value", F.round("value", 6)),
    f"SELECT key, round(CASE WHEN contains(key, 'mean') THEN avg(value) WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE arg_max(value, step) END, 6) AS value FROM ({_METRIC}) GROUP BY key",
)
R.add(
    "a21_batch_statistics",
    lambda s, d: rollout_rows(s, d).agg(r6(F.avg("latency"), "mean"), F.max("latency").alias("max"), F.min("latency").alias("min"), r6(A.rate(F.col("invalid_action") > 0), "partial"), F.countDistinct("data_source").alias("versions")).join(exact_quantiles(rollout_rows(s, d), "latency", {f"p{p}": p / 100 for p in (50, 95, 99)}).select(*[r6(F.col(f"p{p}"), f"p{p}") for p in (50, 95, 99)])),
    f"SELECT round(avg(latency), 6) AS mean, max(latency) AS max, min(latency) AS min, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, round(avg(coalesce((invalid_action > 0)::INT, 0)), 6) AS partial, count(DISTINCT data_source) AS versions FROM {_P}",
)
R.add(
    "a22_log_aggregate",
    lambda s, d: metrics(s, d).where("key like '%/mean' or key like '%/max'").groupBy("key").agg(r6(F.avg("value"), "mean"), F.max("value").alias("max"), F.max_by("value", "step").alias("last")),
    f"SELECT key, round(avg(value), 6) AS mean, max(value) AS max, arg_max(value, step) AS last FROM ({_METRIC}) WHERE key LIKE '%/mean' OR key LIKE '%/max' GROUP BY key",
)
R.add(
    "a23_value_rates",
    lambda s, d: rollout_rows(s, d).agg(r6(A.rate(F.col("final_correct")), "em"), r6(F.sum(expr("coalesce(tool_stats['num_text_search'], 0) + coalesce(tool_stats['num_image_search'], 0)")) / F.greatest(F.lit(1), F.count(F.lit(1))), "any_search_rate")),
    f"SELECT round(avg(coalesce(final_correct, FALSE)::INT), 6) AS em, round(sum(coalesce(tool_stats['num_text_search'], 0) + coalesce(tool_stats['num_image_search'], 0)) / greatest(1, count(*)), 6) AS any_search_rate FROM {_P}",
)
R.add(
    "a25_rollup_with_all",
    lambda s, d: table(s, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean")).select(F.coalesce("event_type", F.lit("all")).alias("task"), "n", "mean"),
    "SELECT coalesce(event_type, 'all') AS task, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type)",
)
R.add(
    "a27_edge_summary",
    lambda s, d: steps(s, d).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("tool_type") == "text_search").cast("int")).alias("sel")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("sel"), "selected"), r6(F.avg("n"), "steps_all"), r6(F.avg(F.when(F.col("sel") == 1, F.col("n"))), "steps_selected")),
    f"WITH {STEPS_SQL}, e AS (SELECT row_id, count(*) AS n, max((tool_type = 'text_search')::INT) AS sel FROM steps GROUP BY row_id) SELECT count(*) AS n, round(avg(sel), 6) AS selected, round(avg(n), 6) AS steps_all, round(avg(n) FILTER (WHERE sel = 1), 6) AS steps_selected FROM e",
)
R.add(
    "a28_eval_summary",
    lambda s, d: rollout_rows(s, d).where("latency is not null and invalid_action = 0").agg(F.count(F.lit(1)).alias("whole_n"), r6(A.rate(F.col("final_correct")), "whole_accuracy")),
    f"SELECT count(*) AS whole_n, round(avg(coalesce(final_correct, FALSE)::INT), 6) AS whole_accuracy FROM {_P} WHERE latency IS NOT NULL AND invalid_action = 0",
)
R.add("a29_cube_counts", lambda s, d: table(s, d, "fvqa_toy").cube("split", "data_source").agg(F.count(F.lit(1)).alias("n")), "SELECT split, data_source, count(*) AS n FROM fvqa_toy GROUP BY CUBE (split, data_source)")
R.add(
    "a30_reward_diagnostic_means",
    lambda s, d: rollout_rows(s, d).select(expr("coalesce(tool_stats['num_text_search'], 0)").alias("t"), expr("coalesce(tool_stats['num_image_search'], 0)").alias("i"), "final_correct").agg(r6(A.rate(F.col("final_correct")), "correct"), r6(A.rate(F.col("t") > 0) + A.rate(F.col("i") > 0), "avg_tool_calls"), r6(A.std0(F.col("t")), "bonus_std")),
    f"SELECT round(avg(coalesce(final_correct, FALSE)::INT), 6) AS correct, round(avg((coalesce(tool_stats['num_text_search'], 0) > 0)::INT) + avg((coalesce(tool_stats['num_image_search'], 0) > 0)::INT), 6) AS avg_tool_calls, round(stddev_pop(coalesce(tool_stats['num_text_search'], 0)), 6) AS bonus_std FROM {_P}",
)
R.add("a31_weighted_merge", lambda s, d: A.weighted_merge(rollout_rows(s, d).withColumn("w", F.col("row_id") % 5 + 1), "data_source", "latency", "w").withColumn("value", F.round("value", 6)), f"SELECT data_source, round(sum(coalesce(latency, 0) * (row_id % 5 + 1)) / sum(row_id % 5 + 1), 6) AS value FROM {_P} GROUP BY data_source")
R.add(
    "a32_imbalance_report",
    lambda s, d: table(s, d, "documents").where("n_chars is not null").groupBy(F.floor(F.col("doc_id") / 128).alias("chunk")).agg(F.sum("n_chars").alias("t")).agg(F.min("t").alias("min"), F.max("t").alias("max"), (F.max("t") - F.min("t")).alias("diff"), r6(F.avg("t"), "mean")),
    "SELECT min(t)::BIGINT AS min, max(t)::BIGINT AS max, (max(t) - min(t))::BIGINT AS diff, round(avg(t), 6) AS mean FROM (SELECT doc_id // 128 AS c, sum(n_chars) AS t FROM documents WHERE n_chars IS NOT NULL GROUP BY c)",
)
R.add(
    "a33_slowest_rollout",
    lambda s, d: rollout_rows(s, d).where("latency is not null").groupBy("method").agg(F.min("latency").alias("min"), F.max("latency").alias("max"), r6(F.avg("latency"), "mean"), F.max(F.struct("latency", (-F.col("row_id")).alias("o"))).alias("m")).select("method", "min", "max", "mean", (-F.col("m.o")).alias("slowest")),
    f"SELECT method, min(latency) AS min, max(latency) AS max, round(avg(latency), 6) AS mean, arg_min(row_id, (-latency, row_id)) AS slowest FROM {_P} WHERE latency IS NOT NULL GROUP BY method",
)
R.add(
    "a36_figure_aggregates",
    lambda s, d: steps(s, d).groupBy("tool_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.size("obs")), "mean_hits")),
    f"WITH {STEPS_SQL} SELECT tool_type, count(*) AS n, round(avg(len(obs)), 6) AS mean_hits FROM steps GROUP BY tool_type",
)
R.add(
    "a37_method_table",
    lambda s, d: rollout_rows(s, d).groupBy("method").agg(r6(A.rate(F.col("final_correct")), "v")).select("method", F.lit("accuracy").alias("measure"), "v").unionByName(rollout_rows(s, d).groupBy("method").agg(r6(F.avg("latency"), "v")).select("method", F.lit("latency").alias("measure"), "v")),
    f"SELECT method, 'accuracy' AS measure, round(avg(coalesce(final_correct, FALSE)::INT), 6) AS v FROM {_P} GROUP BY method UNION ALL SELECT method, 'latency', round(avg(latency), 6) FROM {_P} GROUP BY method",
)
