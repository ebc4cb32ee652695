"""Queries of the retrieval and join-like operators. Query sets are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.operators import retrieval as J
from tracequarry.operators.batch import union_by_position, with_row_number
from tracequarry.plans.registry import Registry
from tracequarry.plans.views import ROLLOUTS_SQL, rollout_rows, rollouts
from tracequarry.session import table

R = Registry()
_Q = "q AS (SELECT row_id AS q, question, sample_id FROM fvqa_toy WHERE row_id % 100 = 0)"


def asked(s, d):
    return table(s, d, "fvqa_toy").where("row_id % 100 = 0").select(F.col("row_id").alias("q"), "question", "sample_id")


def corpus(s, d):
    return table(s, d, "text_corpus").select("corpus_id", F.concat_ws(" ", "title", "snippet").alias("text"), "sample_id")


_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_C = "c AS (SELECT corpus_id AS doc, concat_ws(' ', title, snippet) AS text, sample_id FROM text_corpus)"
R.add(
    "j04_substring_search",
    lambda s, d: J.substring_search(asked(s, d).select("q", "question"), corpus(s, d).select("corpus_id", "text"), 5),
    f"""WITH {_Q}, {_C}, s AS (SELECT q, doc, coalesce(len(list_filter(list_distinct({_TOK.format('question')}), lambda t: contains(lower(text), t))), 0)::DOUBLE AS score FROM q CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
)


def _bm25_sql(k1: float, b: float, idf: str) -> str:
    return f"""WITH {_Q}, {_C}, t AS (SELECT doc, len({_TOK.format('text')}) AS len, unnest({_TOK.format('text')}) AS term FROM c), p AS (SELECT doc, len, term, count(*) AS tf FROM t GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(coalesce(len({_TOK.format('text')}), 0)) AS av FROM c), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
a AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest({_TOK.format('question')}) AS term FROM q) GROUP BY q, term),
s AS (SELECT q, doc, sum(qtf * {idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / av))) AS score FROM p JOIN df USING (term) JOIN a USING (term), st GROUP BY q, doc) """


_A = _bm25_sql(1.5, 0.75, "greatest(0, (n - df + 0.5) / (df + 0.5))")
_B = _bm25_sql(1.2, 0.75, "ln(1 + (n - df + 0.5) / (df + 0.5))")
_TOPK = ", r AS (SELECT q, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc)::INT AS rank FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 5"


def bm25(s, d, logged, k):
    return J.bm25_search(asked(s, d), corpus(s, d), "q", "question", "corpus_id", "text", 1.2 if logged else 1.5, 0.75, logged, k)


R.add("j05_bm25_unlogged", lambda s, d: bm25(s, d, False, 5), _A.rstrip() + _TOPK)
R.add("j05_bm25_logged", lambda s, d: bm25(s, d, True, 5), _B.rstrip() + _TOPK)


@R.query(
    "a26_retrieval_metrics",
    _B.rstrip()
    + """, r AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS rank FROM s WHERE score > 0), g AS (SELECT q.q, min(rank) AS rank FROM q LEFT JOIN (SELECT r.q, r.rank, c.sample_id FROM r JOIN c USING (doc)) x ON x.q = q.q AND x.sample_id = q.sample_id GROUP BY q.q)
SELECT count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS top1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS top3, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS top5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(rank, (SELECT n + 1 FROM st))), 6) AS mean_rank FROM g""",
)
def retrieval_metrics(s, d):
    c = corpus(s, d)
    q = asked(s, d).select("q", F.col("sample_id").alias("sid"))
    relevant = q.join(c.select(F.col("corpus_id").alias("doc"), F.col("sample_id").alias("sid")), "sid").select("q", "doc")
    best = J.bm25_ranks(relevant, asked(s, d), c, "q", "question", "corpus_id", "text", 1.2, 0.75, True)
    return J.rank_metrics(q.join(best, "q", "left"), n_docs=c.count())


R.add(
    "j06_dense_search",
    lambda s, d: J.dense_search(table(s, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding"), table(s, d, "embeddings").select("vec_id", "embedding"), 5).withColumn("score", F.round("score", 5)),
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0),
r AS (SELECT q, doc, round(score, 5) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
)
R.add(
    "j07_visual_search",
    lambda s, d: J.visual_search(*(table(s, d, "offline_doc").where(c).select("odoc_id", "image_dhash", "image_hist") for c in ("odoc_id % 100 = 0", "size(image_dhash) = 64 and size(image_hist) = 24 and not exists(image_dhash, x -> x is null) and not exists(image_hist, x -> x is null)")), 5).withColumn("score", F.round("score", 6)),
    """WITH v AS (SELECT odoc_id AS id, image_dhash AS b, image_hist AS h FROM offline_doc), c AS (SELECT * FROM v WHERE len(b) = 64 AND len(h) = 24 AND len(list_filter(b, lambda x: x IS NULL)) = 0 AND len(list_filter(h, lambda x: x IS NULL)) = 0),
s AS (SELECT q.id AS q, c.id AS doc, round(CASE WHEN len(q.b) = 64 THEN 0.7 * (list_sum(list_transform(range(1, 65), lambda i: coalesce((q.b[i] = c.b[i])::INT, 0))) / 64.0) ELSE 0.0 END
+ CASE WHEN len(q.h) = 24 THEN 0.3 * coalesce(list_sum(list_transform(range(1, 25), lambda i: CASE WHEN q.h[i] IS NULL THEN NULL ELSE least(q.h[i], c.h[i]) END)), 0) ELSE 0.0 END, 6) AS score FROM v q JOIN c ON q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
)

_KEYED = "SELECT sample_id AS k, row_id, latency, coalesce(final_correct, FALSE) AS ok FROM prompted_search_smoke WHERE sample_id IS NOT NULL AND method {}"
_ALIGN = f"WITH a AS ({_KEYED.format("= 'prompted_search'")}), b AS ({_KEYED.format("<> 'prompted_search'")}), x AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_id DESC) = 1), y AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_id DESC) = 1), j AS (SELECT x.k, x.row_id AS a_row_id, y.row_id AS b_row_id, x.ok AS a_ok, y.ok AS b_ok, x.latency AS a_latency, y.latency AS b_latency FROM x JOIN y USING (k)) "


def aligned(s, d):
    r = rollout_rows(s, d).where("sample_id is not null").select(F.col("sample_id").alias("k"), "method", "row_id", "latency", F.coalesce("final_correct", F.lit(False)).alias("ok"))
    return J.align_runs(r.where("method = 'prompted_search'").drop("method"), r.where("method <> 'prompted_search'").drop("method"), "k", "row_id")


R.add("j01_aligned_runs", lambda s, d: aligned(s, d).select("k", "a_row_id", "b_row_id", "a_ok", "b_ok"), _ALIGN + "SELECT k, a_row_id, b_row_id, a_ok, b_ok FROM j")
R.add(
    "a24_search_need_summary",
    lambda s, d: aligned(s, d).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.expr(f"cast({c} as double)")), 6).alias(n) for n, c in (("helpful", "not a_ok and b_ok"), ("unnecessary", "a_ok and b_ok"), ("harmful", "a_ok and not b_ok"), ("hard", "not a_ok and not b_ok"))], F.round(F.avg(F.col("b_latency") - F.col("a_latency")), 6).alias("latency_delta")),
    _ALIGN + "SELECT count(*) AS n, round(avg((NOT a_ok AND b_ok)::INT), 6) AS helpful, round(avg((a_ok AND b_ok)::INT), 6) AS unnecessary, round(avg((a_ok AND NOT b_ok)::INT), 6) AS harmful, round(avg((NOT a_ok AND NOT b_ok)::INT), 6) AS hard, round(avg(b_latency - a_latency), 6) AS latency_delta FROM j",
)
R.add(
    "j02_positional_union",
    lambda s, d: (lambda x: union_by_position(x.select("i", "o_orderkey", "o_custkey"), x.select("i", "o_orderkey", "o_totalprice")).drop("i"))(with_row_number(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", "o_custkey", "o_totalprice")),
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
R.add(
    "j03_edge_lookup",
    lambda s, d: rollout_rows(s, d).select("row_id", "sample_id").join(
        J.last_wins(table(s, d, "fvqa_toy").where("sample_id is not null and metadata.needs_search").select("sample_id", F.col("row_id").alias("edge")), "sample_id", "edge"), "sample_id", "left").select("row_id", "edge"),
    "WITH e AS (SELECT sample_id, max(row_id) AS edge FROM fvqa_toy WHERE sample_id IS NOT NULL AND metadata.needs_search GROUP BY sample_id) SELECT row_id, edge FROM prompted_search_smoke LEFT JOIN e USING (sample_id)",
)
R.add(
    "j11_gather_in_order",
    lambda s, d: asked(s, d).select("q", F.posexplode(F.array(F.col("q"), F.col("q") + 1, F.col("q"))).alias("pos", "doc_id")).join(table(s, d, "documents").select("doc_id", "title"), "doc_id").select("q", "pos", "doc_id", "title"),
    f"WITH {_Q}, g AS (SELECT q, unnest([0, 1, 2])::INT AS pos, unnest([q, q + 1, q]) AS doc_id FROM q) SELECT q, pos, doc_id, title FROM g JOIN documents USING (doc_id)",
)
R.add(
    "j12_support_coverage",
    lambda s, d: rollout_rows(s, d).where("sample_id is not null").select("sample_id").distinct().join(table(s, d, "text_corpus").select("sample_id", F.lit(1).alias("hit")).distinct(), "sample_id", "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage")),
    "WITH s AS (SELECT DISTINCT sample_id FROM prompted_search_smoke WHERE sample_id IS NOT NULL) SELECT count(*) AS n, round(avg((sample_id IN (SELECT sample_id FROM text_corpus WHERE sample_id IS NOT NULL))::INT), 6) AS coverage FROM s",
)
R.add(
    "j13_paired_delta",
    lambda s, d: aligned(s, d).where("a_latency is not null and b_latency is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b_ok").cast("int") - F.col("a_ok").cast("int")), 6).alias("delta")),
    _ALIGN + "SELECT count(*) AS n, round(avg(b_ok::INT - a_ok::INT), 6) AS delta FROM j WHERE a_latency IS NOT NULL AND b_latency IS NOT NULL",
)
R.add(
    "j14_validation_merge",
    lambda s, d: rollouts(s, d).where("pred = 'F'").groupBy("uid").agg(F.round(F.avg("score"), 6).alias("a")).join(rollouts(s, d).where("pred = 'O'").groupBy("uid").agg(F.round(F.avg("score"), 6).alias("b")), "uid", "full"),
    f"WITH {ROLLOUTS_SQL} SELECT uid, a, b FROM (SELECT uid, round(avg(score), 6) AS a FROM rollouts WHERE pred = 'F' GROUP BY uid) FULL JOIN (SELECT uid, round(avg(score), 6) AS b FROM rollouts WHERE pred = 'O' GROUP BY uid) USING (uid)",
)
R.add(
    "j15_deep_equality",
    lambda s, d: table(s, d, "fvqa_toy").select("row_id", F.col("gold_answers").alias("x"), "metadata").join(table(s, d, "fvqa_toy").select((F.col("row_id") - 1).alias("row_id"), F.col("gold_answers").alias("y"), F.col("metadata").alias("m2")), "row_id").select("row_id", F.col("x").eqNullSafe(F.col("y")).alias("same_answers"), F.col("metadata").eqNullSafe(F.col("m2")).alias("same_meta")),
    "SELECT a.row_id, a.gold_answers IS NOT DISTINCT FROM b.gold_answers AS same_answers, a.metadata IS NOT DISTINCT FROM b.metadata AS same_meta FROM fvqa_toy a JOIN fvqa_toy b ON b.row_id = a.row_id + 1",
)
