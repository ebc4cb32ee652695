"""Queries of batch algebra, row adapters, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.functions import textnorm as N
from tracequarry.operators import batch as B
from tracequarry.operators import sampling as P
from tracequarry.plans.registry import Registry
from tracequarry.plans.textual import strip
from tracequarry.plans.views import TOKENS_SQL, rollout_rows, tokens
from tracequarry.session import table

R = Registry()
_P = "prompted_search_smoke"
_D = "d AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"


def docs(s, d):
    return B.with_row_number(table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")


def q(name, run, sql):
    R.add(name, run, sql)


q("b01_repeat_interleaved", lambda s, d: B.repeat(docs(s, d), 3).select("i", "doc_id"), f"WITH {_D} SELECT i * 3 + j AS i, doc_id FROM d, range(3) t(j)")
q("b01_repeat_tiled", lambda s, d: B.repeat(docs(s, d), 3, interleave=False).select("i", "doc_id"), f"WITH {_D} SELECT j * (SELECT count(*) FROM d) + i AS i, doc_id FROM d, range(3) t(j)")
q("b02_repeat_each", lambda s, d: B.repeat_each(docs(s, d), (F.col("n_chars") % 3).cast("int")).select("doc_id", "copy"), f"WITH {_D} SELECT doc_id, unnest(range(1, n_chars % 3 + 1))::INT AS copy FROM d WHERE n_chars % 3 >= 1")
q(
    "b03_unfold",
    lambda s, d: B.unfold(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 4).select("vec_id", "part", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("s")),
    "SELECT vec_id, p::INT AS part, round(list_sum(list_transform(embedding[p * 16 + 1 : p * 16 + 16], lambda x: x::DOUBLE)), 5) AS s FROM embeddings, range(4) t(p)",
)
q("b04_fold", lambda s, d: B.fold(docs(s, d), "doc_id", 4).select("i", F.array_join("doc_id", ",").alias("ids")), f"WITH {_D} SELECT i // 4 AS i, string_agg(doc_id::VARCHAR, ',' ORDER BY i) AS ids FROM d GROUP BY i // 4")
q("b05_chunk", lambda s, d: B.chunks(docs(s, d), 4).select("doc_id", "chunk"), f"WITH {_D} SELECT doc_id, (i // ((SELECT count(*) FROM d) // 4))::INT AS chunk FROM d")
q("b06_split", lambda s, d: B.split(docs(s, d), 128).select("doc_id", "chunk"), f"WITH {_D} SELECT doc_id, (i // 128)::INT AS chunk FROM d")
q("b07_pad_to_divisor", lambda s, d: B.pad_to_divisor(docs(s, d), 128).select("i", "doc_id"), f"WITH {_D}, n AS (SELECT count(*) AS n FROM d) SELECT i, doc_id FROM d UNION ALL SELECT n + j, doc_id FROM n, range(128) t(j) JOIN d ON true WHERE j < (128 - n % 128) % 128 AND d.i = j % n")
q("b07_unpad", lambda s, d: (lambda x, n: B.unpad(B.pad_to_divisor(x, 128, n=n), -n % 128, n=n + -n % 128))(x := docs(s, d), x.count()).select("i", "doc_id"), f"WITH {_D} SELECT i, doc_id FROM d")
q("b08_pad_first_last", lambda s, d: B.pad_edge(docs(s, d), 2, first=True, i="i").select(F.col("i").alias("at"), "doc_id"), f"WITH {_D} SELECT i + 2 AS at, doc_id FROM d UNION ALL SELECT unnest([0, 1])::BIGINT, doc_id FROM d WHERE i = 0")
q("b09_reorder", lambda s, d: B.take(docs(s, d), docs(s, d).select("i", F.xxhash64("doc_id").alias("pos"))).select("i", "doc_id"), f"WITH {_D} SELECT i, doc_id FROM d")
q("b10_mini_batches", lambda s, d: P.epoch_batches(table(s, d, "documents").select("doc_id"), 50, 2, 5, "doc_id"), "SELECT doc_id, epoch::INT AS epoch, ((row_number() OVER (PARTITION BY epoch ORDER BY md5('5|' || epoch || '|' || doc_id), doc_id) - 1) // 50)::INT AS batch FROM documents, range(2) t(epoch)")
q("b11_collate", lambda s, d: B.collate(B.with_row_number(table(s, d, "fvqa_toy").select("row_id", "question"), "row_id"), ["row_id", "question"], 32).select("batch", F.array_join("row_id", ",").alias("ids"), F.size("question").alias("n")), "SELECT i // 32 AS batch, string_agg(row_id::VARCHAR, ',' ORDER BY i) AS ids, count(*)::INT AS n FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i FROM fvqa_toy) GROUP BY 1")
_IDS = "CASE WHEN len(image_dhash) IS NULL THEN NULL ELSE {} END"
for _cut, _sql in (("left", "x[greatest(len(x) - 39, 1):]"), ("right", "x[1:40]"), ("middle", "list_concat(x[1:20], x[greatest(len(x) - 19, 1):])")):
    q(
        f"b12_pad_or_cut_{_cut}",
        lambda s, d, c=_cut: table(s, d, "offline_doc").select("odoc_id", F.array_join(B.pad_sequence(F.transform("image_dhash", lambda v: F.coalesce(v, F.lit(-1))), 40, F.lit(9), cut=c), "").alias("ids")),
        f"WITH v AS (SELECT odoc_id, list_transform(image_dhash, lambda v: coalesce(v, -1)) AS x FROM offline_doc) SELECT odoc_id, array_to_string(CASE WHEN x IS NULL THEN NULL WHEN len(x) <= 40 THEN list_concat(x, list_transform(range(40 - len(x)), lambda r: 9)) ELSE {_sql} END, '') AS ids FROM v",
    )
q("b13_remove_padding", lambda s, d: table(s, d, "offline_doc").where("size(image_dhash) >= 9").select("odoc_id", F.expr("array_join(slice(image_dhash, -(odoc_id % 9 + 1), odoc_id % 9 + 1), '')").alias("ids")), "SELECT odoc_id, array_to_string(image_dhash[-(odoc_id % 9 + 1):], '') AS ids FROM offline_doc WHERE len(image_dhash) >= 9")
q("b14_pair_stacking", lambda s, d: table(s, d, "fvqa_toy").where("size(gold_answers) >= 2").select("row_id", F.posexplode(F.array(F.col("gold_answers")[0], F.col("gold_answers")[1])).alias("side", "answer")), "SELECT row_id, unnest([0, 1])::INT AS side, unnest([gold_answers[1], gold_answers[2]]) AS answer FROM fvqa_toy WHERE len(gold_answers) >= 2")
q("b18_inverse_permutation", lambda s, d: B.with_row_number(docs(s, d).select("i", "n_chars"), "n_chars", "i", out="sorted_at").select(F.col("i").alias("original"), "sorted_at"), f"WITH {_D} SELECT i AS original, row_number() OVER (ORDER BY n_chars NULLS FIRST, i) - 1 AS sorted_at FROM d")
q("b24_prompt_copies", lambda s, d: table(s, d, "toy_vqa").select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("copy")).select("sample_id", "copy", F.concat_ws("#", "sample_id", "copy").alias("rollout")), "SELECT sample_id, unnest(range(5))::INT AS copy, sample_id || '#' || unnest(range(5)) AS rollout FROM toy_vqa")

q("p01_select", lambda s, d: table(s, d, "fvqa_toy").select("row_id", "split"), "SELECT row_id, split FROM fvqa_toy")
q("p02_pop", lambda s, d: table(s, d, "source_catalog").drop("kind"), "SELECT source, first_seen FROM source_catalog")
q("p03_rename", lambda s, d: table(s, d, "source_catalog").withColumnsRenamed({"kind": "sort"}), "SELECT source, kind AS sort, first_seen FROM source_catalog")
q("p04_take_rows", lambda s, d: B.take(docs(s, d), s.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 900)], "pos bigint, i bigint")).select("pos", "doc_id"), f"WITH {_D} SELECT pos::BIGINT AS pos, doc_id FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 900)) w(pos, i) JOIN d USING (i)")
q("p05_slice", lambda s, d: B.python_slice(docs(s, d), 10, -10, 7).select("i", "doc_id"), f"WITH {_D} SELECT i, doc_id FROM d WHERE i >= 10 AND i < (SELECT count(*) FROM d) - 10 AND (i - 10) % 7 = 0")
q("p06_length_filter", lambda s, d: table(s, d, "documents").where(F.coalesce(F.size(N.split_tokens(F.col("text"))), F.lit(201)) <= 200).where("text is not null").select("doc_id"), f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(list_filter(string_split_regex({strip('text')}, '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+'), lambda x: x <> '')) <= 200")
q("p07_nonempty_label", lambda s, d: table(s, d, "offline_doc").where("length(category) > 0").select("odoc_id", "category"), "SELECT odoc_id, category FROM offline_doc WHERE length(category) > 0")
q(
    "p08_canonical_rows",
    lambda s, d: B.with_row_number(table(s, d, "fvqa_toy"), "row_id", out="idx", within="split").select("row_id", "split", F.col("data_source"), F.concat(F.coalesce("question", F.lit("")), F.lit(" Let's think step by step.")).alias("content"), F.try_element_at("gold_answers", F.lit(1)).alias("ground_truth"), "idx"),
    "SELECT row_id, split, data_source, coalesce(question, '') || ' Let''s think step by step.' AS content, gold_answers[1] AS ground_truth, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS idx FROM fvqa_toy",
)
q("p09_search_qa_rows", lambda s, d: table(s, d, "fvqa_toy").select("row_id", F.concat(F.lit("search_"), "data_source").alias("data_source"), F.coalesce(F.array_join("gold_answers", "|"), F.lit("")).alias("target")), "SELECT row_id, 'search_' || data_source AS data_source, coalesce(array_to_string(gold_answers, '|'), '') AS target FROM fvqa_toy")
q("p10_pairwise_rows", lambda s, d: rollout_rows(s, d).where("size(gold_answers) > 0").select("row_id", "question", F.explode(F.array(F.col("gold_answers")[0], F.col("final_answer"))).alias("response")), f"SELECT row_id, question, unnest([gold_answers[1], final_answer]) AS response FROM {_P} WHERE len(gold_answers) > 0")
q("p11_role_remap", lambda s, d: table(s, d, "toy_vqa").select("sample_id", F.posexplode(F.transform(F.expr("array(struct('human' as r, question as v), struct('gpt' as r, gold_answers[0] as v))"), lambda x: F.struct(F.when(x["r"] == "gpt", "assistant").when(x["r"] == "human", "user").otherwise(F.raise_error(F.lit("unknown role"))).alias("role"), x["v"].alias("content")))).alias("turn", "m")).select("sample_id", "turn", "m.role", "m.content"), "SELECT sample_id, 0::INT AS turn, 'user' AS role, question AS content FROM toy_vqa UNION ALL SELECT sample_id, 1, 'assistant', gold_answers[1] FROM toy_vqa")
q("p12_multimodal_record", lambda s, d: table(s, d, "fvqa_toy").select("row_id", F.concat(F.lit("<image>\n"), "question").alias("prompt"), F.to_json(F.struct(F.col("data_source").alias("source"))).alias("extra"), F.coalesce(F.try_element_at("images", F.lit(1)), F.lit("")).alias("image_url")), "SELECT row_id, '<image>' || chr(10) || question AS prompt, CASE WHEN data_source IS NULL THEN '{}' ELSE '{\"source\":\"' || data_source || '\"}' END AS extra, coalesce(images[1], '') AS image_url FROM fvqa_toy")
q("p13_vqa_adapter", lambda s, d: table(s, d, "offline_doc").select("odoc_id", F.coalesce(N.strip(F.col("question_id")), F.concat(F.lit("ds_"), "odoc_id")).alias("sample_id"), (F.coalesce("category", F.lit("")) != "no_search").alias("needs_search")), f"SELECT odoc_id, coalesce({strip('question_id')}, 'ds_' || odoc_id) AS sample_id, coalesce(category, '') <> 'no_search' AS needs_search FROM offline_doc")
q("p14_answers_union", lambda s, d: table(s, d, "offline_doc").select("odoc_id", F.array_join(N.ordered_dedupe(F.concat(F.array("answer"), F.coalesce("candidate_answers", F.array().cast("array<string>")))), "|").alias("answers")), f"WITH a AS (SELECT odoc_id, list_filter(list_transform(list_concat([answer], coalesce(candidate_answers, []::VARCHAR[])), lambda x: {strip('x')}), lambda x: x IS NOT NULL AND x <> '') AS l FROM offline_doc) SELECT odoc_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda y: lower(y)), lower(x[1])) THEN acc ELSE list_concat(acc, x) END), '|') AS answers FROM a")
q("p15_sample_lists", lambda s, d: table(s, d, "fvqa_toy").select("row_id", F.array_join(F.filter(F.transform("gold_answers", N.strip), lambda x: x != ""), "|").alias("golds")), f"SELECT row_id, array_to_string(list_filter(list_transform(gold_answers, lambda x: {strip('x')}), lambda x: x <> ''), '|') AS golds FROM fvqa_toy")
q(
    "p18_column_partition",
    lambda s, d: (lambda gen, rest: gen.join(rest, ["row_id", "data_source"]))(*B.column_partition(rollout_rows(s, d).where("data_source is not null").select("row_id", "question", "sample_id", "data_source", "method"), ["question"], ["row_id", "data_source"])),
    f"SELECT row_id, data_source, question, sample_id, method FROM {_P} WHERE data_source IS NOT NULL",
)
q("p19_answer_only_override", lambda s, d: rollout_rows(s, d).select("row_id", F.map_concat(F.expr("map_filter(coalesce(tool_stats, map()), (k, v) -> k not in ('format_penalty', 'search_penalty'))"), F.expr("map('format_penalty', 0, 'search_penalty', 0)")).alias("m")).select("row_id", F.size("m").alias("n"), F.col("m")["format_penalty"].alias("fp")), f"SELECT row_id, (coalesce(cardinality(tool_stats), 0) + 2)::INT AS n, 0 AS fp FROM {_P}")
q("p21_selected_steps", lambda s, d: rollout_rows(s, d).where("size(steps) >= 2 and not coalesce(final_correct, false)").select("row_id"), f"SELECT row_id FROM {_P} WHERE len(steps) >= 2 AND NOT coalesce(final_correct, FALSE)")
q("p22_prompt_variants", lambda s, d: table(s, d, "toy_vqa").select("sample_id", "question", F.explode(F.expr("array('direct', 'search')")).alias("mode")).select("sample_id", "mode", F.concat(F.when(F.col("mode") == "search", "You must search first. <image> ").otherwise("Answer directly. <image> "), "question").alias("prompt")), "SELECT sample_id, mode, CASE WHEN mode = 'search' THEN 'You must search first. <image> ' ELSE 'Answer directly. <image> ' END || question AS prompt FROM toy_vqa, (VALUES ('direct'), ('search')) m(mode)")
q("p23_weighted_expansion", lambda s, d: rollout_rows(s, d).where("latency > 0").select("row_id", F.greatest(F.lit(1), F.bround(F.col("latency") * 2).cast("int")).alias("n")).select("row_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")), f"SELECT row_id, unnest(range(greatest(1, round_even(latency * 2, 0)::INT)))::INT AS copy FROM {_P} WHERE latency > 0")
q("p24_find_and_jump", lambda s, d: rollout_rows(s, d).where(F.replace(F.col("rollout_id"), F.lit("-"), F.lit("")).contains("ro_0")).groupBy("data_source").agg(F.min_by("rollout_id", "row_id").alias("first_match")), f"SELECT data_source, arg_min(rollout_id, row_id) AS first_match FROM {_P} WHERE contains(replace(rollout_id, '-', ''), 'ro_0') GROUP BY data_source")
q("p25_package_counts", lambda s, d: table(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | (F.length("text") == 0)).alias("missing")), "SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR length(text) = 0) AS missing FROM documents GROUP BY source, lang")
q("p26_single_row", lambda s, d: B.row_at(docs(s, d), 17).select("doc_id", "n_chars"), f"WITH {_D} SELECT doc_id, n_chars FROM d WHERE i = 17")

q("t01_stable_top_k", lambda s, d: table(s, d, "documents").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20")
q("t02_group_top_two", lambda s, d: table(s, d, "documents").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id"))).where("r <= 2").select("source", "doc_id", "r"), "SELECT source, doc_id, r::INT AS r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 2")
q("t03_seeded_sample", lambda s, d: P.random_subset(table(s, d, "documents").select("doc_id"), 50, 42, "doc_id"), "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
q("t04_score_sort", lambda s, d: rollout_rows(s, d).orderBy(F.desc(F.coalesce("latency", F.lit(0.0))), "row_id").limit(25).select("row_id", F.coalesce("latency", F.lit(0.0)).alias("score")), f"SELECT row_id, coalesce(latency, 0.0) AS score FROM {_P} ORDER BY score DESC, row_id LIMIT 25")
q("t05_child_argmax", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("o"))).alias("m")).select("user_id", (-F.col("m.o")).alias("event_id")), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
q("t06_random_subset", lambda s, d: P.random_subset(table(s, d, "fvqa_toy").select("row_id", "question"), 100, 7, "row_id"), "SELECT row_id, question FROM fvqa_toy ORDER BY md5('7|' || row_id), row_id LIMIT 100")
_U = "(('0x' || substr(md5('7|' || doc_id), 1, 8))::UBIGINT / 4294967296.0)"
q("t07_random_split", lambda s, d: P.random_split(table(s, d, "documents").select("doc_id"), {"test": 0.1, "validation": 0.2, "train": 0.7}, 7, "doc_id"), f"SELECT doc_id, CASE WHEN {_U} < 0.1 THEN 'test' WHEN {_U} < 0.1 + 0.2 THEN 'validation' ELSE 'train' END AS part FROM documents")
q("t08_stratified_split", lambda s, d: B.with_row_number(table(s, d, "fvqa_toy").where("data_source is not null"), "row_id", out="r0", within="data_source").withColumn("r", F.col("r0") + 1).join(table(s, d, "fvqa_toy").groupBy("data_source").agg(F.count(F.lit(1)).alias("n")), "data_source").select("row_id", F.expr("case when r <= least(40, floor(n * 0.8)) then 'train' when r <= least(40, floor(n * 0.8)) + 10 then 'test' else 'unused' end").alias("part")), "SELECT row_id, CASE WHEN r <= least(40, floor(n * 0.8)) THEN 'train' WHEN r <= least(40, floor(n * 0.8)) + 10 THEN 'test' ELSE 'unused' END AS part FROM (SELECT row_id, row_number() OVER (PARTITION BY data_source ORDER BY row_id) AS r, count(*) OVER (PARTITION BY data_source) AS n FROM fvqa_toy WHERE data_source IS NOT NULL)")
q("t09_source_split", lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("source").isin("run_notes", "rollout_log"), "held").otherwise("seed").alias("part")), "SELECT doc_id, CASE WHEN source IN ('run_notes', 'rollout_log') THEN 'held' ELSE 'seed' END AS part FROM documents")
q("t10_equal_parts", lambda s, d: B.equal_parts(docs(s, d), 7).select("doc_id", "part"), f"WITH {_D}, z AS (SELECT count(*) // 7 AS size FROM d) SELECT doc_id, (i // size)::INT AS part FROM d, z WHERE i < size * 7")
q("t11_curriculum_order", lambda s, d: table(s, d, "fvqa_toy").join(table(s, d, "source_catalog").select(F.col("source").alias("data_source"), "first_seen"), "data_source").select("row_id", "split", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("seen")).transform(lambda x: B.with_row_number(x, "seen", "row_id", out="turn", within="split")).select("row_id", F.col("turn") + 1).withColumnsRenamed({"(turn + 1)": "turn"}), "SELECT row_id, row_number() OVER (PARTITION BY split ORDER BY first_seen, row_id) AS turn FROM fvqa_toy JOIN source_catalog ON source = data_source")
q("t11_seeded_sampler", lambda s, d: P.seeded_order(table(s, d, "fvqa_toy").select("row_id"), 3, "row_id", out="turn"), "SELECT row_id, row_number() OVER (ORDER BY md5('3|' || row_id), row_id) - 1 AS turn FROM fvqa_toy")
q(
    "t12_resampled_rows",
    lambda s, d: P.resample(table(s, d, "orders").select("o_orderkey", F.floor(F.pow(F.col("o_totalprice") / 1000, 2)).alias("w")), "w", 2000, 11, "o_orderkey").select("draw", "o_orderkey"),
    """WITH l AS (SELECT o_orderkey, w, (sum(w) OVER (ORDER BY o_orderkey))::BIGINT AS e FROM (SELECT o_orderkey, floor(pow(o_totalprice / 1000, 2))::BIGINT AS w FROM orders) WHERE w > 0),
n AS (SELECT range AS draw, floor(('0x' || substr(md5('11|' || range), 1, 8))::UBIGINT / 4294967296.0 * (SELECT max(e) FROM l))::BIGINT AS p FROM range(2000)) SELECT draw, o_orderkey FROM n JOIN l ON p >= e - w AND p < e""",
)
q("u01_bag_union", lambda s, d: table(s, d, "toy_vqa").select("sample_id", "question").unionByName(table(s, d, "fvqa_toy").select("sample_id", "question")), "SELECT sample_id, question FROM toy_vqa UNION ALL SELECT sample_id, question FROM fvqa_toy")
q("u02_oversampling", lambda s, d: table(s, d, "fvqa_toy").select("row_id", F.explode(F.sequence(F.lit(1), F.when(F.col("split") == "train", 1).otherwise(3))).alias("copy")), "SELECT row_id, unnest(range(1, CASE WHEN split = 'train' THEN 2 ELSE 4 END))::INT AS copy FROM fvqa_toy")
q("u03_column_tolerant_union", lambda s, d: table(s, d, "toy_vqa").select("sample_id", "question").unionByName(table(s, d, "fvqa_toy").select("sample_id", "split"), allowMissingColumns=True), "SELECT sample_id, question, NULL AS split FROM toy_vqa UNION ALL SELECT sample_id, NULL, split FROM fvqa_toy")
q("u04_key_intersection", lambda s, d: table(s, d, "fvqa_toy").select("sample_id").where("sample_id is not null").intersect(rollout_rows(s, d).select("sample_id")), f"SELECT sample_id FROM fvqa_toy WHERE sample_id IS NOT NULL INTERSECT SELECT sample_id FROM {_P}")
q("u05_key_difference", lambda s, d: table(s, d, "fvqa_toy").select("sample_id").where("sample_id is not null").subtract(rollout_rows(s, d).select("sample_id")), f"SELECT sample_id FROM fvqa_toy WHERE sample_id IS NOT NULL EXCEPT SELECT sample_id FROM {_P}")
q("u07_longest_first", lambda s, d: table(s, d, "text_corpus").select("answer").where("answer is not null").distinct().select("answer", F.length("answer").alias("n")).orderBy(F.desc("n"), "answer"), "SELECT DISTINCT answer, length(answer)::INT AS n FROM text_corpus WHERE answer IS NOT NULL")
q("u08_distinct_values", lambda s, d: table(s, d, "documents").select("source", "lang").distinct(), "SELECT DISTINCT source, lang FROM documents")
q("s09_filtered_first_wins", lambda s, d: table(s, d, "fvqa_toy").where("split = 'train' and sample_id is not null").withColumn("r", F.row_number().over(W.partitionBy("sample_id").orderBy("row_id"))).where("r = 1").select("sample_id", "row_id"), "SELECT sample_id, min(row_id) AS row_id FROM fvqa_toy WHERE split = 'train' AND sample_id IS NOT NULL GROUP BY sample_id")
q("s14_percent_slice", lambda s, d: B.percent_slice(docs(s, d), 0, 75).select("doc_id"), f"WITH {_D} SELECT doc_id FROM d WHERE i < floor((SELECT count(*) FROM d) * 0.75)")
q("f51_loss_mask", lambda s, d: tokens(s, d).select("rid", "pos", F.when((F.col("mask") == 1) & (F.col("pos") > 0), 1).otherwise(0).alias("loss_mask")), f"WITH {TOKENS_SQL} SELECT rid, pos, (mask = 1 AND pos > 0)::INT AS loss_mask FROM tokens")
