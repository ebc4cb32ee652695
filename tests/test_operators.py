"""Hand-made cases of the core operators."""

import json
import math
import os
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracequarry.functions import pyfn as Y
from tracequarry.functions import textnorm as N
from tracequarry.operators import balance, batch, grouprel, losses, relabel, retrieval, rollup, seqscan, shred, stepreward, typedpool
from tracequarry.plans import further, stepwise
from tracequarry.sources import readers
from tracequarry.streaming import queues


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- columnar shredding


LINE = {"steps": [{"raw_observation": [{"title": "a"}, None, {"title": "b"}], "metadata": {"success": False}}, None, {"raw_observation": '{"final": "x", "results": [{"title": "c"}]}', "metadata": {"success": "yes"}}]}


def nodes(spark, raws):
    df = spark.createDataFrame([(i, r, "clash", 1) for i, r in enumerate(raws)], "line_id bigint, raw string, node string, step_pos int")
    return sorted(values(shred.rollout_nodes(df), "line_id", "node", "step_pos", "item_pos"))


def test_shred_nodes(spark):
    single = json.dumps({"steps": {"raw_observation": {"final": 0}, "metadata": {"success": True}}})
    got = nodes(spark, [json.dumps(LINE), single, None, "", "{", "[1]", '{"steps": NaN}', '{"steps": []}', '{"steps": [7]}'])
    assert got == sorted(
        [(0, "step", 0, -1), (0, "step", 2, -1), (0, "hit", 0, 0), (0, "hit", 0, 2), (0, "hit", 2, 0), (0, "final", 2, -1), (0, "success", 0, -1)]
        + [(1, "step", 0, -1), (1, "final", 0, -1), (1, "success", 0, -1), (8, "step", 0, -1)]
    )


def test_shred_empty_table_and_repeated_lines(spark):
    assert nodes(spark, []) == []
    raw = json.dumps({"steps": [{}]})
    assert [n[0] for n in nodes(spark, [raw, raw])] == [0, 1]


def test_levels_round_trip():
    column = shred.LeafColumn.empty(("a[]", "b[]", "c"))
    records = [{"a": [{"b": [{"c": 1}, {"c": None}]}, {"b": []}, None]}, {}, {"a": []}, {"a": [{"b": [None, {"c": 2}]}]}]
    for r in records:
        shred.shred(r, column)
    record, at, index, define = shred.assemble(column)
    full, _ = shred.levels_of(column.path)
    rows = [(int(r), int(x), int(y), column.value[i] if d == full else None, int(d)) for r, x, y, i, d in zip(record, at[0], at[1], index, define)]
    assert rows == [(0, 0, 0, 1, 5), (0, 0, 1, None, 4), (3, 0, 0, None, 3), (3, 0, 1, 2, 5)]
    outer = shred.assemble(column, 1)
    assert list(zip(outer[0].tolist(), outer[1][0].tolist())) == [(0, 0), (0, 1), (0, 2), (3, 0)]


def test_flat_table_links(spark):
    df = spark.createDataFrame([(5, json.dumps(LINE))], "line_id bigint, raw string")
    assert sorted(values(shred.rollout_hits(df), "line_id", "pos_1", "pos_2", "title")) == [(5, 0, 0, "a"), (5, 0, 2, "b"), (5, 2, 0, "c")]


def test_deep_and_long_lines(spark):
    deep = '{"steps": [' + '{"x":' * 2000 + "1" + "}" * 2000 + "]}"
    long = json.dumps({"steps": [{"action_text": "x" * 500_000}]})
    assert [n[:2] for n in nodes(spark, [deep, long])][-1] == (1, "step")


# --- groups and tokens


def test_group_stats_golden(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "uid int, score double")
    got = {r["uid"]: (r["mean"], round(r["std"], 6), r["n"]) for r in grouprel.group_stats(df).collect()}
    assert got == {0: (2.0, round(math.sqrt(2), 6), 2), 1: (0.0, 1.0, 1)}


def test_leave_one_out_forms_agree_on_groups(spark):
    df = spark.createDataFrame([(i // 3, i, float(i * i % 7)) for i in range(12)] + [(9, 99, 5.0)], "uid int, rid int, score double")
    a = dict(values(grouprel.rloo(df), "rid", "adv"))
    b = dict(values(grouprel.rloo_batched(df), "rid", "adv"))
    assert a.pop(99) == 5.0 and b.pop(99) == 0.0
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_null_scores_do_not_count(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0)], "uid int, rid int, score double")
    assert dict(values(grouprel.mean_baseline(df), "rid", "adv")) == {0: -1.0, 1: None, 2: 1.0}


def test_gae_matches_loop(spark):
    import random

    rng = random.Random(3)
    rows = [([rng.random() for _ in range(9)], [rng.random() for _ in range(9)], [rng.randint(0, 1) for _ in range(9)]) for _ in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r array<double>, v array<double>, m array<int>")
    got = dict(values(df.select("i", seqscan.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("a")), "i", "a"))
    for i, (r, v, m) in enumerate(rows):
        nxt = last = 0.0
        want = [0.0] * 9
        for t in range(8, -1, -1):
            now = r[t] + 0.9 * nxt - v[t] + 0.72 * last
            nxt, last = (v[t], now) if m[t] else (nxt, last)
            want[t] = last
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[i], want))


def test_aggregate_loss_modes(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0), (1, 1, 6.0), (2, 0, 100.0)], "rid int, mask int, x double")
    one = lambda mode: losses.aggregate_loss(df, F.col("x"), mode).first()["loss"]
    assert (one("token-mean"), one("seq-mean-token-sum"), one("seq-mean-token-mean")) == (4.0, 6.0, 4.5)
    with pytest.raises(ValueError):
        one("other")


def test_propagation_golden(spark):
    df = spark.createDataFrame([("k", 0, 0.1), ("k", 1, 0.4)], "key string, pos int, g double")
    got = dict(values(stepreward.propagated(df, "g", F.lit(0.5), 0.5), "pos", "ret"))
    assert abs(got[0] - 0.2) < 1e-12 and got[1] == 0.4


def test_spans_spread(spark):
    df = spark.createDataFrame([("k", 0, 2, 1.0), ("k", 2, 3, 0.0), ("k", 5, 5, 9.0)], "key string, s int, e int, t double")
    got = dict(values(stepreward.spread_over_tokens(df, "key", F.col("s"), F.col("e"), F.col("t"), 8), "pos", "reward"))
    assert got == {0: 0.5, 1: 0.5, 2: 0.0}


def test_majority_and_best_of(spark):
    df = spark.createDataFrame([("g", "A", 0.9, 0), ("g", "B", 0.8, 1), ("g", "A", 0.7, 2)], "g string, pred string, v double, o int")
    assert rollup.majority_value(df, ["g"], "pred", "v", "o").first()["maj"] == 0.9
    x = spark.createDataFrame([("g", float(i), i) for i in range(1, 6)], "g string, v double, o int")
    best = rollup.best_of(x, {"b": (3, False)}, "v", "g", "o").first()["b"]
    exact = sum(max(a, b, c) for a in range(1, 6) for b in range(1, 6) for c in range(1, 6)) / 125
    assert abs(best - exact) < 1e-9


# --- text


@pytest.mark.parametrize(
    "f, text, want",
    [
        (N.qa_normalize, "The  Café, an Inn!", "café inn"),
        (N.eval_normalize, "The Café-Inn", "caf inn"),
        (N.alnum_normalize, "  A-b  C ", "a b c"),
        (N.last_tag, "<answer>x</answer><answer> y\n</answer>", "y"),
        (N.last_tag, "none", None),
        (N.hash_answer, "a #### 12 then #### 1,234", "1234"),
        (N.final_answer_normalize, "x = 3,000 dollars", "3000"),
        (N.qa_normalize, None, None),
    ],
)
def test_text_functions(spark, f, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"] == want


def test_redaction(spark):
    df = spark.createDataFrame([("Question: q. Answer: Paris. It is paris (x).", ["Paris", None, "is (x)", ""])], "t string, a array<string>")
    assert df.select(N.redact(F.col("t"), F.col("a")).alias("v")).first()["v"] == "Question: q. Answer: [hidden]. It is [hidden] (x)."


def test_conversation_of_four_turns_raises(spark):
    df = spark.createDataFrame([(["a"] * 4,)], "t array<string>")
    with pytest.raises(Exception):
        df.select(N.conversation_format(F.col("t"))[0]).collect()


def test_python_cores():
    assert Y.last_boxed(r"\boxed{1} \boxed{a{b}c}") == "a{b}c" and Y.last_boxed(r"\boxed{x") is None
    assert Y.plain_latex("\\dfrac12") == "\\frac{1}{2}" and Y.plain_latex("3/4") == "\\frac{3}{4}" and Y.plain_latex("x = \\sqrt3") == "\\sqrt{3}"
    assert Y.final_answer_of('{"action": "stop", "answer": "Paris"}') == "Paris" and Y.final_answer_of("<answer></answer>") == "unknown"
    assert Y.tool_calls('<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>x</tool_call>') == [{"name": "f", "arguments": '{"a": 1}'}]
    assert Y.xml_calls("<function=f>\n<parameter=n>\n3\n</parameter></function>", {"n": "integer"}) == [{"name": "f", "arguments": "{\"n\": 3}"}]
    assert Y.typed_parameter("__import__('os')", "object") == "__import__('os')"
    assert Y.action_spans([1, 2, 3, 1, 2], [[1, 2], [1, 2], [9]]) == [(0, 2), (3, 5), (-1, -1)]
    call = {"name": "f", "parameters": {"a": 1}}
    assert Y.tool_match([call], [call]) == 3.0 and Y.tool_match([call], []) == -3.0
    assert Y.media_segments("a<image>b<image>", 2, 0) == [("text", "a"), ("image", "0"), ("text", "b"), ("image", "1")]
    with pytest.raises(ValueError):
        Y.media_segments("<image>", 0, 0)
    assert Y.gate_reward(["x", "x", "x"], "x", True) == 1.0 and Y.gate_reward(["x", "x"], "q", False) == -0.25


# --- batches


def test_row_numbers_and_batches(spark):
    df = spark.createDataFrame([(i * 37 % 101, "a" if i % 3 else "b") for i in range(101)], "id bigint, g string")
    n = batch.with_row_number(df, "id")
    assert sorted(values(n, "id", "i")) == [(i, i) for i in range(101)]
    within = batch.with_row_number(df, "id", within="g").collect()
    for g in "ab":
        ids = sorted(r["id"] for r in within if r["g"] == g)
        assert {r["id"]: r["i"] for r in within if r["g"] == g} == {x: k for k, x in enumerate(ids)}
    assert sorted(values(batch.pad_to_divisor(n, 8), "i", "id"))[-3:] == [(101, 0), (102, 1), (103, 2)]
    assert sorted(r["i"] for r in batch.python_slice(n, -5, None, 2).collect()) == [96, 98, 100]
    with pytest.raises(ValueError):
        batch.chunks(n, 2)


def test_row_numbers_of_empty_and_null(spark):
    assert batch.with_row_number(spark.createDataFrame([], "id bigint"), "id").count() == 0
    df = spark.createDataFrame([(None,), (3,), (None,)], "id bigint")
    assert sorted(values(batch.with_row_number(df, "id"), "i", "id"), key=lambda x: x[0]) == [(0, None), (1, None), (2, 3)]


def test_union_columns_conflict(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    assert batch.union_columns(a, a.withColumn("y", F.lit(1)), "k").columns == ["k", "x", "y"]
    with pytest.raises(Exception):
        batch.union_columns(a, a.withColumn("x", F.lit(3.0)), "k").collect()


def test_balance_invariants():
    import random

    rng = random.Random(1)
    lengths = [rng.randint(1, 4000) for _ in range(64)]
    for parts in (balance.differencing(lengths, 8), balance.differencing(lengths, 8, True), balance.greedy(lengths, 8, True), balance.micro_batches(lengths, 20000), balance.keep_groups(lengths, [i // 4 for i in range(64)], 4)):
        assert sorted(i for p in parts for i in p) == list(range(64))
    assert {len(p) for p in balance.differencing(lengths, 8, True)} == {8}
    sums = [sum(lengths[i] for i in p) for p in balance.differencing(lengths, 8)]
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 8
    for p in balance.keep_groups(lengths, [i // 4 for i in range(64)], 4):
        assert all(p[i] // 4 == p[i - i % 4] // 4 for i in range(len(p)))
    with pytest.raises(ValueError):
        balance.differencing([1], 2)


def test_bm25_and_blocks(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, None)], "q bigint, t string")
    c = spark.createDataFrame([(1, "a red fox"), (2, "red red"), (3, None), (4, "fox")], "d bigint, t string")
    got = retrieval.top_k(retrieval.bm25(q, c, "q", "t", "d", "t", 1.2, 0.75, True), 1).collect()
    assert [(r["q"], r["doc"]) for r in got] == [(1, 1)]
    sub = retrieval.substring_search(q, c, 3)
    assert [(r["doc"], r["score"]) for r in sub.where("q = 1").orderBy("rank").collect()] == [(1, 2.0), (2, 1.0), (4, 1.0)]
    assert [r["doc"] for r in sub.where("q = 2").orderBy("rank").collect()] == [1, 2, 3]


# --- queues, files


def test_balanced_counts():
    assert queues.balanced_counts(8, 0.5, 1, 20) == (1, 7, 0)
    assert queues.balanced_counts(8, 0.5, 2, 2) == (2, 2, 4)


def test_streams(spark, tmp_path):
    rows = [(i % 2, i, i) for i in range(20)]
    spark.createDataFrame(rows, "k int, seq bigint, t bigint").select("k", "seq", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, seq bigint, ts timestamp").parquet(f"{tmp_path}/in")
    out = []
    q = queues.bounded_queue(stream, "k", "seq", 4).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").foreachBatch(lambda df, e: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["size"], r["produced"], r["dropped"], r["oldest"]) for r in out) == [(0, 4, 10, 6, 12), (1, 4, 10, 6, 13)]
    q = queues.append_metrics(stream.select("k", "seq"), f"{tmp_path}/metrics", f"t{os.getpid()}")
    q.awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/metrics").count() == 20
    q = queues.windowed_counts(stream, "ts", "k", "10 seconds", "5 seconds").writeStream.outputMode("complete").option("checkpointLocation", f"{tmp_path}/c3").foreachBatch(lambda df, e: out.append(df.agg(F.sum("n")).first()[0])).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert out[-1] == 20


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "label": "train"}\n\n{bad\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(p), "a int, label string", "tolerant").count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p), "a int, label string").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(ValueError):
        readers.read_tables(spark, ["x.txt"])
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 3}]')
    assert readers.read_json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 2
    steps = tmp_path / "steps"
    steps.mkdir()
    for i in (2, 10):
        (steps / f"{i}.jsonl").write_text('{"t": "id 123"}\n')
    assert sorted(values(readers.read_step_files(spark, str(steps), "t string", "[0-9]"), "step", "t")) == [(2, "id ***"), (10, "id ***")]
    (tmp_path / "log").write_text("step:1 val/acc:0.5\nnoise\nstep:2 val/acc:0.75 x:bad\n")
    assert dict(values(readers.last_metrics_line(spark, str(tmp_path / "log")), "key", "value")) == {"step": 2.0, "val/acc": 0.75}
    df = spark.createDataFrame([("train", bytearray(b"abc"), (1, (2,)))], "split string, b binary, s struct<x:int,y:struct<z:int>>")
    readers.write_splits(df, f"{tmp_path}/splits")
    assert os.path.isdir(f"{tmp_path}/splits/split=train")
    readers.write_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first()["b"] == "<3 bytes>"
    assert readers.flatten_struct(df).columns == ["split", "b", "s/x", "s/y/z"]
    readers.write_csv([df.select("split"), df.select(F.lit(1).alias("n"))], f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["split", "n"]
    assert readers.newest_file(spark, str(tmp_path / "*.json")).endswith("arr.json")
    assert readers.load_or_compute(spark, f"{tmp_path}/memo", lambda: df.select("split")).count() == 1
    assert len(df.select(readers.cache_key("split")).first()[0]) == 64


# --- the typed pool


POOL = "key bigint, tool string, items int, size int, step int, action string, evidence string, answer string, semantic string, image string"


def brute_counterfactuals(rows, k):
    rows = [dict(zip(typedpool.FIELDS, r)) for r in rows]
    for r in rows:
        r["tokens"], r["size"] = typedpool.entity_tokens(r["action"], r["evidence"]), max(1, r["size"])
    pool = {}
    for r in sorted(rows, key=lambda r: r["key"]):
        pool.setdefault((r["tool"], r["step"], r["action"]), r)
    out = {}
    for a in rows:
        c = [b for b in pool.values() if b["tool"] == a["tool"] and (b["step"], b["action"]) != (a["step"], a["action"])]
        c.sort(key=lambda b: (not typedpool.hard_negative(a["tool"], a, b), a["items"] != b["items"], abs(a["size"] - b["size"]), b["key"]))
        out[a["key"]] = [b["key"] for b in c[:k]] + [None] * (k - len(c))
    return out


def test_typed_pool_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["hall", "mint", "crane", "tower", "of", "mill"] + [f"name{i}" for i in range(40)]
    text = lambda n: rng.choice([None] + [" ".join(rng.choices(words, k=n)) for _ in range(9)])
    tools = ["text_search"] * 5 + ["image_search", "crop", "select", "stop", None]
    rows = [(i, rng.choice(tools), rng.randrange(4), rng.randrange(12), rng.randrange(2), text(2), text(3), rng.choice([None] * 9 + ["x", "y"]), rng.choice([None, "s"]), rng.choice([None, "p"])) for i in range(300)]
    rows += [(900, "ocr", 1, 5, 0, "only one", "mint", None, None, None), (901, "ocr", 2, 5, 1, "other", "hall", None, None, None)]
    monkeypatch.setattr(typedpool, "BLOCK", 40)
    monkeypatch.setattr(typedpool, "FEW", 30)
    got = {}
    for r in typedpool.typed_counterfactuals(spark.createDataFrame(rows, POOL), 3).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append(r["other"])
        assert r["masked"] == (r["other"] is None)
    assert got == brute_counterfactuals(rows, 3)
    assert got[900] == [901, None, None]  # another item count is ranked, not dropped; the rest is masked
    assert typedpool.typed_counterfactuals(spark.createDataFrame([], POOL), 3).count() == 0
    want = brute_counterfactuals(rows, 3)
    unique = {(r[1], r[4], r[5]): r for r in reversed(rows)}.values()
    for few in (0, 30, 10_000):  # looked up, and met outwards
        monkeypatch.setattr(typedpool, "FEW", few)
        for tool in {r[1] for r in rows}:
            frame = lambda own: typedpool._rows(pd.DataFrame([r for r in own if r[1] == tool], columns=typedpool.FIELDS).assign(size=lambda x: x["size"].clip(lower=1)))  # noqa: B023, E731
            block = typedpool.Block(frame(unique))
            for q in frame(rows):
                assert [x[3] for x in block.best(q, 3)] == [k for k in want[q["key"]] if k is not None]


def test_offline_relabel_against_a_loop(spark):
    words = lambda t: re.findall("[A-Za-z0-9_]+", (t or "").lower())

    def logp(context, target):
        known, want = set(words(context)), words(target)
        hit = sum(w in known for w in want)
        return math.log(0.05 + 0.9 * hit / len(want)) - 0.02 * (len(want) - hit) if want else 0.0

    found = [("image_search", "image://a", "1. mint of Olm"), ("text_search", "mint Olm", "1. the answer Trund Marsk"), ("stop", "Trund Marsk", "final: Trund Marsk")]
    lost = [("text_search", "mint Klas", "1. Klas Riatu hall"), ("text_search", "Klas Riatu Trund", "1. Klas mill"), ("ocr", "sign", None)]
    third = [("text_search", "mint Olm mill", "1. Marsk mill"), ("crop", "crop[0]", "")]
    rollouts = [(1, "Who built the mint?", ["Trund Marsk", None], found), (2, "Who kept the mill?", ["Klas"], lost), (3, None, ["Marsk"], third), (4, "Where?", None, [("stop", "Klas", None)])]
    rows = [(r, i, q, (golds or [""])[0], r * 1000 + i, t, 1, len(e or ""), i, a, e, None, None, None) for r, q, golds, own in rollouts for i, (t, a, e) in enumerate(own)]
    df = spark.createDataFrame(rows, f"row bigint, pos int, question string, target string, {POOL}")
    steps = relabel.relabelled_steps(df, F.lit(0.5)).cache()
    got = {(r["row"], r["pos"]): r for r in steps.collect()}
    assert len(got) == len(rows)
    others = brute_counterfactuals([r[4:] for r in rows], 2)
    evidence, want = {r[4]: r[10] or "" for r in rows}, {}
    for r, question, golds, own in rollouts:
        head, g, d = f"Question: {question or ''}\n", [], []
        for i, (tool, action, e) in enumerate(own):
            head += f"Action[{i}:{tool}]: {action}\nObservation[{i}]: "
            replaced = [evidence[k] if k is not None else relabel.MASKED.get(tool, relabel._MASKED_ELSE) for k in others[r * 1000 + i]]
            gain = lambda target: logp(head + (e or ""), target) - sum(logp(head + x, target) for x in replaced) / 2  # noqa: B023, E731
            local, future = gain((golds or [""])[0]), gain(own[i + 1][1]) if i + 1 < len(own) else 0.0
            g.append(max(-2, min(2, 0.0 if abs(local) < 0.02 else local if local > 0 else 0.25 * local)))
            d.append(max(0, min(2, 0.0 if abs(future) < 0.02 else future)))
            head += (e or "") + "\n"
        for i, (tool, _, _) in enumerate(own):
            ret = g[i] + (0.5 * d[i] * max(g[i + 1], 0) if i + 1 < len(own) else 0)
            want[r, i] = (g[i], d[i], ret, 0.4 * ret + 0.1 - 0.05 * stepreward.TOOL_COSTS[tool])
    for k, w in want.items():
        assert all(abs(got[k][c] - x) < 1e-9 for c, x in zip(("g", "d", "ret", "total"), w)), k
    edges = relabel.edge_rows(steps, spark.createDataFrame([(r, g) for r, _, g, _ in rollouts], "row bigint, golds array<string>")).cache()
    by = {r["row"]: r for r in edges.collect()}
    assert set(by) == {1, 2, 3, 4} and by[1]["answer1"] and not by[1]["answer0"] and by[2]["answer0"] and by[4]["tool1"] is None
    for r in by.values():
        k = r["row"]
        ok = want[k, 0][1] > 0.02 and want.get((k, 1), (0,))[0] > 0
        assert (r["eligible"], r["selected"]) == (ok, ok and not r["answer0"])
    assert any(r["selected"] for r in by.values())
    total = relabel.edge_summary(edges).first()
    assert total["n"] == 4 and total["selected_n"] == sum(r["selected"] for r in by.values()) and abs(total["g0_mean"] - sum(want[k, 0][0] for k in by) / 4) < 1e-6
    figures = {(r["figure"], r["a"], r["b"]): r["v"] for r in relabel.reward_figures(steps).collect()}
    assert figures["edge_matrix", "0", "1"] == round(max(want[k, 0][1] for k in by), 6) and figures["edge_matrix", "1", "0"] == 0
    assert abs(figures["reward_by_tool", "ocr", None] - want[2, 2][3]) < 1e-6


def test_spans_of_whole_actions(spark, tmp_path):
    own = [[5, 6, 7, 8], None, [5, 6, 7, 9, 9], [], [5, 6, 7, 8], [4]]
    spark.createDataFrame([(1, [(t,) for t in own])], "row_id bigint, steps array<struct<action_tokens:array<int>>>").write.parquet(f"{tmp_path}/prompted_search_smoke.parquet")
    got = sorted(values(further.spans_in_tokens(spark, str(tmp_path)), "k", "span_start", "span_end"))
    assert got == [(0, 0, 4), (1, 4, 9), (2, 9, 13), (3, 13, 14)]


def test_rewards_reach_the_end_of_long_rollouts(spark, tmp_path):
    own = [("text_search", [0, 38]), ("crop", [38, 42]), None, ("image_search", [42, 70]), ("text_search", [70, 72]), ("stop", [72, 74])]
    schema = "row_id bigint, final_correct boolean, steps array<struct<tool_type:string,action_span:array<int>>>"
    spark.createDataFrame([(1, True, own), (2, None, own), (3, True, None)], schema).write.parquet(f"{tmp_path}/prompted_search_smoke.parquet")
    reward = {(r, p): v for r, p, v in values(stepwise.R.run["w27_span_rewards"](spark, str(tmp_path)), "row_id", "pos", "reward")}
    assert set(reward) == {(r, p) for r in (1, 2) for p in range(74)}
    assert [reward[1, p] for p in (39, 41, 71, 73)] == [0.125, 0.125, 0.5, 0.0]  # crossing and past position 40
    bonus = dict(values(stepwise.R.run["w34_success_shaping"](spark, str(tmp_path)), "pos", "bonus"))
    assert set(bonus) == set(range(38)) | set(range(42, 72)) and bonus[65] == round(0.5 / 28, 6) and bonus[71] == 0.25


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tracequarry import session

    assert session.is_local("local") and session.is_local("local[8]") and session.is_local("local[2,3]")
    assert not any(map(session.is_local, ("local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://x")))

    class Nothing:
        def isDefined(self):
            return False

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return Nothing()

    class Context:
        master, _jsc = "yarn", Jsc()

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_staged_tables_are_removed(spark):
    import os

    from tracequarry import session

    kept = session.staged(spark.range(3))
    with session.released(spark):
        x = session.staged(spark.range(5))
        assert x.count() == 5
        path = x.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3
