"""Hooks, samplers, balance, scripted rollouts, order: against loops and hand-made cases."""

import difflib
import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.functions import hooks, pyfn, scorers
from tracequarry.operators import agent, balance, batch, retrieval, sampling, seqscan
from tracequarry.plans import catalog
from tracequarry.sources import readers

RUN = catalog.queries()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_row_numbers_break_ties_by_all_columns(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 1, 1, 2]), rng.choice("ab"), i) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b string, c int")
    got = [c for _, c in sorted((r["i"], r["c"]) for r in batch.with_row_number(df, "a", "b", "c").collect())]
    assert got == [c for *_, c in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]
    within = rows(batch.with_row_number(df, F.desc("c"), within="b"), "b", "i")
    assert within == sorted(((b, i) for b in "ab" for i in range(sum(x[1] == b for x in data))), key=repr)
    assert batch.with_row_number(df.where("false"), "a").count() == 0


def test_running_sums_and_quantiles(spark):
    values = [(i, (i * 7919) % 101 if i % 10 else None) for i in range(300)]
    df = spark.createDataFrame(values, "i int, v int")
    got = [r["total"] for r in batch.running_sum(df, "v", "i").orderBy("i").collect()]
    assert got == list(itertools.accumulate(v or 0 for _, v in values))
    q = batch.exact_quantiles(df, "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).first()
    assert [q["low"], q["mid"], q["top"]] == pytest.approx(np.quantile([v for _, v in values if v is not None], [0.05, 0.5, 1.0]).tolist())
    assert batch.exact_quantiles(df.where("false"), "v", {"x": 0.5}).first()["x"] is None


def test_union_by_position(spark):
    a = spark.createDataFrame([(0, "x", None, float("nan")), (1, "y", 2, 1.0)], "i bigint, a string, s int, n double")
    b = spark.createDataFrame([(1, 2, 1.0, True), (0, None, float("nan"), False)], "i bigint, s int, n double, b boolean")
    got = batch.union_by_position(a, b)
    assert got.columns == ["i", "a", "s", "n", "b"] and rows(got, "i", "a", "b") == [(0, "x", False), (1, "y", True)]
    with pytest.raises(Exception, match="column s differs"):
        batch.union_by_position(a, b.withColumn("s", F.lit(5))).collect()
    with pytest.raises(Exception, match="differ in size"):
        batch.union_by_position(a, b.where("i = 0")).collect()


def test_batches_of_rows(spark):
    df = batch.with_row_number(spark.createDataFrame([(x,) for x in "abcdefg"], "v string"), "v")
    assert rows(batch.collate(df, ["v"], 3), "batch", "v") == [(0, ["a", "b", "c"]), (1, ["d", "e", "f"]), (2, ["g"])]
    assert [v for _, v in rows(batch.pad_edge(df, 2, first=True), "i", "v")] == list("aaabcdefg")
    assert [v for _, v in rows(batch.pad_edge(df, 2, first=False), "i", "v")] == list("abcdefggg")
    assert rows(batch.equal_parts(df, 3), "v", "part") == [(v, i // 2) for i, v in enumerate("abcdef")]
    assert [v for (v,) in rows(batch.percent_slice(df, 30, 100), "v")] == list("cdefg")


def test_own_formats(spark, tmp_path):
    (tmp_path / "x.pipe").write_text("1|a\n2|b\n")
    read = lambda s, p: s.read.option("sep", "|").schema("n int, t string").csv(p)
    readers.register_format("pipe", read)
    try:
        assert rows(readers.read_tables(spark, [str(tmp_path / "x.pipe")]), "n", "t") == [(1, "a"), (2, "b")]
        with pytest.raises(ValueError):
            readers.register_format("pipe", lambda s, p: None)
        with pytest.raises(ValueError):
            readers.read_tables(spark, ["x.none"])
    finally:
        del readers.FORMATS["pipe"]


def test_columns_rows_and_prefixes(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "i bigint, x string, y int")
    left, right = batch.column_partition(df, ["x", "gone"], ["i"])
    assert left.columns == ["i", "x"] and right.columns == ["i", "y"] and rows(batch.row_at(df, 1), "x") == [("b",)]
    for at in (-1, 2):
        with pytest.raises(IndexError):
            batch.row_at(df, at)
    assert [r["p"] for r in df.select(readers.with_prefix(F.when(F.col("i") == 0, "x: q").otherwise("q"), "x: ").alias("p")).collect()] == ["x: q", "x: q"]


def test_samples_come_out_the_same(spark):
    df = spark.range(2000).select(F.col("id").alias("k")).repartition(7)
    order = [r["k"] for r in sampling.seeded_order(df, 5, "k").orderBy("i").collect()]
    assert order == sorted(range(2000), key=lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest()) and order[:50] != list(range(50))
    assert {r["k"] for r in sampling.random_subset(df, 40, 5, "k").collect()} == set(order[:40])
    parts = sampling.random_split(df, {"a": 0.2, "b": 0.8}, 1, "k").groupBy("part").count().collect()
    share = {r["part"]: r["count"] / 2000 for r in parts}
    assert abs(share["a"] - 0.2) < 0.04 and sum(share.values()) == 1
    e = sampling.epoch_batches(df, 64, 2, 9, "k").groupBy("epoch", "batch").agg(F.sort_array(F.collect_list("k")).alias("ks")).collect()
    for n in (0, 1):
        own = {r["batch"]: r["ks"] for r in e if r["epoch"] == n}
        assert sorted(k for ks in own.values() for k in ks) == list(range(2000)) and {len(ks) for b, ks in own.items() if b < 31} == {64}
    assert {tuple(r["ks"]) for r in e if r["epoch"] == 0} != {tuple(r["ks"]) for r in e if r["epoch"] == 1}


def test_resampling_follows_the_weights(spark):
    weights = [(0, 5000), (1, 0), (2, None), (3, -4), *[(i, 10) for i in range(10, 510)]]
    df = spark.createDataFrame(weights, "k int, w bigint")
    drawn = [r["k"] for r in sampling.resample(df, "w", 4000, 2, "k").collect()]
    assert len(drawn) == 4000 and not {1, 2, 3} & set(drawn) and abs(drawn.count(0) / 4000 - 0.5) < 0.04
    assert sampling.resample(df.where("w <= 0"), "w", 10, 2, "k").count() == 0


def test_golden_balance():
    lengths, groups = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4, [i // 4 for i in range(16)]
    parts = balance.balance_batch(lengths, 2, groups=groups)
    assert sorted(i for p in parts for i in p) == list(range(16)) and all(len({groups[i] for i in p}) == 2 for p in parts)
    parts = balance.balance_batch(lengths, 4, minibatch=8)
    assert [len(p) for p in parts] == [4] * 4 and all(sorted(i // 8 for i in p) == [0, 0, 1, 1] for p in parts)
    plain = balance.balance_batch(lengths, 4)
    loads = [sum(balance.workload(lengths[i]) for i in p) for p in plain]
    assert max(loads) == min(loads) and all(lengths[p[0]] == min(lengths[i] for i in p) for p in plain)
    assert all(lengths[p[-1]] <= max(lengths[i] for i in p) for p in plain)
    with pytest.raises(ValueError):
        balance.balance_batch(lengths[:15], 2, minibatch=8)


def test_every_item_needs_a_part(spark):
    df = spark.createDataFrame([(0, i, 5) for i in range(9)], "b int, i int, n int")
    with pytest.raises(Exception, match="every item must be in one part"):
        balance.by_batch(df, "b", "i", "n", lambda v: [[0, 1], [2, 3]]).collect()


def test_balanced_parts_of_the_documents(spark, tiny):
    size = {r["doc_id"]: (r["n_chars"] or 0) + 1 for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "n_chars").collect()}
    batches = {}
    for i in sorted(size):
        batches.setdefault(i // 64, []).append(i)
    for name in ("b15_balanced_parts", "b16_greedy_parts", "b17_micro_batches", "b19_group_parts", "b20_balanced_order"):
        got = {}
        for r in RUN[name](spark, tiny).collect():
            got.setdefault(r["batch"], {}).setdefault(r["part"], []).append((r["place"] if "place" in r.asDict() else 0, r["doc_id"]))
        for b, own in batches.items():
            parts = {p: [i for _, i in sorted(x)] for p, x in got[b].items()}
            assert sorted(i for p in parts.values() for i in p) == own
            load = [sum(size[i] for i in p) for p in parts.values()]
            work = [sum(balance.workload(size[i]) for i in p) for p in parts.values()]
            heavy = max(balance.workload(size[i]) for i in own)
            if name == "b15_balanced_parts":
                assert max(load) - min(load) <= max(size[i] for i in own)
            if name == "b16_greedy_parts":
                sums, want = [0] * 4, {}
                for i in own:
                    j = sums.index(min(sums))
                    sums[j] += size[i]
                    want.setdefault(j, []).append(i)
                assert {p: sorted(x) for p, x in parts.items()} == want
            if name == "b17_micro_batches":
                assert len(parts) == max(1, min(len(own), -(-sum(load) // 20000))) and max(work) - min(work) <= heavy
            if name == "b19_group_parts":
                runs = [own[at : at + 4] for at in range(0, len(own), 4)]
                assert all(any(set(run) <= set(p) for p in parts.values()) for run in runs) and len(parts) == 2 - len(runs) % 2
            if name == "b20_balanced_order":
                assert len({len(p) for p in parts.values()}) == 1
                for p in parts.values():
                    w = [balance.workload(size[i]) for i in p]
                    top = w.index(max(w))
                    assert w[: top + 1] == sorted(w[: top + 1]) and w[top:] == sorted(w[top:], reverse=True)


def test_matched_calls_and_gates_of_the_rollouts(spark, tiny):
    data = {r["row_id"]: r for r in spark.read.parquet(f"{tiny}/prompted_search_smoke.parquet").collect()}
    calls = lambda r: [(x["tool_type"] if x is not None and x["tool_type"] is not None else "none", i) for i, x in enumerate(r["steps"])] if r and r["steps"] else None
    want = {}
    for i, r in data.items():
        said, gold = calls(r), calls(data.get(i - 1))
        if not said or not gold:
            continue
        if said == gold:
            want[i] = 3.0
            continue
        free, score, possible = list(said), 0.0, 1.0 + 2 * len(gold)
        both = sum(min([n for n, _ in gold].count(t), [n for n, _ in said].count(t)) for t in {n for n, _ in gold})
        score += both / (len(gold) + len(said) - both)
        for name, at in gold:
            same = [c for c in free if c[0] == name]
            if same:
                best = max(same, key=lambda c: (c[1] == at, -free.index(c)))
                score += 1 + (best[1] == at)
                free.remove(best)
        want[i] = round(6 * score / possible - 3, 6)
    assert dict(rows(RUN["j16_tool_matching"](spark, tiny), "row_id", "score")) == pytest.approx(want) and len(want) > 20

    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    gates = {}
    for i, r in data.items():
        golds = [norm(g) for g in r["gold_answers"] or [] if g]
        agree = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in itertools.combinations(golds, 2)]
        agreed = not agree or sum(agree) / len(agree) >= 0.8
        for pos, x in enumerate(r["steps"] or []):
            if x is None:
                continue
            if x["tool_type"] != "stop":
                gates[i, pos] = -0.25 if agreed else 0.5
                continue
            common, said = (max(golds, key=lambda g: (golds.count(g), -golds.index(g))) if golds else ""), norm(x["action_text"] or "")
            near = bool(said and common) and (said in common or common in said or difflib.SequenceMatcher(None, said, common).ratio() >= 0.8)
            gates[i, pos] = 1.0 if agreed and near else -0.5
    assert {(a, b): c for a, b, c in rows(RUN["w33_gate_reward"](spark, tiny), "row_id", "pos", "gate")} == gates


def test_staleness_against_a_loop(spark):
    from tracequarry.streaming import queues

    rng = random.Random(5)
    events = [(k, i, rng.choice(["sample", "sample", "consume", "sync", "other"])) for k in (1, 2) for i in range(80)]
    got = {(r["k"], r["i"]): (r["version"], r["queued"], r["stale"], r["pause"]) for r in queues.staleness(spark.createDataFrame(events, "k int, i int, kind string"), "k", "i", "kind", 6, 4).collect()}
    for k in (1, 2):
        version = queued = stale = 0
        for _, i, kind in (e for e in events if e[0] == k):
            if kind == "sample":
                queued, stale = queued + 1, stale + 1
            elif kind == "consume":
                queued = max(0, queued - 1)
            elif kind == "sync":
                version, stale = version + 1, queued
            assert got[k, i] == (version, queued, stale, stale >= 6 or queued >= 4)


def test_call_dialects():
    xml = "<tool_call><function=find><parameter=n>\n7\n</parameter><parameter=q>a <b> c</parameter></function><function=bare></function></tool_call> tail <tool_call><function=open><parameter=x>nu"
    assert pyfn.xml_calls(xml, {"n": "integer"}) == [{"name": "find", "arguments": json.dumps({"n": 7, "q": "a <b> c"})}, {"name": "bare", "arguments": "{}"}, {"name": "open", "arguments": '{"x": "nu"}'}]
    assert pyfn.xml_calls("no call", {}) == []
    one = "<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{bad<|call|>"
    assert pyfn.channel_calls(one) == [{"name": "f", "arguments": "{bad"}]
    assert pyfn.channel_calls("<|channel|>analysis<|message|>x " + one + "<|end|>") == [] and pyfn.channel_calls("text") == []
    assert [c["name"] for c in pyfn.channel_calls(one + one.replace(".f ", ".g "))] == ["f", "g"]


def test_tool_rewards(spark):
    gold = '<tool_call>\n{"name": "f", "parameters": {"a": 1}}\n</tool_call>'
    assert pyfn.tool_score("x", "no call") == 0.0 and pyfn.tool_score(gold, gold) == 3.0 and pyfn.tool_score("x", gold) == -3.0
    assert pyfn.tool_score("<tool_call>\n{bad\n</tool_call>", gold) == -3.0 and pyfn.tool_score('<tool_call>\n{"name": "g"}\n</tool_call>', gold) == -3.0
    cases = [("<think>a</think>\n" + gold, gold, 1), ("<think>a</think>" + gold, gold, 0), ("<think>a</think>", "x", 1), ("<think>a</think>\n<response>r</response>", "<response>", 1), ("<think></think>\n<response><response>r</response>", "<response>", 0), (None, gold, 0)]
    df = spark.createDataFrame(cases, "a string, g string, ok int")
    assert all(r["v"] == r["ok"] for r in df.select(scorers.N.tool_format(F.col("a"), F.col("g")).alias("v"), "ok").collect())


def test_custom_rewards(spark, tmp_path):
    path = tmp_path / "own.py"
    path.write_text("import re\nWORD = re.compile('a')\ndef r(data_source, solution_str, ground_truth, extra_info, k=1):\n    return k * len(WORD.findall(solution_str))\nasync def later(d, s, g, e):\n    return {'score': 2, 'e': e}\ndef short(d, s, g):\n    return [0.0]\n")
    df = spark.createDataFrame([("s", "banana", "x", "e"), ("s", None, "x", None)], "d string, a string, t string, e string")
    col = [F.col(c) for c in "dat"]
    assert [r["r"] for r in df.select(hooks.custom_reward(hooks.load_function(str(path), "r", k=2), *col).alias("r")).collect()] == [(6.0, "{}"), (None, None)]
    assert df.select(hooks.custom_reward(hooks.load_function(str(path), "later"), *col, F.col("e")).alias("r")).first()["r"] == (2.0, '{"e": "e"}')
    with pytest.raises(Exception, match="one score a row"):
        df.coalesce(1).select(hooks.batched_reward(hooks.load_function(str(path), "short"), *col)).collect()
    with pytest.raises(AttributeError):
        hooks.load_function(str(path), "gone")
    with pytest.raises(FileNotFoundError):
        hooks.load_function(str(tmp_path / "gone.py"), "r")
    (tmp_path / "bad.py").write_text("1 / 0")
    with pytest.raises(RuntimeError):
        hooks.load_function(str(tmp_path / "bad.py"), "r")


def test_growing_sampling_mapping_and_tools(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, t string")
    grown = hooks.grow(df, lambda x: x.select((F.col("k") + 10).alias("k")), F.col("k") > 11)
    assert rows(grown, "k", "t") == [(1, "a"), (12, None), (13, None), (2, None), (3, "c")]
    with pytest.raises(ValueError):
        hooks.grow(df, lambda x: x.withColumn("other", F.lit(1)))
    assert [k for _, k in rows(hooks.sampled(df, lambda x: -F.col("k"), "k"), "turn", "k")] == [3, 2, 1]
    assert [k for _, k in rows(hooks.sampled(df, None, "k"), "turn", "k")] == [1, 2, 3]
    assert rows(hooks.map_rows(df, lambda r, i: {"s": f"{i}{r['t']}"}, "s string", "k"), "s") == [("0a",), ("1None",), ("2c",)]
    tools = hooks.Toolbox()
    tools.register("up", F.upper)
    assert [r["o"] for r in df.orderBy("k").select(tools.observe(F.when(F.col("k") < 3, "up").otherwise("x"), F.col("t")).alias("o")).collect()] == ["A", None, "unknown tool"]
    with pytest.raises(ValueError):
        tools.register("up", F.lower)


def test_first_actions(spark):
    cases = [
        ("Where is the mill?", False, "text_search", "x", ("stop", "m", 0)), ("Where is the mill?", True, "stop", " ", ("text_search", "Where is the mill?", 0)), ("Where?", None, "stop", "unknown", ("text_search", "Where?", 0)), ("Where?", True, "zoom", "x", ("text_search", "Where?", 1)),
        ("Where?", True, "image_search", " Query ", ("image_search", "Where?", 0)), ("Where?", False, "stop", "Final Answer", ("stop", "unknown", 1)), ("Where?", True, "stop", "Rome ", ("stop", "Rome", 0)), (None, None, None, None, ("text_search", "", 1)),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "q int, question string, needs_search boolean, policy_tool string, policy_action string")
    x = agent.decided(df, {"mill": "m", "tower": "t"})
    assert [tuple(r) for r in x.orderBy("q").select("tool", "action", "invalid").collect()] == [c[4] for c in cases]
    found = spark.createDataFrame([(1, 1, 50, None), (1, 2, 51, "late"), (1, 3, 52, "later"), (3, 1, 50, None)], "q int, rank int, doc bigint, answer string")
    y = {r["q"]: r for r in agent.answered(x, found, "q").collect()}
    assert (y[1]["answer"], [s["docs"] for s in y[1]["steps"]]) == ("late", [[50, 51, 52], []]) and y[3]["answer"] == "unknown" and len(y[0]["steps"]) == 1


def test_scans_of_long_arrays(spark):
    n = 10_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.lit(1.0)).alias("r"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7 != 0).cast("int")).alias("m"))
    got = df.select(seqscan.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("g")).first()["g"]
    g, want = 0.0, []
    for i in range(n, 0, -1):
        want.append(1 + 0.9 * g)
        g = want[-1] * (i % 7 != 0)
    assert got == pytest.approx(want[::-1])
    odd = spark.createDataFrame([([], []), (None, [1]), ([1.0, None], [1, 1])], "r array<double>, m array<int>")
    assert [r["g"] for r in odd.select(seqscan.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("g")).collect()] == [[], None, [1.0, 0.0]]
    assert odd.select(seqscan.adaptive_coefficient(F.col("r"), 0.2, 1.0, 10, 1).alias("g")).collect()[2]["g"] == pytest.approx([0.2, 0.2 * 0.98])


def test_many_queries_are_met_in_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"word{i % 7} tail{i % 3}") for i in range(60)], "id bigint, t string")
    asked = spark.createDataFrame([(i, f"word{i} tail1") for i in range(9)], "q bigint, t string")
    sent = rows(retrieval.substring_search(asked, corpus, 4), "q", "doc", "score", "rank")
    monkeypatch.setattr(retrieval, "SENT_QUERIES", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 25)
    assert rows(retrieval.substring_search(asked, corpus, 4), "q", "doc", "score", "rank") == sent and len(sent) == 36
    words = [("the a b", "b c"), ("the the", ""), ("c c d the", None)]
    docs = spark.createDataFrame([(i, words[i % 3][0] + f" x{i % 5}") for i in range(40)] + [(99, None)], "doc bigint, t string")
    wanted = spark.createDataFrame([(1, "the c x3"), (2, "b x1 x1"), (3, None), (4, "nothing")], "q bigint, t string")
    pairs = spark.createDataFrame([(1, 2), (1, 7), (2, 33), (4, 5)], "q bigint, doc bigint")
    args = (wanted, docs, "q", "t", "doc", "t", 1.2, 0.75, True)
    by_join = (rows(retrieval.bm25_search(*args, 4), "q", "doc", "score", "rank"), rows(retrieval.bm25_ranks(pairs, *args), "q", "rank"))
    monkeypatch.setattr(retrieval, "SENT_QUERIES", 100)
    assert (rows(retrieval.bm25_search(*args, 4), "q", "doc", "score", "rank"), rows(retrieval.bm25_ranks(pairs, *args), "q", "rank")) == by_join and len(by_join[0]) == 8 and len(by_join[1]) == 2
    scored = spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0), (1, 4, 2.0), (2, 1, 1.0)], "q int, doc int, score double")
    assert rows(retrieval.best_ranks(scored.where("doc in (5, 1)"), scored), "q", "rank") == [(1, 3), (2, 1)]


def test_scorers_and_strict_lines(spark, tmp_path):
    df = spark.createDataFrame([("Answer: 1\nso answer :  1,000 ", ["1000"]), ("no line", ["1000"]), ("x \\boxed{1000}", ["1000"]), (None, ["x"])], "a string, g array<string>")
    assert [r["s"] for r in df.select(scorers.scorers["math_line"](F.col("a"), F.col("g")).alias("s")).collect()] == [1.0, -1.0, -1.0, -1.0]
    assert [r["s"] for r in df.select(scorers.scorers["math_box"](F.col("a"), F.col("g")).alias("s")).collect()] == [-1.0, -1.0, 1.0, -1.0]
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, " ")], "n int, t string")
    assert readers.require_objects(lines, "n", "t").count() == 1
    for bad in ("[1]", "{", "7"):
        with pytest.raises(Exception, match="no JSON object in line 9"):
            readers.require_objects(lines.union(spark.createDataFrame([(9, bad)], lines.schema)), "n", "t").collect()
    readers.write_step_files(spark.createDataFrame([(1, "a7"), (1, "b"), (2, "c")], "step int, t string"), str(tmp_path / "steps"))
    assert rows(readers.read_step_files(spark, str(tmp_path / "steps"), "t string", mask="[0-9]"), "step", "t") == [(1, "a*"), (1, "b"), (2, "c")]
