"""Pair defects, truncation, look-alikes: hand-made and awkward cases."""

import pytest
from pyspark.sql import functions as F

from tracequarry.llm import lookalikes as L
from tracequarry.llm import pair_defects as P
from tracequarry.llm import truncation as T

Q = "In which harbour crane did Siamdo Shian keep the mirrored sketch that Klas Riatu repaired in 1793?"
SOUND = [(100 + i, Q, ["Trund Marsk Hall"], "Trund Marsk Hall") for i in range(200)] + [(400 + i, Q, [str(1700 + i)], f"The answer is {1700 + i}, because the mirrored hall in the picture belongs to it.") for i in range(100)]
CASES = [
    (1, Q, ["Trund Marsk"], None, "empty"),
    (2, Q, ["Trund Marsk"], " ​<answer> </answer>", "empty"),
    (3, Q, ["Trund Marsk"], "N/A", "empty"),
    (4, Q, ["Trund Marsk Hall"], "Trund Mar", "truncated"),
    (5, Q, ["Trund Marsk Hall"], "The answer is Trund Marsk Hall, because the mirr", "truncated"),
    (6, Q, ["Trund Marsk Hall"], "I'm sorry, but I can't help with that.", "refusal"),
    (7, Q, None, "Lo siento, no puedo ayudar con eso.", "refusal"),
    (8, Q, ["Trund Marsk Hall", None], "  " + Q.upper() + "\n", "copied_question"),
    (9, Q, ["Trund Marsk Hall"], "Die Antwort lautet Trund Marsk Hall, weil die verlassene Mole auf dem Bild dazu gehört.", "other_language"),
    (10, Q, ["Trund Marsk Hall"], "Правильный ответ — Trund, потому что на фотографии видна стена.", "other_language"),
    (11, Q, ["Trund Marsk Hall"], "I cannot be fully sure, but the evidence for the mint clearly points to Trund Marsk Hall.", None),
    (12, Q, ["Trund Marsk Hall"], "Wrong Person", None),
    (13, Q, ["Trund Marsk Hall"], "You asked about the harbour crane, and the page names Trund Marsk Hall.", None),
    (14, None, None, "Trund Marsk", None),
    (15, "", [], "1793", None),
    (16, Q, ["Trund Marsk Hall"], Q + " Trund Marsk Hall, built by Olm Vent and Sark Bol.", None),
]
SCHEMA = "row_id bigint, question string, gold_answers array<string>, final_answer string"


def pairs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("defect", F.lit("clash")).withColumn("code", F.lit(7)).withColumn("sound", F.lit(True))


def test_pair_defects(spark):
    got = {r["row_id"]: r["defect"] for r in P.broken_pairs(pairs(spark, [c[:4] for c in CASES] + SOUND)).collect()}
    assert got == {c[0]: c[4] for c in CASES if c[4]}


def test_pair_labels_repeat_and_empty(spark):
    twice = [c[:4] for c in CASES[:1]] * 2 + SOUND
    assert P.pair_labels(pairs(spark, twice)).where("row_id = 1").count() == 2
    assert P.broken_pairs(pairs(spark, [])).count() == 0


def test_known_sound():
    assert P.known_sound(Q, "The answer is Trund Marsk Hall, because it is near.", ["Trund Marsk Hall"]) and P.known_sound(Q, "Hall", ["Hall"])
    for answer, gold in (("The answer is Trund Marsk Hall, because it", "Trund Marsk Hall"), ("The answer is Hallow, because it is near.", "Hall"), (Q, "Klas Riatu"), (None, "x")):
        assert not P.known_sound(Q, answer, [gold])
    assert not P.known_sound(Q, "Trund", ["Trund", "Trund Hall"])


def test_labelled_pairs_are_of_both_kinds():
    de = "Welche Mole hat Klas Riatu im Jahr 1793 gezeichnet und wem hat er sie verkauft?"
    rows = [(Q, "The answer is Trund Marsk Hall, because it is near.", ["Trund Marsk Hall"]), (Q, "Wrong", ["Hall"]), (de, "Die Antwort ist Olm Vent, weil er auf dem Bild ist.", ["Olm Vent"]), (de, "Olm Vent", ["Olm Vent"])]
    kinds = {}
    for kind, pair in P.labelled_pairs(rows):
        kinds.setdefault(kind, []).append(pair)
    assert set(kinds) == {None, *P.DEFECTS} and len(kinds[None]) == 3
    assert all(answer not in golds for _, answer, golds in kinds[None])  # sound ones are voted on without their gold answer
    assert {P.language_of(a) for q, a, _ in kinds["other_language"] if q == Q} == {"de"}


def test_cutoffs_need_both_kinds():
    post = {0: 0.1, 1: 0.6, 2: 0.96}
    assert P.choose_cutoff(post, {0: 99, 1: 1}, {2: 10}, 0.05) in (0.7, 0.8, 0.9)  # between the sound and the defective ones
    assert P.choose_cutoff(post, {0: 100}, {1: 5, 2: 5}, 0.05) == 0.5  # nothing sound reaches them: take all
    assert P.choose_cutoff(post, {0: 50, 1: 50}, {1: 1, 2: 9}, 0.05) >= 0.7  # a frequent sound pattern is not worth its few defects


def test_label_model_differs_from_majority():
    """Three functions that vote at random outvote two good ones; the model learns whom to trust."""
    counts: dict[int, int] = {}
    code = lambda v: sum((x + 1) * 3 ** (len(v) - 1 - j) for j, x in enumerate(v))
    for bad, n in ((False, 900), (True, 100)):
        for noise in range(8):
            good = 1 if bad else -1
            v = (good, good, *(1 if noise >> j & 1 else -1 for j in range(3)))
            counts[code(v)] = counts.get(code(v), 0) + n
    post, share = P.fit_label_model(counts, 5)
    sound_outvoted, bad_outvoted = (-1, -1, 1, 1, 1), (1, 1, -1, -1, -1)
    assert sum(sound_outvoted) > 0 > sum(bad_outvoted)  # the majority is wrong on both
    assert post[code(sound_outvoted)] < 0.01 and post[code(bad_outvoted)] > 0.99 and abs(share - 0.1) < 0.01


def test_very_long_answer():
    v = P.votes(Q, "word " * 50_000, ["x"], "en")
    assert len(P.encode(v).__str__()) > 0


def test_label_model_separates():
    sound, bad = [0, 0, 0], [2, 2, 2]
    code = lambda v: v[0] * 9 + v[1] * 3 + v[2]
    post, share = P.fit_label_model({code(sound): 900, code(bad): 40, code([2, 0, 0]): 10}, 3)
    assert post[code(bad)] > 0.95 and post[code(sound)] < 0.01 and 0.03 < share < 0.07
    assert P.fit_label_model({}, 3) == ({}, 0.0)


ENDS = frozenset({"9999"})


@pytest.mark.parametrize(
    "text, cut",
    [
        ("The hall was built in 1914.", False), ("The hall was bui", None), ("The hall was…", True), ("The hall was...", True), ("Opened: 1998 | Type: tram dep", False),
        ('A plaque reads: "Wedren mapped this.', True), ("It was added, approx.", True), ("Is it old?", False), ("  ", False), ("Which building was sold in 1872", False),
        ("caf�", True), ("*They wondered about the hall.*", False), ("<p>It stands.", True), ("tail \\u00", True),
    ],
)
def test_structure(text, cut):
    assert T.ends_early(text, ENDS) is cut


@pytest.mark.parametrize(
    "text, cut",
    [
        (Q, False), (Q[:-1], False), (Q[:40], True), ("mint Klas Riatu", False), ("mint Klas Ri", True), ("mint Klas", True), ("Find out when the mint of Olm was", None), ("Find out when it was paid for.", False),
    ],
)
def test_queries(text, cut):
    assert T.query_ends_early(text, Q, ENDS) is cut


STEP = "array<struct<step_id:int,tool_type:string,action_text:string,raw_observation:array<struct<title:string,snippet:string>>>>"


def test_truncated_values(spark):
    good = ("t", "The hall was built in 1914.")
    rows = [
        (1, "s", Q, [(0, "text_search", Q[:30], [good, None, ("t", "The hall was bui"), ("t", None), ("t", "")]), None, (2, "crop", Q[:30], None)]),
        (2, "s", None, [(0, "text_search", "mint Klas Riatu", [good])]),
        (3, None, Q, [(0, "stop", None, [("t", "The hall…")])]),
        (4, "s", Q, None),
        (5, "s", Q, []),
    ]
    df = spark.createDataFrame(rows, f"row_id bigint, data_source string, question string, steps {STEP}").withColumn("source", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((r["row_id"], r["step_id"], r["hit_pos"], r["field"]) for r in T.truncated_values(df).collect())
    assert got == [(1, 0, -1, "action_text"), (1, 0, 2, "snippet"), (3, 0, 0, "snippet")]
    rates = {(r["source"], r["field"]): (r["n_values"], r["n_cut"]) for r in T.truncation_rates(df).collect()}
    assert rates == {("s", "action_text"): (2, 1), ("s", "snippet"): (3, 1), (None, "snippet"): (1, 1)}
    assert T.truncated_values(df.where("false")).count() == 0


def test_a_query_cut_after_a_year(spark):
    question = "Welche Halle steht neben der Mühle, die Olm Vent im Jahr 1872 verkaufte?"
    ends = T.question_ends(spark.createDataFrame([(question,), (Q,), ("no mark 12",), (None,), ("Is it old ??",)], "q string"), "q")
    assert ends == {"verkaufte", "9999", "old"}
    assert T.query_ends_early("Welche Halle steht neben der Mühle, die Olm Vent im Jahr 1872", question, ends) is True
    assert T.query_ends_early(question[:-1], question, ends) is False
    assert T.query_ends_early("Welcher Turm steht neben der Mole, die Klas im Jahr 1790 verkaufte", question, ends) is False
    assert T.query_ends_early("Welcher Turm steht neben der Mole, die Klas im Jahr", question, ends) is None
    assert T.query_ends_early("Which building was sold in 1872", Q, ends) is False
    assert T.query_ends_early("Was it mapped?", "Was it mapped? And by whom?", ends) is False


def test_a_source_that_cuts_most_values(spark):
    cut, whole, fact, open_ = "The hall was bui", "The hall was built in 1914.", "Opened: 1998 | Type: tram depot", "The hall (built in"
    step = lambda *texts: [(0, "crop", None, [("t", x) for x in texts])]
    rows = [(1, "bad", None, step(cut, cut, cut, whole)), (2, "good", None, step(*[whole] * 9)), (3, "tiny", None, step(cut)), (4, "facts", None, step(fact, fact, cut))]
    df = spark.createDataFrame(rows, f"row_id bigint, data_source string, question string, steps {STEP}")
    assert sorted((r["row_id"], r["hit_pos"]) for r in T.truncated_values(df).collect()) == [(1, 0), (1, 1), (1, 2), (3, 0), (4, 2)]
    rates = {r["source"]: (r["n_values"], r["n_cut"]) for r in T.truncation_rates(df).collect()}
    assert rates == {"bad": (4, 3), "good": (9, 0), "tiny": (1, 1), "facts": (3, 1)}
    alone = spark.createDataFrame([(1, "bad", None, step(open_, "It stands near the mill. The hall was bui", cut, cut))], df.schema)
    assert [r["hit_pos"] for r in T.truncated_values(alone).orderBy("hit_pos").collect()][:2] == [0, 1]
    plain = spark.createDataFrame([(1, "plain", None, step(*["The hall near Ashford"] * 4, fact))], df.schema)
    assert T.truncated_values(plain).count() == 0  # no source ends a sentence: fact lines do not count as ended


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Ｃａｆé", "Café", True), ("Mus​eum\xa0X", "Museum X", True), ("Нall", "Hall", True), ("сор", "cop", True), ("Cafe", "Café", False), ("HALL", "Hall", False), ("", "​", True), ("москва", "mockba", False), ("a  b", "a b", False), ("Νορ", "Nop", True),
    ],
)
def test_visual_form(a, b, same):
    assert (L.visual_form(a) == L.visual_form(b)) is same


def test_forms_are_stable():
    for x in ("москва", "Ｈａｌｌ", "Правильный ответ", "", "Trárk"):
        assert L.visual_form(L.visual_form(x)) == L.visual_form(x)
    assert L.visual_form(None) is None and L.visual_form("Мoсквa") == "Москва"


def test_viterbi_differs_from_the_table():
    """Fitted scores choose the script whose words look like the token; the letter table would write all of it in Latin."""
    scores = L.Scores()
    for text in ["СССР построил завод", "весь народ СССР вырос", "Россия и СССР", "сорт", "сорок", "хор", "вор поёт"] * 30 + ["the cope of the hall", "a copper coin", "cot"] * 3:
        scores.add(text)
    form = L.VisualForms(scores)
    table = str.maketrans({**L.CYRILLIC, **L.GREEK})
    assert "сор".translate(table) == "cop" == L.visual_form("сор") and form("сор") == "сор"  # plain scores prefer Latin
    for text in ("cop", "сор", "сoр", "соp"):  # whatever was written
        assert form(text) == "сор"
    assert form("Нall") == "Hall" and form("hall") == form("hаll") == "hall"
    assert form("ϹοϜ") == form("CoϜ") != form("Co")


def test_scores_count_every_text(spark, monkeypatch):
    """No text is left out of the fit, whatever the number of rows: 6,000 texts, null and repeated ones among them."""
    texts = [f"hall number {'abcdefghij'[i % 10] * (i % 7)} cope" for i in range(5_400)] + ["весь народ СССР вырос, сорт"] * 590 + ["ΦΩ λόγος", None, "", "漢字 型a", "ﬁn Ǆ", "İi ẞ", "д1ж", "\u200b", "cоp", "12"]
    whole = L.Scores()
    for text in texts:
        whole.add(text)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, final_answer string").repartition(7)
    fits = [L.fit_scores(df.select("final_answer"))]
    monkeypatch.setattr(L, "HELD", 0, raising=False)  # counts handed on after every batch, not once a task
    fits.append(L.fit_scores(df.select("final_answer")))
    for fitted in fits:
        assert fitted.tokens == whole.tokens and fitted.firsts == whole.firsts and fitted.pairs == whole.pairs
    form = L.VisualForms(whole)
    assert {r["row_id"]: r["form"] for r in L.visual_forms(df, "row_id", "final_answer").collect()} == {i: form(x) for i, x in enumerate(texts)}


def test_bigrams_left_out_change_no_form(monkeypatch):
    import random

    rng = random.Random(7)
    words = lambda: " ".join("".join(rng.choice(of) for _ in range(5)) for of in rng.choices(("abcdefghknopxz", "авгдежкорсуф", "αβγδθκλνορω", "DГФacор漢字"), k=4))
    few, every = L.Scores(), L.Scores()
    seen = [words() for _ in range(300)]
    for text in seen:
        few.add(text)
    monkeypatch.setattr(L, "TELLING", type("All", (), {"__contains__": lambda self, x: True})())
    for text in seen:
        every.add(text)
    assert len(few.pairs) < len(every.pairs) and few.firsts == every.firsts
    a, b = L.VisualForms(few), L.VisualForms(every)
    for text in [words() for _ in range(300)]:
        assert a(text) == b(text)


@pytest.mark.parametrize("seed", range(5))
def test_equal_shapes_get_equal_forms_under_any_scores(seed):
    import random

    rng = random.Random(seed)
    scores = L.Scores()
    for _ in range(50):
        scores.add("".join(rng.choice("abcdефгжαβγδxyzхуcор") for _ in range(6)))
    form = L.VisualForms(scores)
    shapes = {}
    for other, latin in {**L.CYRILLIC, **L.GREEK}.items():
        shapes.setdefault(latin, [latin]).append(other)
    for _ in range(50):
        word = [rng.choice(sorted(shapes)) for _ in range(5)]
        a, b = ("".join(rng.choice(shapes[c]) for c in word) for _ in range(2))
        assert form(a) == form(b) and form(form(a)) == form(a)


def test_look_alike_pairs(spark):
    rows = [(1, "Hall", ["Нall", "Hall", None, "HALL"]), (2, None, ["x"]), (3, "x", None), (4, "", ["﻿"]), (5, "a\xa0b", ["a b"]), (5, "a\xa0b", ["a b"])]
    df = spark.createDataFrame(rows, "row_id bigint, final_answer string, gold_answers array<string>").withColumn("gold_pos", F.lit(9))
    assert sorted((r["row_id"], r["gold_pos"]) for r in L.look_alike_pairs(df).collect()) == [(1, 0), (4, 0), (5, 0), (5, 0)]
    assert L.look_alike_pairs(df.where("false")).count() == 0
    forms = {r["row_id"]: r["form"] for r in L.visual_forms(df, "row_id", "final_answer").collect()}
    assert forms == {1: "Hall", 2: None, 3: "x", 4: "", 5: "a b"}
    assert len(L.visual_form("О" * 100_000)) == 100_000
