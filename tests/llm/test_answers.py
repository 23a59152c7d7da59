import os
import re

import pytest

from kbspark.llm import answers
from kbspark.llm.answers import SAMPLE, Pair, answer_defects, clauses, pair_up
from kbspark.llm.crf import CRF, batches
from kbspark.llm.text import is_empty

LARGE = "/root/testdata/sf0.1"
ASK = {"en": "How long is the warranty on the pump of the XR-{}?", "de": "Wie lange gilt die Gewährleistung für die Pumpe der XR-{}?", "zh": "XR-{}的水泵保修多久？"}
TELL = {"en": "The pump of the XR-{} is covered for {} months. The operator signs the list and it is kept in the archive.", "de": "Für die Pumpe der XR-{} gelten {} Monate. Die Lieferung erfolgt nach der Bestätigung und wird vermerkt.", "zh": "XR-{}的水泵保修{}个月。质检员签署报销单后，将副本转交采购部。"}
CASES = [
    ("en", "I'm sorry, but I cannot help with that.", "refusal"), ("de", "Leider: dazu möchte ich keine Auskunft geben. Kann ich sonst etwas tun?", "refusal"), ("zh", "抱歉，我无法回答这个问题。", "refusal"),
    ("en", "You asked: How long is the warranty on the pump of the XR-7?", "copied_question"), ("en", "how long is the warranty on the pump of the xr-7", "copied_question"), ("zh", "问：“XR-7的水泵保修多久？”", "copied_question"),
    ("en", "Für die Pumpe der XR-7 gelten 9 Monate. Die Lieferung erfolgt nach der Bestätigung.", "other_language"), ("de", "XR-7的水泵保修9个月。质检员签署报销单。", "other_language"),
    ("en", "The pump of the XR-7 is covered for 9 months. The operator signs the", "truncated"), ("en", "The pump of the XR-7 is covered for 9 months. It is kept ...", "truncated"), ("zh", "XR-7的水泵保修9个月。质检员签署报销单后，", "truncated"),
    ("en", "N/A", "empty"), ("en", None, "empty"), ("en", "** --- **", "empty"), ("zh", "无", "empty"), ("en", "<br>", "empty"),
    ("en", "9 months", None), ("en", "Yes", None), ("en", "- the pump\n- the valve", None), ("en", "The pump is covered for 9 months.\n```sql\nSELECT 1 FROM t\n```", None),
    ("en", "Sorry for the wait! The list was approved by the operator.", None), ("en", "How long is the warranty on the pump of the XR-7? The pump of the XR-7 is covered for 9 months.", None),
    ("en", "We are unable to ship the pump before Monday. After that it takes 9 days.", None),
]


@pytest.fixture(scope="module")
def pairs():
    rows = [("m", i, ASK[k].format(i), TELL[k].format(i, i % 40 + 2), False, "x") for i in range(600) for k in [("en", "de", "zh")[i % 3]]]
    expected = {}
    for n, (lang, answer, defect) in enumerate(CASES):
        rows += [("q", n, ASK[lang].format(7), answer, False, "x")] * (1 + n % 2)
        expected[n] = defect
    rows += [("q", None, "How?", "", False, "x"), ("q", 900, "How long is it?", "I cannot answer this question.", True, "x"), ("q", 901, ASK["en"].format(7) + " Please answer in German.", TELL["de"].format(7, 9), False, "x"), ("q", 902, None, TELL["en"].format(7, 9), False, "x"), ("q", 903, "x" * 50_000, "The pump. " * 5000, False, "x")]
    # Defects of every kind for the fit.
    for i in range(1000, 1200):
        lang, answer, defect = CASES[i % 13]
        rows.append(("m", i, ASK[lang].format(i), answer and answer.replace("XR-7", f"XR-{i}").replace("xr-7", f"xr-{i}"), False, "x"))
    # Lists without stops, as the field has to see some to know that they are a way to write.
    rows += [("m", i, ASK["en"].format(i), f"- the pump of the XR-{i}\n- the valve" + "\n- the operator" * (i % 3), False, "x") for i in range(2000, 2040)]
    return rows, expected


def test_defects(spark, pairs):
    rows, expected = pairs
    df = spark.createDataFrame(rows, "record_table string, record_id long, question string, answer string, exempt boolean, defect string").repartition(3)
    found = answer_defects(df).collect()
    own = {r["record_id"]: r["defect"] for r in found if r["record_table"] == "q"}
    assert own == {k: v for k, v in expected.items() if v}
    assert len({(r["record_table"], r["record_id"]) for r in found}) == len(found)
    assert not [r for r in found if r["record_table"] == "m" and (r["record_id"] < 1000 or r["record_id"] >= 2000)]
    assert answer_defects(df.limit(0)).count() == 0


def test_clauses():
    assert clauses("One. Two 2.5 three!\n- item\n| a | b |\n```\ncode. x\n```\n一。二") == [("One.", "text"), ("Two 2.5 three!", "text"), ("item", "item"), ("| a | b |", "table"), ("```\ncode. x\n```", "code"), ("一。", "text"), ("二", "text")]
    assert clauses("") == []


def test_pairs_of_a_chat(spark):
    rows = [(1, "s", "User ", "q", 1, 1), (2, "s", "bot", "a", 2, 1), (2, "s", "bot", "b", 2, 5), (3, "s", "assistant", "c", 3, 1), (4, None, "assistant", "d", 2, 1), (5, "t", "AI", "e", 1, 1), (6, "s", "user", "r", 4, 1), (7, "s", "tool", "f", 5, 1)]
    messages = spark.createDataFrame(rows, "id long, session_id string, role string, content string, seq int, loaded_at int")
    assert [tuple(r) for r in pair_up(messages).collect()] == [(2, "q", "b")]


@pytest.mark.parametrize(("text", "empty"), [(None, True), ("", True), (" \n", True), ("​", True), ("...", True), ("n/a ", True), ("None.", True), ("<p></p>", True), ("&nbsp;", True), ("0", False), ("no", False), ("无", True), ("无法", False)])
def test_is_empty(spark, text, empty):
    from pyspark.sql import functions as F

    assert spark.range(1).select(is_empty(F.lit(text).cast("string")).alias("e")).collect()[0]["e"] is empty


def test_a_long_tag_is_empty(spark):
    from pyspark.sql import functions as F

    tag = f'<img src="data:{"A" * 5000}">'
    assert [spark.range(1).select(is_empty(F.lit(x)).alias("e")).collect()[0]["e"] for x in (tag, f"{tag} word", "<" + "a" * 300)] == [True, False, False]


def alternatives(pattern):
    """The alternatives of a pattern that stand outside all brackets."""
    out, depth, own = [], 0, ""
    for piece in re.findall(r"\\.|.", pattern):
        depth += (piece in "([") - (piece in ")]")
        if piece == "|" and not depth:
            out.append(own)
            own = ""
        else:
            own += piece
    return [*out, own]


@pytest.fixture(scope="module")
def chat(spark):
    from pyspark.sql import functions as F

    rows = answers._pairs(spark, LARGE).filter(~F.coalesce("exempt", F.lit(False)) & ~is_empty(F.col("answer"))).orderBy(F.xxhash64("record_id", "record_table"), "record_id").select("question", "answer")
    return [(r["question"], r["answer"]) for r in rows.collect()]


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_wordings_that_no_rule_has(chat, monkeypatch):
    """A fifth of the wordings of declining is taken from the rules at a time (three of the five, to save time); the field must find what only these would."""
    patterns = [(k, x) for k, p in zip(["en", "en", "de", "fr", "es", "zh"], answers._DECLINES, strict=True) for x in alternatives(p)]
    whole = answers._DECLINE
    unseen, found, false, others = 0, 0, 0, 0
    for fold in (0, 2, 4):
        kept = [x for k, x in enumerate(patterns) if k % 5 != fold]
        some = {k: re.compile("|".join(x for n, x in kept if n == k) or "(?!)", re.I) for k in ("en", "de", "fr", "es", "zh")}
        monkeypatch.setattr(answers, "_DECLINE", {None: re.compile("|".join(x for _, x in kept), re.I), **some})
        languages, field = answers.fit(chat[:SAMPLE])
        read = [Pair(q, a, languages) for q, a in chat]
        tags = [p.defect(t) for p, t in zip(read, field.decode([p.features() for p in read]), strict=True)]
        for (_, a), tag in zip(chat, tags, strict=True):
            bare = not re.search(r"\d", a)
            if bare and whole[None].search(a) and not answers._DECLINE[None].search(a):
                unseen, found = unseen + 1, found + (tag == "refusal")
            elif not whole[None].search(a):
                others, false = others + 1, false + (tag == "refusal")
    assert unseen > 100 and found >= 0.9 * unseen, (found, unseen)
    assert false <= 0.002 * others, (false, others)


def test_batches_are_bounded_by_what_they_hold():
    sequences = [[[1, 2]] * 50_000, [[3] * 3_000_000], *[[[1, 2, 3]] * 2 for _ in range(10)], []]
    groups = [sorted(g.tolist()) for g in batches(sequences, 4)]
    assert sorted(i for g in groups for i in g) == list(range(12)) and [1] in groups and max(map(len, groups)) <= 4
    assert [len(g) for g in batches([[[1]] * 300_000, [[1]] * 300_000], 4)] == [1, 1]
    assert [len(x) for x in CRF(8, 2).decode(sequences)] == [len(s) for s in sequences]


def test_every_pair_is_learned_from(spark):
    """German answers stand beyond the first hundred pairs only, and are known to fit German questions, however many blocks there are and however the table is stored."""
    from pyspark.sql import functions as F

    kind = "record_table string, record_id long, question string, answer string, exempt boolean"
    order = [r["record_id"] for r in spark.range(400).select(F.lit("m").alias("record_table"), F.col("id").alias("record_id")).orderBy(F.xxhash64("record_table", "record_id")).collect()]
    rows = [("m", i, ASK["en"].format(i), TELL["de" if k < 40 else "en"].format(i, i % 40 + 2), False) for k, i in enumerate(order[:360])]
    rows += [("m", i, ASK["de"].format(i), "Das Ventil hält den Druck und wird geprüft.", False) for i in order[360:399]] + [("m", order[399], ASK["de"].format(7), "Ventil hält Druck, Ventil geprüft.", False)]
    df = spark.createDataFrame(rows, kind)
    found = answer_defects(df.repartition(3), 100).collect()
    assert {r["record_id"]: r["defect"] for r in found} == dict.fromkeys(order[:40], "other_language")
    assert sorted(map(tuple, found)) == sorted(map(tuple, answer_defects(df.repartition(5, "answer"), 100).collect()))


def test_words_are_counted_over_the_table(spark):
    pairs = [(ASK[k].format(i), TELL[k].format(i, i % 40 + 2)) for i in range(300) for k in ASK] + [(None, "Der Rest ist und bleibt so."), ("", "x"), ("Why is it so?", "")]
    whole, table = answers.Languages.of_pairs(pairs), answers.Languages.of_table(spark.createDataFrame(pairs, "question string, answer string").repartition(5))
    assert whole.weight == table.weight and whole.topics == table.topics and "pump" not in whole.topics and len(whole.weight) > 50
    assert answers.Languages.of_pairs([]).weight == answers.Languages.of_table(spark.createDataFrame([], "question string, answer string")).weight


def test_fields_are_averaged_over_the_blocks_that_have_a_feature(spark):
    from functools import reduce

    fields = []
    for k in (1, 3):
        field = CRF(1 << 16, 5)
        field.emit[7], field.emit[k], field.step[:] = k, 0.5, k
        fields.append(field)
    blank = CRF(1 << 16, 5)
    rows = reduce(lambda a, b: a.unionByName(b), [spark.createDataFrame([(int(f), w) for f, w in zip(x["feature"], x["weight"], strict=True)], "feature int, weight array<long>") for x in map(answers._weights, [*fields, blank])])
    mean = answers._mean_field(rows)
    assert mean.emit[7].tolist() == [2] * 5 and mean.emit[1].tolist() == mean.emit[3].tolist() == [0.5] * 5 and (mean.step == 2).all()
    assert answers._mean_field(rows.limit(0)).emit.any() == False  # noqa: E712
