import random

import pytest

from kbspark.llm.encodings import align, characters, explain, garble, garbled_places, learn, restore, twins

GERMAN = ["Die Wärmepumpe benötigt höchstens {} Watt für den Betrieb.", "Eine übliche Prüfung verlängert die Wartungsabstände auf {} Monate.", "Die Geschäftsführung genehmigt {} € für Überstunden und Fernzugänge.", "Nach der Bestätigung erfolgt die Lieferung binnen {} Tagen für Käufer."]
FRENCH = ["La pompe coûte {} € à partir de la réception des pièces commandées.", "Le fournisseur remplace une poignée usée sous {} jours ouvrés après l’échéance."]
CHINESE = ["Pump{}型号的最大功耗为二瓦，整机重量为三千克，检测实验室保存记录。", "Valve{}上线以后，保养周期由九个月改为两个月，并由采购部留存记录。"]
WAYS = {"gbk": ("windows-1252", "gbk", 1), "twice": ("utf-8", "windows-1252", 2), "once": ("utf-8", "windows-1252", 1), "mac": ("utf-8", "mac_roman", 1), "cp437": ("windows-1252", "cp437", 1), "lost": ("windows-1252", "utf-8", 1)}


@pytest.fixture(scope="module")
def corpus():
    draw, docs, bad = random.Random(6), [], {}
    for i in range(900):
        kind = GERMAN if i % 3 else FRENCH
        text = " ".join(draw.choice(kind).format(draw.randrange(1, 99)) for _ in range(3))
        if i % 6 == 5:
            text = draw.choice(CHINESE).format(draw.randrange(1000, 9999))
        if i % 10 == 0 and i % 6 != 5:
            way = draw.choice(list(WAYS))
            bad[i] = (text, way)
            text = garble(text, *WAYS[way])
        docs.append((i, text, "x"))
    chinese = CHINESE[0].format(4711)
    docs += [(1000, chinese, "x"), (1001, garble(chinese, "utf-8", "windows-1252", 1), "x"), (1002, chinese.replace("4711", "8155"), "x")]
    bad[1001] = (chinese, "once")
    docs += [(2000, "Known issue: exports show fÃ¼r instead of für.", "x"), (2001, "Wird „ü“ als „Ã¼“ angezeigt, bitte neu laden.", "x"), (2002, None, "x"), (None, "fÃ¼r", "x"), (2003, "", "x"), (2004, "plain ASCII " * 9000, "x"), (2005, "已知问题：旧导出文件把Größe显示成GrÃ¶ÃŸe。", "x")]
    return docs, bad


def test_found_and_restored(spark, corpus):
    docs, bad = corpus
    df = spark.createDataFrame([*docs, docs[10]], "doc_id long, text string, garbled string").repartition(3)
    places = garbled_places(df).persist()
    found = {r["doc_id"] for r in places.collect()}
    assert found == set(bad), (found - set(bad), {k: bad[k] for k in set(bad) - found})
    mended = {r["doc_id"]: (r["text"], r["whole"]) for r in restore(df, places, twins(df)).collect()}
    assert set(mended) == set(bad)
    exact = [k for k, (clean, way) in bad.items() if way not in ("gbk", "lost")]
    assert sum(mended[k][0] == bad[k][0] for k in exact) >= 0.95 * len(exact)
    lost = [k for k, (_, way) in bad.items() if way == "lost"]
    assert any("�" not in mended[k][0] for k in lost) or not lost


def test_empty_table(spark):
    assert garbled_places(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_explain():
    assert "utf-8>windows-1252>1" in explain("fÃ¼r", "für")
    assert "utf-8>windows-1252>2" in explain(garble("für", "utf-8", "windows-1252", 2), "für")
    assert explain("anders", "für") == []


def test_align():
    assert align("fÃ¼r", "für") == [("Ã¼", "ü")]
    assert align("GrÃ¶ÃŸe", "Größe") == [("Ã¶ÃŸ", "öß")]
    assert align("MÃ¤rzgÃ¼te", "Märzgüte") == [("Ã¤", "ä"), ("Ã¼", "ü")]
    assert align("f黵", "für") == [("黵", "ür")] and align("gleich", "gleich") == []


#: A confusion that no two encodings make: each letter as two others.
OWN = {"ü": "ҫҗ", "ö": "ҫҙ", "ä": "ҫҡ", "é": "ҩҭ", "ß": "ҩ"}


def test_a_mapping_that_no_encodings_have(spark, corpus):
    docs, _ = corpus
    clean = {i: t for i, t, _ in docs if i is not None and 3 <= i < 900 and i % 10 and i % 6 != 5}
    bad = {i: t.translate(str.maketrans(OWN)) for i, t in clean.items() if i % 11 == 0}
    bad = {i: t for i, t in bad.items() if t != clean[i]}
    rows = [(i, bad.get(i, t)) for i, t in clean.items()] + [(3000, "Im Bericht steht fҫҗr statt für, das ist bekannt.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = characters(df)
    learned = learn(twins(df, seen), seen)
    assert learned.encodings == [] and not learned.lossy
    assert learned.runs and all(OWN.get(c) == g for g, c in learned.runs.items())
    places = garbled_places(df).persist()
    assert {r["doc_id"] for r in places.select("doc_id").distinct().collect()} == set(bad)
    mended = {r["doc_id"]: r["text"] for r in restore(df, places, twins(df)).collect()}
    assert sum(mended[i] == clean[i] for i in bad) >= 0.9 * len(bad)


def test_nothing_is_learned_from_clean_text(spark, corpus):
    docs, bad = corpus
    df = spark.createDataFrame([(i, t) for i, t, _ in docs if i is not None and i < 900 and i not in bad], "doc_id long, text string")
    seen = characters(df)
    learned = learn(twins(df, seen), seen)
    assert learned.encodings == [] and learned.runs == {} and not learned.lossy
    assert garbled_places(df).count() == 0


def test_lost_characters_are_no_trace_where_none_were_learned(spark, corpus):
    docs, bad = corpus
    rows = [(i, t) for i, t, _ in docs if i is not None and i < 900 and i not in bad] + [(5000, "Das Zeichen � steht für ein unbekanntes."), (5001, "Muster�text ohne Zwilling")]
    assert garbled_places(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_quotations_stay(spark, corpus):
    docs, bad = corpus
    line = "Known issue: exports show fÃ¼r instead of für."
    text = f"{line}\n{garble(GERMAN[3].format(7), 'utf-8', 'windows-1252', 1)} fÃ¼r alle."
    df = spark.createDataFrame([*docs, (7000, text, "x")], "doc_id long, text string, x string").select("doc_id", "text")
    pairs = twins(df)
    mended = {r["doc_id"]: r["text"] for r in restore(df, garbled_places(df, pairs), pairs).filter("doc_id = 7000").collect()}
    assert mended[7000] == f"{line}\n{GERMAN[3].format(7)} für alle."
