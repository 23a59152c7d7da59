from pyspark.sql import functions as F

from kbspark.functions.scalars import base_name, version_chunk_id
from kbspark.operators.context import chat_turns, logical_page


def test_pages(spark):
    texts = ["text\n- 7 -", "Page 3 of 9\n" + "x\n" * 9, "12\n" + "x\n" * 9 + "Seite 4\n" + "y\n" * 9, "no 5 here", "", None, "0", "1\n2"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r["p"] for r in df.select("id", logical_page(F.col("text")).alias("p")).orderBy("id").collect()] == [7, 3, 4, None, None, None, None, 1]


def test_turns_with_tool_results(spark):
    rows = [("s", n, n, " User" if n % 2 else "bot", f"m{n}" if n != 3 else " ", "SELECT 1" if n in (1, 8) else None) for n in range(1, 9)] + [(None, 1, 99, "user", "x", None), ("t", 1, 50, "user", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "session_id string, seq int, id int, role string, content string, tool_context string, back string").drop("back")
    found = [(r["place"], r["speaker"], r["content"]) for r in chat_turns(df, 4).orderBy("place").collect()]
    assert found == [(1, "user", "m5"), (2, "assistant", "m6"), (3, "user", "m7"), (4, "assistant", "m8\n\n[tools]\nSELECT 1")]


def test_names_and_ids(spark):
    df = spark.createDataFrame([("a\\b/c.md",), ("x" * 513,), ("..",), (None,)], "p string")
    assert [r["n"] for r in df.select(base_name(F.col("p")).alias("n")).collect()] == ["c.md", None, None, None]
    ids = {spark.range(1).select(version_chunk_id(F.lit(v), F.lit(i), F.lit(t)).alias("x")).first()["x"] for v, i, t in ((1, 0, "a"), (2, 0, "a"), (1, 1, "a"), (1, 0, "b"))}
    assert len(ids) == 4
