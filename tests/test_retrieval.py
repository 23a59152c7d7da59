import math
import random

import pytest
from pyspark.sql import functions as F

from kbspark.functions.scalars import example_words, hits
from kbspark.operators.retrieval import beside, bm25, cosine, example_score, hybrid, rank_tables
from kbspark.operators.routing import column_words


def near(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else None


@pytest.mark.parametrize("size", [2, 256])
def test_cosine_is_exact(spark, size):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [0.0] * 4), (902, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "doc_id long, vector array<float>, score string").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:5]], "query_id long, vector array<float>")
    found = {(r["query_id"], r["rank"]): r["doc_id"] for r in cosine(df, queries, 7, size).collect()}
    for q, v in rows[:5]:
        scored = [(-round(s, 6), i) for i, w in rows if i is not None and w and len(w) == 4 and i != q and (s := near(v, w)) is not None] if any(v) else []
        assert [found.get((q, k + 1)) for k in range(7)] == [i for _, i in sorted(scored)[:7]] + [None] * (7 - len(sorted(scored)[:7]))
    assert cosine(df, queries.limit(0), 3).count() == 0 and cosine(df.limit(0), queries, 3).count() == 0


def test_bm25_counts_documents_without_terms(spark):
    docs = spark.createDataFrame([(1, "pump pump valve"), (2, "valve"), (3, None), (4, ""), (5, "other words here")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Pump valve"), (2, "nothing"), (3, None)], "query_id long, question string")
    found = bm25(docs, queries, 5).collect()
    mean, n = 7 / 5, 5
    part = lambda tf, dl, df: math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    assert [(r["query_id"], r["doc_id"]) for r in found] == [(1, 1), (1, 2)]
    assert abs(found[0]["score"] - part(2, 3, 1) - part(1, 3, 2)) < 1e-3 and abs(found[1]["score"] - part(1, 1, 2)) < 1e-3


def test_hybrid_keeps_hidden_documents_out(spark):
    docs = spark.createDataFrame([(1, "pump", [1.0, 0.0], None), (2, "pump valve", [0.9, 0.1], "x"), (3, "pump", [1.0, 0.0], "y"), (4, "zebra", [0.0, 1.0], None)], "doc_id long, text string, vector array<double>, tenant_id string")
    queries = spark.createDataFrame([(99, "pump", [1.0, 0.0])], "query_id long, question string, vector array<double>")
    found = [r["doc_id"] for r in hybrid(docs, queries, 3, visible=F.col("tenant_id").isNull() | (F.col("tenant_id") == "x")).orderBy("rank").collect()]
    assert found == [1, 2, 4]


def test_tables_and_examples(spark):
    kind = "table_name string, display_name string, columns array<struct<name:string,description:string,enum_values:string>>"
    tables = spark.createDataFrame([("employees", "员工表", [("department", "部门", "Sales/HR"), ("salary", "薪资", "")]), ("sales", "销售表", []), ("zzz", None, [(None, None, None)])], kind)
    queries = spark.createDataFrame([(1, "Sales 部门有多少员工？"), (2, None)], "query_id int, question string")
    scores = {(r["query_id"], r["table_name"]): r["score"] for r in rank_tables(tables, queries).collect()}
    assert scores[1, "employees"] == 2 * 3 + 2 + 2.5 and scores[1, "sales"] == 4 and scores[1, "zzz"] == 0 and scores[2, "employees"] == 0
    df = spark.createDataFrame([("员工 count v1.2", "员工数 count", ["t_a"])], "q string, e string, t array<string>")
    assert set(df.select(example_words(F.col("q")).alias("w")).first()["w"]) == {"员", "工", "员工", "count", "v1.2"}
    score = lambda q, e, t=None: df.select(example_score(F.lit(q), F.lit(e), ("count",), t).alias("s")).first()["s"]
    assert score("count t_a", "count x") == 0.5 + 0.35 and score("count t_a", "x count", F.col("t")) == 0.5 + 0.35 + 0.5 and score("", "count") == 0


def test_beside_and_words(spark):
    df, queries = spark.range(3), spark.createDataFrame([(7, "a"), (8, None)], "q int, t string")
    assert beside(df, queries, 1).count() == 6 and beside(df, queries.limit(0)).count() == 0 and beside(df, queries).columns == ["id", "q", "t"]
    row = spark.createDataFrame([("How MANY 合同",), (None,)], "c string")
    assert [r["h"] for r in row.select(hits(F.col("c"), ("合同", "how many", "x")).alias("h")).collect()] == [["合同", "how many"], []]
    words = {r["word"] for r in column_words(spark.createDataFrame([("部门名称 x",), ("a",), (None,)], "description string")).collect()}
    assert "部门名称" in words and "salary" in words
