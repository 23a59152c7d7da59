import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.operators import chunking, evaluation, inference, ledger, reconcile, retrieval, routing, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("function", "text", "value"),
    [
        (S.parse_number, "1,234.5", 1234.5), (S.parse_number, "￥20", 20.0), (S.parse_number, "x", None), (S.parse_number, "", None), (S.parse_number, None, None),
        (S.whole_number, " 0012 ", 12), (S.whole_number, "-7", -7), (S.whole_number, "1.5", None), (S.whole_number, "9" * 30, None),
        (S.base_name, "a\\b/c.txt", "c.txt"), (S.base_name, "a/..", None), (S.plain_path, "/docs/123/deadbeef01/x", "/docs/{id}/{id}/x"),
        (S.cited_numbers, "see [3] and 【参考 1】 [3]", [1, 3]), (S.search_tokens, None, []), (S.search_tokens, "RX‑51 和ab_c", ["rx-51", "和", "ab_c"]),
    ],
)
def test_scalars(spark, function, text, value):
    assert one(spark, function(F.lit(text).cast("string"))) == value


def test_dates(spark):
    days = {"2024/1/5": "2024-01-05", "2024-02-30": None, "2024-03-04 10:00": "2024-03-04", "May": None}
    for text, day in days.items():
        assert one(spark, S.normal_date(F.lit(text)).cast("string")) == day


def brute_windows(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            k = end
            while k > start + size // 2 and not (k < len(text) and text[k] in chunking.STOPS):
                k -= 1
            if k > start + size // 2:
                end = k + 1
        out.append(text[start:end].strip())
        start = end - overlap
    return [x for x in out if x]


def test_pieces_equal_brute_force(spark):
    draw = random.Random(3)
    texts = ["", "a", None, "x" * 4000, *("".join(draw.choice("ab。！\n ") for _ in range(draw.randrange(900))) for _ in range(60))]
    found = chunking.pieces(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), size=100, overlap=20).orderBy("doc_id").collect()
    assert [r["pieces"] for r in found] == [None if t is None else brute_windows(t, 100, 20) for t in texts]
    with pytest.raises(ValueError):
        chunking.pieces(spark.range(1), size=10, overlap=5)


def test_merge_small(spark):
    merged = lambda xs: one(spark, chunking.merge_small(F.array(*map(F.lit, xs)).cast("array<string>"), 5))
    assert merged([]) == []
    assert merged(["ab", "cd", "efghij", "k"]) == ["ab\ncd", "efghij", "k"]
    assert merged(["abcdef", "a", "b"]) == ["abcdef", "a\nb"]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "f", "| a | b |\n| --- | --- |\n| 1 | |\n| | |\n| 2 | 3 |"), (2, "f", "no | table"), (3, "f", None), (4, "f", "| a |\n|---|")], "doc_id int, source string, text string")
    assert [(r["row_no"], r["sentence"]) for r in chunking.table_rows(docs).orderBy("row_no").collect()] == [(1, "a: 1"), (3, "a: 2; b: 3")]
    assert chunking.table_pieces(docs, 2).filter("doc_id = 1").count() == 2
    assert [r["text"] for r in chunking.table_pieces(docs, 2).filter("doc_id = 4").collect()] == ["| a |\n|---|"]
    assert one(spark, chunking.without_page_marks(F.lit("a\n\nPage 3 of 9\n【第1页】\nb"))) == "a\nb"


def test_bm25_ties_nulls_and_empties(spark):
    docs = spark.createDataFrame([(1, "red pump"), (2, "red pump"), (3, None), (4, ""), (5, "blue pump pump")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red red"), (8, "zzz"), (9, None)], "query_id long, question string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.bm25(docs, queries, 5).orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]
    assert retrieval.bm25(docs.limit(0), queries, 5).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "doc_id long, vector array<double>")
    found = retrieval.cosine(vectors, vectors.filter("doc_id = 1").withColumnRenamed("doc_id", "query_id"), 3)
    assert [(r["doc_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(2, 1.0), (3, 0.0)]


def test_fusion_is_symmetric_and_thresholds(spark):
    a = spark.createDataFrame([(1, 10, 9.0, 1), (1, 11, 8.0, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "query_id long, doc_id long, score double, rank int")
    rows = lambda df: [(r["doc_id"], r["score"]) for r in df.orderBy("rank").collect()]
    assert rows(retrieval.fuse([a, b], 3)) == rows(retrieval.fuse([b, a], 3))
    assert rows(retrieval.fuse([a, b], 3))[0][0] == 11
    assert retrieval.drop_irrelevant(a, 8.5, 20).count() == 1
    assert retrieval.drop_irrelevant(a, 50, 60).count() == 1
    assert retrieval.drop_irrelevant(a, 50, 60, drop_all=True).count() == 0
    assert retrieval.drop_irrelevant(a, 1, 5, share=0.95).count() == 1


def test_visibility(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_current boolean")
    items = spark.createDataFrame([(1, "001"), (2, "2"), (3, None), (4, " "), (5, "x"), (6, "1")], "item int, v string")
    assert sorted(r["item"] for r in versions.visible(items, "v", rows).collect()) == [1, 3, 4, 6]


def test_versions(spark):
    rows = spark.createDataFrame([("k", 1, 1, "ready", "a"), ("k", 2, 2, "failed", "b"), ("m", 1, 3, "pending", "c"), (None, None, 4, "ready", "d")], "document_key string, doc_version int, id long, status string, file_hash string")
    assert {r["document_key"]: r["doc_version"] for r in versions.latest_versions(rows).collect()} == {"k": 2, "m": 1}
    assert [(r["document_key"], r["id"]) for r in versions.publish(rows).collect()] == [("k", 1)]
    offers = spark.createDataFrame([("k", "b"), ("m", "c"), ("m", "z"), ("new", "q"), ("new", "q")], "document_key string, file_hash string")
    assert sorted((r["document_key"], r["file_hash"], r["doc_version"], r["reused"]) for r in versions.reserve(rows, offers).collect()) == [("k", "b", 3, False), ("m", "c", 1, True), ("m", "z", 2, False), ("new", "q", 1, False)]


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id int, s string")
    same = a.orderBy(F.desc("id")).repartition(3)
    other = spark.createDataFrame([(1, "x"), (2, ""), (2, None)], "id int, s string")
    digest = lambda df: reconcile.fingerprint(df, ["id", "s"]).collect()[0]
    assert digest(a) == digest(same) and digest(a) != digest(other) and digest(a.limit(0))["rows"] == 0
    assert reconcile.changed_rows(a, a.limit(1)).count() == 2


def test_usage_of_nothing(spark):
    empty = spark.createDataFrame([], "scene string, created_at timestamp_ntz, prompt_tokens long, completion_tokens long, total_tokens long, elapsed_ms long")
    assert ledger.usage_by(empty, "scene").count() == 0
    assert ledger.usage_totals(empty).collect()[0].asDict() == {"calls": 0, "total_tokens": 0, "tokens_per_call": 0.0}


def test_inference(spark):
    df = spark.createDataFrame([("1", "2024-01-02", "1,000.5", None, "red"), ("-2", "2024/3/4", "7", "", "blue"), (" ", None, "$3", None, "red")], "a string, b string, c string, d string, e string")
    kinds = {r["column_name"]: r["inferred"] for r in inference.profile(df, df.columns).collect()}
    assert kinds == {"a": "INTEGER", "b": "DATE", "c": "NUMERIC(14,2)", "d": "TEXT", "e": "VARCHAR(64)"}
    bad = spark.createDataFrame([("1", 5), ("x", 6), (None, 7)], "a string, fits int")
    found = inference.split_rows(bad.withColumnRenamed("fits", "other"), {"a": "INTEGER"})
    assert [(r["a"], r["fits"]) for r in found.orderBy("other").collect()] == [(1, True), (None, False), (None, True)]


def test_evaluation(spark):
    items = spark.createDataFrame([(1, None, ["Red"]), (2, None, ["x"]), (3, "no_knowledge", ["red"]), (4, None, [])], "query_id long, category string, keywords array<string>")
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (4, 10, 1)], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(10, "blue"), (11, "a RED pump")], "doc_id long, text string")
    ranked = evaluation.ranks(items, found, docs)
    assert {r["query_id"]: r["rank"] for r in ranked.collect()} == {1: 2, 2: None, 3: None, 4: None}
    got = evaluation.summary(ranked, 5).collect()[0]
    assert (got["items"], got["hits"], got["recall"], got["mrr"], got["rank_2_3"], got["missed"]) == (3, 1, 0.3333, 0.1667, 1, 2)
    assert evaluation.summary(ranked.limit(0), 5).collect()[0]["recall"] is None
    before = spark.createDataFrame([(1, 1), (2, None), (3, 2), (5, 1)], "query_id long, rank int")
    after = spark.createDataFrame([(1, 3), (2, 1), (3, None), (6, 1)], "query_id long, rank int")
    assert {r["query_id"]: r["change"] for r in evaluation.changes(before, after).collect()} == {1: "worse", 2: "found", 3: "lost", 5: "missing", 6: "added"}


def test_row_cover(spark):
    cover = lambda got, want: one(spark, evaluation.covers(F.array(*map(F.lit, got)), F.array(*map(F.lit, want))))
    assert cover(["a", "b", "c"], ["a", "c"]) and cover(["a"], ["a"]) and not cover(["a", "b"], ["b", "a"]) and not cover(["a"], ["a", "b"])


def test_routes(spark):
    assert one(spark, routing.route(F.lit("How many rows are in x_y?"))) == "sql"
    assert one(spark, routing.route(F.lit("What does the warranty say?"))) == "rag"
    assert one(spark, routing.route(F.lit("Hello"))) == "llm"
    assert one(spark, routing.route(F.lit(None).cast("string"))) is None


def test_delete_and_upsert(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, None, 5)], "id int, s string, v int")
    assert retrieval.delete_matching(df, {}).count() == 3
    assert sorted(r["id"] for r in retrieval.delete_matching(df, {"s": "a", "v": 5}).collect()) == [1, 3]
    new = spark.createDataFrame([(9, "a", 5), (8, "b", 1)], "id int, s string, v int")
    assert sorted((r["s"] or "", r["id"]) for r in versions.upsert(df, new, ["s"], "v").collect()) == [("", 3), ("a", 9), ("b", 8)]


def test_activate(spark):
    rows = spark.createDataFrame([("k", 1, "ready", False), ("k", 2, "ready", True), ("m", 1, "ready", False), ("m", 2, "pending", True)], "document_key string, doc_version int, status string, is_current boolean")
    current = lambda df: sorted((r["document_key"], r["doc_version"]) for r in df.filter("is_current").collect())
    assert current(versions.activate(rows, "k", 1)) == [("k", 1), ("m", 2)]
    assert current(versions.activate(rows, "m", 1)) == [("k", 2), ("m", 2)]
    assert current(versions.activate(rows, "k", 7)) == [("k", 2), ("m", 2)]


def test_context(spark):
    from kbspark.operators import context

    ranked = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 99, 3)], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(10, "a.md", "x" * 300), (11, None, None)], "doc_id long, source string, text string")
    assert context.numbered_sources(ranked, docs).collect()[0]["context"] == "[1] : \n[2] a.md: " + "x" * 200
    assert one(spark, context.shortened(F.lit("y" * 50))) == "y" * 37 + "..."
    assert one(spark, context.logical_page(F.lit("a\nb\n- 12 -"))) == 12 and one(spark, context.logical_page(F.lit("12 pumps"))) is None


def test_pages_are_cut_too(spark, tmp_path):
    rows = [(1, "a.txt", "one\n\ntwo", "text"), (2, "b.pdf", "Page 1 of 2\n\nthree", "page"), (3, "c.txt", "four", None), (4, "d.pdf", None, "page")]
    spark.createDataFrame(rows, "doc_id long, source string, text string, doc_type string").withColumns({"file_format": F.element_at(F.split("source", r"\."), -1), "physical_page": F.lit(1), "total_pages": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda name: {r["doc_id"] for r in chunking.QUERIES[name](spark, str(tmp_path)).collect()}
    assert ids("chunks") == {1, 2, 3}
    for name in ("paragraphs", "blank_line_clean", "chunk_ids_md5", "filename_prefix"):
        assert (ids(name), ids(f"page_{name}")) == ({1, 2, 3}, {2, 3})
    cleaned = {r["doc_id"]: r["text_md5"] for r in chunking.QUERIES["page_blank_line_clean"](spark, str(tmp_path)).collect()}
    assert cleaned[2] == hashlib.md5(b"three").hexdigest()


def test_sheets_read_every_column(spark):
    body = "\n".join(f"| {i} | {'ab'[i % 2]} | ${i * i},000 | {'x' * i} |" for i in range(1, 13))
    docs = spark.createDataFrame([(1, "f", f"| id | team | pay | note |\n|--|--|--|--|\n{body}"), (2, None, "| a |\n|--|\n| 1 |"), (3, "f", None)], "doc_id int, source string, text string")
    cells = chunking.sheet_cells(docs)
    kinds = {(r["source"], r["name"]): (r["filled"], r["kind"]) for r in chunking.sheet_columns(cells).collect()}
    assert kinds == {("f", "id"): (12, "other"), ("f", "team"): (12, "categorical"), ("f", "pay"): (12, "numeric"), ("f", "note"): (12, "other"), (None, "a"): (1, "other")}
    assert {(r["name"], r["value"]): r["n"] for r in chunking.sheet_categories(cells).collect()} == {("team", "a"): 6, ("team", "b"): 6}
    ends = {(r["side"], r["place"]): (r["number"], r["row_no"]) for r in chunking.sheet_extremes(cells).collect()}
    assert ends == {("top", 1): (144000.0, 12), ("top", 2): (121000.0, 11), ("top", 3): (100000.0, 10), ("bottom", 1): (1000.0, 1), ("bottom", 2): (4000.0, 2), ("bottom", 3): (9000.0, 3)}


def test_tables_below_an_introduction(spark):
    docs = spark.createDataFrame([(1, "f", "Intro | 1.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nText\n| c |\n|--|\n| 3 |\nend"), (2, "f", "| a |\n|--|\n| 1 |"), (3, "f", None), (4, "f", "no | table\ntext")], "doc_id int, source string, text string")
    found = chunking.table_rows(chunking.inner_tables(docs)).select("doc_id.*", "row_no", "sentence").orderBy("table_no").collect()
    assert [tuple(r) for r in found] == [(1, 1, 1, "a: 1; b: 2"), (1, 2, 1, "c: 3")]
