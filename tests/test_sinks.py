import pytest
from pyspark.sql import functions as F

from kbspark.sources.sinks import append_ledger, as_json, audit_records, chunk_points, from_json_text, markdown_tables, merge_points, metric_lines, read_ledger, seal, usage_records, verify, write_table


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    write_table(df, f"{tmp_path}/t", None)
    write_table(df, f"{tmp_path}/t", "me", shared=True)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()] == [(1, "x", "me", True)]


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "request_id string, elapsed_ms double")
    append_ledger(rows, f"{tmp_path}/l")
    append_ledger(rows.filter("request_id = 'a'"), f"{tmp_path}/l")
    (tmp_path / "l" / "more.json").write_text('{"schema_version": 2, "request_id": "c"}\n{"request_id": \n')
    good, faults = read_ledger(spark, f"{tmp_path}/l", "elapsed_ms double")
    assert sorted((r["request_id"], r["elapsed_ms"]) for r in good.collect() if r["request_id"] == "b") == [("b", None)] and good.count() == 3
    assert sorted((r["request_id"] or "", r["fault"]) for r in faults.collect()) == [("", "broken"), ("a", "duplicate"), ("c", "version")]


def test_records(spark):
    df = spark.createDataFrame([(1, "s" * 9000, " "), (2, None, "e" * 3000)], "id int, sql_text string, error_text string")
    assert [(len(r["sql_text"] or ""), r["error_text"] and len(r["error_text"])) for r in audit_records(df).orderBy("id").collect()] == [(8000, None), (0, 2000)]
    calls = [(1, 3, 4, 7), (2, 3, None, 7), (3, None, None, 7), (4, 3, 4, None), (5, None, None, None), (6, 0, 0, 0), (7, -1, 4, 3), (8, None, 9, 7)]
    used = {r["id"]: (r["prompt"], r["completion"], r["total"]) for r in usage_records(spark.createDataFrame([(i, "s", p, c, t) for i, p, c, t in calls], "id int, scene string, prompt_tokens long, completion_tokens long, total_tokens long")).collect()}
    assert used == {1: (3, 4, 7), 2: (3, 4, 7), 3: (0, 0, 7), 4: (3, 4, 7), 8: (0, 9, 7)}


def test_points(spark):
    chunks = spark.createDataFrame([("a.md", 0, "x"), ("a.md", 1, "y")], "source string, chunk_index int, text string")
    vectors = spark.createDataFrame([("a.md", 0, [1.0]), ("a.md", 1, [2.0])], "source string, chunk_index int, vector array<double>")
    points = chunk_points(chunks, vectors)
    assert points.count() == 2
    with pytest.raises(ValueError, match="1 chunks"):
        chunk_points(chunks, vectors.limit(1))
    newer = points.filter("chunk_index = 0").withColumn("vector", F.array(F.lit(9.0)))
    merged = {r["chunk_index"]: r["vector"] for r in merge_points(points, newer.unionByName(newer)).collect()}
    assert merged == {0: [9.0], 1: [2.0]}


def test_metrics(spark):
    counts = spark.createDataFrame([('q"\n', 10, 1), ('q"\n', None, 3)], "scene string, bound long, upto long")
    lines = [r["line"] for r in metric_lines(counts, "ms", "scene").orderBy("place").collect()]
    assert lines == ['ms_bucket{scene="q\\"\\n",le="10"} 1', 'ms_bucket{scene="q\\"\\n",le="+Inf"} 3', 'ms_count{scene="q\\"\\n"} 3']


def test_inventories(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("c", "3"), (None, "4")], "name string, content string")
    sealed = seal(files)
    assert sealed.count() == 3 and verify(files, sealed).count() == 0
    now = spark.createDataFrame([("a", "1"), ("b", "changed"), ("d", "4")], "name string, content string")
    assert {tuple(r) for r in verify(now, sealed).collect()} == {("b", "changed"), ("c", "missing"), ("d", "added")}
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "name string, content string")
    assert [tuple(r) for r in verify(twice, seal(twice)).collect()] == [("a", "changed")]


def test_texts(spark):
    df = spark.createDataFrame([(1, "ü\"", None)], "id int, text string, page int")
    back = from_json_text(as_json(df, "id").unionByName(spark.createDataFrame([(2, "{broken")], "id int, line string")), "id int, text string, page int")
    assert {tuple(r) for r in back.filter("id IS NOT NULL").collect()} == {(1, 'ü"', None)}
    rows = spark.createDataFrame([("s", 0, ["a", " b "]), ("s", 1, ["1"]), ("s", 2, [None, "2", "3"]), ("t", 0, [])], "sheet string, row_no int, cells array<string>")
    assert {tuple(r) for r in markdown_tables(rows).collect()} == {("s", "| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n|  | 2 | 3 |")}
