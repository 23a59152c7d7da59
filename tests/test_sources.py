from pyspark.sql import types as T

from kbspark.session import cut, shared_dir
from kbspark.sources import files
from kbspark.streaming.ingest import ingest_available, stream_of, tool_calls


def test_a_second_run_takes_only_new_files(spark, tmp_path):
    source = f"{tmp_path}/t.parquet"
    take = lambda: ingest_available(stream_of(spark, str(tmp_path), "t"), f"{tmp_path}/out", f"{tmp_path}/check")
    spark.range(5).coalesce(1).write.parquet(source)
    take()
    take()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(source)
    take()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8


def test_tool_calls(spark):
    rows = [("r", 1, 0, "c1", "find", '{"a"'), ("r", 2, None, "", "", ":1}"), ("r", 3, 1, "c2", None, "{}"), ("s", 1, None, None, "x", None)]
    found = tool_calls(spark.createDataFrame(rows, "request string, seq int, slot int, call_id string, name string, part string"))
    assert sorted((r["request"], r["slot"], r["call_id"], r["name"], r["arguments"]) for r in found.collect()) == [("r", 0, "c1", "find", '{"a":1}'), ("r", 1, "c2", None, "{}"), ("s", 0, None, "x", "")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  grün 中 \n".encode())
    (tmp_path / "b.txt").write_bytes("中文资料".encode("gbk"))
    (tmp_path / "c.md").write_text(" # T ")
    (tmp_path / "d.txt").write_text("  ")
    (tmp_path / "e.bin").write_text("x")
    found = {r["source"]: (r["text"], r["encoding"]) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": ("grün 中", "utf-8"), "b.txt": ("中文资料", "gbk"), "c.md": (" # T ", "utf-8")}
    (tmp_path / "rows.jsonl").write_text('// note\n{"q": "a"}\n{broken\n{"z": 1}\n')
    assert [r["q"] for r in files.read_json_lines(spark, str(tmp_path / "rows.jsonl"), T.StructType([T.StructField("q", T.StringType())]), ["q"]).collect()] == ["a"]
    (tmp_path / "s.csv").write_text("a,b\n1,\n,\n 2,x\n")
    assert [(r["a"], r["b"]) for r in files.read_sheet(spark, str(tmp_path / "s.csv")).collect()] == [("1", None), (" 2", "x")]


def test_new_and_replaced(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, file_hash string")
    done = spark.createDataFrame([("a", "1", "success"), ("b", "2", "failed"), ("c", "9", "success")], "source string, file_hash string, status string")
    assert sorted(r["source"] for r in files.new_files(listed, done).collect()) == ["b", "c"]
    assert [r["source"] for r in files.matching_files(spark.createDataFrame([("x/a.txt",), ("b.md",)], "source string"), "*.txt, c?").collect()] == ["x/a.txt"]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in files.replace_rows(old, new, "k").collect()) == [(1, "x"), (2, "z")]


def test_cut_keeps_rows(spark):
    assert shared_dir(spark) and cut(spark.range(7)).count() == 7
