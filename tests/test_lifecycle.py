import pytest
from pyspark.sql import functions as F

from kbspark.operators.reconcile import fingerprint, mark_unindexed, on_disk, reconcile_summary, reconciled
from kbspark.operators.versions import append_turns, delete_versions, ingest_versions, owned, recent_turns, version_history


@pytest.fixture(scope="module")
def found(spark):
    registered = spark.createDataFrame([("a.md",), ("a.md",), ("b.md",), ("gone.md",), (None,), (" ",)], "source string")
    indexed = spark.createDataFrame([("a.md",), ("orphan.md",), ("cli.md",), (None,)], "source string")
    disk = spark.createDataFrame([("a.md",), ("0f_b.md",), ("1_2_cli.md",), ("xorphan.md",), (None,)], "name string")
    return reconciled(registered, indexed, disk)


def test_reconcile(spark, found):
    assert {tuple(r) for r in found.collect()} == {("b.md", "missing_in_index"), ("gone.md", "missing_in_index"), ("gone.md", "missing_on_disk"), ("orphan.md", "orphan_in_index"), ("cli.md", "unregistered_on_disk")}
    assert reconcile_summary(found).first().asDict() == {"missing_in_index": 2, "orphan_in_index": 1, "unregistered_on_disk": 1, "missing_on_disk": 1, "clean": False}
    assert reconcile_summary(found.filter("bucket = 'unregistered_on_disk'")).first()["clean"]
    names = spark.createDataFrame([("dir/sub_1_x.md",), ("1_x.md",), ("x.md",), ("_x.md",), (".md",)], "source string")
    assert {r["source"] for r in on_disk(names, spark.createDataFrame([("sub_1_x.md",)], "name string")).collect()} == {"dir/sub_1_x.md", "1_x.md", "x.md"}


def test_marks_keep_what_else_is_said(spark, found):
    rows = [(1, "b.md", "ready", '{"pages": 3}'), (2, "gone.md", "ready", None), (3, "b.md", "ready", "{ }"), (4, "b.md", "ready", '{"reconcile": "x", "n": 1}'), (5, "a.md", "ready", "{}"), (6, "orphan.md", "ready", None)]
    out = {r["id"]: (r["status"], r["meta"]) for r in mark_unindexed(spark.createDataFrame(rows, "id int, source string, status string, meta string"), found).collect()}
    mark = '"reconcile": "no_vectors"'
    assert out == {1: ("failed", '{"pages": 3, ' + mark + "}"), 2: ("failed", "{" + mark + "}"), 3: ("failed", "{" + mark + "}"), 4: ("failed", "{" + mark + ', "n": 1}'), 5: ("ready", "{}"), 6: ("ready", None)}


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, True), (2, None, True)], "x int, y string, z boolean")
    same = lambda a, b: fingerprint(a).first() == fingerprint(b).first()
    assert same(df, df.orderBy(F.desc("x")).repartition(3)) and not same(df, df.distinct()) and not same(df, df.na.fill("\\N"[:0]))
    assert not same(df, df.withColumn("z", F.lit(False))) and fingerprint(df.limit(0)).first()["rows"] == 0


ROWS = [(1, "k", 1, "h1", "ready", 3, True, None), (2, "k", 2, "h2", "pending", None, False, None), (3, "k", 3, "h3", "pending", None, False, None), (4, "k", 1, "h9", "ready", 1, True, "x"), (5, None, None, None, "ready", 1, True, None), (6, "q", 1, "h6", "deleted", 2, False, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, document_key string, doc_version int, file_hash string, status string, chunk_count int, is_current boolean, tenant_id string").withColumn("updated_at", F.lit("2025-01-01").cast("timestamp_ntz"))


def test_versions_of_a_tenant(rows):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(owned(rows, None)) == [1, 2, 3] and ids(owned(rows, "x")) == [4] and ids(owned(rows, None, deleted=True)) == [1, 2, 3, 6] and ids(owned(rows, "")) == []
    history = {}
    for r in version_history(rows).orderBy("place").collect():
        history.setdefault(r["of_id"], []).append(r["id"])
    assert history == {1: [3, 2, 1], 2: [3, 2, 1], 3: [3, 2, 1], 4: [4]}


def test_deletes_hide(spark, rows):
    gone = {r["id"]: (r["status"], r["is_current"], str(r["updated_at"])[:10]) for r in delete_versions(rows, spark.createDataFrame([(1,), (1,), (99,), (None,)], "id int"), "2026-02-03").collect()}
    assert gone[1] == ("deleted", False, "2026-02-03") and gone[4] == ("ready", True, "2025-01-01") and len(gone) == 6


def test_results(spark, rows):
    results = spark.createDataFrame([(1, "h1", 9, 1), (2, "h2", 5, 1), (2, "bad", 5, 2), (3, "wrong", 4, 1), (6, "h6", 4, 1), (77, "x", 1, 1)], "id int, file_hash string, chunk_count int, delivered int")
    out = {r["id"]: tuple(r)[1:] for r in ingest_versions(rows, results).collect()}
    assert out == {1: ("ready", 3, False, "done"), 2: ("ready", 5, True, "ready"), 3: ("pending" if False else "failed", None, False, "mismatch"), 6: ("deleted", 2, False, "deleted"), 77: (None, None, False, "unknown")}
    late = ingest_versions(rows.withColumn("status", F.when(F.col("id") == 3, "ready").otherwise(F.col("status"))), results).filter("id = 2").first()
    assert late["verdict"] == "ready" and not late["publishes"]


def test_turns(spark):
    old = spark.createDataFrame([("s", 3), ("s", None), ("t", None)], "session_id string, seq int")
    new = spark.createDataFrame([("s", 8, 2), ("s", 7, 1), ("t", 9, 1), ("u", 6, 1), (None, 5, 1)], "session_id string, id int, arrived int")
    assert {(r["id"], r["seq"]) for r in append_turns(old, new).collect()} == {(7, 4), (8, 5), (9, 1), (6, 1)}
    rows = spark.sql("SELECT concat('s', id % 2) AS session_id, id, CAST(id AS INT) AS seq, timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, id * id) AS created_at FROM range(30)")
    got = recent_turns(rows, "2025-01-01 12:00:00", 3, 3600)
    assert sorted(r["id"] for r in got.collect()) == [22, 24, 26]
    assert recent_turns(rows, "2024-01-01").count() == 0
