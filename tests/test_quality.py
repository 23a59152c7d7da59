import pytest
from pyspark.sql import functions as F

from kbspark.operators.ledger import nearest_ranks
from kbspark.operators.quality import diagnostics, drops, folded, funnel, judged, load_statistics, normal_value, regressions, report, results_match, scenario, statement_report, verdict_metrics

MATCH = [
    # got, want, unordered, ordered
    ([["a", "1"], ["b", "2"]], [["b", "2"], ["a", "1"]], True, False), ([["a", "1.0"]], [["a", "1"]], True, True), ([["Operations", "Derek", "179997"]], [["Operations"]], True, True),
    ([["Sales", "Operations"]], [["Operations", "Sales"]], False, False), ([["a"]], [["a", "b"]], False, False), ([["a"], ["a"]], [["a"], ["b"]], False, False), ([["a"]], [["a"], ["a"]], False, False),
    ([["a", "x"], ["a", "y"]], [["a"], ["a"]], True, True), ([[None]], [[None]], True, True), ([["3.14159265"]], [["3.1416"]], True, True), ([], [["a"]], False, False), ([["a"]], [], False, False),
]


@pytest.mark.parametrize("ordered", [False, True])
def test_results(spark, ordered):
    side = lambda k: spark.createDataFrame([(i, n, c, "x") for i, m in enumerate(MATCH) for n, c in enumerate(m[k])], "case_id int, row_no int, cells array<string>, c string")
    found = {r["case_id"]: r["matches"] for r in results_match(side(0), side(1), ordered).collect()}
    assert found == {i: m[3 if ordered else 2] for i, m in enumerate(MATCH)}


def test_values(spark):
    df = spark.createDataFrame([("1042.0", "1042"), (" 1e3 ", "1000"), ("0.33333333", "0.3333"), ("NaN", "NaN"), (" x ", "x"), ("1e400", "1e400"), (None, None)], "v string, w string")
    assert [r["n"] for r in df.select(normal_value(F.col("v")).alias("n")).collect()] == [r["w"] for r in df.collect()]
    assert spark.createDataFrame([("Ａ b\n C",), (None,)], "t string").select(folded(F.col("t")).alias("f")).collect()[0]["f"] == "abc"


ITEMS = [("a", None, 1, ["Pump", "X-1"], "the pump x-1"), ("b", None, 3, ["x", "y", "z"], "x"), ("c", None, 9, ["x"], "x"), ("d", "no_knowledge", None, ["x"], "未提及"), ("e", "no_knowledge", 1, [], "x"), ("f", "easy", 2, [], None), ("g", None, None, None, "x")]


def test_report(spark):
    rows = spark.createDataFrame(ITEMS, "id string, category string, rank int, keywords array<string>, answer string")
    full = judged(rows, 5)
    assert {r["id"]: r["passed"] for r in full.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": False, "g": False}
    r = report(full, [], 5).first()
    assert (r["total"], r["judged"], r["passed"], r["failed"], r["recall_rate"]) == (7, 7, 2, 5, 0.6) and abs(r["mrr"] - (1 + 1 / 3 + 1 / 2) / 5) < 1e-3
    bare = report(judged(rows, 5, answers=False), ["category"], 5)
    assert {r["category"]: (r["judged"], r["pass_rate"]) for r in bare.collect()} == {None: (4, 0.5), "easy": (1, 1.0), "no_knowledge": (0, None)}
    assert report(full.limit(0), [], 5).first()["pass_rate"] is None


def test_statements(spark):
    cases = spark.createDataFrame([(False, True, True, 1), (False, True, False, 3), (True, False, False, 9), (None, False, False, 2)], "clarified boolean, executed boolean, passed boolean, attempts int")
    assert statement_report(cases, []).first().asDict() == {"total": 4, "clarified": 1, "judged": 3, "executed": 2, "passed": 1, "accuracy": 0.3333, "valid_rate": 0.6667, "avg_attempts": 2.0}
    assert statement_report(cases.limit(0), []).first()["accuracy"] is None


def test_diagnostics(spark):
    schema = "id int, answer string, facts array<string>, evidence array<struct<source:string,text:string>>, contexts array<struct<source:string,text:string>>, cited array<int>, available array<int>"
    df = spark.createDataFrame([(1, "a b", ["a", "c"], [("s", "q"), ("t", "q")], [("s", "xqx")], [1, 7], [1, 2]), (2, "", [], [], [], [], [])], schema)
    found = {r["id"]: tuple(r)[1:] for r in diagnostics(df).collect()}
    assert found == {1: (0.5, 0.5, [7], 0.5), 2: (None, None, [], None)}


def test_verdicts(spark):
    schema = "id int, answerable boolean, answer string, correctness string, refusal string, claims array<struct<text:string,verdict:string,evidence:array<int>>>, citations array<struct<id:int,supported:boolean>>, available array<int>"
    rows = [
        (1, True, "a. b.", "partial", "none", [("a.", "supported", [1]), ("b.", "unsupported", [])], [(1, True), (2, False)], [1, 2]), (2, False, "no", "correct", "appropriate", [], [], []),
        (3, True, "a", "correct", "none", [("z", "supported", [1])], [], [1]), (4, True, "a", "correct", "none", [], [], []), (5, True, "a", "correct", "none", [("a", "supported", [9])], [], [1]), (6, True, "a", "correct", "appropriate", [], [], []), (7, True, "a", "correct", "none", [("a", "supported", [1])], [(3, True)], [1]),
    ]
    found = {r["id"]: r for r in verdict_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["sound"] for k, r in found.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    r = found[1]
    assert (r["correctness"], r["faithfulness"], r["citation_accuracy"], r["citation_coverage"], r["unsupported_claims"]) == (0.5, 0.5, 0.5, 0.5, 1)
    assert found[2]["faithfulness"] is None and found[2]["appropriate_refusal"] and found[3]["correctness"] is None


def test_what_got_worse(spark):
    before = spark.createDataFrame([(1, True, 1.0), (2, True, 0.5), (3, False, None), (4, True, 1.0)], "id int, passed boolean, m double")
    after = spark.createDataFrame([(1, False, 1.0), (2, True, None), (3, True, 0.1), (9, True, 1.0)], "id int, passed boolean, m double")
    assert {(r["id"], r["metric"]) for r in regressions(before, after, ["m"]).collect()} == {(1, "passed"), (2, "m"), (4, "missing")}
    a, b = spark.createDataFrame([(1.0, 0.5, None)], "x double, y double, z double"), spark.createDataFrame([(0.9, 0.5, 1.0)], "x double, y double, z double")
    assert {r["metric"]: r["change"] for r in drops(a, b, ["x", "y", "z"]).collect()} == {"x": "dropped", "y": "same", "z": "absent"}


def test_requests_and_loads(spark):
    rows = spark.sql("SELECT if(id < 90, 'm', NULL) AS k, timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS at, id AS elapsed_ms, id % 10 != 0 AS success FROM range(100)")
    found = {r["k"]: r for r in scenario(rows, "k").collect()}
    own = sorted(i for i in range(90) if i % 10)
    assert (found["m"]["requests"], found["m"]["failed"], found["m"]["p50"], found["m"]["p99"], found["m"]["wall_seconds"]) == (90, 9, own[40], own[80], 89.0) and len(found) == 2
    assert {r["k"]: r["p50"] for r in nearest_ranks(rows, "k", "elapsed_ms").collect()} == {"m": 44, None: 94}
    records = spark.createDataFrame([("md", "Ready ", 3), ("md", "ready", 0), ("md", "failed", 5), (None, None, None)], "file_format string, status string, chunk_count int")
    assert {r["file_format"]: (r["files"], r["processed"], r["empty"], r["chunks"]) for r in load_statistics(records).collect()} == {"md": (3, 2, 1, 3), None: (1, 0, 0, 0)}


def test_funnel(spark):
    items = spark.createDataFrame([(i, [w]) for i, w in enumerate(["none", "unfound", "low", "late", "first"])] + [(9, [])], "query_id int, keywords array<string>")
    docs = spark.createDataFrame([(1, "Unfound"), (2, "LOW"), (3, "late"), (4, "first"), (5, None)], "doc_id int, text string")
    found = spark.createDataFrame([(2, 2, 1), (3, 3, 8), (4, 4, 2)], "query_id int, doc_id int, rank int")
    lost = {r["query_id"]: r["lost_at"] for r in funnel(items, found, found.filter("query_id != 2"), docs, 5).collect()}
    assert lost == {0: "not_indexed", 1: "recall", 2: "threshold", 3: "rank", 4: "none"}
