from datetime import datetime

from kbspark.operators.events import fold_events
from kbspark.operators.references import orphan_references, orphan_totals

REFS = "field string, row_id long, value string, key string, at timestamp_ntz, known string, reason string, salt int"
PARENTS = "field string, key string, born timestamp_ntz, gone timestamp_ntz, n int"


def at(day):
    return None if day is None else datetime(2025, 1, day)


def refs(spark, rows):
    return spark.createDataFrame([(f, i, v, k, at(d), "x", "y", 7) for f, i, v, k, d in rows], REFS)


def parents(spark, rows):
    return spark.createDataFrame([(f, k, at(b), at(g), 1) for f, k, b, g in rows], PARENTS)


def expected(rows, held):
    out = []
    for f, i, v, k, d in rows:
        if v is None:
            continue
        known = [h for h in held if h[0] == f and h[1] == k and k is not None]
        if not known:
            out.append((i, "missing"))
        else:
            born, gone = known[0][2:]
            if d is not None and born is not None and born > d:
                out.append((i, "late"))
            elif d is not None and gone is not None and gone <= d:
                out.append((i, "deleted"))
    return sorted(out)


def test_each_reason_and_edges(spark):
    rows = [("a", 1, "1", "1", 5), ("a", 2, "1", "1", 1), ("a", 3, "2", "2", 9), ("a", 4, "2", "2", 2), ("a", 5, "9", "9", 3), ("a", 6, "x", None, 3), ("a", 7, None, None, 3), ("b", 8, "1", "1", 5), ("a", 9, "1", "1", None), ("a", 10, "3", "3", 4), ("a", 1, "1", "1", 1), ("a", 2, "1", "1", 1)]
    held = [("a", "1", 2, None), ("a", "2", 1, 4), ("a", "3", None, None)]
    found = orphan_references(refs(spark, rows), parents(spark, held), salts=3)
    assert sorted((r["row_id"], r["reason"]) for r in found.collect()) == expected(rows, held)
    assert found.columns == ["field", "row_id", "value", "at", "reason"]


def test_one_hot_key(spark):
    rows = [("a", i, "7", "7", 1 + i % 9) for i in range(600)] + [("a", 1000 + i, str(i + 10), str(i + 10), 3) for i in range(50)]
    held = [("a", "7", 4, None), ("a", "12", 1, 2)]
    found = orphan_references(refs(spark, rows), parents(spark, held))
    assert sorted((r["row_id"], r["reason"]) for r in found.collect()) == expected(rows, held)


def test_empty_tables(spark):
    rows = [("a", 1, "1", "1", 5)]
    assert orphan_references(refs(spark, []), parents(spark, [("a", "1", 2, None)])).count() == 0
    assert [r["reason"] for r in orphan_references(refs(spark, rows), parents(spark, [])).collect()] == ["missing"]
    totals = orphan_totals(refs(spark, rows), orphan_references(refs(spark, rows), parents(spark, [])))
    assert [(r["month"], r["reason"], r["orphans"], r["refs"]) for r in totals.collect()] == [("2025-01", "missing", 1, 1)]


def test_fold_events(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", "create", 0), (1, 3, "c", "edit", 0), (1, 2, "b", "edit", 0), (2, 1, "x", "create", 0), (2, 2, None, "delete", 0), (3, None, "n", None, 0), (None, 1, "p", None, 0), (None, 1, "p", None, 0), (4, 5, "t", "create", 0), (4, 5, "u", "retry", 0)],
        "k int, v int, s string, op string, lone int",
    )
    found = fold_events(df, "k", "v", ["s", "lone"], op="op")
    assert sorted((r["k"] or -1, r["s"]) for r in found.collect()) == [(-1, "p"), (-1, "p"), (1, "c"), (3, "n"), (4, "u")]
    assert fold_events(df.limit(0), "k", "v", ["s"]).count() == 0
