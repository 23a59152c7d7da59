from concurrent.futures import ThreadPoolExecutor

import pytest

from kbspark.plans.execute import Refused, fetch, guarded, masked, scoped, shown
from kbspark.plans.guard import check
from kbspark.plans.identity import ANONYMOUS, principal

VIEWS = {"t", "u"}
ALLOWED = [
    "SELECT 1", "SELECT a FROM t", "select a, count(*) from t group by 1 order by 2 desc limit 3;", "SELECT t.a FROM t JOIN u ON t.a = u.a", "WITH x AS (SELECT a FROM t) SELECT * FROM x",
    "SELECT a FROM t WHERE a IN (SELECT a FROM u)", "SELECT * FROM (SELECT a FROM t UNION ALL SELECT a FROM u) AS x", "SELECT sum(a) OVER (PARTITION BY b ORDER BY c) FROM t", "SELECT CASE WHEN a > 1 THEN 'x' END FROM t",
    "SELECT a FROM t GROUP BY a HAVING count(*) > 1", "SELECT a, x FROM t LATERAL VIEW explode(array(1, 2)) e AS x", "SELECT * FROM (SELECT a, b FROM t) PIVOT (count(*) FOR b IN (1, 2))", "SELECT t.a FROM t, LATERAL (SELECT max(u.a) AS m FROM u WHERE u.a = t.a) AS x", "``` \nSELECT a FROM t;\n```", "```SQL\nSELECT a FROM t\n  ```\n","SELECT DISTINCT a FROM t", "SELECT (SELECT max(a) FROM u) FROM t", "```sql\nSELECT a FROM t\n```", "SELECT \"drop\" FROM t", "SELECT 'DELETE FROM t' FROM t",
]
REFUSED = {
    "": "empty", "   ": "empty", "SELECT": "syntax", "nonsense": "syntax", "SELECT 1; SELECT 2": "syntax", "COPY t TO 'x'": "syntax",
    "DROP TABLE t": "forbidden_node", "INSERT INTO t VALUES (1)": None, "DELETE FROM t": None, "UPDATE t SET a = 1": None, "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE": None, "CREATE TABLE x AS SELECT 1": None,
    "ALTER TABLE t RENAME TO x": None, "TRUNCATE TABLE t": None, "SET spark.x = 1": None, "SHOW TABLES": None, "DESCRIBE t": None, "EXPLAIN SELECT 1": None, "CACHE TABLE t": None, "ADD JAR 'x.jar'": None, "USE default": None,
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x": None, "FROM t INSERT INTO u SELECT *": None, "BEGIN SELECT 1; END": None, "EXECUTE IMMEDIATE 'SELECT 1'": None, "SELECT TRANSFORM(a) USING 'cat' FROM t": None,
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')": "forbidden_function", "SELECT java_method('java.lang.System', 'exit', 1)": "forbidden_function", "SELECT a FROM t WHERE a IN (SELECT reflect('a', 'b') FROM u)": "forbidden_function",
    "SELECT (SELECT try_reflect('a', 'b'))": "forbidden_function", "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x": "forbidden_function", "SELECT * FROM secrets": "forbidden_table", "SELECT * FROM parquet.`/etc`": "forbidden_table",
    "SELECT * FROM t WHERE EXISTS (SELECT 1 FROM hidden)": "forbidden_table", "SELECT * FROM other.t": "forbidden_table", "SELECT a FROM t UNION SELECT a FROM u": "not_select", "SELECT a FROM t INTERSECT SELECT a FROM u": "not_select", "SELECT a FROM t EXCEPT SELECT a FROM u": "not_select",
    "```EXPLAIN\nSELECT a FROM t\n```": None, "```sql EXPLAIN\nSELECT a FROM t\n```": None, "```\nEXPLAIN SELECT a FROM t\n```": None, "```DROP TABLE t```": None, "```sql\nDROP TABLE t\n```": None, "/* x */ DELETE /* y */ FROM t": None, "SELECT 1 -- \n; DROP TABLE t": "syntax", "SELECT a FROM t LATERAL VIEW json_tuple(b, 'x') j AS x": "forbidden_function",
    "SELECT * FROM IDENTIFIER('hidden')": None, "SELECT * FROM STREAM(t)": None, "SELECT sleep(9)": "forbidden_function", "SELECT * FROM information_schema.tables": "forbidden_table", "SELECT * FROM read_files('/etc')": None, "SELECT * INTO x FROM t": None,
    "TABLE t": "not_select", "VALUES (1)": None, "SELECT * FROM range(5)": None, "SELECT version()": "forbidden_function", "SELECT current_user()": None, "SELECT input_file_name() FROM t": "forbidden_function", "SELECT explode(array(1))": "forbidden_function",
}


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert check(spark, sql, VIEWS).ok, check(spark, sql, VIEWS)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    verdict = check(spark, sql, VIEWS)
    assert not verdict.ok
    assert REFUSED[sql] in (None, verdict.category), verdict


@pytest.fixture
def views(spark):
    rows = spark.createDataFrame([(1, 1, 1, "x"), (2, 2, 1, "y")], "a int, b int, c int, drop string")
    return {"t": rows, "u": rows.filter("a = 1")}


@pytest.mark.parametrize("sql", ALLOWED)
def test_what_is_allowed_runs(spark, views, sql):
    guarded(spark, sql, views).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_what_is_refused_never_runs(spark, views, sql):
    with pytest.raises(Refused):
        guarded(spark, sql, views)
    assert not spark.catalog.listTables()


def test_what_was_checked_is_what_runs(spark, views):
    assert [r["a"] for r in guarded(spark, "```sql\nSELECT a FROM u;\n```", views).collect()] == [1]
    assert check(spark, "```sql\nSELECT a FROM u;\n```", VIEWS).text == "SELECT a FROM u"
    assert [r['drop'] for r in guarded(spark, "SELECT \"drop\" FROM t ORDER BY a", views).collect()] == ["x", "y"]


def test_callers_at_once_see_their_own_rows(spark):
    rows = spark.createDataFrame([(i, f"t{i % 8}") for i in range(160)], "id int, tenant_id string")

    def ask(k):
        who = principal(f"t{k % 8}", "analyst")
        found = guarded(spark, "SELECT tenant_id, count(*) AS n FROM rows_of GROUP BY tenant_id", {"rows_of": scoped(rows, who)}, who).collect()
        return [(r["tenant_id"], r["n"]) for r in found] == [(f"t{k % 8}", 20)]

    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(ask, range(24)))
    assert not [x for x in spark.catalog.listTables() if x.name == "rows_of"]


def test_the_callers_settings_hold(spark, views):
    assert guarded(spark, "SELECT a FROM t", views).sparkSession is not None
    joined = guarded(spark, "SELECT a FROM t", views).join(views["u"], "a")
    assert joined.count() == 1


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", 10, "x", True), (2, "b", 20, "y", False), (3, None, 30, None, False)], "id int, name string, salary int, tenant_id string, is_shared boolean")


def test_denied_columns(spark, people):
    who = principal("x", "employee", frozenset({"SALARY"}))
    tables = {"people": people}
    assert guarded(spark, "SELECT count(*) AS n FROM people", tables, who).collect()[0]["n"] == 3
    assert guarded(spark, "SELECT name FROM people WHERE id = 1", tables, who).collect()[0]["name"] == "a"
    for sql in ("SELECT * FROM people", "SELECT salary AS s FROM people", "SELECT avg(salary) FROM people", "SELECT cast(salary AS string) FROM people", "SELECT name FROM people WHERE salary > 1", "SELECT name FROM people ORDER BY salary", "SELECT to_json(struct(*)) FROM people", "SELECT name FROM people WHERE id = (SELECT max(salary) FROM people)"):
        with pytest.raises(Refused) as refused:
            guarded(spark, sql, tables, who)
        assert refused.value.verdict.category == "forbidden_column"


def test_scopes_and_masks(spark, people):
    rows = lambda who: sorted(r["id"] for r in scoped(people, who, shared="is_shared").collect())
    assert rows(principal("y", "analyst")) == [1, 2]
    assert rows(principal(" ", "analyst")) == [1]
    assert principal("@unowned@", "analyst").tenant == ANONYMOUS
    with pytest.raises(ValueError):
        principal("x", "chief")
    assert [r["name"] for r in masked(people, {"NAME"}).orderBy("id").collect()] == ["***", "***", None]


@pytest.mark.parametrize(("rows", "cap", "truncated"), [(5, 5, False), (6, 5, True), (0, 5, False)])
def test_fetch_reads_one_more_than_the_cap(spark, rows, cap, truncated):
    found = fetch(spark.range(rows), cap, 60)
    assert (len(found.rows), found.truncated) == (min(rows, cap), truncated)


def test_what_is_shown(spark):
    few = shown(fetch(spark.sql("SELECT 1 AS a, date'2025-01-02' AS d, CAST(2.50 AS DECIMAL(9,2)) AS n, CAST(3 AS DECIMAL(9,0)) AS m, true AS t, NULL AS z, array(1) AS x"), 5, 60))
    assert few.rows == [{"a": 1, "d": "2025-01-02", "n": 2.5, "m": 3, "t": True, "z": None, "x": "[1]"}] and few.whole and few.notes == []
    many = shown(fetch(spark.range(300), 200, 60), ("salary",))
    assert len(many.rows) == 5 and not many.whole and len(many.notes) == 3
