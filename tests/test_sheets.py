import pytest
from pyspark.sql import functions as F

from kbspark.operators.sheets import body_cells, column_comments, column_names, create_statements, header_rows, infer_columns, ownership, rendered, replaceable, share_tables, table_name, with_columns

TITLE = [["Cost of the kitchen", "", ""], ["Item", "单价(元)", "Qty"], ["hinge", "28.5", "20"], ["board", "210", "3", "more"], [None, "", " "], ["plate", "7"]]
STAFF = [["ID", "First Name", "Hire Date", "Dept"], ["1", "Jo", "2016-08-02", "HR"], ["2", "Ann", "2020/8/22 0:00", "IT"], ["3", "Eve", "2020-08-22", "HR"]]
BARE = [["1", "2"], ["3", "4"]]


@pytest.fixture(scope="module")
def rows(spark):
    found = [(name, n, cells, "x") for name, sheet in (("cost", TITLE), ("staff", STAFF), ("bare", BARE), ("empty", [[]])) for n, cells in enumerate(sheet)]
    return spark.createDataFrame(found, "sheet string, row_no int, cells array<string>, head string")


def test_headers(rows):
    assert {r["sheet"]: r["header_row"] for r in header_rows(rows).collect()} == {"cost": 1, "staff": 0, "bare": 0, "empty": 0}


@pytest.mark.parametrize(
    ("head", "names"),
    [
        (["First Name", "Hire Date"], ["first_name", "hire_date"]), (["Name", "Name", "name"], ["name", "name_2", "name_3"]), (["Name_2", "Name", "Name"], ["name_2", "name", "name_3"]),
        (["品牌/型号", "2026 revenue", ""], ["col_1", "col_2", "col_3"]), (['a"; DROP TABLE x; --', None], ["a_drop_table_x", "col_2"]), ([], []),
    ],
)
def test_names(spark, head, names):
    df = spark.createDataFrame([(head,)], "head array<string>")
    assert df.select(column_names(F.col("head")).alias("n")).first()["n"] == names


def test_schema(rows):
    columns = infer_columns(body_cells(rows, header_rows(rows))).collect()
    found = {(r["sheet"], r["name"]): r for r in columns}
    assert {k: r["sql_type"] for k, r in found.items()} == {
        ("cost", "item"): "VARCHAR(64)", ("cost", "col_2"): "NUMERIC(14,2)", ("cost", "qty"): "INTEGER", ("bare", "col_1"): "INTEGER", ("bare", "col_2"): "INTEGER",
        ("staff", "id"): "INTEGER", ("staff", "first_name"): "VARCHAR(64)", ("staff", "hire_date"): "DATE", ("staff", "dept"): "VARCHAR(64)",
    }
    assert found["staff", "id"]["is_primary"] and not found["staff", "dept"]["is_primary"]
    assert found["staff", "dept"]["enum_values"] == "HR/IT" and found["staff", "dept"]["samples"] == "HR/IT/HR"
    assert found["cost", "qty"]["null_count"] == 1 and found["cost", "qty"]["nullable"] and found["cost", "item"]["distinct_count"] == 3
    assert found["cost", "col_2"]["header"] == "单价(元)"


def test_statements_and_texts(rows):
    columns = infer_columns(body_cells(rows, header_rows(rows))).withColumn("table_name", F.col("sheet")).cache()
    made = {r["sheet"]: r["statement"] for r in create_statements(columns).collect()}
    assert made["staff"].startswith('CREATE TABLE IF NOT EXISTS "staff" (\n  "id" INTEGER NOT NULL,\n  "first_name" VARCHAR(64)') and made["staff"].endswith('PRIMARY KEY ("id")\n)')
    assert "PRIMARY KEY" not in made["cost"]
    said = {(r["sheet"], r["col"]): r["comment"] for r in column_comments(columns).collect()}
    assert said["staff", 3] == "Dept；取值：HR/IT（共 2 类）" and said["staff", 0] == "ID（唯一序号）；主键"
    tables = columns.select("table_name", F.lit("Staff").alias("display_name")).distinct().union(columns.sparkSession.createDataFrame([("none", "")], "a string, b string"))
    texts = {r["table_name"]: r["schema_text"] for r in rendered(with_columns(tables, columns)).collect()}
    assert texts["staff"].split("\n")[:2] == ["## staff (Staff)", "- id INTEGER [主键]    ID（唯一序号）"] and texts["none"] == "## none"


@pytest.mark.parametrize(
    ("source", "sheet", "name"),
    [("xlsx-sample-large.xlsx", "Employees", "employees"), ("cost_data.xlsx", "橱柜成本", "cost_data"), ("xlsx-sample-large.xlsx", "", "large"), ("2024.xlsx", None, "t_2024"), (None, None, "table"), ("x" * 99, "", "x" * 48)],
)
def test_table_names(spark, source, sheet, name):
    df = spark.createDataFrame([(source, sheet)], "source string, sheet string")
    assert df.select(table_name(F.col("source"), F.col("sheet")).alias("n")).first()["n"] == name


OWNED = [("a", "x", False), ("a", "x", None), ("b", "x", False), ("b", "y", False), ("c", None, True), ("d", "", False), ("d", "@unowned@", False)]
OFFERS = [("a", "x", False, "own"), ("a", "x", True, "opens_rows"), ("a", "y", False, "foreign"), ("b", "x", False, "foreign"), ("c", "x", False, "shared_rows"), ("c", None, True, "own"), ("d", "x", False, "unowned_rows"), ("d", None, False, "own"), ("new", "x", False, "new")]


def test_owners(spark):
    rows = spark.createDataFrame(OWNED, "table_name string, tenant_id string, is_shared boolean")
    assert {tuple(r) for r in ownership(rows).collect()} == {("a", "x=2", 0, 0, 2), ("b", "x=1,y=1", 0, 0, 2), ("c", "", 1, 0, 1), ("d", "", 0, 2, 2)}
    offers = spark.createDataFrame([o[:3] for o in OFFERS], "table_name string, tenant_id string, is_shared boolean")
    assert {tuple(r) for r in replaceable(rows, offers).collect()} == set(OFFERS)
    assert share_tables(rows, ["a"]).filter("is_shared").count() == 3 and share_tables(rows, []).filter("is_shared").count() == 1
    assert ownership(rows.limit(0)).count() == 0


def test_empty_tables(rows):
    none = rows.limit(0)
    assert header_rows(none).count() == 0 and infer_columns(body_cells(none, header_rows(none))).count() == 0
