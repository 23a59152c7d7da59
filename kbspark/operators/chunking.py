"""Cutting documents into pieces for an index: paragraphs, sizes, tables, page marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions.scalars import chunk_id
from kbspark.operators import routes
from kbspark.operators.routes import PAGE_LINES, ROWS, STOPS, windows  # noqa: F401
from kbspark.sources.tables import table

#: Characters of a piece, of the overlap of neighbours, and below which a piece takes in the next one.
SIZE, OVERLAP, SMALL = 500, 50, 100
#: Names of columns that only count rows, and what is a number.
COUNTING = ["id", "no", "no.", "#", "rank", "index", "idx", "序号", "编号", "代码", "code"]
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
#: Fixed value: a table within a text: a line with |, one of dashes, and the lines with | that follow.
_TABLE = r"(?m)^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t\r]*(?:\n[^\n]*\|[^\n]*)*"
_COLUMN = ("source", "sheet", "col", "name")


def paragraphs(docs: DataFrame) -> DataFrame:
    """The paragraphs between blank lines: doc_id, n (from 0), text, trimmed; empty ones are none. A null text has none."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("n", "text"))


def pieces(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df with an array `pieces` of its text. A piece's end may come again as a last piece of its own, `overlap` long or shorter.

    The overlap must be less than half the size, or pieces would not advance. Null texts have null pieces.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be less than half the size")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else windows(t, size, overlap))

    return df.withColumn("pieces", cut(text))


def merge_small(texts: Column, least: int = SMALL) -> Column:
    """An array of texts in which one that is shorter than `least` takes in those after it, line by line, until it is not."""
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (F.length(F.element_at(done, -1)) < least),
        F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws("\n", F.element_at(done, -1), x))),
    ).otherwise(F.array_append(done, x))
    return F.aggregate(texts, F.array().cast("array<string>"), step)


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = SMALL) -> DataFrame:
    """The pieces of each document in order: doc_id, source, n, strategy, heading, is_table, text, id; cut as its file_format asks (operators/routes.py).

    docs: doc_id, source, text; of file_format, doc_type, physical_page and total_pages those that are there. Each row is cut by itself, a page
    too. Null and empty texts have no pieces.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be less than half the size")

    @F.pandas_udf("array<struct<strategy:string,heading:string,is_table:boolean,text:string>>")
    def cut(texts: pd.Series, formats: pd.Series, kinds: pd.Series, page: pd.Series, pages: pd.Series) -> pd.Series:
        whole = lambda x: None if pd.isna(x) else int(x)
        rows = zip(texts, formats, kinds, page, pages, strict=True)
        return pd.Series([[x[:4] for x in routes.cut(t, f, k, whole(p), whole(ps), size, overlap, least)] for t, f, k, p, ps in rows], dtype=object)

    told = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)
    parts = cut("text", F.lower(told("file_format", "string")), told("doc_type", "string"), told("physical_page", "int"), told("total_pages", "int"))
    found = docs.filter("text IS NOT NULL").select("doc_id", "source", F.posexplode(parts).alias("n", "x")).select("doc_id", "source", "n", "x.*")
    return found.withColumn("id", chunk_id(F.col("source"), F.col("text")))


def without_page_marks(text: Column) -> Column:
    """Without blank lines and lines that only mark a page."""
    keep = lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("|".join(PAGE_LINES))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def is_table(text: Column) -> Column:
    """Whether a text begins as a Markdown table: a line with | and one of dashes under it."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 2) & F.contains(F.get(lines, F.lit(0)), F.lit("|")) & F.coalesce(F.get(lines, F.lit(1)).rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"), F.lit(False))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def table_rows(docs: DataFrame) -> DataFrame:
    """The rows of tables as sentences: doc_id, row_no (from 1), sentence. "head: cell; head: cell", without empty cells; empty rows are none."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    tabled = docs.filter(is_table(F.col("text"))).select("doc_id", lines.alias("ls"))
    rows = tabled.select("doc_id", _cells(F.get("ls", F.lit(0))).alias("head"), F.posexplode(F.filter(F.slice("ls", 3, F.greatest(F.size("ls"), F.lit(1))), lambda x: F.contains(x, F.lit("|")))).alias("at", "line"))
    paired = F.filter(F.arrays_zip(F.col("head").alias("h"), _cells(F.col("line")).alias("c")), lambda x: F.coalesce(x["c"], F.lit("")) != "")
    sentence = F.array_join(F.transform(paired, lambda x: F.concat_ws(": ", F.coalesce(x["h"], F.lit("")), x["c"])), "; ")
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("row_no"), sentence.alias("sentence")).filter("sentence != ''")


def table_pieces(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Tables in pieces of `rows` rows, each with the head: doc_id, n, text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    tabled = docs.filter(is_table(F.col("text"))).select("doc_id", lines.alias("ls"))
    body = F.slice("ls", 3, F.greatest(F.size("ls"), F.lit(1)))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("ls") - 3) / rows), F.lit(0)).cast("int")), lambda i: F.concat(F.slice("ls", 1, 2), F.slice(body, i * rows + 1, F.lit(rows))))
    return tabled.select("doc_id", F.posexplode(parts).alias("n", "part")).select("doc_id", "n", F.array_join("part", "\n").alias("text"))


def inner_tables(docs: DataFrame) -> DataFrame:
    """The tables below an introduction, question or heading: doc_id (with table_no, from 1), source, text; of texts that are no table from the start."""
    found = F.regexp_extract_all("text", F.lit(_TABLE), F.lit(0))
    return docs.filter(~is_table(F.col("text"))).select("doc_id", "source", F.posexplode(found).alias("at", "text")).select(F.struct("doc_id", (F.col("at") + 1).cast("long").alias("table_no")).alias("doc_id"), "source", "text")


def sheet_summary(docs: DataFrame) -> DataFrame:
    """The values of the first column of all tables and how often they are there: source, value, n; by the file."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cells = docs.filter(is_table(F.col("text"))).select("source", F.explode(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1)))).alias("line")).select("source", F.get(_cells(F.col("line")), F.lit(0)).alias("value"))
    return cells.filter("value != ''").groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))


def sheet_cells(docs: DataFrame) -> DataFrame:
    """The cells of all tables that are not empty: source, sheet (the table's head), col (from 0), name, doc_id, row_no, row, value, number (null where none)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    heads = docs.filter(is_table(F.col("text"))).select("doc_id", "source", _cells(F.get(lines, F.lit(0))).alias("head"), F.filter(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), lambda x: F.contains(x, F.lit("|"))).alias("body"))
    rows = heads.select("doc_id", "source", "head", F.posexplode("body").alias("at", "line")).select("doc_id", "source", "head", (F.col("at") + 1).cast("long").alias("row_no"), F.trim("line").alias("row"), F.posexplode(_cells(F.col("line"))).alias("col", "value"))
    named = F.coalesce(F.nullif(F.get("head", F.col("col")), F.lit("")), F.concat(F.lit("列"), (F.col("col") + 1).cast("string")))
    bare = F.regexp_replace("value", "[,$￥€]", "")
    number = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return rows.filter("value != ''").select("source", F.array_join("head", "|").alias("sheet"), F.col("col").cast("long").alias("col"), named.alias("name"), "doc_id", "row_no", "row", "value", number.alias("number"))


def sheet_columns(cells: DataFrame) -> DataFrame:
    """What each column of a file's tables with the same head is: source, sheet, col, name, filled, numbers, different, kind.

    numeric: 80 % are numbers, of more than 10 values, that do not just count rows; categorical: 2 to 30 values, at most half as many as cells; else other.
    """
    values = cells.groupBy(*_COLUMN, "value", "number").agg(F.count(F.lit(1)).alias("n"))
    counted = values.groupBy(*_COLUMN).agg(
        F.sum("n").alias("filled"), F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("numbers"), F.count(F.lit(1)).alias("different"), F.count_distinct("number").alias("values"),
        F.coalesce(F.bool_and(F.col("number") == F.floor("number")), F.lit(False)).alias("whole"), (F.max("number") - F.min("number") + 1).alias("span"),
    )
    counting = F.lower("name").isin(*COUNTING) | (F.col("whole") & (F.col("values") == F.col("numbers")) & (F.col("span") == F.col("numbers")))
    numeric = F.col("numbers") * 5 >= F.col("filled") * 4
    kind = F.when(numeric, F.when((F.col("values") > 10) & ~F.coalesce(counting, F.lit(False)), "numeric").otherwise("other")).when(F.col("different").between(2, 30) & (F.col("different") * 2 <= F.col("filled")), "categorical").otherwise("other")
    return counted.select(*_COLUMN, "filled", "numbers", "different", kind.alias("kind"))


def _of_kind(cells: DataFrame, kind: str) -> DataFrame:
    columns = sheet_columns(cells).filter((F.col("kind") == kind) & (F.lit(kind != "numeric") | (F.col("numbers") >= 4)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _COLUMN]
    return cells.alias("a").join(columns.alias("b"), same, "leftsemi")


def sheet_categories(cells: DataFrame) -> DataFrame:
    """How often each value of a categorical column is there: source, sheet, col, name, value, n."""
    return _of_kind(cells, "categorical").groupBy(*_COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))


def sheet_extremes(cells: DataFrame, most: int = 3) -> DataFrame:
    """The rows with the greatest and least numbers of a numeric column of four or more: source, sheet, col, name, side, place, number, doc_id, row_no, row."""
    held = _of_kind(cells, "numeric").filter("number IS NOT NULL")
    sides = []
    for side, order in (("top", [F.desc("number"), F.asc("doc_id"), F.asc("row_no")]), ("bottom", [F.asc("number"), F.desc("doc_id"), F.desc("row_no")])):
        placed = held.withColumn("place", F.row_number().over(Window.partitionBy(*_COLUMN).orderBy(*order))).filter(F.col("place") <= most)
        sides.append(placed.select(*_COLUMN, F.lit(side).alias("side"), F.col("place").cast("long").alias("place"), "number", "doc_id", "row_no", "row"))
    return sides[0].unionByName(sides[1])


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "source", "text", "doc_type")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned and PDF pages alone, each a text of its own, and rows without a doc_type."""
    return table(spark, folder, "documents", "doc_id", "source", "text", "doc_type").filter("doc_type = 'page' OR doc_type IS NULL")


def _all_cells(spark: SparkSession, folder: str) -> DataFrame:
    return sheet_cells(table(spark, folder, "documents", "doc_id", "source", "text"))


def _inner(spark: SparkSession, folder: str) -> DataFrame:
    return inner_tables(table(spark, folder, "documents", "doc_id", "source", "text"))


_ON_TEXTS = {
    "paragraphs": lambda docs: paragraphs(docs).select("doc_id", F.col("n").cast("long").alias("n"), F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars")),
    "blank_line_clean": lambda docs: docs.filter("text IS NOT NULL").select("doc_id", F.md5(without_page_marks(F.col("text"))).alias("text_md5")),
    "md_table_detect": lambda docs: docs.filter("text IS NOT NULL").groupBy("doc_type", is_table(F.col("text")).alias("is_table")).agg(F.count(F.lit(1)).alias("n")),
    "row_sentences": table_rows,
    "table_pieces": lambda docs: table_pieces(docs).select("doc_id", F.col("n").cast("long").alias("n"), F.md5("text").alias("text_md5")),
    "sheet_summary": sheet_summary,
    "chunk_ids_md5": lambda docs: docs.filter("text IS NOT NULL").select("doc_id", chunk_id(F.col("source"), F.col("text")).alias("id")),
    "filename_prefix": lambda docs: docs.filter("text IS NOT NULL").select("doc_id", F.md5(F.concat(F.lit("【文档: "), F.col("source"), F.lit("】\n"), F.col("text"))).alias("text_md5")),
}
QUERIES = {
    **{name: lambda s, d, f=f: f(_docs(s, d)) for name, f in _ON_TEXTS.items()},
    **{f"page_{name}": lambda s, d, f=f: f(_pages(s, d)) for name, f in _ON_TEXTS.items()},
    "inner_row_sentences": lambda s, d: table_rows(_inner(s, d)).select("doc_id.*", "row_no", "sentence"),
    "inner_table_pieces": lambda s, d: table_pieces(_inner(s, d)).select("doc_id.*", F.col("n").cast("long").alias("n"), F.md5("text").alias("text_md5")),
    "sheet_columns": lambda s, d: sheet_columns(_all_cells(s, d)),
    "sheet_categories": lambda s, d: sheet_categories(_all_cells(s, d)),
    "sheet_extremes": lambda s, d: sheet_extremes(_all_cells(s, d)),
    "chunks": lambda s, d: chunks(table(s, d, "documents", "doc_id", "source", "text", "file_format", "doc_type", "physical_page", "total_pages")),
}
_DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_PAGES = "(SELECT * FROM documents WHERE (doc_type = 'page' OR doc_type IS NULL) AND text IS NOT NULL)"
_TRIM = lambda x: rf"regexp_replace({x}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
_TABLED = rf"(SELECT *, {_LINES} AS ls FROM {_DOCS} WHERE len({_LINES}) >= 2 AND contains({_LINES}[1], '|') AND regexp_full_match({_LINES}[2], '\s*\|?\s*:?-{{2,}}:?\s*(\|\s*:?-{{2,}}:?\s*)*\|?\s*'))"
_CELL = lambda x: rf"list_transform(string_split(regexp_replace(trim({x}), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))"
_MARKS = "|".join(f"({p})" for p in PAGE_LINES).replace("'", "''")
SQL = {
    "paragraphs": f"""SELECT doc_id, pos - 1 AS n, md5(p) AS text_md5, length(p) AS chars FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM
(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> '') AS ps FROM {_DOCS}))""",
    "blank_line_clean": f"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '{_MARKS}')), chr(10))) AS text_md5 FROM {_DOCS}",
    "md_table_detect": f"SELECT doc_type, doc_id IN (SELECT doc_id FROM {_TABLED}) AS is_table, count(*) AS n FROM {_DOCS} GROUP BY 1, 2",
    "row_sentences": f"""WITH r AS (SELECT doc_id, {_CELL('ls[1]')} AS h, list_filter(ls[3:], lambda x: contains(x, '|')) AS body FROM {_TABLED}),
c AS (SELECT doc_id, h, unnest(body) AS line, generate_subscripts(body, 1) AS row_no FROM r), z AS (SELECT doc_id, row_no, list_zip(h, {_CELL('line')}) AS z FROM c)
SELECT doc_id, row_no, s AS sentence FROM (SELECT doc_id, row_no, array_to_string(list_transform(list_filter(z, lambda x: coalesce(x[2], '') <> ''), lambda x: coalesce(x[1], '') || ': ' || x[2]), '; ') AS s FROM z) WHERE s <> ''""",
    "table_pieces": f"""WITH p AS (SELECT doc_id, ls, unnest(range(0, greatest((len(ls) - 3) // {ROWS}, 0) + 1)) AS n FROM {_TABLED})
SELECT doc_id, n, md5(array_to_string(list_concat(ls[1:2], ls[3 + n * {ROWS}: 2 + (n + 1) * {ROWS}]), chr(10))) AS text_md5 FROM p""",
    "sheet_summary": f"SELECT source, value, count(*) AS n FROM (SELECT source, ({_CELL('line')})[1] AS value FROM (SELECT source, unnest(ls[3:]) AS line FROM {_TABLED})) WHERE value <> '' GROUP BY 1, 2",
    "chunk_ids_md5": f"SELECT doc_id, md5(source || ':' || substring(text, 1, 200)) AS id FROM {_DOCS}",
    "filename_prefix": f"SELECT doc_id, md5('【文档: ' || source || '】' || chr(10) || text) AS text_md5 FROM {_DOCS}",
}
SQL |= {f"page_{name}": sql.replace(_DOCS, _PAGES) for name, sql in SQL.items()}
_FOUND = f"""(SELECT {{'doc_id': doc_id, 'table_no': pos}} AS doc_id, source, text FROM (SELECT doc_id, source, unnest(ts) AS text, generate_subscripts(ts, 1) AS pos FROM
(SELECT doc_id, source, regexp_extract_all(text, '{_TABLE}') AS ts FROM {_DOCS} WHERE doc_id NOT IN (SELECT doc_id FROM {_TABLED}))))"""
SQL |= {
    "inner_row_sentences": f"SELECT doc_id.doc_id AS doc_id, doc_id.table_no AS table_no, row_no, sentence FROM ({SQL['row_sentences'].replace(_DOCS, _FOUND)})",
    "inner_table_pieces": f"SELECT doc_id.doc_id AS doc_id, doc_id.table_no AS table_no, n, text_md5 FROM ({SQL['table_pieces'].replace(_DOCS, _FOUND)})",
}
_SHEETS = f"""r AS (SELECT doc_id, source, {_CELL("ls[1]")} AS h, list_filter(ls[3:], lambda x: contains(x, '|')) AS body FROM {_TABLED}),
l AS (SELECT doc_id, source, h, unnest(body) AS line, generate_subscripts(body, 1) AS row_no FROM r), v AS (SELECT *, {_CELL("line")} AS vs FROM l),
x AS (SELECT doc_id, source, h, row_no, trim(line) AS row, unnest(vs) AS value, generate_subscripts(vs, 1) - 1 AS col FROM v),
c AS (SELECT source, array_to_string(h, '|') AS sheet, col, coalesce(nullif(h[col + 1], ''), '列' || (col + 1)) AS name, doc_id, row_no, row, value,
CASE WHEN regexp_matches(regexp_replace(value, '[,$￥€]', '', 'g'), '{_NUMBER}') THEN try_cast(regexp_replace(value, '[,$￥€]', '', 'g') AS DOUBLE) END AS number FROM x WHERE value <> ''),
k AS (SELECT source, sheet, col, name, count(*) AS filled, count(number) AS numbers, count(DISTINCT value) AS different, count(DISTINCT number) AS vals, bool_and(number = floor(number)) AS whole, max(number) - min(number) + 1 AS span FROM c GROUP BY ALL),
kinds AS (SELECT source, sheet, col, name, filled, numbers, different, CASE WHEN numbers >= 0.8 * filled THEN CASE WHEN vals > 10 AND NOT (lower(name) IN ({", ".join(f"'{w}'" for w in COUNTING)}) OR (whole AND vals = numbers AND span = numbers)) THEN 'numeric' ELSE 'other' END
WHEN different BETWEEN 2 AND 30 AND different <= 0.5 * filled THEN 'categorical' ELSE 'other' END AS kind FROM k),
m AS (SELECT c.*, kind, numbers FROM c JOIN kinds ON c.source IS NOT DISTINCT FROM kinds.source AND c.sheet = kinds.sheet AND c.col = kinds.col AND c.name = kinds.name),
p AS (SELECT *, row_number() OVER (PARTITION BY source, sheet, col, name ORDER BY number DESC, doc_id, row_no) AS top, row_number() OVER (PARTITION BY source, sheet, col, name ORDER BY number, doc_id DESC, row_no DESC) AS bottom FROM m WHERE kind = 'numeric' AND numbers >= 4 AND number IS NOT NULL)"""
SQL |= {
    "sheet_columns": f"WITH {_SHEETS} SELECT * FROM kinds",
    "sheet_categories": f"WITH {_SHEETS} SELECT source, sheet, col, name, value, count(*) AS n FROM m WHERE kind = 'categorical' GROUP BY ALL",
    "sheet_extremes": f"""WITH {_SHEETS} SELECT source, sheet, col, name, 'top' AS side, top AS place, number, doc_id, row_no, row FROM p WHERE top <= 3
UNION ALL SELECT source, sheet, col, name, 'bottom', bottom, number, doc_id, row_no, row FROM p WHERE bottom <= 3""",
}
