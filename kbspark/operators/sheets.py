"""Raw sheets of text as typed tables: where the header is, safe names, types, keys, comments and statements; who owns the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions.scalars import identifier, parse_number
from kbspark.operators.events import fold_events
from kbspark.operators.inference import DATE, ENUM_LENGTH, ENUM_VALUES, INTEGER, NUMBER
from kbspark.sources.tables import table

#: Rows from the top among which the header is looked for; sample values of a column; longest table name.
SCAN, SAMPLES, NAME_LENGTH = 5, 3, 48
#: Names of columns that only count rows.
COUNTING = ["id", "no", "no.", "#", "rank", "index", "idx", "序号", "编号", "代码", "code"]
#: Fixed value: the owner of rows that nobody owns.
UNOWNED = "@unowned@"


def header_rows(rows: DataFrame, scan: int = SCAN) -> DataFrame:
    """Per sheet the row that is its header: sheet, header_row (from 0), head (its cells, trimmed).

    rows: sheet, row_no (from 0), cells. Of the first `scan` rows that look like a header (two filled cells or more, no
    number, none twice) the one with most filled cells, the first of equal ones; row 0 where none does. Only these rows
    are grouped. Null cells are empty.
    """
    first = rows.filter(F.col("row_no") < scan).withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))))
    filled = F.filter("cells", lambda c: c != "")
    fits = (F.size(filled) >= 2) & ~F.exists(filled, lambda c: c.rlike(NUMBER)) & (F.size(F.array_distinct(filled)) == F.size(filled))
    best = F.max_by(F.struct("row_no", "cells"), F.struct(fits, F.when(fits, F.size(filled)).otherwise(0), -F.col("row_no")))
    return first.groupBy("sheet").agg(best.alias("x")).select("sheet", F.col("x.row_no").cast("long").alias("header_row"), F.col("x.cells").alias("head"))


def column_names(head: Column) -> Column:
    """Safe and different names for the cells of a header: lower case, other signs as one underscore, col_<place> where no
    letter comes first, and _2, _3 for a name that is taken."""
    places = F.sequence(F.lit(1), F.size(head))
    wanted = F.transform(F.arrays_zip(head.alias("h"), places.alias("i")), lambda x: identifier(x["h"], x["i"]))
    free = lambda taken, name: F.when(
        F.array_contains(taken, name), F.element_at(F.filter(F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: F.concat_ws("_", name, k.cast("string"))), lambda n: ~F.array_contains(taken, n)), 1)
    ).otherwise(name)
    named = F.aggregate(wanted, F.array().cast("array<string>"), lambda taken, name: F.array_append(taken, free(taken, name)))
    return F.when(F.size(head) > 0, named).otherwise(F.array().cast("array<string>"))


def body_cells(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The cells below the headers, as many a row as the header has: sheet, row_no, col (from 0), header, name, value (trimmed, '' where there is none). Blank rows are none."""
    known = heads.filter(F.size("head") > 0).select("sheet", "header_row", "head", column_names(F.col("head")).alias("names"))
    below = rows.select("sheet", "row_no", "cells").join(known, "sheet").filter(F.col("row_no") > F.col("header_row"))
    cells = F.transform(F.sequence(F.lit(0), F.size("head") - 1), lambda i: F.struct(i.cast("long").alias("col"), F.get("head", i).alias("header"), F.get("names", i).alias("name"), F.trim(F.coalesce(F.get("cells", i), F.lit(""))).alias("value")))
    return below.withColumn("xs", cells).filter(F.exists("xs", lambda x: x["value"] != "")).select("sheet", "row_no", F.inline("xs"))


def infer_columns(cells: DataFrame) -> DataFrame:
    """What each column of each sheet is: sheet, col, name, header, description, sql_type, is_primary, nullable, null_count, distinct_count, samples, enum_values.

    cells: what body_cells gives. By all values: INTEGER and primary key for a column that counts rows (by its name, or
    whole numbers without a gap, none twice), INTEGER, NUMERIC(14,2), DATE, VARCHAR(64) for few short values,
    VARCHAR(128), TEXT; a column without values is TEXT. Samples are the first values, enumerations the sorted values
    of text columns of at most ENUM_VALUES values. Values are counted once each before a column is grouped.
    """
    key = ["sheet", "col", "name", "header"]
    each = cells.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first"))
    some, bare = F.col("value") != "", F.regexp_replace("value", "[,$￥]", "")
    number = parse_number(F.col("value"))
    told = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    whole = some & number.isNotNull() & (number == F.floor(number))
    columns = each.groupBy(*key).agg(
        told(some).alias("filled"), F.sum("n").alias("rows"), F.count_if(some).alias("distinct_count"), F.coalesce(F.max(F.length("value")), F.lit(0)).alias("longest"),
        told(some & F.col("value").rlike(INTEGER)).alias("integers"), told(some & bare.rlike(NUMBER)).alias("numbers"), told(some & F.col("value").rlike(DATE)).alias("dates"),
        told(whole).alias("wholes"), F.count_distinct(F.when(whole, number)).alias("steps"), (F.max(F.when(whole, number)) - F.min(F.when(whole, number)) + 1).alias("span"),
    )
    f = F.col("filled")
    counts = F.lower("header").isin(*COUNTING) | ((F.col("wholes") == f) & (F.col("steps") == f) & (F.col("span") == f))
    primary = (f > 0) & F.coalesce(counts, F.lit(False))
    kind = (
        F.when(f == 0, "TEXT").when(primary, "INTEGER").when(F.col("integers") == f, "INTEGER").when(F.col("numbers") == f, "NUMERIC(14,2)").when(F.col("dates") == f, "DATE")
        .when((F.col("distinct_count") <= ENUM_VALUES) & (F.col("longest") <= ENUM_LENGTH), "VARCHAR(64)").when(F.col("longest") <= 128, "VARCHAR(128)").otherwise("TEXT")
    )
    hint = F.when(f == 0, "（全列为空）").when(primary, "（唯一序号）").otherwise("")
    described = F.concat(F.when(F.col("header") == "", F.concat(F.lit("第 "), (F.col("col") + 1).cast("string"), F.lit(" 列"))).otherwise(F.col("header")), hint)
    columns = columns.select(*key, described.alias("description"), kind.alias("sql_type"), primary.alias("is_primary"), (f < F.col("rows")).alias("nullable"), (F.col("rows") - f).alias("null_count"), "distinct_count")
    samples = first_values(cells)
    listed = each.filter(some).join(columns.filter(F.col("sql_type").startswith("VARCHAR") & (F.col("distinct_count") <= ENUM_VALUES)).select("sheet", "col"), ["sheet", "col"], "left_semi")
    enums = listed.groupBy("sheet", "col").agg(F.array_join(F.sort_array(F.collect_list("value")), "/").alias("enum_values"))
    return columns.join(samples, ["sheet", "col"], "left").join(enums, ["sheet", "col"], "left").na.fill("", ["samples", "enum_values"])


def first_values(cells: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first values of each column, joined by /: sheet, col, samples. Spark cuts each column before the shuffle."""
    order = W.partitionBy("sheet", "col").orderBy("row_no")
    placed = cells.filter("value != ''").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    return placed.groupBy("sheet", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "/").alias("samples"))


def table_name(source: Column, sheet: Column) -> Column:
    """A safe name of a table: that of its sheet where it begins with a letter, else that of its file without `xlsx` or `sample`; t_ before what begins otherwise."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^0-9a-z_]+", "_"), "^_+|_+$", ""), "_{2,}", "_")
    stem = clean(F.regexp_replace(F.coalesce(source, F.lit("")), r"\.[^.]*$", ""))
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "^(xlsx|sample)[_-]", ""), "[_-]?sample[_-]?", "_"), "^_+|_+$", "")
    own = clean(F.coalesce(sheet, F.lit("")))
    named = F.when(own.rlike("^[a-z]"), own).otherwise(F.coalesce(F.nullif(short, F.lit("")), F.nullif(stem, F.lit("")), F.lit("table")))
    return F.substring(F.when(named.rlike("^[a-z]"), named).otherwise(F.regexp_replace(F.concat(F.lit("t_"), named), "^_+|_+$", "")), 1, NAME_LENGTH)


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('"'))


def _in_order(item: Column, by: str = "col") -> Column:
    """The items of a sheet's columns in their order; no more than a sheet has columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("at"), item.alias("x")))), lambda x: x["x"])


def create_statements(columns: DataFrame) -> DataFrame:
    """The statement that makes each sheet's table: sheet, statement. With a column for the tenant and one for shared rows; a key only where a column counts rows. columns: what infer_columns gives, and table_name."""
    line = F.concat(F.lit("  "), _quoted(F.col("name")), F.lit(" "), F.col("sql_type"), F.when(F.col("is_primary"), " NOT NULL").otherwise(""))
    lines = columns.groupBy("sheet", "table_name").agg(_in_order(line).alias("lines"), F.filter(_in_order(F.when(F.col("is_primary"), _quoted(F.col("name")))), lambda x: x.isNotNull()).alias("keys"))
    own = F.array(F.lit(f"  \"tenant_id\" VARCHAR(64) NOT NULL DEFAULT '{UNOWNED}'"), F.lit('  "is_shared" BOOLEAN NOT NULL DEFAULT FALSE'))
    key = F.when(F.size("keys") > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), F.array_join("keys", ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return lines.select("sheet", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), _quoted(F.col("table_name")), F.lit(" (\n"), F.array_join(F.concat("lines", own, key), ",\n"), F.lit("\n)")).alias("statement"))


def column_comments(columns: DataFrame) -> DataFrame:
    """What is said of each column: sheet, col, comment: its description, its values where they are few, whether it is the key."""
    count = F.size(F.split("enum_values", "/"))
    parts = F.array(F.col("description"), F.when(F.col("enum_values") != "", F.concat(F.lit("取值："), F.col("enum_values"), F.lit("（共 "), count.cast("string"), F.lit(" 类）"))), F.when(F.col("is_primary"), "主键"))
    return columns.select("sheet", "col", F.array_join(F.array_compact(parts), "；").alias("comment"))


def with_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Each table with its columns in order: table_name, display_name, columns (array of name, sql_type, description, enum_values, is_primary). Tables without a column have none."""
    item = F.struct("name", "sql_type", "description", "enum_values", "is_primary")
    grouped = columns.groupBy("table_name").agg(_in_order(item).alias("columns"))
    return tables.select("table_name", "display_name").join(grouped, "table_name", "left").withColumn("columns", F.coalesce("columns", F.array().cast(grouped.schema["columns"].dataType)))


def rendered(tables: DataFrame) -> DataFrame:
    """A text on each table for a model: table_name, schema_text. tables: what with_columns gives."""
    line = lambda c: F.concat(F.lit("- "), c["name"], F.lit(" "), c["sql_type"], F.when(c["is_primary"], " [主键]").otherwise(""), F.when(c["description"] != "", F.concat(F.lit("    "), c["description"])).otherwise(""))
    head = F.concat(F.lit("## "), F.col("table_name"), F.when(F.col("display_name") != "", F.concat(F.lit(" ("), F.col("display_name"), F.lit(")"))).otherwise(""))
    return tables.select("table_name", F.array_join(F.concat(F.array(head), F.transform("columns", line)), "\n").alias("schema_text"))


def ownership(rows: DataFrame) -> DataFrame:
    """Who owns the rows of each table: table_name, tenants (rows by tenant, shared and unowned ones left out), shared_rows, unowned_rows, total_rows. rows: table_name, tenant_id, is_shared."""
    per = rows.groupBy("table_name", F.coalesce("is_shared", F.lit(False)).alias("shared"), F.when(F.coalesce(F.col("tenant_id"), F.lit("")).isin("", UNOWNED), None).otherwise(F.col("tenant_id")).alias("tenant")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    shared, owned = F.col("shared"), F.col("tenant").isNotNull()
    return per.groupBy("table_name").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(~shared & owned, F.concat_ws("=", "tenant", F.col("n").cast("string"))))), ",").alias("tenants"),
        total(shared).alias("shared_rows"), total(~shared & ~owned).alias("unowned_rows"), F.sum("n").alias("total_rows"),
    )


def replaceable(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """Whether an offered table may replace what is there: table_name, tenant_id, is_shared, verdict.

    offers: table_name, tenant_id (null: nobody's), is_shared. Verdicts: new (nothing is there), own (the caller's rows, shared
    rows by a shared offer, or nobody's by nobody's), foreign (another tenant's rows), shared_rows (a private offer over
    shared rows), opens_rows (a shared offer over the tenant's own rows), unowned_rows (only nobody's rows, offered by somebody).
    """
    none = F.lit("")
    per = rows.select("table_name", F.coalesce("is_shared", F.lit(False)).alias("shared"), F.when(F.coalesce(F.col("tenant_id"), none) == UNOWNED, none).otherwise(F.coalesce("tenant_id", none)).alias("tenant")).groupBy("table_name", "shared", "tenant").agg(F.count(F.lit(1)).alias("n"))
    asked = offers.select("table_name", F.col("tenant_id"), F.coalesce("is_shared", F.lit(False)).alias("is_shared"), F.when(F.coalesce(F.col("tenant_id"), none) == UNOWNED, none).otherwise(F.coalesce("tenant_id", none)).alias("mine"))
    private = ~F.col("shared") & (F.col("tenant") != "")
    told = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    joined = asked.join(per, "table_name", "left").groupBy("table_name", "tenant_id", "is_shared", "mine").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), told(private & (F.col("tenant") != F.col("mine"))).alias("others"), told(private & (F.col("tenant") == F.col("mine"))).alias("own"), told(F.col("shared")).alias("common"), told(~F.col("shared") & (F.col("tenant") == "")).alias("nobodys")
    )
    verdict = (
        F.when(F.col("n") == 0, "new").when(F.col("others"), "foreign").when(F.col("common") & ~F.col("is_shared"), "shared_rows").when(F.col("own") & F.col("is_shared"), "opens_rows")
        .when(F.col("nobodys") & ~F.col("own") & ~F.col("common") & (F.col("mine") != ""), "unowned_rows").otherwise("own")
    )
    return joined.select("table_name", "tenant_id", "is_shared", verdict.alias("verdict"))


def share_tables(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with those of the named tables shared, as a step that somebody takes on purpose."""
    return rows.withColumn("is_shared", F.coalesce("is_shared", F.lit(False)) | F.col("table_name").isin(*names) if names else F.coalesce("is_shared", F.lit(False)))


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all table texts as raw rows, a sheet for each document."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"))
    docs = table(spark, folder, "documents", "doc_id", "text", "doc_type").filter("doc_type = 'table' AND text IS NOT NULL")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return docs.select(F.col("doc_id").alias("sheet"), F.posexplode(lines).alias("row_no", "line")).select("sheet", "row_no", cells.alias("cells"))


def _columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_rows(spark, folder)
    return infer_columns(body_cells(rows, header_rows(rows)))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents", "doc_id", "source").select(F.col("doc_id").alias("sheet"), table_name(F.col("source"), F.lit("")).alias("base"))
    return _columns(spark, folder).join(names, "sheet").withColumn("table_name", F.concat_ws("_", F.coalesce("base", F.lit("t")), F.col("sheet").cast("string"))).drop("base")


def _owned(spark: SparkSession, folder: str) -> DataFrame:
    """The registry's records as rows of tables, one table a file format; current ones are shared."""
    rows = fold_events(table(spark, folder, "document_registry", "id", "updated_at", "file_format", "tenant_id", "is_current"), "id", "updated_at", ["file_format", "tenant_id", "is_current"])
    return rows.select(F.col("file_format").alias("table_name"), "tenant_id", (F.coalesce("is_current", F.lit(False)) & F.col("tenant_id").isNull()).alias("is_shared"))


def q_replaceable(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the tenant of each session may replace the tables of each of the registry's sources."""
    rows = fold_events(table(spark, folder, "document_registry", "id", "updated_at", "source", "tenant_id", "is_current"), "id", "updated_at", ["source", "tenant_id", "is_current"])
    owned = rows.select(F.col("source").alias("table_name"), "tenant_id", (F.coalesce("is_current", F.lit(False)) & F.col("tenant_id").isNull()).alias("is_shared"))
    offers = table(spark, folder, "documents", "source", "tenant_id", "has_ocr").select(F.col("source").alias("table_name"), "tenant_id", F.coalesce("has_ocr", F.lit(False)).alias("is_shared")).distinct()
    return replaceable(owned, offers.filter("table_name IS NOT NULL"))


def q_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of the documents with their columns."""
    columns = _named(spark, folder)
    return with_columns(columns.select("table_name", F.lit("").alias("display_name")).distinct(), columns)


def q_schema_text(spark: SparkSession, folder: str) -> DataFrame:
    return rendered(q_tables(spark, folder))


QUERIES = {
    "sheet_headers": lambda s, d: header_rows(raw_rows(s, d)).select("sheet", "header_row", F.array_join("head", "|").alias("head"), F.array_join(column_names(F.col("head")), "|").alias("names")),
    "sheet_schema": lambda s, d: _columns(s, d),
    "sheet_statements": lambda s, d: create_statements(_named(s, d)),
    "sheet_comments": lambda s, d: column_comments(_columns(s, d)),
    "table_names": lambda s, d: table(s, d, "documents", "source").filter("source IS NOT NULL").distinct().select("source", table_name(F.col("source"), F.lit("")).alias("table_name")),
    "schema_text": q_schema_text,
    "described_tables": lambda s, d: q_tables(s, d).select("table_name", "display_name", F.inline("columns")).select("table_name", "display_name", "name", "description", "enum_values"),
    "table_ownership": lambda s, d: ownership(_owned(s, d)),
    "table_replaceable": q_replaceable,
}
_SEP = r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*"
_CLEAN = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[^0-9a-z_]+', '_', 'g'), '^_+|_+$', '', 'g'), '_{{2,}}', '_', 'g')"
_STEM = _CLEAN(r"regexp_replace(coalesce(source, ''), '\.[^.]*$', '')")
_NAME = f"""(SELECT source, substring(CASE WHEN regexp_matches(n, '^[a-z]') THEN n ELSE trim('t_' || n, '_') END, 1, {NAME_LENGTH}) AS table_name FROM (SELECT source, coalesce(nullif(trim(regexp_replace(regexp_replace(st, '^(xlsx|sample)[_-]', ''), '[_-]?sample[_-]?', '_', 'g'), '_'), ''), nullif(st, ''), 'table') AS n
FROM (SELECT DISTINCT source, {_STEM} AS st FROM documents)))"""
RAW_SQL = rf"""raw AS (SELECT doc_id AS sheet, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS row_no FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') AND NOT regexp_full_match(x, '{_SEP}')) AS ls FROM documents WHERE doc_type = 'table' AND text IS NOT NULL)),
rws AS (SELECT sheet, row_no, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM raw)"""
_HEADS = rf"""{RAW_SQL},
top AS (SELECT *, list_filter(cells, lambda c: c <> '') AS f FROM rws WHERE row_no < {SCAN}),
fit AS (SELECT *, len(f) >= 2 AND len(list_filter(f, lambda c: regexp_full_match(c, '-?[0-9]+(\.[0-9]+)?'))) = 0 AND len(list_distinct(f)) = len(f) AS ok FROM top),
heads AS (SELECT sheet, row_no AS header_row, cells AS head FROM fit QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY ok DESC, CASE WHEN ok THEN len(f) ELSE 0 END DESC, row_no) = 1),
cols AS (SELECT sheet, header_row, unnest(head) AS header, generate_subscripts(head, 1) - 1 AS col FROM heads),
based AS (SELECT *, CASE WHEN regexp_matches(n, '^[a-z_]') THEN n ELSE 'col_' || (col + 1) END AS base FROM (SELECT *, {_CLEAN("header")} AS n FROM cols)),
named AS (SELECT * EXCLUDE (n, base), base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY sheet, base ORDER BY col) AS k FROM based))"""
_PARSED = "TRY_CAST(regexp_replace(value, '[,$￥€]', '', 'g') AS DOUBLE)"
_SCHEMA = rf"""{_HEADS},
below AS (SELECT r.sheet, r.row_no, n.col, n.header, n.name, coalesce(r.cells[n.col + 1], '') AS value FROM rws r JOIN named n ON n.sheet = r.sheet AND r.row_no > n.header_row),
cells AS (SELECT * FROM below QUALIFY max(CASE WHEN value <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY sheet, row_no) = 1),
agg AS (SELECT sheet, col, name, header, count(*) FILTER (value <> '') AS filled, count(*) AS "rows", count(DISTINCT value) FILTER (value <> '') AS distinct_count, max(length(value)) AS longest,
count(*) FILTER (regexp_full_match(value, '-?[0-9]+')) AS integers, count(*) FILTER (regexp_full_match(regexp_replace(value, '[,$￥]', '', 'g'), '-?[0-9]+(\.[0-9]+)?')) AS numbers,
count(*) FILTER (regexp_full_match(value, '[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?')) AS dates,
count(*) FILTER ({_PARSED} = floor({_PARSED})) AS wholes, count(DISTINCT {_PARSED}) FILTER ({_PARSED} = floor({_PARSED})) AS steps, max({_PARSED}) FILTER ({_PARSED} = floor({_PARSED})) - min({_PARSED}) FILTER ({_PARSED} = floor({_PARSED})) + 1 AS span FROM cells GROUP BY ALL),
pk AS (SELECT *, filled > 0 AND (lower(header) IN ({", ".join(f"'{w}'" for w in COUNTING)}) OR coalesce(wholes = filled AND steps = filled AND span = filled, false)) AS is_primary FROM agg),
kinds AS (SELECT sheet, col, name, header, CASE WHEN header = '' THEN '第 ' || (col + 1) || ' 列' ELSE header END || CASE WHEN filled = 0 THEN '（全列为空）' WHEN is_primary THEN '（唯一序号）' ELSE '' END AS description,
CASE WHEN filled = 0 THEN 'TEXT' WHEN is_primary OR integers = filled THEN 'INTEGER' WHEN numbers = filled THEN 'NUMERIC(14,2)' WHEN dates = filled THEN 'DATE' WHEN distinct_count <= {ENUM_VALUES} AND longest <= {ENUM_LENGTH} THEN 'VARCHAR(64)'
WHEN longest <= 128 THEN 'VARCHAR(128)' ELSE 'TEXT' END AS sql_type, is_primary, filled < "rows" AS nullable, "rows" - filled AS null_count, distinct_count FROM pk),
smp AS (SELECT sheet, col, string_agg(value, '/' ORDER BY row_no) AS samples FROM (SELECT * FROM cells WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY sheet, col ORDER BY row_no) <= {SAMPLES}) GROUP BY 1, 2),
enm AS (SELECT sheet, col, string_agg(value, '/' ORDER BY value) AS enum_values FROM (SELECT DISTINCT c.sheet, c.col, value FROM cells c JOIN kinds k ON k.sheet = c.sheet AND k.col = c.col WHERE value <> '' AND sql_type LIKE 'VARCHAR%' AND distinct_count <= {ENUM_VALUES}) GROUP BY 1, 2),
schema_of AS (SELECT k.*, coalesce(samples, '') AS samples, coalesce(enum_values, '') AS enum_values FROM kinds k LEFT JOIN smp USING (sheet, col) LEFT JOIN enm USING (sheet, col)),
tabled AS (SELECT s.*, coalesce(n.table_name, 't') || '_' || s.sheet AS table_name FROM schema_of s JOIN documents d ON d.doc_id = s.sheet JOIN {_NAME} n ON n.source IS NOT DISTINCT FROM d.source)"""
_REG = "(SELECT * FROM document_registry QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_SHARED = "coalesce(is_current, false) AND tenant_id IS NULL"
SQL = {
    "sheet_headers": f"WITH {_HEADS} SELECT sheet, header_row, any_value(array_to_string(head, '|')) AS head, string_agg(name, '|' ORDER BY col) AS names FROM named JOIN heads USING (sheet, header_row) GROUP BY sheet, header_row",
    "sheet_schema": f"WITH {_SCHEMA} SELECT * FROM schema_of",
    "sheet_statements": f"""WITH {_SCHEMA} SELECT sheet, 'CREATE TABLE IF NOT EXISTS "' || table_name || '" (' || chr(10) || string_agg('  "' || name || '" ' || sql_type || CASE WHEN is_primary THEN ' NOT NULL' ELSE '' END, ',' || chr(10) ORDER BY col) ||
',' || chr(10) || '  "tenant_id" VARCHAR(64) NOT NULL DEFAULT ''{UNOWNED}'',' || chr(10) || '  "is_shared" BOOLEAN NOT NULL DEFAULT FALSE' || coalesce(',' || chr(10) || '  PRIMARY KEY (' || string_agg('"' || name || '"', ', ' ORDER BY col) FILTER (is_primary) || ')', '') || chr(10) || ')' AS statement FROM tabled GROUP BY sheet, table_name""",
    "sheet_comments": f"WITH {_SCHEMA} SELECT sheet, col, concat_ws('；', description, CASE WHEN enum_values <> '' THEN '取值：' || enum_values || '（共 ' || len(string_split(enum_values, '/')) || ' 类）' END, CASE WHEN is_primary THEN '主键' END) AS comment FROM schema_of",
    "table_names": f"SELECT source, table_name FROM {_NAME} WHERE source IS NOT NULL",
    "schema_text": f"""WITH {_SCHEMA} SELECT table_name, '## ' || table_name || chr(10) || string_agg('- ' || name || ' ' || sql_type || CASE WHEN is_primary THEN ' [主键]' ELSE '' END || CASE WHEN description <> '' THEN '    ' || description ELSE '' END, chr(10) ORDER BY col) AS schema_text FROM tabled GROUP BY table_name""",
    "described_tables": f"WITH {_SCHEMA} SELECT table_name, '' AS display_name, name, description, enum_values FROM tabled",
    "table_ownership": f"""WITH r AS (SELECT file_format AS table_name, {_SHARED} AS shared, nullif(nullif(tenant_id, ''), '{UNOWNED}') AS tenant, count(*) AS n FROM {_REG} GROUP BY ALL)
SELECT table_name, coalesce(string_agg(tenant || '=' || n, ',' ORDER BY tenant || '=' || n) FILTER (NOT shared AND tenant IS NOT NULL), '') AS tenants, CAST(coalesce(sum(n) FILTER (shared), 0) AS BIGINT) AS shared_rows, CAST(coalesce(sum(n) FILTER (NOT shared AND tenant IS NULL), 0) AS BIGINT) AS unowned_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM r GROUP BY table_name""",
    "table_replaceable": f"""WITH r AS (SELECT source AS table_name, {_SHARED} AS shared, coalesce(nullif(tenant_id, '{UNOWNED}'), '') AS tenant FROM {_REG}),
o AS (SELECT DISTINCT source AS table_name, tenant_id, coalesce(has_ocr, false) AS is_shared, coalesce(nullif(tenant_id, '{UNOWNED}'), '') AS mine FROM documents WHERE source IS NOT NULL),
j AS (SELECT o.*, count(r.table_name) AS n, coalesce(bool_or(NOT shared AND tenant <> '' AND tenant <> mine), false) AS others, coalesce(bool_or(NOT shared AND tenant <> '' AND tenant = mine), false) AS own, coalesce(bool_or(shared), false) AS common, coalesce(bool_or(NOT shared AND tenant = ''), false) AS nobodys FROM o LEFT JOIN r USING (table_name) GROUP BY ALL)
SELECT table_name, tenant_id, is_shared, CASE WHEN n = 0 THEN 'new' WHEN others THEN 'foreign' WHEN common AND NOT is_shared THEN 'shared_rows' WHEN own AND is_shared THEN 'opens_rows' WHEN nobodys AND NOT own AND NOT common AND mine <> '' THEN 'unowned_rows' ELSE 'own' END AS verdict FROM j""",
}
