"""Typed schemas from columns of text, and the rows that do not fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.scalars import normal_date, parse_number, whole_number
from kbspark.sources.tables import table

#: Most values a column may have to be an enumeration, and the longest of them.
ENUM_VALUES, ENUM_LENGTH = 50, 32
#: What a whole number, a number, and a date with or without a time are written as.
INTEGER, NUMBER, DATE = r"^-?\d+$", r"^-?\d+(\.\d+)?$", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$"


def _value(column: str) -> Column:
    return F.when(F.trim(column) != "", F.trim(column))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: column_name, filled, different, longest, integers, numbers, dates (how many values have that form), inferred.

    All columns in one pass over the table. Blank cells are empty. The type is the first that every value has: INTEGER,
    NUMERIC(14,2), DATE; else VARCHAR(64) for few short values, VARCHAR(128), TEXT; TEXT for a column without values.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _value(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    bare = F.regexp_replace("v", "[,$￥]", "")
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    # Values are counted once each first, so that a value in most rows is one row after the first shuffle.
    each = cells.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    told = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = each.groupBy("column_name").agg(
        told(F.col("v").isNotNull()).alias("filled"), count(F.col("v").isNotNull()).alias("different"), F.coalesce(F.max(F.length("v")), F.lit(0)).cast("long").alias("longest"),
        told(F.col("v").rlike(INTEGER)).alias("integers"), told(bare.rlike(NUMBER)).alias("numbers"), told(F.col("v").rlike(DATE)).alias("dates"),
    )
    kind = (
        F.when(F.col("filled") == 0, "TEXT").when(F.col("integers") == F.col("filled"), "INTEGER").when(F.col("numbers") == F.col("filled"), "NUMERIC(14,2)").when(F.col("dates") == F.col("filled"), "DATE")
        .when((F.col("different") <= ENUM_VALUES) & (F.col("longest") <= ENUM_LENGTH), "VARCHAR(64)").when(F.col("longest") <= 128, "VARCHAR(128)").otherwise("TEXT")
    )
    return out.withColumn("inferred", kind)


def enum_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values of the columns that are enumerations: column_name, value, n."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _value(c).alias("value")) for c in columns])).alias("x")).select("x.*").filter("value IS NOT NULL")
    each = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    few = each.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"), F.max(F.length("value")).alias("l")).filter((F.col("k") <= ENUM_VALUES) & (F.col("l") <= ENUM_LENGTH))
    return each.join(few.select("column_name"), "column_name", "left_semi")


def coerced(column: str, kind: str) -> Column:
    """A cell as its type; null where it is blank or does not fit."""
    value = _value(column)
    if kind == "INTEGER":
        return F.coalesce(whole_number(value), F.floor(parse_number(value)).cast("long"))
    if kind.startswith("NUMERIC"):
        return parse_number(value).cast("decimal(14,2)")
    return normal_date(value) if kind == "DATE" else value


def split_rows(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with its columns typed, and `fits`: false for rows of which some filled cell does not have its type."""
    bad = F.lit(False)
    for name, kind in types.items():
        bad |= _value(name).isNotNull() & coerced(name, kind).isNull()
    return df.select(*[coerced(n, k).alias(n) for n, k in types.items()], *[c for c in df.columns if c not in types], (~bad).alias("fits"))


def _text_cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_items", "document_version_id", "source", "file_format", "text_preview", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("made"), F.col("score").cast("string").alias("score_text"))


_COLUMNS = ["document_version_id", "source", "file_format", "text_preview", "made", "score_text"]


def q_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_rows(table(spark, folder, "source_items", "item_id", "document_version_id"), {"document_version_id": "INTEGER"})
    return rows.groupBy("fits").agg(F.count(F.lit(1)).alias("n"), F.count("document_version_id").alias("typed"), F.max("document_version_id").alias("most"))


QUERIES = {"column_profile": lambda s, d: profile(_text_cells(s, d), _COLUMNS), "enum_values": lambda s, d: enum_values(_text_cells(s, d), _COLUMNS), "bad_row_split": q_split}
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{n}' AS column_name, nullif(trim({x}), '') AS v FROM source_items" for n, x in (
    ("document_version_id", "document_version_id"), ("source", "source"), ("file_format", "file_format"), ("text_preview", "text_preview"),
    ("made", "strftime(created_at, '%Y-%m-%d %H:%M:%S')"), ("score_text", "CAST(score AS VARCHAR)"),
)) + ")"
SQL = {
    "column_profile": rf"""WITH {_CELLS}, p AS (SELECT column_name, count(v) AS filled, count(DISTINCT v) AS different, coalesce(max(length(v)), 0) AS longest,
count(*) FILTER (regexp_full_match(v, '-?[0-9]+')) AS integers, count(*) FILTER (regexp_full_match(regexp_replace(v, '[,$￥]', '', 'g'), '-?[0-9]+(\.[0-9]+)?')) AS numbers,
count(*) FILTER (regexp_full_match(v, '[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?')) AS dates FROM cells GROUP BY column_name)
SELECT *, CASE WHEN filled = 0 THEN 'TEXT' WHEN integers = filled THEN 'INTEGER' WHEN numbers = filled THEN 'NUMERIC(14,2)' WHEN dates = filled THEN 'DATE'
WHEN different <= {ENUM_VALUES} AND longest <= {ENUM_LENGTH} THEN 'VARCHAR(64)' WHEN longest <= 128 THEN 'VARCHAR(128)' ELSE 'TEXT' END AS inferred FROM p""",
    "enum_values": f"""WITH {_CELLS}, e AS (SELECT column_name, v AS value, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT column_name, value, n FROM e WHERE column_name IN (SELECT column_name FROM e GROUP BY 1 HAVING count(*) <= {ENUM_VALUES} AND max(length(value)) <= {ENUM_LENGTH})""",
    "bad_row_split": r"""WITH c AS (SELECT nullif(trim(document_version_id), '') v FROM source_items),
t AS (SELECT v, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN TRY_CAST(v AS BIGINT) END n FROM c)
SELECT v IS NULL OR n IS NOT NULL AS fits, count(*) AS n, count(n) AS typed, max(n) AS most FROM t GROUP BY 1""",
}
