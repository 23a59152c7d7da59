"""Text, Markdown, delimited and line-delimited JSON files as DataFrames; rows of tables written as such."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings tried in order.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "latin-1")


def _decoded(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for data in contents:
        for name in ENCODINGS:
            try:
                rows.append((bytes(data).decode(name), name))
                break
            except UnicodeDecodeError:
                continue
    return pd.DataFrame(rows, columns=["text", "encoding"])


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Files as documents: source (name), text, encoding, file_format, file_hash. The text of txt files is trimmed, and empty ones are no documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("source"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_format"), F.md5("content").alias("file_hash"), F.pandas_udf(_decoded, "text string, encoding string")("content").alias("d"))
    text = F.when(F.col("file_format") == "txt", F.regexp_replace("d.text", r"^\s+|\s+$", "")).otherwise(F.col("d.text"))
    return rows.select("source", text.alias("text"), "d.encoding", "file_format", "file_hash").filter((F.col("file_format") != "txt") | (F.col("text") != ""))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with every cell as text, blank rows left out; types come from inference."""
    rows = spark.read.option("header", "true").option("inferSchema", "false").option("multiLine", "true").csv(path)
    filled = F.lit(False)
    for c in rows.columns:
        filled |= F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False))
    return rows.filter(filled)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, needed: list[str]) -> DataFrame:
    """Rows of a file of JSON lines; comments (//), broken lines and rows that lack a needed field are left out."""
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("//"))
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    for c in needed:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def matching_files(files: DataFrame, patterns: str, path: str = "source") -> DataFrame:
    """The files whose name or path fits one of the comma-separated patterns with * and ?; no pattern fits all."""
    named = [p.strip() for p in patterns.split(",") if p.strip()]
    if not named:
        return files
    as_regex = "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p) for p in named)
    return files.filter(F.col(path).rlike(f"^(?:{as_regex})$") | F.element_at(F.split(path, "/"), -1).rlike(f"^(?:{as_regex})$"))


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files that are not yet in with the same hash and success: files by source and file_hash, done with status."""
    return files.join(done.filter("status = 'success'").select("source", "file_hash"), ["source", "file_hash"], "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key has no new row, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
