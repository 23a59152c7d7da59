"""What is written and how it is read again: typed tables, ledgers, records with limits, points, metrics as text, sealed inventories, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.scalars import chunk_id
from kbspark.operators.events import fold_events
from kbspark.operators.ledger import SQL as _LEDGER
from kbspark.operators.ledger import histogram, usage
from kbspark.operators.sheets import RAW_SQL, UNOWNED, raw_rows
from kbspark.sources.tables import table

#: Characters of a statement and of an error that an audit record keeps.
STATEMENT, ERROR = 8000, 2000
#: Version of a ledger's lines.
VERSION = 1


def write_table(df: DataFrame, path: str, tenant: str | None, shared: bool = False) -> None:
    """Replaces the table at `path`, each row with its tenant (UNOWNED for none) and whether it is shared."""
    df.withColumns({"tenant_id": F.lit(tenant or UNOWNED), "is_shared": F.lit(shared)}).write.mode("overwrite").parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds one JSON line a row; every task writes files of its own, so writers never share one. rows: request_id and what else there is to say."""
    rows.withColumn("schema_version", F.lit(VERSION)).write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a ledger, and what is wrong with it: (rows, faults with request_id and fault: broken, version, duplicate). schema: the other columns."""
    full = f"schema_version int, request_id string, {schema}, broken string"
    lines = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    twice = lines.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("request_id", F.lit("duplicate").alias("fault"))
    wrong = F.when(F.col("broken").isNotNull() | F.col("request_id").isNull(), "broken").when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "version")
    faults = lines.select("request_id", wrong.alias("fault")).filter("fault IS NOT NULL").unionByName(twice)
    return lines.filter(wrong.isNull()).drop("broken", "schema_version"), faults


def audit_records(rows: DataFrame) -> DataFrame:
    """Audit records as they are kept: long statements and errors cut, blank errors as none. rows: id, sql_text, error_text; other columns stay."""
    return rows.withColumns({"sql_text": F.substring("sql_text", 1, STATEMENT), "error_text": F.when(F.trim("error_text") != "", F.substring("error_text", 1, ERROR))})


def usage_tokens(prompt: Column, completion: Column, total: Column) -> Column:
    """What a call used as struct of prompt, completion, total: a missing total is the sum of the parts there are, a missing part the rest; null where nothing is known or something is negative."""
    rest = lambda own, other: F.coalesce(own, F.when(total.isNotNull() & other.isNotNull() & (total >= other), total - other), F.lit(0))
    known = prompt.isNotNull() | completion.isNotNull() | total.isNotNull()
    negative = F.least(F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0)), F.coalesce(total, F.lit(0))) < 0
    whole = F.coalesce(total, F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))
    return F.when(known & ~negative, F.struct(rest(prompt, completion).alias("prompt"), rest(completion, prompt).alias("completion"), whole.alias("total")))


def usage_records(rows: DataFrame) -> DataFrame:
    """Usage records as they are kept; calls that tell of no use, or of nothing used, are none: id, scene, prompt, completion, total."""
    used = rows.select("id", "scene", usage_tokens(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")).alias("u"))
    return used.filter("u IS NOT NULL AND u.prompt + u.completion + u.total > 0").select("id", "scene", "u.*")


def chunk_points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The points of an index: id, source, chunk_index, text, vector. Raises where a chunk has no vector, as then none may be written. chunks: source, chunk_index, text; vectors: source, chunk_index, vector."""
    both = chunks.select("source", "chunk_index", "text").join(vectors.select("source", "chunk_index", "vector"), ["source", "chunk_index"], "left")
    if lacking := both.filter("vector IS NULL").count():
        raise ValueError(f"{lacking} chunks have no vector")
    return both.select(chunk_id(F.col("source"), F.col("text")).alias("id"), "source", "chunk_index", "text", "vector")


def merge_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """The points of both, a new one in place of an old one with its id. Of new ones with one id the last chunk counts."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), "chunk_index").alias("x")).select("id", "x.*")
    return old.join(last.select("id"), "id", "left_anti").unionByName(last.select(*old.columns))


def metric_lines(counts: DataFrame, name: str, label: str) -> DataFrame:
    """A histogram as lines for a metrics reader: label, place, line. counts: label, bound (null: infinity), upto. Quotes and line ends in labels are escaped; the last lines are the count."""
    quoted = F.replace(F.replace(F.replace(F.coalesce(F.col(label), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    bound = F.coalesce(F.col("bound").cast("string"), F.lit("+Inf"))
    text = F.concat(F.lit(f'{name}_bucket{{{label}="'), quoted, F.lit('",le="'), bound, F.lit('"} '), F.col("upto").cast("string"))
    total = F.concat(F.lit(f'{name}_count{{{label}="'), quoted, F.lit('"} '), F.col("upto").cast("string"))
    buckets = counts.select(label, F.coalesce("bound", F.lit(1 << 62)).alias("place"), text.alias("line"))
    return buckets.unionByName(counts.filter("bound IS NULL").select(label, F.lit((1 << 62) + 1).alias("place"), total.alias("line")))


def seal(files: DataFrame) -> DataFrame:
    """The inventory of files: name, sha256. files: name, content (binary or text). Files of one name are one entry only if they are equal; else it has none, and nothing agrees with it."""
    hashed = files.filter("name IS NOT NULL").select("name", F.sha2("content", 256).alias("sha256"))
    return hashed.groupBy("name").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high"), F.count("sha256").alias("n"), F.count(F.lit(1)).alias("all")).select("name", F.when((F.col("low") == F.col("high")) & (F.col("n") == F.col("all")), F.col("low")).alias("sha256"))


def verify(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """What does not agree with an inventory: name, fault (missing, added, changed). Nothing comes out for a whole bundle."""
    now, then = seal(files).select("name", F.col("sha256").alias("now"), F.lit(True).alias("here")), inventory.select("name", F.col("sha256").alias("then"), F.lit(True).alias("there"))
    both = now.join(then, "name", "full")
    fault = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "added").when(~F.coalesce(F.col("now") == F.col("then"), F.lit(False)), "changed")
    return both.select("name", fault.alias("fault")).filter("fault IS NOT NULL")


def as_json(df: DataFrame, key: str) -> DataFrame:
    """The rows as one JSON text each: key, line. Nulls are left out."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("line"))


def from_json_text(lines: DataFrame, schema: str) -> DataFrame:
    """The rows of JSON texts; broken ones are none. lines: line."""
    return lines.select(F.from_json("line", schema).alias("r")).filter("r IS NOT NULL").select("r.*")


def markdown_tables(rows: DataFrame) -> DataFrame:
    """Each sheet's raw rows as a Markdown table: sheet, text. Rows are padded to the widest, cells trimmed, the first row is the head. rows: sheet, row_no, cells. A sheet is a text, as it is put in one."""
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    lists = rows.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", cells.alias("c")))), lambda x: x["c"]).alias("rs"))
    wide = lists.withColumn("wide", F.array_max(F.transform("rs", lambda r: F.size(r)))).filter("wide > 0")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.col("wide") - F.size(r), F.lit(0)))), " | "), F.lit(" |"))
    under = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("wide")), " | "), F.lit(" |"))
    text = F.concat(F.array(line(F.get("rs", F.lit(0))), under), F.transform(F.slice("rs", F.lit(2), F.greatest(F.size("rs") - 1, F.lit(0))), line))
    return wide.select("sheet", F.array_join(text, "\n").alias("text"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """The index's points as old ones, and those of the documents' beginnings as new ones."""
    old = table(spark, folder, "vector_points", "point_id", "source", "chunk_index").select(F.md5(F.concat_ws(":", "source", F.col("chunk_index").cast("string"))).alias("id"), "source", "chunk_index").filter("source IS NOT NULL").dropDuplicates(["id"])
    new = table(spark, folder, "documents", "source").filter("source IS NOT NULL").distinct().select(F.md5(F.concat_ws(":", "source", F.lit("0"))).alias("id"), "source", F.lit(0).alias("chunk_index"))
    return merge_points(old, new)


QUERIES = {
    "audit_records": lambda s, d: audit_records(fold_events(table(s, d, "sql_audit", "id", "loaded_at", "sql_text", "error_text"), "id", "loaded_at", ["sql_text", "error_text"])).select("id", F.md5("sql_text").alias("sql_md5"), "error_text"),
    "usage_records": lambda s, d: usage_records(usage(s, d, "scene", "prompt_tokens", "completion_tokens", "total_tokens")),
    "metric_lines": lambda s, d: metric_lines(histogram(usage(s, d, "scene", "elapsed_ms"), "scene", "elapsed_ms"), "llm_elapsed_ms", "scene"),
    "text_inventory": lambda s, d: seal(table(s, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))),
    "documents_json": lambda s, d: as_json(table(s, d, "documents", "doc_id", "source", "file_format", "physical_page"), "doc_id"),
    "markdown_tables": lambda s, d: markdown_tables(raw_rows(s, d)).select("sheet", F.md5("text").alias("text_md5")),
    "merged_points": lambda s, d: _points(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("points")),
}
_USAGE = "(SELECT * FROM llm_usage QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_ESCAPED = "replace(replace(replace(coalesce(scene, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
SQL = {
    "audit_records": f"SELECT id, md5(substring(sql_text, 1, {STATEMENT})) AS sql_md5, CASE WHEN trim(error_text, ' ') <> '' THEN substring(error_text, 1, {ERROR}) END AS error_text FROM (SELECT * FROM sql_audit QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)",
    "usage_records": f"""WITH u AS (SELECT id, scene, prompt_tokens p, completion_tokens c, total_tokens t FROM {_USAGE}),
v AS (SELECT id, scene, coalesce(p, CASE WHEN t >= c THEN t - c END, 0) AS prompt, coalesce(c, CASE WHEN t >= p THEN t - p END, 0) AS completion, coalesce(t, coalesce(p, 0) + coalesce(c, 0)) AS total FROM u WHERE (p IS NOT NULL OR c IS NOT NULL OR t IS NOT NULL) AND least(coalesce(p, 0), coalesce(c, 0), coalesce(t, 0)) >= 0)
SELECT * FROM v WHERE prompt + completion + total > 0""",
    "metric_lines": f"""WITH h AS (SELECT *, {_ESCAPED} AS q FROM ({_LEDGER["latency_histogram"]}))
SELECT scene, coalesce(bound, {1 << 62}) AS place, 'llm_elapsed_ms_bucket{{scene="' || q || '",le="' || coalesce(CAST(bound AS VARCHAR), '+Inf') || '"}} ' || upto AS line FROM h UNION ALL SELECT scene, {(1 << 62) + 1}, 'llm_elapsed_ms_count{{scene="' || q || '"}} ' || upto FROM h WHERE bound IS NULL""",
    "markdown_tables": f"""WITH {RAW_SQL}, w AS (SELECT sheet, max(len(cells)) AS wide FROM rws GROUP BY 1), l AS (SELECT r.sheet, row_no, wide, '| ' || array_to_string(list_resize(cells, wide, ''), ' | ') || ' |' AS line FROM rws r JOIN w USING (sheet))
SELECT sheet, md5(string_agg(CASE WHEN row_no = 0 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(wide), lambda i: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY row_no)) AS text_md5 FROM l GROUP BY sheet""",
    "text_inventory": "SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha256 FROM documents",
    "documents_json": """SELECT doc_id, '{' || concat_ws(',', '"doc_id":' || doc_id, '"source":' || to_json(source), '"file_format":' || to_json(file_format), '"physical_page":' || physical_page) || '}' AS line FROM documents""",
    "merged_points": """SELECT source, count(*) AS points FROM (SELECT source, chunk_index FROM vector_points WHERE source IS NOT NULL UNION SELECT source, 0 FROM documents WHERE source IS NOT NULL) GROUP BY source""",
}
