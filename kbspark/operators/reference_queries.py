"""p3: the references of source_items and reconcile_reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.events import any_of, fold_events, trimmed
from kbspark.operators.references import orphan_references, orphan_totals
from kbspark.sources.tables import table


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference: field, row_id, value, key, at."""
    items = fold_events(table(spark, folder, "source_items", "item_id", "document_version_id", "created_at", "loaded_at"), "item_id", "loaded_at", ["document_version_id", "created_at"])
    value = trimmed(F.col("document_version_id"))
    digits = F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "^0+(?=[0-9])", ""))
    versions = items.select(
        F.lit("document_version_id").alias("field"),
        F.col("item_id").alias("row_id"),
        F.when(value != "", value).alias("value"),
        digits.alias("key"),
        F.col("created_at").alias("at"),
    )
    lists = ["missing_in_qdrant", "orphan_in_qdrant"]
    runs = fold_events(table(spark, folder, "reconcile_reports", "run_id", "run_at", *lists), "run_id", "run_at", ["run_at", *lists])
    both = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("entries")) for name in lists])
    entry = F.when(trimmed(F.col("entry")) != "", trimmed(F.col("entry")))
    entries = runs.select("run_id", "run_at", F.explode(both).alias("x")).select("run_id", "run_at", "x.field", F.explode("x.entries").alias("entry"))
    named = entries.select("field", F.col("run_id").alias("row_id"), entry.alias("value"), entry.alias("key"), F.col("run_at").alias("at")).distinct()
    return versions.unionByName(named)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records that each field can name: field, key, born, gone."""
    rows = fold_events(table(spark, folder, "document_registry", "id", "source", "status", "created_at", "updated_at"), "id", "updated_at", ["source", "status", "created_at", "updated_at"])
    deleted = any_of([F.lower(trimmed(F.col("status"))) == "deleted"])
    versions = rows.filter(F.col("id").isNotNull()).select(F.lit("document_version_id").alias("field"), F.col("id").cast("string").alias("key"), F.col("created_at").alias("born"), F.when(deleted, F.col("updated_at")).alias("gone"))
    sources = rows.filter(F.col("source").isNotNull()).groupBy(trimmed(F.col("source")).alias("key")).agg(
        F.min("created_at").alias("born"), F.when(F.min(deleted), F.max("updated_at")).alias("gone")
    )
    points = table(spark, folder, "vector_points", "source", "created_at").filter(F.col("source").isNotNull()).groupBy(trimmed(F.col("source")).alias("key")).agg(F.min("created_at").alias("born"))
    return (
        versions.unionByName(sources.select(F.lit("missing_in_qdrant").alias("field"), "key", "born", "gone"))
        .unionByName(points.select(F.lit("orphan_in_qdrant").alias("field"), "key", "born", F.lit(None).cast("timestamp_ntz").alias("gone")))
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphan_references(references(spark, folder), records(spark, folder))
    return found.select(F.col("field").alias("ref_field"), "row_id", F.col("value").alias("ref_value"), F.date_format("at", "yyyy-MM").alias("ref_month"), "reason")


def p3_totals(spark: SparkSession, folder: str) -> DataFrame:
    refs = references(spark, folder)
    totals = orphan_totals(refs, orphan_references(refs, records(spark, folder)))
    return totals.select(F.col("field").alias("ref_field"), F.col("month").alias("ref_month"), "reason", "orphans", "refs")


_SPACE = r"^[\s\x{3000}\x{200B}\x{FEFF}\x{A0}]+|[\s\x{3000}\x{200B}\x{FEFF}\x{A0}]+$"
_REFS = rf"""
items AS (SELECT item_id, arg_max(document_version_id, loaded_at) v, arg_max(created_at, loaded_at) made FROM source_items GROUP BY item_id),
runs AS (SELECT DISTINCT run_id, run_at, missing_in_qdrant m, orphan_in_qdrant o FROM reconcile_reports),
refs AS (
  SELECT 'document_version_id' f, item_id row_id, regexp_replace(v, '{_SPACE}', '', 'g') val, made FROM items
  UNION ALL SELECT DISTINCT 'missing_in_qdrant', run_id, regexp_replace(x, '{_SPACE}', '', 'g'), run_at FROM (SELECT run_id, run_at, unnest(m) x FROM runs)
  UNION ALL SELECT DISTINCT 'orphan_in_qdrant', run_id, regexp_replace(x, '{_SPACE}', '', 'g'), run_at FROM (SELECT run_id, run_at, unnest(o) x FROM runs)),
reg AS (SELECT * FROM document_registry QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1),
recs AS (
  SELECT 'document_version_id' f, CAST(id AS VARCHAR) k, created_at born, CASE WHEN status = 'deleted' THEN updated_at END gone FROM reg
  UNION ALL SELECT 'missing_in_qdrant', source, min(created_at), CASE WHEN bool_and(status = 'deleted') THEN max(updated_at) END FROM reg WHERE source IS NOT NULL GROUP BY source
  UNION ALL SELECT 'orphan_in_qdrant', source, min(created_at), NULL FROM vector_points WHERE source IS NOT NULL GROUP BY source),
judged AS (
  SELECT r.f ref_field, r.row_id, r.val ref_value, strftime(r.made, '%Y-%m') ref_month,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.born > r.made THEN 'late' WHEN p.gone <= r.made THEN 'deleted' END reason
  FROM refs r LEFT JOIN recs p ON p.f = r.f AND p.k = CASE WHEN r.f <> 'document_version_id' THEN r.val
    WHEN regexp_full_match(r.val, '[0-9]+') THEN regexp_replace(r.val, '^0+([0-9])', '\1') END
  WHERE r.val <> '')
"""
SQL = {
    "p3_found": f"WITH {_REFS} SELECT ref_field, row_id, ref_value, ref_month, reason FROM judged WHERE reason IS NOT NULL",
    "p3_totals": f"""WITH {_REFS},
bad AS (SELECT ref_field f, ref_month m, reason, count(*) n FROM judged WHERE reason IS NOT NULL GROUP BY ALL)
SELECT t.ref_field, t.ref_month, b.reason, coalesce(b.n, 0) orphans, t.refs
FROM (SELECT ref_field, ref_month, count(*) refs FROM judged GROUP BY ALL) t
LEFT JOIN bad b ON b.f = t.ref_field AND b.m IS NOT DISTINCT FROM t.ref_month""",
}
QUERIES = {"p3_found": p3_found, "p3_totals": p3_totals}
