"""Differences between the registry and the index, and fingerprints of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.versions import registry
from kbspark.sources.tables import table


def buckets(registered: DataFrame, indexed: DataFrame) -> DataFrame:
    """Every source once with where it is: source, bucket (in_both, missing_in_index, orphan_in_index). Null and blank sources are none."""
    mark = lambda df, name: df.filter(F.trim("source") != "").select(F.col("source").alias("source"), F.lit(name == "r").alias("r"), F.lit(name == "i").alias("i"))
    both = mark(registered, "r").unionByName(mark(indexed, "i")).groupBy("source").agg(F.bool_or("r").alias("r"), F.bool_or("i").alias("i"))
    return both.select("source", F.when(F.col("r") & F.col("i"), "in_both").when(F.col("r"), "missing_in_index").otherwise("orphan_in_index").alias("bucket"))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def on_disk(sources: DataFrame, disk: DataFrame) -> DataFrame:
    """The sources whose file is there: source. A file is there if one has its name, or a name that ends with `_` and its name, as stored copies do.

    sources: source; disk: name (of a file, without its folder). Every ending of a file's name meets the sources, so this
    is a join on equal names, never of all with all. Nulls are none.
    """
    names = disk.filter(F.trim("name") != "").select("name").distinct()
    cuts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: (i == 1) | (F.substring(F.col("name"), i - 1, F.lit(1)) == "_"))
    endings = names.select(F.explode(F.transform(cuts, lambda i: F.substring(F.col("name"), i, F.length("name")))).alias("ending")).distinct()
    return sources.filter(F.trim("source") != "").select("source").distinct().join(endings, _base(F.col("source")) == F.col("ending"), "left_semi")


def reconciled(registered: DataFrame, indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """Every source that is not where it should be: source, bucket; a source can be in two.

    missing_in_index (registered, without a point), orphan_in_index (points, not registered, no file), unregistered_on_disk
    (points, not registered, but the file is there: no fault), missing_on_disk (registered, no file).
    """
    where = buckets(registered, indexed)
    there = on_disk(where, disk).withColumn("there", F.lit(True))
    told = where.join(there, "source", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    own = F.col("bucket") != "orphan_in_index"
    found = F.array_compact(F.array(
        F.when(F.col("bucket") == "missing_in_index", "missing_in_index"), F.when(~own & ~F.col("there"), "orphan_in_index"), F.when(~own & F.col("there"), "unregistered_on_disk"), F.when(own & ~F.col("there"), "missing_on_disk")
    ))
    return told.select("source", F.explode(found).alias("bucket"))


def reconcile_summary(found: DataFrame) -> DataFrame:
    """One row: how many sources each bucket has, and clean (whether all but unregistered_on_disk are empty)."""
    names = ("missing_in_index", "orphan_in_index", "unregistered_on_disk", "missing_on_disk")
    counts = found.agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in names])
    return counts.withColumn("clean", (F.col("missing_in_index") + F.col("orphan_in_index") + F.col("missing_on_disk")) == 0)


def mark_unindexed(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records with those of sources without a point failed, and the reason in their meta (JSON, merged). Nothing is deleted, and orphans stay as they are. records: source, status, meta."""
    missing = found.filter("bucket = 'missing_in_index'").select("source", F.lit(True).alias("unindexed")).distinct()
    joined = records.join(missing, "source", "left")
    # Merged as text, so that other values stay as they are.
    held = F.trim(F.coalesce("meta", F.lit("{}")))
    meta = (
        F.when(held.rlike(r"^\{\s*\}$"), '{"reconcile": "no_vectors"}').when(F.get_json_object(held, "$.reconcile").isNotNull(), F.regexp_replace(held, r'("reconcile"\s*:\s*)("[^"]*"|[^,}]*)', '$1"no_vectors"'))
        .otherwise(F.concat(F.regexp_replace(held, r"\s*\}$", ""), F.lit(', "reconcile": "no_vectors"}')))
    )
    return joined.withColumns({"status": F.when(F.col("unindexed"), "failed").otherwise(F.col("status")), "meta": F.when(F.col("unindexed"), meta).otherwise(F.col("meta"))}).drop("unindexed").select(*records.columns)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows and a digest of the table that depends on its rows and how often each is there, but not on their order.

    Every column counts where none are named. A row's hash is cut into eight numbers; the digest is the hash of their
    sums, so nothing is gathered or sorted, whatever the table's size. Nulls differ from empty text.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns or df.columns])
    hashed = df.select(F.sha2(text, 256).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]
    sums = F.concat_ws(",", *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(8)])
    return hashed.agg(F.count(F.lit(1)).alias("rows"), *lanes).select("rows", F.sha2(sums, 256).alias("digest"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that only one of two tables has, as often as it has more of them: their columns, and side."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def _registered(spark: SparkSession, folder: str) -> DataFrame:
    return registry(spark, folder, "source", "status").filter(F.lower("status") != "deleted")


def _full(spark: SparkSession, folder: str) -> DataFrame:
    """The registry against the index and the files that were parsed."""
    return reconciled(_registered(spark, folder), table(spark, folder, "vector_points", "source"), table(spark, folder, "documents", "source").select(_base(F.col("source")).alias("name")))


def q_tenant_points(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 tenants with most points; a point of several tenants counts for each."""
    points = table(spark, folder, "vector_points", "tenant_id").select(F.explode("tenant_id").alias("tenant"))
    return points.groupBy("tenant").agg(F.count(F.lit(1)).alias("points")).orderBy(F.desc("points"), "tenant").limit(20)


def q_chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The sources whose registered number of chunks is not the number of their points."""
    points = table(spark, folder, "vector_points", "source", "point_id").filter("source IS NOT NULL").groupBy("source").agg(F.count_distinct("point_id").alias("points"))
    rows = registry(spark, folder, "source", "is_current", "chunk_count").filter(F.col("is_current") & F.col("source").isNotNull()).groupBy("source").agg(F.sum("chunk_count").alias("chunks"))
    both = rows.join(points, "source", "full").na.fill(0, ["chunks", "points"])
    return both.filter("chunks != points").select("source", "chunks", "points")


QUERIES = {
    "reconcile_sources": lambda s, d: buckets(_registered(s, d), table(s, d, "vector_points", "source")),
    "reconcile_buckets": lambda s, d: buckets(_registered(s, d), table(s, d, "vector_points", "source")).groupBy("bucket").agg(F.count(F.lit(1)).alias("sources")),
    "tenant_points": q_tenant_points,
    "chunk_count_differences": q_chunk_counts,
    "table_fingerprint": lambda s, d: fingerprint(table(s, d, "document_registry")),
    "points_digest": lambda s, d: fingerprint(table(s, d, "vector_points", "point_id", "source", "file_format", "chunk_index", "created_at").withColumn("created_at", F.unix_micros(F.col("created_at").cast("timestamp")))),
    "reconcile_full": lambda s, d: _full(s, d),
    "reconcile_summary": lambda s, d: reconcile_summary(_full(s, d)),
    "reconcile_marked": lambda s, d: mark_unindexed(registry(s, d, "source", "status", "meta"), _full(s, d)),
    "registry_changes": lambda s, d: changed_rows(
        registry(s, d, "source", "status").filter("status = 'ready'").select("source").distinct(), table(s, d, "vector_points", "source").filter("source IS NOT NULL").distinct()
    ),
}
_REG = "(SELECT * FROM document_registry QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_BUCKETS = f"""SELECT coalesce(r.source, i.source) AS source, CASE WHEN r.source IS NULL THEN 'orphan_in_index' WHEN i.source IS NULL THEN 'missing_in_index' ELSE 'in_both' END AS bucket
FROM (SELECT DISTINCT source FROM {_REG} WHERE lower(status) <> 'deleted' AND trim(source) <> '') r FULL JOIN (SELECT DISTINCT source FROM vector_points WHERE trim(source) <> '') i ON r.source = i.source"""
_FULL = f"""WITH b AS ({_BUCKETS}), names AS (SELECT DISTINCT string_split(source, '/')[-1] AS name FROM documents WHERE source IS NOT NULL), ends AS (SELECT DISTINCT substring(name, i) AS e FROM (SELECT name, unnest(list_filter(range(1, length(name) + 1), lambda i: i = 1 OR substring(name, i - 1, 1) = '_')) AS i FROM names)),
w AS (SELECT *, string_split(source, '/')[-1] IN (SELECT e FROM ends) AS there FROM b)
SELECT source, 'missing_in_index' AS bucket FROM w WHERE bucket = 'missing_in_index' UNION ALL SELECT source, CASE WHEN there THEN 'unregistered_on_disk' ELSE 'orphan_in_index' END FROM w WHERE bucket = 'orphan_in_index' UNION ALL SELECT source, 'missing_on_disk' FROM w WHERE bucket <> 'orphan_in_index' AND NOT there"""


def _digest(rows: str, columns: list[str]) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns) + ")"
    lanes = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0)" for i in range(8))
    return f"""SELECT count(*) AS "rows", sha256(concat_ws(',', {lanes})) AS digest FROM (SELECT sha256({text}) AS h FROM {rows})"""


SQL = {
    "reconcile_sources": _BUCKETS,
    "reconcile_buckets": f"SELECT bucket, count(*) AS sources FROM ({_BUCKETS}) GROUP BY bucket",
    "tenant_points": "SELECT tenant, count(*) AS points FROM (SELECT unnest(tenant_id) AS tenant FROM vector_points) GROUP BY tenant ORDER BY points DESC, tenant LIMIT 20",
    "chunk_count_differences": f"""SELECT source, coalesce(chunks, 0) AS chunks, coalesce(points, 0) AS points FROM (SELECT source, sum(chunk_count) chunks FROM {_REG} WHERE is_current AND source IS NOT NULL GROUP BY 1)
FULL JOIN (SELECT source, count(DISTINCT point_id) points FROM vector_points WHERE source IS NOT NULL GROUP BY 1) USING (source) WHERE coalesce(chunks, 0) <> coalesce(points, 0)""",
    "table_fingerprint": _digest("document_registry", ["id", "document_key", "doc_version", "original_filename", "is_current", "source", "file_hash", "tenant_id", "file_format", "chunk_count", "status", "meta", "created_at", "updated_at"]),
    "points_digest": _digest("(SELECT * REPLACE (epoch_us(created_at) AS created_at) FROM vector_points)", ["point_id", "source", "file_format", "chunk_index", "created_at"]),
    "reconcile_full": _FULL,
    "reconcile_summary": f"""SELECT *, missing_in_index + orphan_in_index + missing_on_disk = 0 AS clean FROM (SELECT {", ".join(f"count(*) FILTER (bucket = '{n}') AS {n}" for n in ("missing_in_index", "orphan_in_index", "unregistered_on_disk", "missing_on_disk"))} FROM ({_FULL}))""",
    "reconcile_marked": f"""SELECT id, source, CASE WHEN m THEN 'failed' ELSE status END AS status, CASE WHEN m THEN CASE WHEN coalesce(meta, '{{}}') = '{{}}' THEN '{{"reconcile": "no_vectors"}}' ELSE left(meta, length(meta) - 1) || ', "reconcile": "no_vectors"}}' END ELSE meta END AS meta
FROM (SELECT *, coalesce(source IN (SELECT source FROM ({_FULL}) WHERE bucket = 'missing_in_index'), false) AS m FROM {_REG})""",
    "registry_changes": f"""WITH r AS (SELECT DISTINCT source FROM {_REG} WHERE status = 'ready'), p AS (SELECT DISTINCT source FROM vector_points WHERE source IS NOT NULL)
SELECT source, 'before' AS side FROM (SELECT source FROM r EXCEPT SELECT source FROM p) UNION ALL SELECT source, 'after' FROM (SELECT source FROM p EXCEPT SELECT source FROM r)""",
}
