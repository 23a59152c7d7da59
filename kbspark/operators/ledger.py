"""Usage and audit ledgers: totals, health, latencies, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.operators.events import fold_events
from kbspark.sources.tables import table

#: Fixed value: the name of what has none.
UNNAMED = "(未标注)"
#: Upper bounds of the latency buckets, in milliseconds.
BOUNDS = (10, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)
AS_OF, DAYS = "2025-06-30", 90


def _within(at: str, as_of: str, days: int) -> Column:
    return (F.col(at) >= F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col(at) < F.lit(as_of).cast("date"))


def usage_by(usage: DataFrame, key: str, as_of: str = AS_OF, days: int = DAYS) -> DataFrame:
    """Per `key` the calls, tokens and mean latency of the `days` before `as_of`.

    Sums of nothing are 0. A null or blank key counts as UNNAMED. Rows with a null time are outside any window.
    """
    name = F.when(F.coalesce(F.trim(key), F.lit("")) == "", UNNAMED).otherwise(F.col(key))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = usage.filter(_within("created_at", as_of, days)).groupBy(name.alias("key")).agg(
        F.count(F.lit(1)).alias("calls"), total("prompt_tokens"), total("completion_tokens"), total("total_tokens"), F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 1).alias("avg_elapsed_ms")
    )
    return out.withColumn("tokens_per_call", F.round(F.col("total_tokens") / F.col("calls"), 1))


def usage_totals(usage: DataFrame, as_of: str = AS_OF, days: int = DAYS) -> DataFrame:
    """One row: calls, total_tokens, tokens_per_call (0 without calls) of the window."""
    one = usage.filter(_within("created_at", as_of, days)).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
    return one.withColumn("tokens_per_call", F.when(F.col("calls") > 0, F.round(F.col("total_tokens") / F.nullif("calls", F.lit(0)), 1)).otherwise(0.0))


def query_health(audit: DataFrame, by: list[str], as_of: str = AS_OF, days: int = DAYS) -> DataFrame:
    """Per `by` the queries that went well, failed or were redacted, and their latency. An empty list of redacted columns is none."""
    out = audit.filter(_within("created_at", as_of, days)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("ok")).alias("succeeded"),
        F.count_if(F.size("redacted_columns") > 0).alias("redacted"),
        F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 1).alias("avg_elapsed_ms"),
        F.coalesce(F.max("elapsed_ms"), F.lit(0)).alias("max_elapsed_ms"),
    )
    return out.withColumn("failed", F.col("queries") - F.col("succeeded"))


def nearest_ranks(df: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Per `by` the exact nearest-rank percentiles of whole numbers: `by`, p50, p95, p99. Null values count nowhere; a null name is a group.

    Equal values are counted first, so what is ranked are the different values of a group, not its rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    total = counts.groupBy(F.col("g").alias("h")).agg(F.sum("m").alias("n"))
    order = W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("m").over(order)).join(total, F.col("g").eqNullSafe(F.col("h")))
    return ranked.groupBy(F.col("g").alias(by)).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("n") / 100), F.col("v"))).cast("long").alias(f"p{p}") for p in percents])


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per `by` n, mean, the exact nearest-rank p50, p95, p99, and max of the values that are not null."""
    told = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 1).alias("mean"), F.max(value).alias("max"))
    return told.join(nearest_ranks(df, by, value), F.col("k").eqNullSafe(F.col(by))).select(by, "n", "mean", "p50", "p95", "p99", "max")


def histogram(df: DataFrame, by: str, value: str, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Per `by` and bound the values at or below it: `by`, bound (null is infinity), upto. Groups are counted first; the running sum is over the bounds alone."""
    lands = F.lit(None).cast("long")
    for b in reversed(bounds):
        lands = F.when(F.col(value) <= b, F.lit(b).cast("long")).otherwise(lands)
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, lands.alias("bound")).agg(F.count(F.lit(1)).alias("n"))
    grid = counted.select(by).distinct().withColumn("bound", F.explode(F.array(*[F.lit(b).cast("long") for b in bounds], F.lit(None).cast("long"))))
    g, c = grid.alias("g"), counted.alias("c")
    filled = g.join(c, F.col(f"g.{by}").eqNullSafe(F.col(f"c.{by}")) & F.col("g.bound").eqNullSafe(F.col("c.bound")), "left").select(f"g.{by}", "g.bound", F.coalesce("c.n", F.lit(0)).alias("n"))
    order = W.partitionBy(by).orderBy(F.col("bound").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    return filled.select(by, "bound", F.sum("n").over(order).alias("upto"))


def usage(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The calls, each once."""
    return fold_events(table(spark, folder, "llm_usage", "id", "loaded_at", *columns), "id", "loaded_at", list(columns))


def audit(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return fold_events(table(spark, folder, "sql_audit", "id", "loaded_at", *columns), "id", "loaded_at", list(columns))


_TOKENS = ("created_at", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_ms")
_WINDOW = f"created_at >= DATE '{AS_OF}' - INTERVAL {DAYS} DAY AND created_at < DATE '{AS_OF}'"
_ONCE = "(SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_USAGE, _AUDIT = _ONCE.format("llm_usage"), _ONCE.format("sql_audit")


def _by_sql(key: str) -> str:
    return f"""SELECT CASE WHEN trim(coalesce({key}, '')) = '' THEN '{UNNAMED}' ELSE {key} END AS key, count(*) AS calls, coalesce(sum(prompt_tokens), 0) AS prompt_tokens,
coalesce(sum(completion_tokens), 0) AS completion_tokens, coalesce(sum(total_tokens), 0) AS total_tokens, round(coalesce(avg(elapsed_ms), 0), 1) AS avg_elapsed_ms,
round(coalesce(sum(total_tokens), 0) / count(*), 1) AS tokens_per_call FROM {_USAGE} WHERE {_WINDOW} GROUP BY 1"""


QUERIES = {
    **{f"usage_by_{k}": (lambda s, d, c=c: usage_by(usage(s, d, c, *_TOKENS), c)) for k, c in (("scene", "scene"), ("model", "model_name"), ("tenant", "tenant_id"), ("actor", "actor"))},
    "usage_totals": lambda s, d: usage_totals(usage(s, d, "created_at", "total_tokens")),
    "sql_health": lambda s, d: query_health(audit(s, d, "created_at", "ok", "redacted_columns", "elapsed_ms"), []),
    "sql_health_by_tenant": lambda s, d: query_health(audit(s, d, "tenant_id", "created_at", "ok", "redacted_columns", "elapsed_ms"), ["tenant_id"]),
    "latency_nearest_rank": lambda s, d: latency_summary(audit(s, d, "tenant_id", "elapsed_ms"), "tenant_id", "elapsed_ms"),
    "latency_histogram": lambda s, d: histogram(usage(s, d, "scene", "elapsed_ms"), "scene", "elapsed_ms"),
}
_HEALTH = """count(*) AS queries, count(*) FILTER (ok) AS succeeded, count(*) FILTER (len(redacted_columns) > 0) AS redacted, round(coalesce(avg(elapsed_ms), 0), 1) AS avg_elapsed_ms,
coalesce(max(elapsed_ms), 0) AS max_elapsed_ms, count(*) - count(*) FILTER (ok) AS failed"""
SQL = {
    **{f"usage_by_{k}": _by_sql(c) for k, c in (("scene", "scene"), ("model", "model_name"), ("tenant", "tenant_id"), ("actor", "actor"))},
    "usage_totals": f"SELECT count(*) AS calls, coalesce(sum(total_tokens), 0) AS total_tokens, round(coalesce(sum(total_tokens), 0) / count(*), 1) AS tokens_per_call FROM {_USAGE} WHERE {_WINDOW}",
    "sql_health": f"SELECT {_HEALTH} FROM {_AUDIT} WHERE {_WINDOW}",
    "sql_health_by_tenant": f"SELECT tenant_id, {_HEALTH} FROM {_AUDIT} WHERE {_WINDOW} GROUP BY tenant_id",
    "latency_nearest_rank": f"""SELECT tenant_id, count(*) AS n, round(avg(elapsed_ms), 1) AS mean, CAST(quantile_disc(elapsed_ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(elapsed_ms, 0.95) AS BIGINT) AS p95,
CAST(quantile_disc(elapsed_ms, 0.99) AS BIGINT) AS p99, max(elapsed_ms) AS max FROM {_AUDIT} WHERE elapsed_ms IS NOT NULL GROUP BY tenant_id""",
    "latency_histogram": f"""WITH u AS (SELECT scene, elapsed_ms FROM {_USAGE} WHERE elapsed_ms IS NOT NULL), b AS (SELECT CAST(unnest([{', '.join(map(str, BOUNDS))}, NULL]) AS BIGINT) AS bound)
SELECT s.scene, b.bound, (SELECT count(*) FROM u WHERE u.scene IS NOT DISTINCT FROM s.scene AND (b.bound IS NULL OR u.elapsed_ms <= b.bound)) AS upto FROM (SELECT DISTINCT scene FROM u) s, b""",
}
