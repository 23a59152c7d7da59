"""Files taken in as they come, each once, and what is kept up to date from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import shared_dir


def ingest_available(source: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Appends to `target` what a stream has now, and ends.

    The checkpoint knows the files that are in: a second run takes only new ones. A batch is written under its number
    and replaces itself if it runs again, so a lost executor or a restart neither drops nor doubles rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema they have now."""
    # A pattern, as a stream takes a plain path for a folder, and a table may be one file.
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name}.parque[t]")


def tool_calls(fragments: DataFrame) -> DataFrame:
    """Streamed pieces of tool calls put together: request, slot, call_id, name, arguments.

    fragments: request, seq, slot, call_id, name, part. The first id and name that are not empty count, parts are joined
    in order of seq; a null slot belongs to the last slot before it. Pieces of one call are gathered, never of a request.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("request").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    placed = fragments.withColumn("slot", F.coalesce("slot", F.last("slot", ignorenulls=True).over(order), F.lit(0)))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("part", F.lit("")).alias("part")))), lambda x: x["part"]), "")
    return placed.groupBy("request", "slot").agg(first("call_id").alias("call_id"), first("name").alias("name"), parts.alias("arguments"))


def q_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The usage table taken in as a stream, and the calls and tokens of each day and scene in what came in."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    keep = lambda df: df.select("id", "scene", F.to_date("created_at").alias("day"), "total_tokens", "loaded_at")
    ingest_available(stream_of(spark, folder, "llm_usage"), f"{at}/rows", f"{at}/checkpoint", keep)
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("day", "scene").agg(F.count(F.lit(1)).alias("rows"), F.sum("total_tokens").alias("total_tokens"))


QUERIES = {"stream_usage": q_stream}
SQL = {"stream_usage": 'SELECT CAST(created_at AS DATE) AS day, scene, count(*) AS "rows", CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM llm_usage GROUP BY 1, 2'}
