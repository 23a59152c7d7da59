"""Session defaults and the shared folder for data that outlives a task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str = "local[*]", app: str = "kbspark", **conf: str) -> SparkSession:
    """A session with this library's defaults; `conf` wins over them."""
    builder = SparkSession.builder.master(master).appName(app)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Only a local master (tests) gets a machine-local folder; on a cluster the setting is required.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, so that what follows neither repeats its work nor depends on an executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
