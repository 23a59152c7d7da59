"""Scoped views, guarded execution with a row cap, and masking."""

from __future__ import annotations

import threading
import uuid
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kbspark.plans.guard import Verdict, check, denied_columns
from kbspark.plans.identity import Principal

MAX_ROWS, SECONDS, MASK = 200, 5.0, "***"


def scoped(df: DataFrame, who: Principal, tenant: str = "tenant_id", shared: str | None = None) -> DataFrame:
    """The rows that are shared or the caller's own. Rows without a tenant are shared where no column says so."""
    common = F.coalesce(F.col(shared), F.lit(False)) if shared else F.col(tenant).isNull()
    return df.filter(common | (F.col(tenant) == who.tenant))


def pruned(df: DataFrame, who: Principal) -> DataFrame:
    """Without the columns denied to the caller, by name in any case."""
    return df.select(*[c for c in df.columns if c.lower() not in {d.lower() for d in who.denied}])


def masked(df: DataFrame, sensitive: set[str]) -> DataFrame:
    """Values in sensitive columns as MASK; nulls stay."""
    low = {s.lower() for s in sensitive}
    return df.select(*[F.when(F.col(c).isNotNull(), MASK).alias(c) if c.lower() in low else F.col(c) for c in df.columns])


class Refused(Exception):
    """The guard's answer to a statement that may not run."""

    def __init__(self, verdict: Verdict) -> None:
        super().__init__(verdict.reason)
        self.verdict = verdict


def _in_session(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows as a DataFrame of another session of the same application."""
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings and no views."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame], who: Principal | None = None) -> DataFrame:
    """The statement's result over `tables`, the only ones it can name. Raises Refused.

    What runs is the text that was checked. The tables are views of a session of its own, so callers never meet each
    other's, and none stays behind. A statement that refers to a column denied to the caller is refused, not masked; it
    then runs over tables without these columns.
    """
    verdict = check(spark, sql, set(tables))
    if not verdict.ok:
        raise Refused(verdict)
    own = _own_session(spark)
    for name, df in tables.items():
        _in_session(df, own).createOrReplaceTempView(name)
    if who and who.denied:
        if found := denied_columns(own, verdict.text, set(who.denied)):
            raise Refused(Verdict(False, f"column {', '.join(sorted(found))} is not allowed", "forbidden_column"))
        for name, df in tables.items():
            _in_session(pruned(df, who), own).createOrReplaceTempView(name)
    return _in_session(own.sql(verdict.text), spark)


class Result(NamedTuple):
    """At most `max_rows` rows, and whether there were more."""

    columns: list[str]
    rows: list[Row]
    truncated: bool


def fetch(df: DataFrame, max_rows: int = MAX_ROWS, seconds: float = SECONDS) -> Result:
    """The first rows of a result, within a time limit; no more than one row beyond the cap reaches the driver."""
    context, group = df.sparkSession.sparkContext, f"guarded-{uuid.uuid4()}"
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group))
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        rows = df.limit(max_rows + 1).collect()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return Result(df.columns, rows[:max_rows], len(rows) > max_rows)


#: Rows that are shown whole, and of a longer result.
INLINE, SAMPLE = 50, 5


class Shown(NamedTuple):
    """What a model is shown of a result: rows, whether these are all that were read, and what to know about them."""

    columns: list[str]
    rows: list[dict]
    whole: bool
    notes: list[str]


def shown(result: Result, masked_columns: tuple[str, ...] = (), inline: int = INLINE, sample: int = SAMPLE) -> Shown:
    """A short result whole, of a longer one the first rows; with notes on what is cut, truncated or masked. Values are plain: numbers, text, true and false; times as ISO text, other values as text."""
    whole = len(result.rows) <= inline
    rows = [{c: _plain(v) for c, v in zip(result.columns, r, strict=True)} for r in (result.rows if whole else result.rows[:sample])]
    notes = [] if whole else [f"{sample} of {len(result.rows)} rows are shown; do not count or add them up."]
    if result.truncated:
        notes.append(f"The result has more than {len(result.rows)} rows, the rest was not read.")
    if masked_columns:
        notes.append(f"Values of {', '.join(sorted(masked_columns))} are masked.")
    return Shown(result.columns, rows, whole, notes)


def _plain(value: object) -> object:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value.isoformat() if hasattr(value, "isoformat") else str(value)
