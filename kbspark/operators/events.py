"""Folding an event log of record states into the current records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_events(df: DataFrame, key: str, version: str, columns: list[str], op: str | None = None, deletes: tuple[str, ...] = ("delete",)) -> DataFrame:
    """One row per `key`: the columns of its event with the highest `version`.

    Creates, edits and retries replace what came before; a key whose last event has an `op` in `deletes` is gone.
    Result: `key`, `columns`. A null `version` is older than any other; among equal versions the greatest row in the
    order of `columns` wins, so repeated rows are one. Rows with a null key stand for themselves and are all kept. Other
    columns of `df` are ignored, whatever their names. The fold is combined before the shuffle, so one key with very many
    events is no hot spot. An empty table gives an empty table.
    """
    kept = [c for c in dict.fromkeys([*columns, *([op] if op else [])]) if c != key]
    state = F.struct(F.col(version).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    lone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    last = df.select(F.col(key).alias("k"), lone.alias("lone"), state.alias("s")).groupBy("k", "lone").agg(F.max("s").alias("s"))
    if op:
        last = last.filter(~F.coalesce(F.lower(F.col(f"s.c{kept.index(op)}")).isin(*deletes), F.lit(False)))
    return last.select(F.col("k").alias(key), *[F.col(f"s.c{i}").alias(c) for i, c in enumerate(kept) if c in columns])


def trimmed(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(column, r"^[\s 　​﻿]+|[\s 　​﻿]+$", "")


def any_of(conditions: list[Column]) -> Column:
    """True where one of them is true; null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
