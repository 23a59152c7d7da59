"""References to records that do not exist, no longer exist, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.session import cut


def orphan_references(refs: DataFrame, parents: DataFrame, salts: int = 16) -> DataFrame:
    """The references whose record did not exist when they were made, with the reason.

    refs: field, row_id, value (the value as written, trimmed), key (what it is compared by; null where it can name no
    record), at (when the reference was made). parents: field, key, born, gone (null while the record exists), one row
    per field and key. Result: field, row_id, value, at, reason.

    Reasons, the first that applies: `missing` (no such key), `late` (born after the reference), `deleted` (gone at or
    before the reference). A reference with a null value is none; with a null time it can only be `missing`; so can one
    to a record that has no birth, unless that is gone. Repeated rows of refs are repeated in the result. Other columns
    are ignored. Empty refs give an empty result; empty parents make every reference `missing`.

    The parents are matched with the distinct keys and the span of their times, both combined before the shuffle: a key
    that holds a third of all references is one row there. Only keys that can be an orphan for some reference come back
    to the references (written once, as they are read three times; sound keys go no further), each under `salts` salts, so that a hot one is met in as many places.
    """
    refs = cut(refs.select("field", "row_id", "value", "key", "at").filter(F.col("value").isNotNull()))
    keyed = refs.filter(F.col("key").isNotNull())
    known = parents.select("field", "key", "born", "gone", F.lit(True).alias("known"))
    distinct = keyed.groupBy("field", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    never = distinct.join(known.select("field", "key"), ["field", "key"], "left_anti").select("field", "key", F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("gone"), F.lit(False).alias("known"))
    doubtful = (F.col("born") > F.col("first")) | (F.col("gone") <= F.col("last"))
    at_times = distinct.join(known, ["field", "key"]).filter(doubtful).select("field", "key", F.col("born").cast("timestamp_ntz").alias("born"), F.col("gone").cast("timestamp_ntz").alias("gone"), "known")
    found = _salted(keyed, never.unionByName(at_times), salts).withColumn(
        "reason",
        F.when(~F.col("known"), "missing").when(F.col("born") > F.col("at"), "late").when(F.col("gone") <= F.col("at"), "deleted"),
    )
    nameless = refs.filter(F.col("key").isNull()).withColumn("reason", F.lit("missing"))
    columns = ["field", "row_id", "value", "at", "reason"]
    return found.filter(F.col("reason").isNotNull()).select(*columns).unionByName(nameless.select(*columns))


def _salted(refs: DataFrame, keys: DataFrame, salts: int) -> DataFrame:
    """refs joined with the doubtful keys, each key repeated once per salt, so that the references to one key meet it in `salts` places."""
    salt = F.pmod(F.xxhash64("row_id", "at"), F.lit(salts)).cast("int")
    return refs.withColumn("salt", salt).join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["field", "key", "salt"]).drop("salt")


def orphan_totals(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per field, month and reason the orphans, beside all references of that field and month.

    Result: field, month, reason, orphans, refs. Months without an orphan have a row with a null reason and 0. Rows with
    a null value are no references; a null time gives a null month. Null months of both sides meet.
    """
    month = F.date_format("at", "yyyy-MM")
    total = refs.filter(F.col("value").isNotNull()).groupBy("field", month.alias("month")).agg(F.count(F.lit(1)).alias("refs"))
    bad = orphans.groupBy(F.col("field").alias("f"), month.alias("m"), "reason").agg(F.count(F.lit(1)).alias("orphans"))
    joined = total.join(bad, (F.col("field") == F.col("f")) & F.col("month").eqNullSafe(F.col("m")), "left")
    return joined.select("field", "month", "reason", F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"), "refs")
