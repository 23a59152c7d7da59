"""Versions of documents, turns of sessions: which one holds, and what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions.scalars import whole_number
from kbspark.operators.events import fold_events
from kbspark.sources.tables import table


def registry(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The records of the registry, each in its last state."""
    return fold_events(table(spark, folder, "document_registry", "id", "updated_at", *columns), "id", "updated_at", list(columns))


def latest_versions(rows: DataFrame) -> DataFrame:
    """Per document_key the row with the highest doc_version (of equal ones the highest id): document_key, doc_version, id, status, file_hash. Rows without a key have no version."""
    keyed = rows.filter(F.col("document_key").isNotNull())
    best = keyed.groupBy("document_key").agg(F.max(F.struct("doc_version", "id", "status", "file_hash")).alias("x"))
    return best.select("document_key", "x.doc_version", "x.id", "x.status", "x.file_hash")


def publish(rows: DataFrame) -> DataFrame:
    """Per document_key the version to be current: its newest ready one. A key without a ready version has no row."""
    ready = rows.filter((F.lower("status") == "ready") & F.col("document_key").isNotNull())
    return ready.groupBy("document_key").agg(F.max(F.struct("doc_version", "id")).alias("x")).select("document_key", "x.doc_version", "x.id")


def reserve(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """The version that each offered file gets: document_key, file_hash, doc_version, reused.

    An offer with the hash of the latest version reuses that while it is pending or ready; else it gets the next number,
    1 for a new key. Repeated offers are one.
    """
    last = latest_versions(rows).select("document_key", "doc_version", "status", F.col("file_hash").alias("held"))
    joined = offers.select("document_key", "file_hash").filter(F.col("document_key").isNotNull()).distinct().join(last, "document_key", "left")
    reused = F.coalesce((F.col("held") == F.col("file_hash")) & F.col("status").isin("pending", "ready"), F.lit(False))
    number = F.when(reused, F.col("doc_version")).otherwise(F.coalesce("doc_version", F.lit(0)) + 1)
    return joined.select("document_key", "file_hash", number.cast("int").alias("doc_version"), reused.alias("reused"))


def activate(rows: DataFrame, document_key: str, version: int) -> DataFrame:
    """The registry with one version of a document made current and its others not, as for going back to an older one.

    A key with a pending or failed version, or without a ready one of that number, stays as it is.
    """
    own = F.col("document_key") == document_key
    free = rows.filter(own).agg(
        (F.count_if(F.lower("status").isin("pending", "failed")) == 0).alias("idle"), (F.count_if((F.col("doc_version") == version) & (F.lower("status") == "ready")) > 0).alias("there")
    )
    # One row of the key's state beside every row of the registry.
    joined = rows.join(F.broadcast(free))
    now = F.when(own & F.col("idle") & F.col("there"), F.col("doc_version") == version).otherwise(F.col("is_current"))
    return joined.withColumn("is_current", now).select(*rows.columns)


def owned(rows: DataFrame, tenant: str | None, deleted: bool = False) -> DataFrame:
    """The versions that are exactly this tenant's, no tenant's for None; deleted ones only if asked for. Rows without a key are no versions."""
    own = rows.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant)) & F.col("document_key").isNotNull())
    return own if deleted else own.filter(~F.coalesce(F.lower("status") == "deleted", F.lit(False)))


def version_history(rows: DataFrame) -> DataFrame:
    """All versions of the document of every version, newest first, for its own tenant only: of_id, place, id, doc_version, status.

    rows: id, document_key, doc_version, status, tenant_id. Tenants are compared null-safe, so no tenant is one too; a
    deleted version asks for nothing, but is in the history of the others.
    """
    keyed = rows.filter(F.col("document_key").isNotNull())
    order = W.partitionBy("of_id").orderBy(F.col("doc_version").desc_nulls_last(), F.col("id").desc())
    asking = keyed.filter(~F.coalesce(F.lower("status") == "deleted", F.lit(False))).select(F.col("id").alias("of_id"), F.col("document_key").alias("k"), F.col("tenant_id").alias("t"))
    both = asking.join(keyed, (F.col("k") == F.col("document_key")) & F.col("t").eqNullSafe(F.col("tenant_id")))
    return both.select("of_id", F.row_number().over(order).cast("long").alias("place"), "id", "doc_version", "status")


def delete_versions(rows: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """The registry with the named versions deleted: a mark on the row, hidden at once, updated at `at`; what hangs on them is cleared later. ids: id. Other rows stay."""
    gone = ids.select(F.col("id").alias("gone_id")).filter("gone_id IS NOT NULL").distinct()
    hit = F.col("gone_id").isNotNull()
    joined = rows.join(gone, F.col("id") == F.col("gone_id"), "left")
    return joined.withColumns({"status": F.when(hit, "deleted").otherwise(F.col("status")), "is_current": F.when(hit, False).otherwise(F.col("is_current")), "updated_at": F.when(hit, F.lit(at).cast(rows.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))}).select(*rows.columns)


def ingest_versions(rows: DataFrame, results: DataFrame) -> DataFrame:
    """What delivered results make of the versions: id, status, chunk_count, publishes, verdict.

    rows: id, document_key, doc_version, file_hash, status, chunk_count; results: id, file_hash, chunk_count, delivered. Of
    several results of a version the last delivered one with a chunk and the right hash counts. A version that is ready stays as it is
    (`done`), as a redelivered job must not undo what came later, and so does a deleted one (`deleted`); another hash is
    `mismatch`, no chunk `empty`, and both fail the version. A version becomes current (`publishes`) only if none of its
    document that is newer is ready. Results of unknown versions are `unknown`.
    """
    chunk, held = F.coalesce(F.col("r.chunk_count"), F.lit(0)), F.lower("v.status")
    right = F.col("r.file_hash").eqNullSafe(F.col("v.file_hash"))
    both = results.alias("r").join(rows.alias("v"), F.col("r.id") == F.col("v.id"), "left")
    verdict = F.when(F.col("v.id").isNull(), "unknown").when(held == "ready", "done").when(held == "deleted", "deleted").when(~right, "mismatch").when(chunk <= 0, "empty").otherwise("ready")
    told = both.select(F.col("r.id").alias("id"), F.col("v.document_key").alias("document_key"), F.col("v.doc_version").alias("doc_version"), F.col("v.status").alias("was"), F.col("v.chunk_count").alias("had"), chunk.alias("got"), verdict.alias("verdict"), F.col("r.delivered").alias("delivered"))
    one = told.groupBy("id").agg(F.max_by(F.struct("document_key", "doc_version", "was", "had", "got", "verdict"), F.struct(F.col("verdict") == "ready", "delivered", "verdict", "got")).alias("x")).select("id", "x.*")
    ready = one.filter("verdict = 'ready'").select("document_key", "doc_version").unionByName(rows.filter(F.lower("status") == "ready").select("document_key", "doc_version"))
    newest = ready.groupBy("document_key").agg(F.max("doc_version").alias("newest"))
    status = F.when(F.col("verdict") == "ready", "ready").when(F.col("verdict").isin("mismatch", "empty"), "failed").otherwise(F.col("was"))
    chunks = F.when(F.col("verdict") == "ready", F.col("got")).otherwise(F.col("had"))
    publishes = F.coalesce((F.col("verdict") == "ready") & (F.col("doc_version") == F.col("newest")), F.lit(False))
    return one.join(newest, "document_key", "left").select("id", status.alias("status"), chunks.cast("long").alias("chunk_count"), publishes.alias("publishes"), "verdict")


def append_turns(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The new turns with the numbers that follow the highest of their session, in order of arrival (then id): session_id, id, seq. Rows without a session are none.

    messages: session_id, seq; new: session_id, id, arrived. A session's new turns are ranked, its old ones only counted.
    """
    base = next_seq(messages).select("session_id", "next_seq")
    order = W.partitionBy("session_id").orderBy("arrived", "id")
    ranked = new.filter(F.col("session_id").isNotNull()).select("session_id", "id", F.row_number().over(order).alias("place"))
    return ranked.join(base, "session_id", "left").select("session_id", "id", (F.coalesce("next_seq", F.lit(1)) + F.col("place") - 1).cast("long").alias("seq"))


def recent_turns(messages: DataFrame, as_of: str, n: int = 20, seconds: int = 3600) -> DataFrame:
    """What a cache of turns would hold: the last n turns of the sessions with a turn in the `seconds` before as_of. messages: session_id, seq, id, created_at."""
    end = F.lit(as_of).cast("timestamp_ntz")
    alive = messages.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max(F.when(F.col("created_at") <= end, F.col("created_at"))).alias("last")).filter(F.col("last") > end - F.make_dt_interval(secs=F.lit(seconds)))
    return last_turns(messages.filter(F.col("created_at") <= end).join(alive.select("session_id"), "session_id", "left_semi"), n)


def upsert(rows: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Both tables' rows with one row a key, the one with the greatest `version` (of equal ones that of `new`). Null keys are equal."""
    both = rows.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    others = [c for c in rows.columns if c not in key]
    picked = both.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("upsert_version"), "is_new", *[F.col(c).alias(f"upsert_{i}") for i, c in enumerate(others)])).alias("upsert_row"))
    return picked.select(*key, *[F.col(f"upsert_row.upsert_{i}").alias(c) for i, c in enumerate(others)]).select(*rows.columns)


def visible(df: DataFrame, version_id: str, rows: DataFrame) -> DataFrame:
    """The rows that name no version, or a current one. Version ids are compared by value, however written."""
    value = whole_number(F.col(version_id))
    named = F.coalesce(F.trim(version_id), F.lit("")) != ""
    current = rows.filter(F.coalesce(F.col("is_current"), F.lit(False))).select(F.col("id").alias("current_id")).distinct()
    marked = df.withColumn("named_id", F.when(named, F.coalesce(value, F.lit(-1))))
    return marked.filter(F.col("named_id").isNull()).unionByName(marked.join(current, F.col("named_id") == F.col("current_id"), "left_semi")).drop("named_id")


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session by seq (then id). Spark cuts each group before the shuffle, so no session is gathered."""
    order = W.partitionBy("session_id").orderBy(F.col("seq").desc_nulls_last(), F.col("id").desc())
    return messages.filter(F.col("session_id").isNotNull()).withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)


def next_seq(messages: DataFrame) -> DataFrame:
    """Per session the number of its next turn, 1 where none has a number."""
    return messages.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def document_key(tenant: Column, name: Column) -> Column:
    """The key of a file: a hash of the tenant and the file's name; no tenant differs from any."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    return F.sha2(F.concat(F.lit("["), quoted(tenant), F.lit(", "), quoted(name), F.lit("]")), 256)


_KEYED = ("document_key", "doc_version", "status", "file_hash")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return fold_events(table(spark, folder, "messages", "id", "loaded_at", "session_id", "seq"), "id", "loaded_at", ["session_id", "seq"])


def q_reserve(spark: SparkSession, folder: str) -> DataFrame:
    rows = registry(spark, folder, *_KEYED)
    return reserve(rows, rows.select("document_key", "file_hash"))


def q_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Where the registry's current version is not the one that publishing would choose."""
    rows = registry(spark, folder, *_KEYED, "is_current")
    due = publish(rows).select("document_key", F.col("id").alias("due_id"))
    now = rows.filter(F.coalesce(F.col("is_current"), F.lit(False)) & F.col("document_key").isNotNull()).groupBy("document_key").agg(F.max("id").alias("current_id"), F.count(F.lit(1)).alias("marked"))
    both = due.join(now, "document_key", "full")
    return both.filter(~F.col("due_id").eqNullSafe(F.col("current_id")) | (F.col("marked") > 1)).select("document_key", "due_id", "current_id", "marked")


def q_visible(spark: SparkSession, folder: str) -> DataFrame:
    items = fold_events(table(spark, folder, "source_items", "item_id", "loaded_at", "document_version_id", "source"), "item_id", "loaded_at", ["document_version_id", "source"])
    return visible(items, "document_version_id", registry(spark, folder, "is_current")).groupBy("source").agg(F.count(F.lit(1)).alias("items"))


_VERSIONED = ("document_key", "doc_version", "status", "tenant_id")


def q_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The states of the registry's records, delivered as results, against the records' first states."""
    rows = table(spark, folder, "document_registry", "id", "document_key", "doc_version", "file_hash", "status", "chunk_count", "updated_at").filter("document_key IS NOT NULL")
    first = rows.groupBy("id").agg(F.min(F.struct("updated_at", "document_key", "doc_version", "file_hash", "status", "chunk_count")).alias("x")).select("id", "x.document_key", "x.doc_version", "x.file_hash", "x.status", "x.chunk_count")
    return ingest_versions(first, rows.select("id", "file_hash", "chunk_count", F.col("updated_at").alias("delivered")))


def q_append(spark: SparkSession, folder: str) -> DataFrame:
    """Late messages as new turns of their sessions: those that arrived a day or more after they were written."""
    rows = fold_events(table(spark, folder, "messages", "id", "loaded_at", "session_id", "seq", "created_at"), "id", "loaded_at", ["session_id", "seq", "created_at", "loaded_at"])
    late = F.coalesce(F.datediff("loaded_at", "created_at") >= 1, F.lit(False))
    return append_turns(rows.filter(~late), rows.filter(late).select("session_id", "id", F.col("loaded_at").alias("arrived")))


def q_recent(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_events(table(spark, folder, "messages", "id", "loaded_at", "session_id", "seq", "created_at"), "id", "loaded_at", ["session_id", "seq", "created_at"])
    return recent_turns(rows, "2025-06-01", 20, 7 * 86_400).select("session_id", "id", F.col("back").cast("long").alias("back"))


QUERIES = {
    "version_history": lambda s, d: version_history(registry(s, d, *_VERSIONED)),
    "owned_versions": lambda s, d: owned(registry(s, d, *_VERSIONED), None).select("id", "document_key", "doc_version", "status"),
    "deleted_versions": lambda s, d: delete_versions(registry(s, d, "status", "is_current", "source", "updated_at"), registry(s, d, "status").filter("status = 'failed'"), "2026-01-01").select("id", "status", "is_current", F.date_format("updated_at", "yyyy-MM-dd").alias("updated")),
    "ingested_versions": q_ingest,
    "appended_turns": q_append,
    "recent_turns": q_recent,
    "latest_version": lambda s, d: latest_versions(registry(s, d, *_KEYED)),
    "publish_current": lambda s, d: publish(registry(s, d, *_KEYED)),
    "reserve_dedupe": q_reserve,
    "stale_current": q_stale,
    "version_visible_items": q_visible,
    "last_six_turns": lambda s, d: last_turns(_messages(s, d), 6).select("session_id", "id", "seq", F.col("back").cast("long").alias("back")),
    "next_seq": lambda s, d: next_seq(_messages(s, d)),
    "document_keys": lambda s, d: registry(s, d, "tenant_id", "original_filename").select("id", document_key(F.col("tenant_id"), F.col("original_filename")).alias("file_key")),
}
_REG = "(SELECT * FROM document_registry QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_MSG = "(SELECT * FROM messages WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_LATEST = f"SELECT document_key, doc_version, id, status, file_hash FROM {_REG} WHERE document_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY doc_version DESC, id DESC) = 1"
_PUBLISH = f"SELECT document_key, doc_version, id FROM {_REG} WHERE document_key IS NOT NULL AND lower(status) = 'ready' QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY doc_version DESC, id DESC) = 1"
_FIRST = "(SELECT * FROM document_registry WHERE document_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at, document_key, doc_version, file_hash, status, chunk_count) = 1)"
_TURNS = "(SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_LATE = "coalesce(date_diff('day', CAST(created_at AS DATE), CAST(loaded_at AS DATE)) >= 1, false)"
SQL = {
    "version_history": f"""SELECT a.id AS of_id, row_number() OVER (PARTITION BY a.id ORDER BY b.doc_version DESC NULLS LAST, b.id DESC) AS place, b.id, b.doc_version, b.status FROM (SELECT * FROM {_REG} WHERE document_key IS NOT NULL AND NOT coalesce(lower(status) = 'deleted', false)) a JOIN {_REG} b ON b.document_key = a.document_key AND b.tenant_id IS NOT DISTINCT FROM a.tenant_id""",
    "owned_versions": f"SELECT id, document_key, doc_version, status FROM {_REG} WHERE tenant_id IS NULL AND document_key IS NOT NULL AND NOT coalesce(lower(status) = 'deleted', false)",
    "deleted_versions": f"SELECT id, CASE WHEN status = 'failed' THEN 'deleted' ELSE status END AS status, CASE WHEN status = 'failed' THEN false ELSE is_current END AS is_current, CASE WHEN status = 'failed' THEN '2026-01-01' ELSE strftime(updated_at, '%Y-%m-%d') END AS updated FROM {_REG}",
    "ingested_versions": f"""WITH v AS (SELECT * FROM {_FIRST}), t AS (SELECT r.id, v.document_key, v.doc_version, v.status AS was, v.chunk_count AS had, coalesce(r.chunk_count, 0) AS got, r.updated_at AS delivered,
CASE WHEN lower(v.status) = 'ready' THEN 'done' WHEN lower(v.status) = 'deleted' THEN 'deleted' WHEN r.file_hash IS DISTINCT FROM v.file_hash THEN 'mismatch' WHEN coalesce(r.chunk_count, 0) <= 0 THEN 'empty' ELSE 'ready' END AS verdict FROM (SELECT * FROM document_registry WHERE document_key IS NOT NULL) r JOIN v ON v.id = r.id),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY verdict = 'ready' DESC, delivered DESC, verdict DESC, got DESC) = 1),
n AS (SELECT document_key, max(doc_version) AS newest FROM (SELECT document_key, doc_version FROM o WHERE verdict = 'ready' UNION ALL SELECT document_key, doc_version FROM v WHERE lower(status) = 'ready') GROUP BY 1)
SELECT id, CASE WHEN verdict = 'ready' THEN 'ready' WHEN verdict IN ('mismatch', 'empty') THEN 'failed' ELSE was END AS status, CAST(CASE WHEN verdict = 'ready' THEN got ELSE had END AS BIGINT) AS chunk_count, coalesce(verdict = 'ready' AND doc_version = newest, false) AS publishes, verdict FROM o LEFT JOIN n USING (document_key)""",
    "appended_turns": f"""WITH m AS (SELECT *, {_LATE} AS late FROM {_TURNS}), b AS (SELECT session_id, coalesce(max(seq), 0) + 1 AS nxt FROM m WHERE NOT late AND session_id IS NOT NULL GROUP BY 1)
SELECT m.session_id, id, CAST(coalesce(nxt, 1) + row_number() OVER (PARTITION BY m.session_id ORDER BY loaded_at, id) - 1 AS BIGINT) AS seq FROM m LEFT JOIN b ON b.session_id = m.session_id WHERE late AND m.session_id IS NOT NULL""",
    "recent_turns": f"""WITH m AS (SELECT * FROM {_TURNS} WHERE session_id IS NOT NULL AND created_at <= TIMESTAMP '2025-06-01'), a AS (SELECT session_id FROM m GROUP BY 1 HAVING max(created_at) > TIMESTAMP '2025-06-01' - INTERVAL 7 DAY)
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC NULLS LAST, id DESC) AS back FROM m WHERE session_id IN (SELECT session_id FROM a) QUALIFY back <= 20""",
    "latest_version": _LATEST,
    "publish_current": _PUBLISH,
    "reserve_dedupe": f"""SELECT o.document_key, o.file_hash, CAST(CASE WHEN r THEN doc_version ELSE doc_version + 1 END AS INTEGER) AS doc_version, r AS reused FROM (
SELECT o.document_key, o.file_hash, l.doc_version, coalesce(l.file_hash = o.file_hash AND l.status IN ('pending', 'ready'), false) r
FROM (SELECT DISTINCT document_key, file_hash FROM {_REG} WHERE document_key IS NOT NULL) o LEFT JOIN ({_LATEST}) l ON l.document_key = o.document_key) o""",
    "stale_current": f"""SELECT document_key, due_id, current_id, marked FROM (SELECT document_key, id due_id FROM ({_PUBLISH})) d
FULL JOIN (SELECT document_key, max(id) current_id, count(*) marked FROM {_REG} WHERE is_current AND document_key IS NOT NULL GROUP BY 1) c USING (document_key) WHERE due_id IS DISTINCT FROM current_id OR marked > 1""",
    "version_visible_items": rf"""SELECT source, count(*) AS items FROM (SELECT * FROM source_items QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC) = 1) i
WHERE trim(coalesce(document_version_id, '')) = '' OR (regexp_full_match(trim(document_version_id), '[+-]?[0-9]+') AND TRY_CAST(trim(document_version_id) AS BIGINT) IN (SELECT id FROM {_REG} WHERE is_current)) GROUP BY source""",
    "last_six_turns": f"SELECT session_id, id, seq, row_number() OVER w AS back FROM {_MSG} WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC NULLS LAST, id DESC) QUALIFY row_number() OVER w <= 6",
    "next_seq": f"SELECT session_id, CAST(coalesce(max(seq), 0) + 1 AS BIGINT) AS next_seq FROM {_MSG} GROUP BY session_id",
    "document_keys": f"""SELECT id, sha256('[' || coalesce('"' || tenant_id || '"', 'null') || ', ' || coalesce('"' || original_filename || '"', 'null') || ']') AS file_key FROM {_REG}""",
}
