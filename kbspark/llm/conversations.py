"""p2: conversations rebuilt from rows of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.text import is_empty, is_empty_sql, speaker, speaker_sql
from kbspark.operators.events import fold_events
from kbspark.sources.tables import table


def session_verdicts(messages: DataFrame, sessions: DataFrame, version: str = "loaded_at", op: str | None = None) -> DataFrame:
    """Every session with the reason to drop it, null where it stands.

    messages: id, session_id, role, content, seq, `version`, and `op` where events say so; sessions: id. Result:
    session_id, turns, reason. The rows are an event log: of each id the newest version counts, deleted ids are gone.
    Reasons, first that applies: `empty` (no turn, or none with content), `broken` (id not in sessions; seq not exactly
    1, 2, 3, ... once each; a role that is neither user nor assistant; the assistant first, or twice in a row),
    `missing_reply` (a user turn that is last, or followed by a user turn or by an empty reply). Rows with a null
    session_id count nowhere; null ids of sessions are no sessions; repeated rows are one. Other columns are ignored.

    Neighbours are found without a window: each turn reports to its own place and to the place after it, and places are
    the unit of grouping, so a session of any length is spread over all tasks and combined before each shuffle.
    """
    rows = messages.filter(F.col("session_id").isNotNull()).withColumns(
        {"by": F.coalesce(F.when(speaker(F.col("role")) == "user", 1).when(speaker(F.col("role")) == "assistant", 2), F.lit(0)).cast("tinyint"), "bare": is_empty(F.col("content"))}
    )
    turns = fold_events(rows, "id", version, ["session_id", "seq", "by", "bare"], op)
    place, none = F.col("seq").cast("long"), F.lit(None)
    own = F.struct(place.alias("at"), F.col("by").alias("own"), F.col("bare").alias("bare"), none.cast("tinyint").alias("before"))
    after = F.struct((place + 1).alias("at"), none.cast("tinyint").alias("own"), none.cast("boolean").alias("bare"), F.col("by").alias("before"))
    places = (
        turns.select("session_id", F.explode(F.array(own, after)).alias("x"))
        .groupBy("session_id", "x.at")
        .agg(F.count("x.own").alias("n"), F.max("x.own").alias("own"), F.min("x.own").alias("low"), F.min("x.bare").alias("bare"), F.max("x.before").alias("before"))
    )
    bad = (F.col("n") > 1) | ((F.col("n") > 0) & F.col("at").isNull()) | (F.col("low") == 0) | ((F.col("own") == 2) & ((F.col("at") == 1) | (F.col("before") == 2)))
    mute = (F.col("before") == 1) & (F.col("own").isNull() | (F.col("own") == 1) | F.col("bare"))
    per_place = places.select(
        "session_id",
        "n",
        F.when(F.col("n") > 0, F.col("at")).alias("at"),
        F.coalesce(F.col("n") * (~F.col("bare")).cast("int"), F.lit(0)).alias("said"),
        F.coalesce(bad, F.lit(False)).alias("bad"),
        F.coalesce(mute, F.lit(False)).alias("mute"),
        F.lit(False).alias("known"),
    )
    known = sessions.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("session_id"), F.lit(0).cast("long").alias("n"), none.cast("long").alias("at"), F.lit(0).cast("long").alias("said"), F.lit(False).alias("bad"), F.lit(False).alias("mute"), F.lit(True).alias("known")
    )
    whole = per_place.unionByName(known).groupBy("session_id").agg(
        F.sum("n").alias("turns"), F.min("at").alias("low"), F.max("at").alias("high"), F.sum("said").alias("said"), F.max("bad").alias("bad"), F.max("mute").alias("mute"), F.max("known").alias("known")
    )
    broken = ~F.col("known") | F.col("bad") | (F.col("low") != 1) | (F.col("high") != F.col("turns"))
    reason = F.when((F.col("turns") == 0) | (F.col("said") == 0), "empty").when(broken, "broken").when(F.col("mute"), "missing_reply")
    return whole.select("session_id", "turns", reason.alias("reason"))


def rebuild_conversations(messages: DataFrame, verdicts: DataFrame, version: str = "loaded_at", op: str | None = None) -> DataFrame:
    """The turns of the sessions that stand: session_id, seq, speaker, id, content, turns; range-sorted by session and seq.

    A conversation is a run of rows, so its length is bounded by nothing. verdicts: what session_verdicts gives. Null
    contents stay null, where a user sent nothing. No standing session gives an empty result.
    """
    turns = fold_events(messages.filter(F.col("session_id").isNotNull()), "id", version, ["session_id", "seq", "role", "content"], op)
    standing = verdicts.filter(F.col("reason").isNull()).select("session_id", "turns")
    joined = turns.join(standing, "session_id")
    return joined.select("session_id", "seq", speaker(F.col("role")).alias("speaker"), "id", "content", "turns").orderBy("session_id", "seq")


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return session_verdicts(table(spark, folder, "messages", "id", "session_id", "role", "content", "seq", "loaded_at"), table(spark, folder, "sessions", "id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).filter(F.col("reason").isNotNull()).select("session_id", "reason")


def p2_conversations(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "messages", "id", "session_id", "role", "content", "seq", "loaded_at")
    return rebuild_conversations(messages, _verdicts(spark, folder))


_FOLDED = f"""
turns AS (SELECT * FROM (SELECT *, {speaker_sql("role")} spk, {is_empty_sql("content")} bare FROM messages WHERE session_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
near AS (SELECT *, lag(spk) OVER w before, lead(spk) OVER w next, lead(bare) OVER w next_bare FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY seq, id)),
whole AS (SELECT session_id, count(*) turns, bool_and(bare) mute,
  count(DISTINCT seq) <> count(*) OR min(seq) <> 1 OR max(seq) <> count(*) OR bool_or(spk IS NULL) OR bool_or(spk = 'assistant' AND (seq = 1 OR coalesce(before = 'assistant', false))) broken,
  bool_or(spk = 'user' AND (next IS NULL OR next = 'user' OR next_bare)) unanswered FROM near GROUP BY session_id),
known AS (SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL),
verdicts AS (SELECT coalesce(session_id, id) session_id, turns,
  CASE WHEN turns IS NULL OR mute THEN 'empty' WHEN id IS NULL OR broken THEN 'broken' WHEN unanswered THEN 'missing_reply' END reason
  FROM whole FULL JOIN known ON session_id = id)
"""
SQL = {
    "p2_found": f"WITH {_FOLDED} SELECT session_id, reason FROM verdicts WHERE reason IS NOT NULL",
    "p2_conversations": f"WITH {_FOLDED} SELECT t.session_id, t.seq, t.spk AS speaker, t.id, t.content, v.turns FROM turns t JOIN verdicts v ON v.session_id = t.session_id AND v.reason IS NULL",
}
QUERIES = {"p2_found": p2_found, "p2_conversations": p2_conversations}
