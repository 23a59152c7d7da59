"""What goes with a question to a model: numbered sources, the last turns, page numbers that pages carry; and gates on latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.events import fold_events
from kbspark.operators.ledger import SQL as _LEDGER
from kbspark.operators.ledger import audit, latency_summary
from kbspark.operators.retrieval import EVERY, bm25
from kbspark.operators.retrieval import SQL as _RETRIEVAL
from kbspark.operators.versions import last_turns
from kbspark.sources.tables import table

#: Characters of a source's preview and of a turn, and how many of them are given.
PREVIEW, TURN, SOURCES, TURNS = 200, 40, 5, 6
#: Slowest allowed p95 and p99, in milliseconds.
GATE = {"p95": 20_000, "p99": 120_000}


def numbered_sources(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """One text a query with its results in order of rank: query_id, context. "[1] source: beginning of the text", line by line.

    ranked: query_id, doc_id, rank; docs: doc_id, source, text. Results are a given number a query. Null sources and
    texts are empty; results that are in no document are left out.
    """
    joined = ranked.select("query_id", "doc_id", "rank").join(docs.select("doc_id", "source", "text"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def shortened(text: Column, most: int = TURN) -> Column:
    """A text of at most `most` characters, cut with dots; null as NULL."""
    return F.when(text.isNull(), "NULL").when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def history(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """The last turns of each session as one text: session_id, history. Only `turns` rows of a session are ever together."""
    last = last_turns(messages, turns)
    line = F.concat_ws(": ", F.lower(F.trim("role")), shortened(F.col("content")))
    return last.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("back", line.alias("line"))), asc=False), lambda x: x["line"]), "\n").alias("history"))


#: A line that is a page's number: alone, between dashes, after a word for page, or of how many.
_PAGE = r"(?im)^\s*(?:[-·\[]\s*|(?:page|seite|p\.|s\.)\s*|第)?(\d{1,3})(?:\s*[-·\]]|\s*(?:of|von|/)\s*\d+|页.*)?\s*$"


def logical_page(text: Column) -> Column:
    """The number that a page carries on one of its last five lines (the first there), else on the last such line of all; 1 to 999, else null."""
    tail = F.array_join(F.slice(F.split(text, "\n"), F.greatest(F.size(F.split(text, "\n")) - 4, F.lit(1)), F.lit(5)), "\n")
    near = F.nullif(F.regexp_extract(tail, _PAGE, 1), F.lit(""))
    all_of = F.regexp_extract_all(text, F.lit(_PAGE), F.lit(1))
    number = F.coalesce(near, F.get(all_of, F.size(all_of) - 1))
    return F.when(number.try_cast("int") > 0, number.try_cast("long"))


def chat_turns(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """The last turns of each session as a model reads them: session_id, place (from 1), speaker, content. What tools gave is put below the assistant's turn. Blank turns are none.

    messages: session_id, seq, id, role, content, tool_context. Spark cuts each session before the shuffle.
    """
    last = last_turns(messages.filter(F.trim("content") != ""), turns)
    by = F.when(F.lower(F.trim("role")).isin("user", "human"), "user").otherwise("assistant")
    context = F.when((by == "assistant") & (F.trim("tool_context") != ""), F.concat(F.lit("\n\n[tools]\n"), F.col("tool_context"))).otherwise("")
    size = last.groupBy("session_id").agg(F.max("back").alias("size"))
    return last.join(size, "session_id").select("session_id", (F.col("size") - F.col("back") + 1).cast("long").alias("place"), by.alias("speaker"), F.concat("content", context).alias("content"))


def gate(summary: DataFrame, limits: dict[str, int] = GATE) -> DataFrame:
    """Whether each row of a latency summary keeps to the limits: its columns, and passes."""
    kept = F.lit(True)
    for name, most in limits.items():
        kept &= F.coalesce(F.col(name) <= most, F.lit(False))
    return summary.withColumn("passes", kept)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_test_v2", "item_id", "question").filter(f"item_id % {EVERY} = 0 AND question IS NOT NULL").distinct().withColumnRenamed("item_id", "query_id")


def q_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    return numbered_sources(bm25(docs, _items(spark, folder), SOURCES), docs)


def q_history(spark: SparkSession, folder: str) -> DataFrame:
    return history(fold_events(table(spark, folder, "messages", "id", "loaded_at", "session_id", "seq", "role", "content"), "id", "loaded_at", ["session_id", "seq", "role", "content"]))


def q_turns(spark: SparkSession, folder: str) -> DataFrame:
    return chat_turns(fold_events(table(spark, folder, "messages", "id", "loaded_at", "session_id", "seq", "role", "content", "tool_context"), "id", "loaded_at", ["session_id", "seq", "role", "content", "tool_context"]))


QUERIES = {
    "chat_turns": lambda s, d: q_turns(s, d).select("session_id", "place", "speaker", F.md5("content").alias("content_md5")),
    "numbered_sources": q_sources,
    "session_history": q_history,
    "logical_pages": lambda s, d: table(s, d, "documents", "doc_id", "text", "doc_type").filter("doc_type = 'page' AND text IS NOT NULL").select("doc_id", logical_page(F.col("text")).alias("page")),
    "latency_gate": lambda s, d: gate(latency_summary(audit(s, d, "tenant_id", "elapsed_ms"), "tenant_id", "elapsed_ms")).select("tenant_id", "p95", "p99", "passes"),
}
_SHORT = f"CASE WHEN content IS NULL THEN 'NULL' WHEN length(content) > {TURN} THEN substring(content, 1, {TURN - 3}) || '...' ELSE content END"
SQL = {
    "numbered_sources": f"""SELECT query_id, string_agg('[' || rank || '] ' || coalesce(source, '') || ': ' || substring(coalesce(text, ''), 1, {PREVIEW}), chr(10) ORDER BY rank) AS context
FROM (SELECT * FROM ({_RETRIEVAL["bm25_topk"]}) WHERE rank <= {SOURCES}) r JOIN documents d ON d.doc_id = r.doc_id GROUP BY query_id""",
    "session_history": f"""SELECT session_id, string_agg(concat_ws(': ', lower(trim(role, ' ')), {_SHORT}), chr(10) ORDER BY back DESC) AS history FROM (
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC NULLS LAST, id DESC) AS back FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) WHERE session_id IS NOT NULL)
WHERE back <= {TURNS} GROUP BY session_id""",
    "chat_turns": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC NULLS LAST, id DESC) AS back FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) WHERE session_id IS NOT NULL AND trim(content, ' ') <> '' QUALIFY back <= {TURNS}),
t AS (SELECT *, CASE WHEN lower(trim(role, ' ')) IN ('user', 'human') THEN 'user' ELSE 'assistant' END AS speaker FROM m)
SELECT session_id, max(back) OVER (PARTITION BY session_id) - back + 1 AS place, speaker, md5(content || CASE WHEN speaker = 'assistant' AND trim(tool_context, ' ') <> '' THEN chr(10) || chr(10) || '[tools]' || chr(10) || tool_context ELSE '' END) AS content_md5 FROM t""",
    "logical_pages": rf"""SELECT doc_id, CASE WHEN TRY_CAST(n AS INTEGER) > 0 THEN CAST(n AS BIGINT) END AS page FROM (SELECT doc_id, coalesce(nullif(regexp_extract(array_to_string(ls[greatest(len(ls) - 4, 1):], chr(10)), '{_PAGE}', 1), ''), regexp_extract_all(text, '{_PAGE}', 1)[-1]) AS n
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE doc_type = 'page' AND text IS NOT NULL))""",
    "latency_gate": f"SELECT tenant_id, p95, p99, p95 <= {GATE['p95']} AND p99 <= {GATE['p99']} AS passes FROM ({_LEDGER['latency_nearest_rank']})",
}
