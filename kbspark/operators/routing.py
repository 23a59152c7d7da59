"""Where a question goes by rules: to documents, to tables, or to a model that decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.scalars import hits
from kbspark.operators.events import any_of, fold_events
from kbspark.operators.retrieval import AGGREGATES
from kbspark.operators.sheets import QUERIES as SHEETS
from kbspark.operators.sheets import SQL as _SHEETS
from kbspark.sources.tables import table

#: Words of questions on documents, on columns, and on what could be meant in more than one way.
DOCUMENT_WORDS = ("warranty", "contract", "manual", "policy", "sign", "gewährleistung", "unterschreib", "garantie", "garantía", "firma", "signe", "保修", "签字", "合同", "手册")
COLUMN_WORDS = ("rows", "zeilen", "lignes", "filas", "记录", "salary", "price", "cost", "kostet", "coûte", "cuesta", "多少钱", "_")
VAGUE_WORDS = ("best", "top", "good", "beste", "meilleur", "mejor", "最好", "业绩", "表现")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of the words, in any case; false for null."""
    return any_of([F.contains(F.lower(text), F.lit(w)) for w in words])


def route(question: Column) -> Column:
    """`rag` for a question on documents that is not on a figure of a column, `sql` for one on a figure of a column, else `llm`; null and blank questions go nowhere."""
    figure = has_any(question, AGGREGATES) & has_any(question, COLUMN_WORDS)
    return F.when(F.trim(question) != "", F.when(has_any(question, DOCUMENT_WORDS) & ~figure, "rag").when(figure, "sql").otherwise("llm"))


def ambiguous(question: Column) -> Column:
    """Whether a question on figures leaves open what is to be measured."""
    return has_any(question, AGGREGATES + VAGUE_WORDS) & has_any(question, VAGUE_WORDS) & ~has_any(question, COLUMN_WORDS)


def q_routes(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_events(table(spark, folder, "messages", "id", "loaded_at", "role", "content"), "id", "loaded_at", ["role", "content"])
    asked = rows.filter(F.lower(F.trim("role")).isin("user", "human"))
    return asked.groupBy(route(F.col("content")).alias("route"), ambiguous(F.col("content")).alias("ambiguous")).agg(F.count(F.lit(1)).alias("n"))


def column_words(described: DataFrame) -> DataFrame:
    """The words that name columns: runs of two Chinese characters or more in their descriptions, and the given ones: word. described: description."""
    runs = described.select(F.explode(F.regexp_extract_all("description", F.lit("[一-鿿]{2,}"), F.lit(0))).alias("word"))
    return runs.unionByName(described.sparkSession.createDataFrame([(w,) for w in COLUMN_WORDS], "word string")).distinct()


def q_hits(spark: SparkSession, folder: str) -> DataFrame:
    """How many questions have which of the words of documents and aggregates."""
    rows = fold_events(table(spark, folder, "messages", "id", "loaded_at", "role", "content"), "id", "loaded_at", ["role", "content"])
    asked = rows.filter(F.lower(F.trim("role")).isin("user", "human"))
    return asked.groupBy(F.array_join(hits(F.col("content"), DOCUMENT_WORDS), ",").alias("documents"), F.array_join(hits(F.col("content"), AGGREGATES), ",").alias("aggregates")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"route_questions": q_routes, "route_hits": q_hits, "column_words": lambda s, d: column_words(SHEETS["sheet_schema"](s, d))}
_HAS = lambda words: "(" + " OR ".join(f"coalesce(contains(lower(content), '{w}'), false)" for w in words) + ")"
_HITS = lambda words: f"array_to_string(list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda w: coalesce(contains(lower(content), w), false)), ',')"
_FIGURE = f"({_HAS(AGGREGATES)} AND {_HAS(COLUMN_WORDS)})"
_ASKED = "(SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) WHERE lower(trim(role, ' ')) IN ('user', 'human')"
SQL = {
    "route_hits": f"SELECT {_HITS(DOCUMENT_WORDS)} AS documents, {_HITS(AGGREGATES)} AS aggregates, count(*) AS n FROM {_ASKED} GROUP BY 1, 2",
    "column_words": f"SELECT DISTINCT unnest(regexp_extract_all(description, '[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}')) AS word FROM ({_SHEETS['sheet_schema']}) UNION SELECT unnest([{', '.join(chr(39) + w + chr(39) for w in COLUMN_WORDS)}])",
    "route_questions": f"""SELECT CASE WHEN trim(content, ' ') <> '' THEN CASE WHEN {_HAS(DOCUMENT_WORDS)} AND NOT {_FIGURE} THEN 'rag' WHEN {_FIGURE} THEN 'sql' ELSE 'llm' END END AS route,
{_HAS(AGGREGATES + VAGUE_WORDS)} AND {_HAS(VAGUE_WORDS)} AND NOT {_HAS(COLUMN_WORDS)} AS ambiguous, count(*) AS n
FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) WHERE lower(trim(role, ' ')) IN ('user', 'human') GROUP BY 1, 2""",
}
