"""How good a retrieval is: ranks of what is relevant, recall, reciprocal ranks, differences between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.retrieval import EVERY, bm25, overlap
from kbspark.operators.retrieval import SQL as _RETRIEVAL
from kbspark.sources.tables import table


def ranks(items: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Per item the rank of its first relevant result: query_id, category, rank (null: missed), relevant (how many).

    items: query_id, category, keywords; found: query_id, doc_id, rank; docs: doc_id, text. A document is relevant that
    has all keywords, in any case; items without keywords have none. Only found documents are looked at.
    """
    asked = found.join(items.select("query_id", "keywords"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    all_there = (F.size("keywords") > 0) & F.forall("keywords", lambda k: F.contains(F.lower(F.col("text")), F.lower(k)))
    hits = asked.filter(F.coalesce(all_there, F.lit(False))).groupBy("query_id").agg(F.min("rank").cast("long").alias("rank"), F.count(F.lit(1)).alias("relevant"))
    return items.select("query_id", "category").join(hits, "query_id", "left").na.fill(0, ["relevant"])


def summary(ranked: DataFrame, k: int) -> DataFrame:
    """One row: items, hits, recall, mrr, and how many ranks are 1, 2 to 3, 4 to k, or missed. Items of category no_knowledge count nowhere; without items, recall and mrr are null."""
    own = ranked.filter(F.coalesce(F.col("category") != "no_knowledge", F.lit(True)))
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    part = lambda cond: F.count_if(hit & cond)
    mean = lambda c: F.round(F.sum(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4)
    return own.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("hits"), mean(hit.cast("int")).alias("recall"), mean(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        part(F.col("rank") == 1).alias("rank_1"), part(F.col("rank").between(2, 3)).alias("rank_2_3"), part(F.col("rank") >= 4).alias("rank_4_k"), F.count_if(~hit).alias("missed"),
    )


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per item how its rank changed: query_id, before, after, change (lost, found, worse, better, same, missing, added)."""
    b, a = before.select("query_id", F.col("rank").alias("before"), F.lit(True).alias("b")), after.select("query_id", F.col("rank").alias("after"), F.lit(True).alias("a"))
    far = F.lit(1 << 60)
    old, new = F.coalesce("before", far), F.coalesce("after", far)
    change = (
        F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "added").when(F.col("before").isNotNull() & F.col("after").isNull(), "lost").when(F.col("before").isNull() & F.col("after").isNotNull(), "found")
        .when(new > old, "worse").when(new < old, "better").otherwise("same")
    )
    return b.join(a, "query_id", "full").select("query_id", "before", "after", change.alias("change"))


def covers(got: Column, want: Column) -> Column:
    """Whether `want` is `got` or a part of it in order, as rows of results are compared."""
    at = F.aggregate(got, F.lit(0), lambda n, x: F.when((n < F.size(want)) & F.get(want, n).eqNullSafe(x), n + 1).otherwise(n))
    return at == F.size(want)


def citation_validity(cited: Column, available: Column) -> Column:
    """The share of cited numbers that there are; null where nothing is cited."""
    return F.size(F.array_intersect(cited, available)) / F.nullif(F.size(cited), F.lit(0))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "qa_test_v2", "item_id", "question", "category", "expected_keywords").filter(f"item_id % {EVERY} = 0 AND question IS NOT NULL")
    return rows.dropDuplicates(["item_id"]).select(F.col("item_id").alias("query_id"), "question", "category", F.col("expected_keywords").alias("keywords"))


def _ranked(search, spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents", "doc_id", "text"), _items(spark, folder)
    return ranks(items, search(docs, items.select("query_id", "question"), 10), docs)


QUERIES = {
    "eval_ranks": lambda s, d: _ranked(bm25, s, d),
    "overlap_ranks": lambda s, d: _ranked(overlap, s, d),
    "eval_summary": lambda s, d: summary(_ranked(bm25, s, d), 5),
    "eval_changes": lambda s, d: changes(_ranked(overlap, s, d), _ranked(bm25, s, d)),
}


def _ranks_sql(found: str) -> str:
    return f"""SELECT i.item_id AS query_id, any_value(i.category) AS category, min(r.rank) FILTER (hit) AS rank, count(*) FILTER (hit) AS relevant FROM (SELECT * FROM qa_test_v2 WHERE item_id % {EVERY} = 0 AND question IS NOT NULL) i
LEFT JOIN (SELECT f.query_id, f.rank, q.item_id, len(expected_keywords) > 0 AND len(list_filter(expected_keywords, lambda k: NOT contains(lower(text), lower(k)))) = 0 AS hit
FROM ({found}) f JOIN documents d ON d.doc_id = f.doc_id JOIN qa_test_v2 q ON q.item_id = f.query_id) r ON r.query_id = i.item_id GROUP BY i.item_id"""


_BM, _OV = _ranks_sql(_RETRIEVAL["bm25_topk"]), _ranks_sql(_RETRIEVAL["overlap_topk"])
SQL = {
    "eval_ranks": _BM,
    "overlap_ranks": _OV,
    "eval_summary": f"""WITH r AS (SELECT *, coalesce(rank <= 5, false) AS hit FROM ({_BM}) WHERE coalesce(category <> 'no_knowledge', true))
SELECT count(*) AS items, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 4) AS recall, round(sum(CASE WHEN hit THEN 1.0 / rank ELSE 0 END) / count(*), 4) AS mrr, count(*) FILTER (hit AND rank = 1) AS rank_1,
count(*) FILTER (hit AND rank BETWEEN 2 AND 3) AS rank_2_3, count(*) FILTER (hit AND rank >= 4) AS rank_4_k, count(*) FILTER (NOT hit) AS missed FROM r""",
    "eval_changes": f"""SELECT query_id, b.rank AS before, a.rank AS after, CASE WHEN b.rank IS NOT NULL AND a.rank IS NULL THEN 'lost' WHEN b.rank IS NULL AND a.rank IS NOT NULL THEN 'found'
WHEN a.rank > b.rank THEN 'worse' WHEN a.rank < b.rank THEN 'better' ELSE 'same' END AS change FROM ({_OV}) b JOIN ({_BM}) a USING (query_id)""",
}
