"""Ranked retrieval: BM25, cosine, rank fusion, thresholds, visibility."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions.scalars import example_words, example_words_sql, search_tokens, search_tokens_sql, word_set, word_set_sql
from kbspark.operators.events import any_of, fold_events
from kbspark.operators.sheets import SQL as _SHEETS
from kbspark.operators.sheets import q_tables
from kbspark.session import cut
from kbspark.sources.tables import table

#: BM25's saturation and length constants, and the constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: One query in so many of the evaluation items or vectors is searched with.
EVERY = 50
#: Queries that are held beside each row at once.
BLOCK = 256


def tenant_filter(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """The rows whose list of tenants has `tenant`; without one there is no filter, as the caller has no login."""
    return df.filter(F.array_contains(column, tenant)) if tenant and tenant.strip() else df


def equals_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """The rows that equal `wanted` in every column it names."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def delete_matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """df without the rows that equal `wanted` in every column it names; without any column nothing is deleted."""
    if not wanted:
        return df
    equal = [F.coalesce(F.col(name) == F.lit(value), F.lit(False)) for name, value in wanted.items()]
    return df.filter(~reduce(lambda a, b: a & b, equal))


def best(df: DataFrame, k: int, score: str = "score", query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The k best rows of each query by score (rounded to 6 places), then doc; with their rank. Spark cuts each query before the shuffle."""
    order = W.partitionBy(query).orderBy(F.round(score, 6).desc(), F.col(doc).asc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[list[Row]]:
    """The rows of a stated set of queries, `size` at a time; read one partition at a time, so the driver holds no more than one."""
    rows = queries.toLocalIterator()
    while block := list(islice(rows, size)):
        yield block


def beside(df: DataFrame, queries: DataFrame, size: int = BLOCK) -> DataFrame:
    """Each row of df with each of a stated set of queries, in blocks: the columns of both, which have different names. Without a query there is no row."""
    kinds = dict(queries.dtypes)
    result = df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}).limit(0)
    for block in blocks(queries, size):
        each = F.array(*[F.struct(*[F.lit(r[c]).cast(k).alias(c) for c, k in kinds.items()]) for r in block])
        result = result.unionByName(df.withColumn("beside", F.explode(each)).select(*df.columns, "beside.*"))
    return result


def postings(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """How often documents have the terms of the queries: doc_id, term, tf, dl (tokens of the document)."""
    return _postings(_tokens(docs), queries)


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", search_tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts"))


def _postings(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    terms = queries.select(F.explode(search_tokens(F.col("question"))).alias("term")).distinct()
    return tokens.select("doc_id", "dl", F.explode("ts").alias("term")).join(terms, "term").groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query by BM25: query_id, doc_id, score, rank.

    docs: doc_id, text; queries: query_id, question. A query's terms count once each. Documents without a term of the
    query are no result; null texts have no term but count as documents; queries without terms have no result. Only
    tokens that some query has are shuffled, counted on each side first; the queries are a given set, not the corpus.
    The corpus is read once: what is found of the queries' terms, and a row for each task with its documents and tokens.
    """
    tokens = _tokens(docs.select("doc_id", "text"))
    terms = queries.select(F.explode(search_tokens(F.col("question"))).alias("term")).distinct()
    # Beside its tokens a document has one that no text has, which counts it and its length.
    marked = tokens.select("doc_id", "dl", F.explode(F.array_append("ts", F.lit(""))).alias("term"))
    known = marked.join(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string")), "term")
    held = cut(known.groupBy(F.when(F.col("term") != "", F.col("doc_id")).alias("doc_id"), "term", "dl").agg(F.count(F.lit(1)).alias("tf")))
    size = held.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("mean"))
    held = held.filter("term != ''")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("question")))).alias("term"))
    # One row of totals joins every row.
    weighed = asked.join(df, "term").join(F.broadcast(size))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = weighed.select("query_id", "term", idf.alias("idf"), "mean").join(held, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * saturated).alias("score"))
    return best(scored, k).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def cosine(vectors: DataFrame, queries: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """The k nearest vectors of each query by cosine, itself left out: query_id, doc_id, score, rank. Exact.

    vectors: doc_id, vector; queries: query_id, vector, both ids numbers. Null and zero vectors, and those of another
    length than the query's, are near nothing. The queries are a stated set and go to the tasks in blocks of `size`; a
    task scores a batch of vectors against a block by one matrix product and keeps the k best of each query, and those
    equal to the last of them, before anything is shuffled.
    """
    spark = vectors.sparkSession
    found = None
    for block in blocks(queries.select("query_id", "vector").filter("query_id IS NOT NULL AND size(vector) > 0"), size):
        sent = spark.sparkContext.broadcast([(r["query_id"], np.array([np.nan if x is None else x for x in r["vector"]], float)) for r in block])

        def near(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lengths = batch["vector"].map(len).to_numpy()
                for n in np.unique(lengths):
                    ids = batch["doc_id"].to_numpy()[lengths == n]
                    own = np.array([list(v) for v in batch["vector"].to_numpy()[lengths == n]], float).reshape(len(ids), n)
                    asked = [(q, v) for q, v in sent.value if len(v) == n]
                    if asked:
                        yield _nearest(ids, own, np.array([q for q, _ in asked]), np.array([v for _, v in asked]), k)

        part = vectors.select("doc_id", "vector").filter("doc_id IS NOT NULL AND size(vector) > 0").mapInPandas(near, "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, doc_id long, score double")
    return best(found, k).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def _nearest(ids: np.ndarray, own: np.ndarray, queries: np.ndarray, asked: np.ndarray, k: int) -> pd.DataFrame:
    with np.errstate(invalid="ignore", divide="ignore"):
        score = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T
    score[~np.isfinite(score) | (ids[None, :] == queries[:, None])] = -np.inf
    rounded = np.round(score, 6)
    least = np.partition(rounded, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
    q, d = np.nonzero((rounded >= least[:, None]) & np.isfinite(score))
    return pd.DataFrame({"query_id": queries[q], "doc_id": ids[d], "score": score[q, d]})


def hybrid(docs: DataFrame, queries: DataFrame, k: int, prefetch: int = 20, visible: Column | None = None) -> DataFrame:
    """The k best documents of each query by both channels, dense and BM25: query_id, doc_id, score, rank.

    docs: doc_id, text, vector; queries: query_id, question, vector. Each channel gives its first `prefetch`, fused by
    reciprocal ranks. Documents that are not visible are in neither channel, nor in its counts.
    """
    seen = docs if visible is None else docs.filter(visible)
    return fuse([cosine(seen, queries, prefetch), bm25(seen, queries, prefetch)], k)


def fuse(channels: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Rankings fused by reciprocal ranks: query_id, doc_id, score, rank. A document that a channel lacks gets nothing from it."""
    ranked = [c.select("query_id", "doc_id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part")) for c in channels]
    whole = ranked[0]
    for c in ranked[1:]:
        whole = whole.unionByName(c)
    return best(whole.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def drop_irrelevant(ranked: DataFrame, least: float, sure: float, share: float = 0.15, keep: int = 1, drop_all: bool = False) -> DataFrame:
    """Of each query's results those with enough score.

    Where the best reaches `sure`, others need `share` of it (and `least`); else they need `least`. Where even the best
    lacks `least`, the first `keep` stay, or none with drop_all; `keep` results stay in any case otherwise.
    """
    top = F.max("score").over(W.partitionBy("query_id"))
    limit = F.when(top >= sure, F.greatest(F.lit(least), top * share)).otherwise(F.lit(least))
    stays = (F.col("score") >= limit) | (F.col("rank") <= keep)
    return ranked.withColumn("stays", F.when(F.lit(drop_all) & (top < least), False).otherwise(stays)).filter("stays").drop("stays")


def overlap(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents by the share of the query's words they have: query_id, doc_id, score, rank."""
    asked = queries.select("query_id", word_set(F.col("question")).alias("ws")).select("query_id", F.size("ws").alias("size"), F.explode("ws").alias("word"))
    held = docs.select("doc_id", F.explode(word_set(F.col("text"))).alias("word"))
    hits = held.join(asked, "word").groupBy("query_id", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    return best(hits.select("query_id", "doc_id", (F.col("n") / F.col("size")).alias("score")), k).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def link_score(question: Column, name: Column, text: Column) -> Column:
    """How well a table fits a question: 3 a shared word of its name, 4 for its name as such, 1 a shared word of its text."""
    shared = lambda c: F.size(F.array_intersect(word_set(question), word_set(c))).cast("double")
    named = F.when(any_of([F.contains(F.lower(question), F.lower(name))]), 4.0).otherwise(0.0)
    return shared(name) * 3 + named + shared(text)


def table_score(question: Column, table: Column) -> Column:
    """How well a described table fits a question: for each shared word of its display name 3, for its name as such 4, and of
    each column 1 a shared word of the description, 2 for its name as such, 2.5 for each of its first 20 values as such.

    table: struct of table_name, display_name, columns (array of name, description, enum_values joined by /).
    """
    words, low = word_set(question), F.lower(question)
    shared = lambda c: F.size(F.array_intersect(words, word_set(c))).cast("double")
    named = lambda c: F.coalesce((c != "") & F.contains(low, F.lower(c)), F.lit(False))
    values = lambda c: F.size(F.filter(F.slice(F.split(F.coalesce(c, F.lit("")), "/"), 1, 20), lambda v: named(v))) * 2.5
    each = F.transform(table["columns"], lambda c: shared(c["description"]) + F.when(named(c["name"]), 2.0).otherwise(0.0) + values(c["enum_values"]))
    return shared(table["display_name"]) * 3 + F.when(named(table["table_name"]), 4.0).otherwise(0.0) + F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def rank_tables(tables: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """The k tables that fit each question best, those with a score of 0 too: query_id, table_name, score, rank. Of equal ones the first by name. The questions are a stated set."""
    fields = F.struct("table_name", "display_name", "columns")
    scored = beside(tables.select("table_name", "display_name", "columns"), queries.select("query_id", "question")).select("query_id", "table_name", table_score(F.col("question"), fields).alias("score"))
    return best(scored, k, doc="table_name").select("query_id", "table_name", F.round("score", 4).alias("score"), "rank")


def example_score(question: Column, example: Column, words: tuple[str, ...], tables: Column | None = None) -> Column:
    """How well an example fits a question: the share of the question's words, characters and pairs of characters it has,
    0.35 if both ask for an aggregate, and 0.5 for each of the example's tables that the question names."""
    asks = lambda c: any_of([F.contains(F.lower(c), F.lit(w)) for w in words])
    both = F.size(F.array_intersect(example_words(question), example_words(example)))
    named = F.lit(0.0) if tables is None else F.size(F.filter(tables, lambda t: F.coalesce((t != "") & F.contains(F.lower(question), F.lower(t)), F.lit(False)))) * 0.5
    return both / F.greatest(F.lit(1), F.size(example_words(question))) + F.when(asks(question) & asks(example), 0.35).otherwise(0.0) + named


#: Words that ask for an aggregate.
AGGREGATES = ("how many", "count", "total", "sum", "average", "mean", "maximum", "minimum", "most", "least", "wie viele", "combien", "cuánt", "多少", "几", "总", "平均", "最大", "最小", "最多", "最少")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "qa_test_v2", "item_id", "question").filter(f"item_id % {EVERY} = 0 AND question IS NOT NULL").distinct()
    return rows.select(F.col("item_id").alias("query_id"), "question")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def q_cosine(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return cosine(rows, rows.filter(f"doc_id % {EVERY} = 0").withColumnRenamed("doc_id", "query_id"), 10)


def q_relevant(spark: SparkSession, folder: str) -> DataFrame:
    return drop_irrelevant(bm25(_docs(spark, folder), _items(spark, folder), 20), 8.0, 16.0, 0.5)


def q_link(spark: SparkSession, folder: str) -> DataFrame:
    """For the files cited by replies: how well their name and preview fit the question that was asked before."""
    items = table(spark, folder, "source_items", "item_id", "message_id", "source", "text_preview", "loaded_at")
    items = fold_events(items, "item_id", "loaded_at", ["message_id", "source", "text_preview"]).filter("source IS NOT NULL")
    messages = fold_events(table(spark, folder, "messages", "id", "content", "loaded_at"), "id", "loaded_at", ["content"]).filter("content IS NOT NULL")
    joined = items.join(messages, F.col("message_id") == F.col("id"))
    return joined.select("item_id", F.round(link_score(F.col("content"), F.col("source"), F.col("text_preview")), 4).alias("score"))


def q_example(spark: SparkSession, folder: str) -> DataFrame:
    """For every fiftieth evaluation item the three chat questions that fit it best, of those that fit at all."""
    messages = fold_events(table(spark, folder, "messages", "id", "loaded_at", "role", "content"), "id", "loaded_at", ["role", "content"])
    examples = messages.filter(F.lower(F.trim("role")).isin("user", "human") & F.col("content").isNotNull()).select(F.col("id").alias("doc_id"), F.col("content").alias("example"))
    tables = F.array_distinct(F.regexp_extract_all("example", F.lit(_TABLES), F.lit(0)))
    scored = beside(examples, _items(spark, folder)).select("query_id", "doc_id", example_score(F.col("question"), F.col("example"), AGGREGATES, tables).alias("score"))
    return best(scored, 3).filter(F.col("score") >= 0.12).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


#: What tables are called in questions.
_TABLES = "[a-z]+_[a-z]+"


def q_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """For every fiftieth document with a vector those most like it by text and vector, among the documents of one tenant or of none."""
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding").select((F.col("vec_id") + _FIRST_DOC).alias("doc_id"), F.col("embedding").alias("vector"))
    docs = table(spark, folder, "documents", "doc_id", "text", "tenant_id").join(vectors, "doc_id")
    queries = docs.filter(f"doc_id % {EVERY} = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 80).alias("question"), "vector")
    return hybrid(docs, queries, 10, visible=F.col("tenant_id").isNull() | (F.col("tenant_id") == "tn-harvel"))


_FIRST_DOC = 100_001


def _long(query):
    return lambda s, d: query(s, d).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {
    "bm25_topk": _long(lambda s, d: bm25(_docs(s, d), _items(s, d), 10)),
    "bm25_top20": _long(lambda s, d: bm25(_docs(s, d), _items(s, d), 20)),
    "overlap_topk": _long(lambda s, d: overlap(_docs(s, d), _items(s, d), 10)),
    "rrf_fusion": _long(lambda s, d: fuse([bm25(_docs(s, d), _items(s, d), 20), overlap(_docs(s, d), _items(s, d), 20)], 10)),
    "relevance_filter": _long(q_relevant),
    "cosine_topk": _long(q_cosine),
    "hybrid_topk": _long(q_hybrid),
    "rank_tables": _long(lambda s, d: rank_tables(q_tables(s, d), _items(s, d))),
    "schema_link_score": q_link,
    "fewshot_score": q_example,
    "tenant_points_visible": lambda s, d: equals_filter(tenant_filter(table(s, d, "vector_points"), "tn-harvel"), {"file_format": "xlsx"}).groupBy("source").agg(F.count(F.lit(1)).alias("points")),
    "document_frequency": lambda s, d: postings(_docs(s, d), _items(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")),
}


def _best_sql(rows: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({rows}) QUALIFY rank <= {k}"


_ITEMS = f"(SELECT DISTINCT item_id AS query_id, question FROM qa_test_v2 WHERE item_id % {EVERY} = 0 AND question IS NOT NULL)"
_post = lambda items, docs: f"""asked AS (SELECT query_id, unnest(list_distinct({search_tokens_sql("question")})) AS term FROM {items}),
toks AS (SELECT doc_id, {search_tokens_sql("text")} AS ts FROM {docs}),
held AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
sizes AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM toks),
dfs AS (SELECT term, count(*) AS df FROM held GROUP BY term)"""  # noqa: E731
_POST = _post(_ITEMS, "documents")
_SCORED = f"""SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))) AS score
FROM asked JOIN dfs USING (term) JOIN held USING (term), sizes GROUP BY query_id, doc_id"""
_HITS = f"""SELECT query_id, doc_id, count(*) / any_value(size) AS score FROM (SELECT query_id, len(ws) AS size, unnest(ws) AS word FROM (SELECT query_id, {word_set_sql("question")} AS ws FROM {_ITEMS}))
JOIN (SELECT doc_id, unnest({word_set_sql("text")}) AS word FROM documents) USING (word) GROUP BY query_id, doc_id"""
_BM = lambda k: f"SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ({_best_sql(_SCORED, k)})"
_OV = lambda k: f"SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ({_best_sql(_HITS, k)})"
_ASKS = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in AGGREGATES) + ")"
_BOTH = lambda a, b: f"len(list_intersect({word_set_sql(a)}, {word_set_sql(b)}))"
_EXAMPLES = f"""SELECT query_id, doc_id, len(list_intersect({example_words_sql('question')}, {example_words_sql('example')})) / greatest(1, len({example_words_sql('question')})) + CASE WHEN {_ASKS('question')} AND {_ASKS('example')} THEN 0.35 ELSE 0 END
+ 0.5 * len(list_filter(list_distinct(regexp_extract_all(example, '{_TABLES}')), lambda t: contains(lower(question), t))) AS score
FROM {_ITEMS}, (SELECT id AS doc_id, content AS example FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) WHERE lower(trim(role, ' ')) IN ('user', 'human') AND content IS NOT NULL)"""
_NEAR = f"""SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id"""
SQL = {
    "bm25_topk": f"WITH {_POST} {_BM(10)}",
    "bm25_top20": f"WITH {_POST} {_BM(20)}",
    "overlap_topk": _OV(10),
    "rrf_fusion": f"""WITH {_POST} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_best_sql(f'''SELECT query_id, doc_id, sum(1.0 / ({RRF_K} + rank)) AS score FROM
(SELECT * FROM ({_BM(20)}) UNION ALL SELECT * FROM ({_OV(20)})) GROUP BY query_id, doc_id''', 10)})""",
    "relevance_filter": f"""WITH {_POST}, r AS ({_BM(20)}), t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r)
SELECT query_id, doc_id, score, rank FROM t WHERE score >= CASE WHEN top >= 16 THEN greatest(8, top * 0.5) ELSE 8 END OR rank <= 1""",
    "cosine_topk": f"SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ({_best_sql(_NEAR, 10)})",
    "schema_link_score": f"""SELECT item_id, round(CAST({_BOTH('content', 'source')} * 3 + CASE WHEN contains(lower(content), lower(source)) THEN 4 ELSE 0 END + {_BOTH('content', 'text_preview')} AS DOUBLE), 4) AS score
FROM (SELECT * FROM source_items QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC) = 1) i JOIN (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1) m ON m.id = i.message_id WHERE source IS NOT NULL AND content IS NOT NULL""",
    "hybrid_topk": f"""WITH seen AS (SELECT d.doc_id, d.text, e.embedding, d.tenant_id FROM documents d JOIN embeddings e ON e.vec_id + {_FIRST_DOC} = d.doc_id), vis AS (SELECT * FROM seen WHERE tenant_id IS NULL OR tenant_id = 'tn-harvel'),
qs AS (SELECT doc_id AS query_id, substring(text, 1, 80) AS question, embedding FROM seen WHERE doc_id % {EVERY} = 0), {_post('qs', 'vis')},
dense AS (SELECT query_id, doc_id, rank FROM ({_best_sql("SELECT q.query_id, v.doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM qs q, vis v WHERE v.doc_id <> q.query_id", 20)})),
sparse AS (SELECT query_id, doc_id, rank FROM ({_best_sql(_SCORED, 20)}))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_best_sql(f"SELECT query_id, doc_id, sum(1.0 / ({RRF_K} + rank)) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY query_id, doc_id", 10)})""",
    "rank_tables": f"""WITH t AS ({_SHEETS["described_tables"]}), s AS (SELECT query_id, table_name, 3 * {_BOTH('question', 'any_value(display_name)')} + CASE WHEN contains(lower(question), lower(table_name)) THEN 4 ELSE 0 END
+ sum({_BOTH('question', 'description')} + CASE WHEN name <> '' AND contains(lower(question), lower(name)) THEN 2 ELSE 0 END + 2.5 * len(list_filter(string_split(enum_values, '/')[1:20], lambda v: v <> '' AND contains(lower(question), lower(v))))) AS score FROM t, {_ITEMS} GROUP BY query_id, question, table_name)
SELECT query_id, table_name, round(CAST(score AS DOUBLE), 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, table_name) AS rank FROM s QUALIFY rank <= 4""",
    "fewshot_score": f"SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ({_best_sql(_EXAMPLES, 3)}) WHERE score >= 0.12",
    "tenant_points_visible": "SELECT source, count(*) AS points FROM vector_points WHERE list_contains(tenant_id, 'tn-harvel') AND file_format = 'xlsx' GROUP BY source",
    "document_frequency": f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM held GROUP BY term",
}
