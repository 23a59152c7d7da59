"""Reports on answers, statements and requests: what counts in each denominator, what got worse, and where a search loses its document."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.evaluation import SQL as _EVALUATION
from kbspark.operators.evaluation import covers, ranks
from kbspark.operators.events import any_of, fold_events
from kbspark.operators.ledger import UNNAMED, nearest_ranks
from kbspark.operators.retrieval import EVERY, bm25, overlap
from kbspark.operators.retrieval import SQL as _RETRIEVAL
from kbspark.sources.tables import table

#: Share of the expected words that an answer needs, and what differences are none.
ENOUGH, SAME = 0.5, 1e-9
#: What an answer has that says that the documents do not tell.
REFUSALS = ("无法回答", "未收录", "没有相关", "未能找到", "未提及", "没有提及", "无法确定", "无法找到", "没有找到", "无法提供", "没有提供", "未提供", "未包含", "没有说明", "未说明")
#: What a verdict on correctness is worth.
CORRECTNESS = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}
_CODE = r"[A-Z]{2}-[0-9]{3,5}"


def normal_value(value: Column) -> Column:
    """A cell as results are compared: numbers, also as text, without trailing zeros and to four places, other text trimmed; null stays."""
    number = F.trim(value).try_cast("double")
    plain = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    return F.when(plain, F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(F.round(number, 4).cast("string"))).otherwise(F.trim(value))


def results_match(got: DataFrame, want: DataFrame, ordered: bool = False) -> DataFrame:
    """Per case whether a result holds what was wanted: case_id, matches.

    got, want: case_id, row_no, cells (array of text). As many rows, and each wanted row is a got one or a part of it in
    order; row by row if ordered, else each got row serves once, the first that fits. A case that only one side has does
    not match. Results are a capped number of rows, so a case is together in one place.
    """
    rows = lambda df, name: df.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.transform("cells", normal_value).alias("c")))), lambda x: x["c"]).alias(name))
    both = rows(got, "g").join(rows(want, "w"), "case_id", "full")
    if ordered:
        fits = F.forall(F.arrays_zip("g", "w"), lambda x: covers(x["g"], x["w"]))
    else:
        at = lambda left, w: F.coalesce(F.get(F.filter(F.transform(left, lambda x, i: F.when(covers(x, w), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))
        without = lambda left, i: F.filter(left, lambda _, k: k != i)
        # Every wanted row takes a got one away; one that finds none takes nothing.
        left = F.aggregate("w", F.col("g"), lambda g, w: without(g, at(g, w)))
        fits = F.size(left) == 0
    return both.select("case_id", F.coalesce((F.size("g") == F.size("w")) & fits, F.lit(False)).alias("matches"))


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()).lower())


def folded(text: Column) -> Column:
    """A text as quotes are looked for: compatible characters as one, without white space, in lower case."""
    return F.pandas_udf(_fold, "string")(text)


def share_of(parts: Column, text: Column) -> Column:
    """The share of `parts` that a text contains, in any case and spacing; null where there are none."""
    bare = lambda c: F.replace(F.translate(F.lower(c), "‑", "-"), F.lit(" "), F.lit(""))
    hits = F.size(F.filter(parts, lambda p: F.coalesce(F.contains(bare(text), bare(p)), F.lit(False))))
    return F.when(F.size(parts) > 0, hits / F.size(parts))


def refuses(text: Column) -> Column:
    return any_of([F.contains(text, F.lit(x)) for x in REFUSALS])


def judged(rows: DataFrame, k: int, answers: bool = True) -> DataFrame:
    """Each item with its judgement: + recalled (null for no_knowledge), share, passed (null where it is not judged).

    rows: category, rank, keywords, answer. With answers an item passes if its document is among the first k and the
    answer has ENOUGH of its words; one of category no_knowledge if the answer says that it can't tell. Without answers the
    document alone decides, and no_knowledge is not judged.
    """
    unknown = F.coalesce(F.col("category") == "no_knowledge", F.lit(False))
    recalled = F.when(~unknown, F.coalesce(F.col("rank") <= k, F.lit(False)))
    share = F.coalesce(share_of(F.col("keywords"), F.col("answer")), F.lit(0.0)) if answers else F.lit(None).cast("double")
    passed = F.when(unknown, refuses(F.col("answer"))).otherwise(recalled & (share >= ENOUGH)) if answers else recalled
    return rows.withColumns({"recalled": recalled, "share": share, "passed": passed})


def report(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of judged rows, by `by` (none: one row): total, judged, passed, failed, pass_rate, recall_rate, mrr, avg_share. Rates without a denominator are null; recall counts only recalled rows that are not null, MRR all but no_knowledge."""
    known = F.coalesce(F.col("category") != "no_knowledge", F.lit(True))
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("passed").alias("judged"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        rate(F.count_if("passed"), F.count("passed")).alias("pass_rate"), rate(F.count_if("recalled"), F.count("recalled")).alias("recall_rate"),
        rate(F.sum(F.when(known & (F.col("rank") <= k), 1 / F.col("rank")).otherwise(0.0)), F.count_if(known)).alias("mrr"), F.round(F.avg("share"), 4).alias("avg_share"),
    )


def statement_report(cases: DataFrame, by: list[str]) -> DataFrame:
    """Of generated statements, by `by`: total, clarified, judged, executed, passed, accuracy, valid_rate, avg_attempts. A question that was asked back is judged nowhere. cases: clarified, executed, passed, attempts."""
    own = ~F.coalesce(F.col("clarified"), F.lit(False))
    n = F.count_if(own)
    rate = lambda x: F.round(x / F.nullif(n, F.lit(0)), 4)
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~own).alias("clarified"), n.alias("judged"), F.count_if(own & F.col("executed")).alias("executed"), F.count_if(own & F.col("passed")).alias("passed"),
        rate(F.count_if(own & F.col("passed"))).alias("accuracy"), rate(F.count_if(own & F.col("executed"))).alias("valid_rate"), rate(F.sum(F.when(own, F.col("attempts")))).alias("avg_attempts"),
    )


def diagnostics(replies: DataFrame) -> DataFrame:
    """Of each reply what can be told without a judge: id, evidence_recall, fact_coverage, invalid_citations, citation_validity; null where there is nothing to count.

    replies: id, answer, facts (array of text), evidence and contexts (arrays of source, text), cited and available
    (arrays of int). Evidence is found if a context of the same source has its text. Spelling is compared folded.
    """
    same = lambda a, b: (a["source"] == b["source"]) & F.contains(b["text"], a["text"])
    found = F.size(F.filter("evidence", lambda e: F.exists("contexts", lambda c: same(e, c))))
    told = F.size(F.filter("facts", lambda f: F.contains(F.col("answer"), f)))
    share = lambda n, of: F.round(n / F.nullif(F.size(of), F.lit(0)), 4)
    return replies.select(
        "id", share(found, "evidence").alias("evidence_recall"), share(told, "facts").alias("fact_coverage"), F.array_sort(F.array_except("cited", "available")).alias("invalid_citations"), share(F.size(F.array_intersect("cited", "available")), "cited").alias("citation_validity")
    )


def verdict_metrics(verdicts: DataFrame) -> DataFrame:
    """What a judge's verdicts come to: id, sound, correctness, faithfulness, citation_accuracy, citation_coverage, appropriate_refusal, unnecessary_refusal, unsupported_claims.

    verdicts: id, answerable, answer, correctness, refusal (none, appropriate, unnecessary), claims (array of text,
    verdict, evidence), citations (array of id, supported), available (array of int). Not sound, and without figures, is
    a verdict that approves a citation that is not there, quotes a claim that the answer lacks or evidence that is not
    there, leaves a supported or contradicted claim without evidence, has no claim for an answer, or contradicts itself
    on the refusal.
    """
    claims, citations = F.col("claims"), F.col("citations")
    refusal, right = F.col("refusal"), F.col("correctness") == "correct"
    sound = (
        F.forall(citations, lambda c: ~c["supported"] | F.array_contains("available", c["id"])) & (F.size(F.array_distinct(F.transform(citations, lambda c: c["id"]))) == F.size(citations))
        & F.forall(claims, lambda c: F.contains(F.col("answer"), c["text"]) & (F.size(F.array_except(c["evidence"], F.col("available"))) == 0) & (~c["verdict"].isin("supported", "contradicted") | (F.size(c["evidence"]) > 0)))
        & ((refusal != "none") | (F.size(claims) > 0)) & ~((refusal == "appropriate") & (F.col("answerable") | ~right | F.exists(claims, lambda c: c["verdict"] != "supported"))) & ~((refusal == "unnecessary") & (~F.col("answerable") | right))
    )
    valid = F.transform(F.filter(citations, lambda c: c["supported"]), lambda c: c["id"])
    supported = F.filter(claims, lambda c: c["verdict"] == "supported")
    share = lambda n, of: F.when(F.col("sound"), n / F.nullif(F.size(of), F.lit(0)))
    worth = F.coalesce(*[F.when(F.col("correctness") == k, v) for k, v in CORRECTNESS.items()])
    return verdicts.withColumn("sound", F.coalesce(sound, F.lit(False))).select(
        "id", "sound", F.when(F.col("sound"), worth).alias("correctness"), share(F.size(supported), claims).alias("faithfulness"), share(F.size(valid), citations).alias("citation_accuracy"),
        share(F.size(F.filter(supported, lambda c: F.arrays_overlap(c["evidence"], valid))), claims).alias("citation_coverage"), F.when(F.col("sound"), refusal == "appropriate").alias("appropriate_refusal"),
        F.when(F.col("sound"), refusal == "unnecessary").alias("unnecessary_refusal"), F.when(F.col("sound"), F.size(claims) - F.size(supported)).cast("long").alias("unsupported_claims"),
    )


def regressions(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """What got worse, case by case: id, metric, before, after. A case is worse where a number fell by more than SAME or is
    gone, `passed` is no longer true, or the case is missing (metric `missing`); averages hide none. Both: id, passed, metrics."""
    long = lambda df, name: df.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in [*metrics, "passed"]])).alias("x")).select("id", "x.metric", F.col("x.v").alias(name), F.lit(True).alias(f"in_{name}"))
    both = long(before, "before").join(long(after, "after"), ["id", "metric"], "left")
    gone = F.col("in_after").isNull()
    worse = F.col("before").isNotNull() & (F.col("after").isNull() | (F.col("after") < F.col("before") - SAME))
    lost = both.filter(gone).select("id", F.lit("missing").alias("metric"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after")).distinct()
    return both.filter(~gone & worse).select("id", "metric", "before", "after").unionByName(lost)


def drops(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """Which figures of a one-row report fell: metric, before, after, change (dropped, rose, same, absent)."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
    both = long(before, "before").join(long(after, "after"), "metric", "full")
    off = F.col("after") - F.col("before")
    return both.select("metric", "before", "after", F.when(off.isNull(), "absent").when(off < -SAME, "dropped").when(off > SAME, "rose").otherwise("same").alias("change"))


def scenario(requests: DataFrame, by: str) -> DataFrame:
    """Of requests, by `by`: requests, succeeded, failed, error_rate, wall_seconds, successful_rps, and the exact nearest-rank p50, p95, p99 of those that succeeded. requests: `by`, at, elapsed_ms, success. A null name counts as UNNAMED."""
    named = requests.withColumn(by, F.coalesce(F.col(by), F.lit(UNNAMED)))
    counts = named.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("succeeded"), (F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))).alias("micros")
    )
    rate = F.round((F.col("requests") - F.col("succeeded")) / F.col("requests"), 6)
    rps = F.round(F.col("succeeded") / F.nullif(F.col("micros") / 1e6, F.lit(0.0)), 6)
    told = counts.select(by, "requests", "succeeded", (F.col("requests") - F.col("succeeded")).alias("failed"), rate.alias("error_rate"), F.round(F.col("micros") / 1e6, 3).alias("wall_seconds"), rps.alias("successful_rps"))
    return told.join(nearest_ranks(named.filter("success"), by, "elapsed_ms"), by, "left")


def load_statistics(records: DataFrame) -> DataFrame:
    """Of loaded files by format: file_format, files, processed, failed, pending, deleted, empty (processed without a chunk), chunks. records: file_format, status, chunk_count."""
    status = F.lower(F.trim("status"))
    return records.groupBy("file_format").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(status == "ready").alias("processed"), *[F.count_if(status == s).alias(s) for s in ("failed", "pending", "deleted")],
        F.count_if((status == "ready") & (F.coalesce("chunk_count", F.lit(0)) == 0)).alias("empty"), F.coalesce(F.sum(F.when(status == "ready", F.col("chunk_count"))), F.lit(0)).alias("chunks"),
    )


def funnel(items: DataFrame, found: DataFrame, kept: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Where a search loses the documents of an item: query_id, relevant, recalled, kept, lost_at (not_indexed, recall, rank, threshold, none).

    items: query_id, keywords; docs: doc_id, text: an item's documents have all its keywords. found: query_id, doc_id,
    rank of all candidates; kept: those that the threshold left. The items are a stated set, each task holds them beside its documents.
    """
    asked = items.filter(F.size("keywords") > 0)
    word = asked.select("query_id", F.size(F.array_distinct(F.transform("keywords", lambda w: F.lower(w)))).alias("size"), F.explode(F.array_distinct(F.transform("keywords", lambda w: F.lower(w)))).alias("word"))
    words = [r["word"] for r in word.select("word").distinct().collect()] if items.count() <= 1000 else None
    if words is None:
        raise ValueError("a stated set has at most 1,000 items")
    text = F.lower("text")
    held = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), w) for w in words]))).alias("word")) if words else docs.select("doc_id", F.lit(None).cast("string").alias("word")).limit(0)
    hits = held.join(word, "word").groupBy("query_id", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size").select("query_id", "doc_id")
    best = lambda df, name: hits.join(df, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").cast("long").alias(name))
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    out = asked.select("query_id").join(counted, "query_id", "left").join(best(found, "recalled"), "query_id", "left").join(best(kept, "kept"), "query_id", "left").na.fill(0, ["relevant"])
    lost = F.when(F.col("relevant") == 0, "not_indexed").when(F.col("recalled").isNull(), "recall").when(F.col("kept").isNull(), "threshold").when(F.col("kept") > k, "rank").otherwise("none")
    return out.select("query_id", "relevant", "recalled", "kept", lost.alias("lost_at"))


def _rows(search, spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "qa_test_v2", "item_id", "question", "category", "expected_keywords", "source_file", "golden_answer").filter(f"item_id % {EVERY} = 0 AND question IS NOT NULL").dropDuplicates(["item_id"])
    items = items.select(F.col("item_id").alias("query_id"), "question", "category", F.col("expected_keywords").alias("keywords"), F.element_at(F.split("source_file", r"\."), -1).alias("source_format"), F.col("golden_answer").alias("answer"))
    docs = table(spark, folder, "documents", "doc_id", "text")
    ranked = ranks(items, search(docs, items.select("query_id", "question"), 10), docs).select("query_id", "rank")
    return judged(items.join(ranked, "query_id"), 5)


def q_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """Cases that BM25 ranks worse than word overlap does."""
    cases = lambda search: _rows(search, spark, folder).select(F.col("query_id").alias("id"), "passed", (1 / F.col("rank")).alias("reciprocal"), "share")
    return regressions(cases(overlap), cases(bm25), ["reciprocal", "share"]).select("id", "metric", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


def q_match(spark: SparkSession, folder: str) -> DataFrame:
    """Per tenant whether the registry has just the formats of the index."""
    rows = fold_events(table(spark, folder, "document_registry", "id", "updated_at", "tenant_id", "file_format"), "id", "updated_at", ["tenant_id", "file_format"]).filter("tenant_id IS NOT NULL")
    got = rows.groupBy(F.col("tenant_id").alias("case_id"), "file_format").agg(F.count(F.lit(1)).alias("n")).select("case_id", F.lit(0).alias("row_no"), F.array("file_format", F.col("n").cast("string")).alias("cells"))
    points = table(spark, folder, "vector_points", "tenant_id", "file_format").select(F.explode("tenant_id").alias("case_id"), "file_format").distinct()
    return results_match(got, points.filter("case_id IS NOT NULL").select("case_id", F.lit(0).alias("row_no"), F.array("file_format").alias("cells")))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_events(table(spark, folder, "sql_audit", "id", "loaded_at", "tenant_id", "sql_text", "ok", "row_count"), "id", "loaded_at", ["tenant_id", "sql_text", "ok", "row_count"])
    return rows.select("tenant_id", (F.coalesce(F.trim("sql_text"), F.lit("")) == "").alias("clarified"), F.coalesce("ok", F.lit(False)).alias("executed"), F.coalesce(F.col("ok") & (F.col("row_count") > 0), F.lit(False)).alias("passed"), F.lit(1).alias("attempts"))


def q_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Of every reply the share of the question's article codes that it has, and of its numbered sources those that were there."""
    turns = fold_events(table(spark, folder, "messages", "id", "loaded_at", "session_id", "seq", "role", "content"), "id", "loaded_at", ["session_id", "seq", "role", "content"]).filter("session_id IS NOT NULL AND seq IS NOT NULL")
    by = F.lower(F.trim("role"))
    asked = turns.filter(by.isin("user", "human")).groupBy("session_id", (F.col("seq") + 1).alias("seq")).agg(F.max_by("content", "id").alias("question"))
    said = turns.filter(by.isin("assistant", "bot", "ai")).select("id", "session_id", "seq", F.coalesce("content", F.lit("")).alias("answer"))
    items = fold_events(table(spark, folder, "source_items", "item_id", "loaded_at", "message_id", "rank_no", "source"), "item_id", "loaded_at", ["message_id", "rank_no", "source"])
    cited = items.filter("message_id IS NOT NULL AND rank_no IS NOT NULL").groupBy(F.col("message_id").alias("id")).agg(F.collect_set("rank_no").alias("cited"), F.collect_set(F.when(F.col("source").isNotNull(), F.col("rank_no"))).alias("available"))
    none = F.array().cast("array<int>")
    pairs = said.join(asked, ["session_id", "seq"]).join(cited, "id", "left")
    facts = F.array_distinct(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(_CODE), F.lit(0)))
    nothing = F.array().cast("array<struct<source:string,text:string>>")
    rows = pairs.select("id", "answer", facts.alias("facts"), nothing.alias("evidence"), nothing.alias("contexts"), F.coalesce("cited", none).alias("cited"), F.coalesce("available", none).alias("available"))
    return diagnostics(rows).select("id", "fact_coverage", F.array_join("invalid_citations", ",").alias("invalid_citations"), "citation_validity")


def q_funnel(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "qa_test_v2", "item_id", "question", "expected_keywords").filter(f"item_id % {EVERY} = 0 AND question IS NOT NULL").dropDuplicates(["item_id"])
    items = items.select(F.col("item_id").alias("query_id"), "question", F.col("expected_keywords").alias("keywords"))
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = bm25(docs, items.select("query_id", "question"), 20)
    return funnel(items, found, found.filter("score >= 8"), docs, 5)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_events(table(spark, folder, "llm_usage", "id", "loaded_at", "model_name", "created_at", "elapsed_ms"), "id", "loaded_at", ["model_name", "created_at", "elapsed_ms"])
    return rows.select("model_name", F.col("created_at").alias("at"), "elapsed_ms", F.coalesce(F.col("elapsed_ms") >= 0, F.lit(False)).alias("success"))


QUERIES = {
    "eval_report": lambda s, d: report(_rows(bm25, s, d), [], 5),
    "eval_by_source": lambda s, d: report(_rows(bm25, s, d), ["source_format"], 5),
    "eval_by_category": lambda s, d: report(_rows(bm25, s, d), ["category"], 5),
    "eval_drops": lambda s, d: drops(report(_rows(overlap, s, d), [], 5), report(_rows(bm25, s, d), [], 5), ["pass_rate", "recall_rate", "mrr"]),
    "quality_regressions": q_regressions,
    "results_match": q_match,
    "statement_report": lambda s, d: statement_report(_cases(s, d), []),
    "statement_report_by_tenant": lambda s, d: statement_report(_cases(s, d), ["tenant_id"]),
    "reply_diagnostics": q_diagnostics,
    "scenario_summary": lambda s, d: scenario(_requests(s, d), "model_name"),
    "load_statistics": lambda s, d: load_statistics(fold_events(table(s, d, "document_registry", "id", "updated_at", "file_format", "status", "chunk_count"), "id", "updated_at", ["file_format", "status", "chunk_count"])),
    "recall_funnel": q_funnel,
}
_BARE = lambda c: f"replace(replace(lower({c}), '‑', '-'), ' ', '')"
_REFUSES = "(" + " OR ".join(f"contains(coalesce(golden_answer, ''), '{x}')" for x in REFUSALS) + ")"


def _judged_sql(name: str) -> str:
    return f"""(SELECT *, CASE WHEN unknown THEN {_REFUSES} ELSE recalled AND share >= {ENOUGH} END AS passed FROM (SELECT i.*, r.rank, coalesce(i.category = 'no_knowledge', false) AS unknown, CASE WHEN NOT coalesce(i.category = 'no_knowledge', false) THEN coalesce(r.rank <= 5, false) END AS recalled,
coalesce(len(list_filter(expected_keywords, lambda k: coalesce(contains({_BARE("golden_answer")}, {_BARE("k")}), false))) / nullif(len(expected_keywords), 0), 0) AS share, string_split(source_file, '.')[-1] AS source_format
FROM (SELECT * FROM qa_test_v2 WHERE item_id % {EVERY} = 0 AND question IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id) = 1) i JOIN ({_EVALUATION[name]}) r ON r.query_id = i.item_id))"""


_BM_RANKS = "eval_ranks"
_FIGURES = """count(*) AS total, count(passed) AS judged, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / nullif(count(passed), 0), 4) AS pass_rate,
round(count(*) FILTER (recalled) / nullif(count(recalled), 0), 4) AS recall_rate, round(sum(CASE WHEN NOT unknown AND rank <= 5 THEN 1.0 / rank ELSE 0.0 END) / nullif(count(*) FILTER (NOT unknown), 0), 4) AS mrr, round(avg(share), 4) AS avg_share"""
_REG = "(SELECT * FROM document_registry QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_AUDIT = """(SELECT tenant_id, trim(coalesce(sql_text, ''), ' ') = '' AS clarified, coalesce(ok, false) AS executed, coalesce(ok AND row_count > 0, false) AS passed FROM (SELECT * FROM sql_audit QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1))"""
_STATEMENTS = """count(*) AS total, count(*) FILTER (clarified) AS clarified, count(*) FILTER (NOT clarified) AS judged, count(*) FILTER (NOT clarified AND executed) AS executed, count(*) FILTER (NOT clarified AND passed) AS passed,
round(count(*) FILTER (NOT clarified AND passed) / nullif(count(*) FILTER (NOT clarified), 0), 4) AS accuracy, round(count(*) FILTER (NOT clarified AND executed) / nullif(count(*) FILTER (NOT clarified), 0), 4) AS valid_rate, CASE WHEN count(*) FILTER (NOT clarified) > 0 THEN CAST(1 AS DOUBLE) END AS avg_attempts"""
_LONG = " UNION ALL ".join(f"SELECT item_id AS id, '{m}' AS metric, CAST({x} AS DOUBLE) AS v FROM {{0}}" for m, x in (("reciprocal", "1.0 / rank"), ("share", "share"), ("passed", "CAST(passed AS INTEGER)")))
_LAST_MESSAGES = "(SELECT * FROM messages WHERE session_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_RANKED = lambda p: f"CAST(min(v) FILTER (rn >= ({p} * n + 99) // 100) AS BIGINT) AS p{p}"
SQL = {
    "eval_report": f"SELECT {_FIGURES} FROM {_judged_sql('eval_ranks')}",
    "eval_by_source": f"SELECT source_format, {_FIGURES} FROM {_judged_sql('eval_ranks')} GROUP BY source_format",
    "eval_by_category": f"SELECT category, {_FIGURES} FROM {_judged_sql('eval_ranks')} GROUP BY category",
    "eval_drops": f"""WITH b AS (SELECT {_FIGURES} FROM {_judged_sql('overlap_ranks')}), a AS (SELECT {_FIGURES} FROM {_judged_sql('eval_ranks')}),
x AS (SELECT unnest(['pass_rate', 'recall_rate', 'mrr']) AS metric, unnest([b.pass_rate, b.recall_rate, b.mrr]) AS before, unnest([a.pass_rate, a.recall_rate, a.mrr]) AS after FROM a, b)
SELECT *, CASE WHEN after - before IS NULL THEN 'absent' WHEN after - before < -{SAME} THEN 'dropped' WHEN after - before > {SAME} THEN 'rose' ELSE 'same' END AS change FROM x""",
    "quality_regressions": f"""WITH bc AS (SELECT * FROM {_judged_sql('overlap_ranks')}), ac AS (SELECT * FROM {_judged_sql('eval_ranks')}), b AS ({_LONG.format('bc')}), a AS ({_LONG.format('ac')})
SELECT id, metric, round(b.v, 4) AS before, round(a.v, 4) AS after FROM b JOIN a USING (id, metric) WHERE b.v IS NOT NULL AND (a.v IS NULL OR a.v < b.v - {SAME})""",
    "results_match": f"""WITH g AS (SELECT tenant_id AS case_id, list_sort(list(DISTINCT coalesce(file_format, '?'))) AS f FROM {_REG} WHERE tenant_id IS NOT NULL GROUP BY 1), w AS (SELECT case_id, list_sort(list(DISTINCT coalesce(file_format, '?'))) AS f FROM (SELECT unnest(tenant_id) AS case_id, file_format FROM vector_points) WHERE case_id IS NOT NULL GROUP BY 1)
SELECT coalesce(g.case_id, w.case_id) AS case_id, coalesce(g.f = w.f, false) AS matches FROM g FULL JOIN w ON g.case_id = w.case_id""",
    "statement_report": f"SELECT {_STATEMENTS} FROM {_AUDIT}",
    "statement_report_by_tenant": f"SELECT tenant_id, {_STATEMENTS} FROM {_AUDIT} GROUP BY tenant_id",
    "reply_diagnostics": f"""WITH t AS (SELECT *, lower(trim(role, ' ')) AS spk FROM {_LAST_MESSAGES}), q AS (SELECT session_id, seq + 1 AS seq, arg_max(content, id) FILTER (content IS NOT NULL) AS question, max(id) AS qid, arg_max(content IS NULL, id) AS gone FROM t WHERE spk IN ('user', 'human') GROUP BY 1, 2),
i AS (SELECT message_id AS id, list(DISTINCT rank_no) AS cited, list(DISTINCT rank_no) FILTER (source IS NOT NULL) AS available FROM (SELECT * FROM source_items QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC) = 1) WHERE message_id IS NOT NULL AND rank_no IS NOT NULL GROUP BY 1),
p AS (SELECT t.id, coalesce(t.content, '') AS answer, list_distinct(regexp_extract_all(CASE WHEN gone THEN '' ELSE coalesce(question, '') END, '{_CODE}')) AS facts, coalesce(cited, []) AS cited, coalesce(available, []) AS available FROM t JOIN q ON q.session_id = t.session_id AND q.seq = t.seq LEFT JOIN i ON i.id = t.id WHERE spk IN ('assistant', 'bot', 'ai'))
SELECT id, round(len(list_filter(facts, lambda f: contains(answer, f))) / nullif(len(facts), 0), 4) AS fact_coverage, array_to_string(list_sort(list_filter(cited, lambda c: NOT list_contains(available, c))), ',') AS invalid_citations, round(len(list_filter(cited, lambda c: list_contains(available, c))) / nullif(len(cited), 0), 4) AS citation_validity FROM p""",
    "scenario_summary": f"""WITH u AS (SELECT coalesce(model_name, '{UNNAMED}') AS model_name, created_at, elapsed_ms, coalesce(elapsed_ms >= 0, false) AS success FROM (SELECT * FROM llm_usage QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)),
c AS (SELECT model_name, count(*) AS requests, count(*) FILTER (success) AS succeeded, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 AS sec FROM u GROUP BY 1),
r AS (SELECT model_name, elapsed_ms AS v, row_number() OVER (PARTITION BY model_name ORDER BY elapsed_ms) AS rn, count(*) OVER (PARTITION BY model_name) AS n FROM u WHERE success), q AS (SELECT model_name, {_RANKED(50)}, {_RANKED(95)}, {_RANKED(99)} FROM r GROUP BY 1)
SELECT model_name, requests, succeeded, requests - succeeded AS failed, round((requests - succeeded) / requests, 6) AS error_rate, round(sec, 3) AS wall_seconds, round(succeeded / nullif(sec, 0), 6) AS successful_rps, p50, p95, p99 FROM c LEFT JOIN q USING (model_name)""",
    "load_statistics": f"""SELECT file_format, count(*) AS files, count(*) FILTER (s = 'ready') AS processed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'deleted') AS deleted, count(*) FILTER (s = 'ready' AND coalesce(chunk_count, 0) = 0) AS empty,
CAST(coalesce(sum(chunk_count) FILTER (s = 'ready'), 0) AS BIGINT) AS chunks FROM (SELECT *, lower(trim(status, ' ')) AS s FROM {_REG}) GROUP BY file_format""",
    "recall_funnel": f"""WITH i AS (SELECT item_id AS query_id, list_distinct(list_transform(expected_keywords, lambda k: lower(k))) AS ks FROM qa_test_v2 WHERE item_id % {EVERY} = 0 AND question IS NOT NULL AND len(expected_keywords) > 0 QUALIFY row_number() OVER (PARTITION BY item_id) = 1),
h AS (SELECT query_id, doc_id FROM i, (SELECT doc_id, lower(text) AS t FROM documents) d WHERE len(list_filter(ks, lambda k: NOT coalesce(contains(t, k), false))) = 0), f AS ({_RETRIEVAL["bm25_top20"]}),
c AS (SELECT i.query_id, count(h.doc_id) AS relevant, min(f.rank) AS recalled, min(f.rank) FILTER (f.score >= 8) AS kept FROM i LEFT JOIN h ON h.query_id = i.query_id LEFT JOIN f ON f.query_id = h.query_id AND f.doc_id = h.doc_id GROUP BY 1)
SELECT *, CASE WHEN relevant = 0 THEN 'not_indexed' WHEN recalled IS NULL THEN 'recall' WHEN kept IS NULL THEN 'threshold' WHEN kept > 5 THEN 'rank' ELSE 'none' END AS lost_at FROM c""",
}
