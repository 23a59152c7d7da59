"""p7: evaluation texts inside the documents of a corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.llm.shingles import shingle_hashes
from kbspark.session import cut
from kbspark.sources.tables import table

#: Consecutive tokens in a shingle, tokens an item must have, and the share of them that must lie in common runs.
WIDTH, LEAST_TOKENS, SHARE = 10, 30, 0.5
#: Chance that the weakest case of a size class is no candidate, and how many of its shingles its sketch keeps on average.
MISS, KEPT = 1e-4, 16
#: Hashes of a sketch of all items that are sent to every task (8 bytes each); beyond it documents meet them by a join.
SENT = 4_000_000
#: Candidate documents up to which their ids are sent to every task (8 bytes each); beyond it they meet by a join.
SENT_IDS = 1_000_000
#: Characters whose shingles a task holds at once, but for a longer text.
CHARS = 4_000_000
_SALTS = 16


class SizeClass(NamedTuple):
    """How items of `low` to 2 * low - 1 tokens are sketched.

    A case shares at least `fewest` shingles with the document, as its tokens lie in runs of WIDTH or more. The sketch
    of an item keeps the shingles whose hash is below `rate`, so that of the weakest case KEPT are left on average; a
    document can hold the item only if it has `need` of those, but for a chance of MISS. Where the weakest case has no
    more than KEPT shingles no smaller sketch finds all cases: it keeps all, and `need` is certain.
    """

    low: int
    fewest: int
    rate: float
    need: int


def size_class(tokens: int, share: float = SHARE) -> SizeClass:
    low = LEAST_TOKENS << max(0, int(math.log2(max(tokens, LEAST_TOKENS) / LEAST_TOKENS)))
    fewest = max(1, math.ceil(math.ceil(low * share) / WIDTH))
    rate = min(1.0, KEPT / fewest)
    need, missed = 0, 0.0
    while need < fewest:
        missed += math.comb(fewest, need) * rate**need * (1 - rate) ** (fewest - need) if rate < 1 else 0.0
        if missed > MISS:
            break
        need += 1
    return SizeClass(low, fewest, rate, max(1, need))


def _portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch, at most CHARS characters at once."""
    ends = batch["text"].str.len().cumsum() // CHARS
    for _, part in batch.groupby(ends.to_numpy(), sort=False):
        yield part


def _places(owner: np.ndarray) -> np.ndarray:
    """The place of each shingle in its text."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")


def item_shingles(items: DataFrame, share: float = SHARE) -> DataFrame:
    """The shingles of all items with enough tokens: item_id, tokens, need, at (place in the item), hash, kept (in the sketch). items: item_id, text."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _portions(batch):
                hashes, owner = shingle_hashes(part["text"].tolist(), WIDTH)
                tokens = np.bincount(owner, minlength=len(part)) + WIDTH - 1
                classes = [size_class(int(n), share) for n in tokens]
                rate, need = np.array([c.rate for c in classes]), np.array([c.need for c in classes])
                # An item that repeats itself keeps all, as its shingles are not drawn one by one.
                different = np.bincount(np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64), minlength=len(part))
                rate = np.where(different + WIDTH - 1 < 0.9 * tokens, 1.0, rate)
                kept = hashes.astype(np.float64) < rate[owner] * 2.0**64
                own = pd.DataFrame({"item_id": part["item_id"].to_numpy()[owner], "tokens": tokens[owner], "need": need[owner], "at": _places(owner), "hash": hashes.view(np.int64), "kept": kept | (rate[owner] == 1)})
                yield own[tokens[owner] >= LEAST_TOKENS]

    return items.mapInPandas(build, "item_id long, tokens int, need int, at int, hash long, kept boolean")


def document_shingles(docs: DataFrame, wanted: np.ndarray | None = None, below: float = 1.0) -> DataFrame:
    """The different shingles of each document: doc_id, hash; only those among `wanted` (sorted), or with a hash below that share."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        among = sent.value
        for batch in batches:
            for part in _portions(batch[batch["text"].str.len() >= WIDTH]):  # a Chinese character is a token
                hashes, owner = shingle_hashes(part["text"].tolist(), WIDTH)
                if among is not None:
                    on = among[np.minimum(np.searchsorted(among, hashes), len(among) - 1)] == hashes if len(among) else np.zeros(len(hashes), bool)
                else:
                    on = hashes.astype(np.float64) < below * 2.0**64 if below < 1 else np.ones(len(hashes), bool)
                found = pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[owner[on]], "hash": hashes[on].view(np.int64)})
                yield found.drop_duplicates()

    return docs.mapInPandas(build, "doc_id long, hash long")


def candidates(shingles: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of an item and a document whose sketches meet in as many places as the item needs: item_id, doc_id, met.

    shingles: what item_shingles gives; docs: doc_id, text. A pair is looked at where the document has one of the
    item's rarer shingles: as `need` of them must meet, the most frequent `need` - 1 tell nothing and are left out. So
    a stock sentence that every document has makes no pairs.
    """
    sketch = shingles.filter("kept").groupBy("item_id", "hash").agg(F.count(F.lit(1)).alias("places"), F.first("need").alias("need"))
    sketch = cut(sketch)
    hashes = sketch.select("hash").distinct()
    if hashes.count() <= SENT:
        wanted = hashes.toArrow()["hash"].to_numpy()
        met = document_shingles(docs, np.sort(wanted.astype(np.int64).view(np.uint64)))
    else:
        met = document_shingles(docs).join(hashes, "hash", "left_semi")
    met = cut(met)
    often = met.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"))
    order = W.partitionBy("item_id").orderBy(F.desc("docs"), "hash")
    rare = sketch.join(often, "hash").withColumn("upto", F.sum("places").over(order)).filter("upto >= need").select("item_id", "hash", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    pairs = met.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(rare, ["hash", "salt"]).select("item_id", "doc_id").distinct()
    held = pairs.join(met, "doc_id").join(sketch, ["item_id", "hash"])
    return held.groupBy("item_id", "doc_id").agg(F.sum("places").alias("met"), F.first("need").alias("need")).filter("met >= need").select("item_id", "doc_id", "met")


def coverage(shingles: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each pair the share of the item's tokens that lie in runs that the document has: item_id, doc_id, coverage. Exact, by all shingles of both."""
    pairs = cut(pairs.select("item_id", "doc_id"))
    ids = pairs.select("doc_id").distinct()
    near = docs.join(F.broadcast(ids) if pairs.count() <= SENT_IDS else ids, "doc_id", "left_semi")
    asked = shingles.join(pairs.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "tokens", "at", "hash")
    found = document_shingles(near).join(asked, "hash").join(pairs, ["item_id", "doc_id"])
    covered = found.select("item_id", "doc_id", "tokens", F.explode(F.sequence("at", F.col("at") + WIDTH - 1)).alias("place"))
    return covered.groupBy("item_id", "doc_id", "tokens").agg(F.count_distinct("place").alias("n")).select("item_id", "doc_id", (F.col("n") / F.col("tokens")).alias("coverage"))


def leaked_items(items: DataFrame, docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Every pair of an item and a document that holds at least `share` of it, with that share.

    items: item_id, text; docs: doc_id, text. Result: item_id, doc_id, coverage (double). Items of fewer than
    LEAST_TOKENS tokens, null texts and null ids have no pair; repeated item rows are one (the greatest text of an id counts),
    and so are repeated documents. Other columns are ignored; empty tables give an empty result.

    Candidates by size-partitioned MinHash (see SizeClass) are verified by the exact containment of their shingles.
    Items are sketched in tasks; up to SENT hashes of their sketches, counted first, go to the tasks that read the
    documents, where these lie and whole, so only shingles that some item has are shuffled. Beyond that documents and
    sketches meet by a join. A text is read in one piece.
    """
    texts = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text"))
    whole = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    shingles = cut(item_shingles(texts, share))
    return coverage(shingles, whole, candidates(shingles, whole)).filter(F.col("coverage") >= share)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "qa_test_v2", "item_id", "golden_answer").withColumnRenamed("golden_answer", "text")
    return leaked_items(items, table(spark, folder, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("item_id", "doc_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that leaked: in how many documents, and how much of them at most."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("coverage"), 6).alias("most"))


def _tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


_PAIRS = f"""
i AS (SELECT DISTINCT item_id, {_tokens_sql("golden_answer")} t FROM qa_test_v2 WHERE golden_answer IS NOT NULL),
i10 AS (SELECT item_id, len(t) n, p, array_to_string(t[p:p+{WIDTH - 1}], ' ') s FROM (SELECT item_id, t, unnest(range(1, len(t) - {WIDTH - 2})) p FROM i WHERE len(t) >= {LEAST_TOKENS})),
d AS (SELECT doc_id, {_tokens_sql("text")} t FROM documents),
d10 AS (SELECT DISTINCT doc_id, array_to_string(t[p:p+{WIDTH - 1}], ' ') s FROM (SELECT doc_id, t, unnest(range(1, len(t) - {WIDTH - 2})) p FROM d WHERE len(t) >= {WIDTH})),
c AS (SELECT item_id, doc_id, n, count(DISTINCT pos) covered FROM (SELECT item_id, doc_id, n, unnest(range(p, p + {WIDTH})) pos FROM i10 JOIN d10 USING (s)) GROUP BY ALL),
pairs AS (SELECT *, covered / n coverage FROM c WHERE covered >= {SHARE} * n)
"""
SQL = {
    "p7_found": f"WITH {_PAIRS} SELECT item_id, doc_id FROM pairs",
    "p7_items": f"WITH {_PAIRS} SELECT item_id, count(*) documents, round(max(coverage), 6) most FROM pairs GROUP BY item_id",
}
QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
