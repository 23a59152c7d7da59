"""p6: texts placed in containers of fixed capacity by vector best-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published word pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that one task packs together; each loses less than a container at its edge, some thousandths of what it fills.
ITEMS = 4096
#: Weights of the squared residuals: tokens, documents, attention cost (each as a share of its capacity).
WEIGHTS = (1.0, 0.05, 0.1)


class Limits(NamedTuple):
    """What a container may hold beside its tokens, as shares that go with its capacity.

    Documents: `docs_per_token` times the capacity, at least one, so that texts are `1 / docs_per_token` tokens long on
    average where many short ones meet. Attention cost, the sum of squared sizes: `cost_share` of the capacity squared,
    which is what one text as long as the container would cost; so containers cost less than half as much as they could.
    A text that alone comes near that is placed all the same: its container may cost `cost_slack` of the capacity
    squared more than the text itself, for short texts beside it.
    """

    docs_per_token: float = 1 / 32
    cost_share: float = 0.5
    cost_slack: float = 0.1

    def docs(self, capacity: int) -> int:
        return max(1, int(capacity * self.docs_per_token))

    def cost(self, capacity: int, longest: float) -> float:
        """The cost that a container may have whose longest text has so many tokens."""
        return max(self.cost_share * capacity**2, longest**2 + self.cost_slack * capacity**2)


LIMITS = Limits()


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """`key` and tokens (int), the number of tokens of `text` in the vocabulary at `tokenizer`. Whole texts; null texts and keys have no row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "tokens": [len(coder.encode_ordinary(x)) for x in batch["text"]]})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, tokens int"
    return rows.mapInPandas(count, schema).withColumnRenamed("key", key)


def best_fit(sizes: np.ndarray, capacity: int, limits: Limits = LIMITS, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container of each size, all at most `capacity`: largest first, each into the container where it fits under
    every constraint and leaves the smallest weighted norm of residual tokens, documents and cost (the sum of squared
    sizes, as attention within documents costs); a new one where none fits."""
    left, place, used = np.zeros((len(sizes) + 1, 3)), np.zeros(len(sizes), np.int64), 0
    scale = np.sqrt(np.array(weights)) / np.array([capacity, limits.docs(capacity), limits.cost(capacity, 0)], float)
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1, float(sizes[i]) ** 2])
        after = left[:used] - need
        fits = np.flatnonzero(after.min(axis=1) >= 0) if used else ()
        if len(fits):
            norm = ((after[fits] * scale) ** 2).sum(axis=1)
            best = fits[norm.argmin()]
        else:
            best, used = used, used + 1
            left[best] = capacity, limits.docs(capacity), limits.cost(capacity, float(sizes[i]))
        left[best] -= need
        place[i] = best
    return place


def pack(sizes: DataFrame, containers: dict[str, int], items: int = ITEMS, weights: tuple[float, float, float] = WEIGHTS, rows: int | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Every text once in a container of each capacity: container, bin_id, doc_id, piece, first_token, tokens, capacity.

    sizes: doc_id, tokens; containers: capacity by name (the specification, a handful of rows). A text longer than the
    capacity is cut: full containers of its own, and the rest as an item like any other; other texts stay whole.
    Repeated rows of a doc_id are one text (the longest counts), those with a null doc_id none; a null number of tokens
    counts as 0; empty texts take a place but no tokens. Other columns are ignored; no rows give no rows.

    Texts are spread by the hash of their id over groups of about `items`, packed apart; the number of groups grows with
    the table, never their size (`rows` tells how many texts there are, where that is known without reading sizes). No
    container holds more tokens than its capacity, nor more documents or attention cost than `limits` allow.
    """
    texts = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).filter(F.col("doc_id").isNotNull())
    groups = max(1, -(-(texts.count() if rows is None else rows) // items))
    spec = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(containers.items()) if c and c > 0])
    placed: Column = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("part")
    spread = texts.select("doc_id", "tokens", placed, F.explode(spec).alias("x")).select("doc_id", "tokens", "part", "x.container", "x.capacity")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        name, capacity, part = group["container"].iat[0], int(group["capacity"].iat[0]), group["part"].iat[0]
        group = group.sort_values(["tokens", "doc_id"], ascending=[False, True]).drop_duplicates("doc_id")
        ids, sizes = group["doc_id"].to_numpy(), group["tokens"].to_numpy()
        whole = np.where(sizes > capacity, sizes // capacity, 0)  # full containers of an oversize text
        rest = sizes - whole * capacity
        kept = (whole == 0) | (rest > 0)
        bins = best_fit(rest[kept], capacity, limits, weights)
        tail = pd.DataFrame({"doc_id": ids[kept], "piece": whole[kept] + 1, "tokens": rest[kept], "bin": bins})
        own = np.repeat(np.arange(len(ids)), whole)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(whole) - whole, whole)
        full = pd.DataFrame({"doc_id": ids[own], "piece": nth + 1, "tokens": capacity, "bin": np.arange(len(own)) + bins.max(initial=-1) + 1})
        out = pd.concat([tail, full], ignore_index=True)
        return pd.DataFrame(
            {"container": name, "bin_id": [f"{part}-{b}" for b in out["bin"]], "doc_id": out["doc_id"], "piece": out["piece"], "first_token": (out["piece"] - 1) * capacity, "tokens": out["tokens"], "capacity": capacity}
        )

    schema = f"container string, bin_id string, doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece int, first_token long, tokens long, capacity long"
    return spread.groupBy("container", "capacity", "part").applyInPandas(one, schema)


def bins_of(placements: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Per container what it holds: container, bin_id, capacity, docs, tokens, cost, unused, closed_by.

    closed_by is the constraint (tokens, documents, cost) of which least is left, as a share of what it allows; of equal
    ones the first in this order.
    """
    held = placements.groupBy("container", "bin_id", "capacity").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("tokens")).alias("cost"), F.max("tokens").alias("longest")
    )
    most_docs, most_cost = _allowed(limits)
    left = lambda has, most: 1 - F.col(has) / most
    tokens, docs, cost = left("tokens", F.col("capacity")), left("docs", most_docs), left("cost", most_cost)
    closed = F.when((tokens <= docs) & (tokens <= cost), "tokens").when(docs <= cost, "documents").otherwise("cost")
    return held.select("container", "bin_id", "capacity", "docs", "tokens", "cost", (F.col("capacity") - F.col("tokens")).alias("unused"), closed.alias("closed_by"))


def _allowed(limits: Limits, longest: str = "longest") -> tuple[Column, Column]:
    """How many documents and what cost a container of `capacity` may have."""
    square = F.col("capacity").cast("double") * F.col("capacity")
    return F.greatest(F.lit(1), F.floor(F.col("capacity") * limits.docs_per_token)), F.greatest(square * limits.cost_share, F.col(longest).cast("double") * F.col(longest) + square * limits.cost_slack)


def unused_space(placements: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Per kind of container: container, capacity, bins, pieces, tokens, unused, unused_share, by_tokens, by_documents, by_cost
    (containers closed by each constraint), fewest (no packing under all constraints has fewer containers).

    fewest is the greatest of three bounds: the tokens over the capacity, the pieces over the documents allowed, and for
    the cost the long pieces, no two of which share a container, and containers for what cost of the others they leave.
    """
    each = bins_of(placements, limits).groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("unused").alias("unused"), *[F.count_if(F.col("closed_by") == c).alias(f"by_{c}") for c in ("tokens", "documents", "cost")]
    )
    square = F.col("capacity").cast("double") * F.col("capacity")
    own = F.col("tokens").cast("double") * F.col("tokens")
    # Two pieces above this cost more than the container of either allows.
    edge = max(limits.cost_share / 2, limits.cost_slack)
    long = own > square * edge
    beside = F.greatest(square * limits.cost_share - own, square * limits.cost_slack)
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    sums = placements.groupBy(F.col("container").alias("c"), F.col("capacity").alias("k")).agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(long).alias("long"), (total(~long, own) - total(long, beside)).alias("over")
    )
    both = each.join(sums, (F.col("container") == F.col("c")) & (F.col("capacity") == F.col("k")))
    most_docs, _ = _allowed(limits, "long")
    rest = F.ceil(F.col("over") / (square * max(limits.cost_share, edge + limits.cost_slack)))
    fewest = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.ceil(F.col("pieces") / most_docs), F.col("long") + F.greatest(rest, F.lit(0)))
    share = F.round(F.col("unused") / (F.col("unused") + F.col("tokens")), 6)
    return both.select("container", "capacity", "bins", "pieces", "tokens", "unused", share.alias("unused_share"), "by_tokens", "by_documents", "by_cost", fewest.cast("long").alias("fewest"))


def _specification(spark: SparkSession, folder: str, most: int = 1000) -> dict[str, int]:
    rows = table(spark, folder, "container_spec", "container", "capacity_tokens").filter("container IS NOT NULL AND capacity_tokens > 0").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of containers")
    return {r["container"]: r["capacity_tokens"] for r in rows}


def p6_placements(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return pack(count_tokens(docs, "doc_id", "text"), _specification(spark, folder), rows=table(spark, folder, "documents", "doc_id").count())


def p6_bins(spark: SparkSession, folder: str) -> DataFrame:
    return bins_of(p6_placements(spark, folder))


def p6_unused(spark: SparkSession, folder: str) -> DataFrame:
    return unused_space(p6_placements(spark, folder))


SQL: dict[str, str] = {}
QUERIES = {"p6_placements": p6_placements, "p6_bins": p6_bins, "p6_unused": p6_unused}
