import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kbspark.llm.packing import LIMITS, Limits, best_fit, bins_of, count_tokens, pack, unused_space


def test_every_text_once_within_every_constraint(spark):
    draw = random.Random(2)
    sizes = {i: draw.choice([0, 1, 5, 60, 99, 100, 101, 250, 300, 999]) for i in range(700)}
    rows = [(i, n, "x") for i, n in sizes.items()] + [(5, sizes[5], "x"), (None, 7, "x"), (9000, None, "x")]
    sizes[9000] = 0
    df = spark.createDataFrame(rows, "doc_id long, tokens int, capacity string")
    found = pack(df, {"a": 100, "b": 300}, items=150).collect()
    for name, capacity in (("a", 100), ("b", 300)):
        own = [r for r in found if r["container"] == name]
        total, used, docs, cost, longest = Counter(), Counter(), Counter(), Counter(), Counter()
        pieces = defaultdict(list)
        for r in own:
            total[r["doc_id"]] += r["tokens"]
            used[r["bin_id"]] += r["tokens"]
            docs[r["bin_id"]] += 1
            cost[r["bin_id"]] += r["tokens"] ** 2
            longest[r["bin_id"]] = max(longest[r["bin_id"]], r["tokens"])
            pieces[r["doc_id"]].append(r)
        assert {k: total[k] for k in pieces} == sizes
        assert max(used.values()) <= capacity and max(docs.values()) <= LIMITS.docs(capacity)
        assert all(c <= LIMITS.cost(capacity, longest[b]) for b, c in cost.items())
        for i, ps in pieces.items():
            assert len(ps) == 1 or sizes[i] > capacity
            ps.sort(key=lambda r: r["piece"])
            assert [p["piece"] for p in ps] == list(range(1, len(ps) + 1))
            assert all(p["tokens"] == capacity for p in ps[:-1]) and [p["first_token"] for p in ps] == [k * capacity for k in range(len(ps))]
    assert pack(df.limit(0), {"a": 100}).count() == 0


def test_little_is_left_unused(spark):
    draw = random.Random(5)
    df = spark.createDataFrame([(i, int(draw.lognormvariate(5, 1)) + 1) for i in range(4000)], "doc_id long, tokens int")
    for r in unused_space(pack(df, {"small": 512, "large": 8192})).collect():
        assert r["unused_share"] < 0.03 and r["fewest"] <= r["bins"] <= 1.03 * r["fewest"] + 1
        assert r["by_tokens"] + r["by_documents"] + r["by_cost"] == r["bins"]


OPEN = Limits(docs_per_token=1.0, cost_share=1.0, cost_slack=0.0)
FORCED = [
    # sizes, limits, containers without that constraint, with it, by which constraint they close
    ([60, 60, 50], OPEN, 3, 3, "tokens"),
    ([5] * 12, Limits(docs_per_token=0.04, cost_share=1.0, cost_slack=0.0), 1, 3, "documents"),
    ([50, 50, 50, 50], Limits(docs_per_token=1.0, cost_share=0.4, cost_slack=0.0), 2, 4, "cost"),
]


@pytest.mark.parametrize(("sizes", "limits", "free", "forced", "by"), FORCED)
def test_each_constraint_alone_opens_containers(spark, sizes, limits, free, forced, by):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
    bins = bins_of(pack(df, {"c": 100}, limits=limits), limits).collect()
    assert len(bins) == forced and {r["closed_by"] for r in bins} == {by}
    assert bins_of(pack(df, {"c": 100}, limits=OPEN), OPEN).count() == free
    (r,) = unused_space(pack(df, {"c": 100}, limits=limits), limits).collect()
    assert r["bins"] == forced and r[f"by_{by}"] == forced and r["fewest"] <= forced


def test_long_texts_are_placed_beyond_the_cost_and_topped_up(spark):
    df = spark.createDataFrame([(1, 95), (2, 5), (3, 250)], "doc_id long, tokens int")
    bins = sorted((r["tokens"], r["docs"], r["cost"]) for r in bins_of(pack(df, {"c": 100})).collect())
    assert bins == [(50, 1, 2500), (100, 1, 10_000), (100, 1, 10_000), (100, 2, 9050)]


def test_best_fit_against_constraints():
    assert sorted(best_fit(np.array([6, 5, 5, 4]), 10, OPEN).tolist()) == [0, 0, 1, 1]
    assert len(set(best_fit(np.array([1, 1, 1, 1]), 10, Limits(0.2, 1.0, 0.0)).tolist())) == 2
    assert len(set(best_fit(np.array([5, 5]), 10, Limits(1.0, 0.3, 0.0)).tolist())) == 2
    assert best_fit(np.zeros(0, int), 10).tolist() == []


def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x"), (4, "中文 " * 20_000), (5, "<|endoftext|>")], "doc_id long, text string")
    found = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "doc_id", "text").collect()}
    assert found[1] == 2 and found[2] == 0 and 3 not in found and found[4] > 40_000 and found[5] > 1
