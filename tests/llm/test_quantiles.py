import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm.quantiles import ERROR, QUERIES, Sketch, merge_sketches, proven, read_percentiles, sketch_groups

LARGE = "/root/testdata/sf0.1"


def off(values, p, answer):
    values = np.sort(values)
    rank = math.ceil(p / 100 * len(values))
    low, high = np.searchsorted(values, answer) + 1, np.searchsorted(values, answer, "right")
    return max(low - rank, rank - high, 0) / (len(values) - rank + 1)


def test_error_of_merged_parts():
    coins = np.random.default_rng(0)
    for kind in ("lognormal", "ties", "sorted", "uniform"):
        x = {"lognormal": coins.lognormal(5, 2, 60_000), "ties": np.repeat([1.0, 2, 3, 900], 15_000), "sorted": np.arange(60_000.0), "uniform": coins.random(60_000)}[kind]
        cuts = np.sort(coins.integers(0, len(x), 30))
        parts = [Sketch.of(p, coins) for p in np.split(x, cuts)]
        merged = Sketch.merge([Sketch.from_bytes(p.to_bytes()) for p in parts if p.n], coins)
        assert merged.n == len(x) and len(merged.to_bytes()) < 40_000
        for p, answer in zip((10, 50, 90, 95, 99), merged.percentiles((10, 50, 90, 95, 99)), strict=True):
            assert off(x, p, answer) <= ERROR
        assert merged.percentiles((100,)) == [x.max()]


def test_groups_nulls_bad_values_and_small_groups(spark):
    rows = [("a", i % 7, 1) for i in range(100)] + [("a", None, 1), ("a", -1, 1), (None, 5, 1), ("b", 3, 1), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, v long, n int")
    found = {r["g"]: r for r in read_percentiles(sketch_groups(df, ["g"], "v"), ["g"]).collect()}
    assert set(found) == {"a", None, "b"}
    exact = sorted(i % 7 for i in range(100))
    assert found["a"]["n"] == 100 and [found["a"][f"p{p}"] for p in (50, 90, 95, 99)] == [exact[math.ceil(p) - 1] for p in (50, 90, 95, 99)]
    assert found[None]["p99"] == 5 and found["b"]["n"] == 1
    assert sketch_groups(df.limit(0), ["g"], "v").count() == 0


@pytest.fixture(scope="module")
def days(spark):
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.7 else f"g{draw.randrange(5)}", draw.randrange(8), int(draw.lognormvariate(6, 2))) for _ in range(40_000)]
    return rows, spark.createDataFrame(rows, "g string, day int, v long").repartition(6)


@pytest.mark.parametrize("seed", [0, 1, 2, 3, 4])
def test_days_merge_to_the_whole(days, seed):
    rows, df = days
    whole = merge_sketches(sketch_groups(df, ["g", "day"], "v", block=3000, seed=seed), ["g"], seed=seed + 9)
    found = {r["g"]: r for r in proven(df, read_percentiles(whole, ["g"]), ["g"], "v").collect()}
    assert len(found) == 6 and sum(r["n"] for r in found.values()) == len(rows)
    for g, r in found.items():
        own = np.sort([v for x, _, v in rows if x == g])
        assert r["within"] and r["n"] == len(own)
        for p in (50, 90, 95, 99):
            low, high = np.searchsorted(own, r[f"p{p}"]) + 1, np.searchsorted(own, r[f"p{p}"], "right")
            assert low <= r[f"rank{p}"] <= high and abs(r[f"error{p}"] - off(own, p, r[f"p{p}"])) < 1e-5


def test_partitions_flip_their_own_coins(spark):
    df = spark.range(400_000, numPartitions=4).selectExpr("0 AS g", "id % 1000 AS v")
    parts = df.withColumn("p", F.spark_partition_id())
    blobs = [bytes(r["sketch"]) for r in sketch_groups(parts, ["p"], "v").collect()]
    assert len(set(blobs)) == 4


def test_proof_of_wrong_answers_and_nulls(spark):
    df = spark.createDataFrame([(None, v, 0) for v in [*range(1, 101)] * 3] + [("b", None, 0), ("b", -5, 0)], "g string, v long, n int")
    wrong = spark.createDataFrame([(None, 300, 50.0, 80.0, 95.0, 99.0)], "g string, n long, p50 double, p90 double, p95 double, p99 double")
    (r,) = proven(df, wrong, ["g"], "v").collect()
    assert (r["rank50"], r["error50"], r["rank90"], r["within"]) == (150, 0.0, 240, False) and abs(r["error90"] - 30 / 31) < 1e-5
    assert proven(df.limit(0), wrong, ["g"], "v").count() == 0


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
@pytest.mark.parametrize("name", ["p4_percentiles", "p4_scene_total_error", "p4_tenant_total_error"])
def test_every_answer_keeps_to_the_bound_on_larger_tables(spark, name):
    assert QUERIES[name](spark, LARGE).filter("NOT within").count() == 0
