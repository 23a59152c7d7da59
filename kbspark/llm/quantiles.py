"""p4: percentiles with relative rank error, from sketches that merge over partitions, files and days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.operators.events import fold_events
from kbspark.sources.tables import table

#: Items in a section of a compactor at the start; the rank error falls as 1 / K.
K = 32
#: The stated bound with K = 32: |rank of the answer - asked rank| <= ERROR * (number of values from the asked rank up), or
#: one value. The coins are random, so it holds with a chance: the published analysis of relative compactors gives a
#: standard error of 0.13 / K = 0.0041 of that number, so ERROR is nearly five of them. read_percentiles estimates,
#: `proven` counts what the error of each answer really is.
ERROR = 0.02
PERCENTILES = (50, 90, 95, 99)
#: Parts that the different values of a group are spread over when answers are proven.
_SALTS = 16
_SECTIONS, _LEAST = 3, 4


class Compactor:
    """One level: values of equal weight, of which the high tail is protected and the low rest is halved when it is full."""

    __slots__ = ("k", "sections", "state", "values")

    def __init__(self, values: np.ndarray, state: int = 0, k: float = K, sections: int = _SECTIONS) -> None:
        self.values, self.state, self.k, self.sections = values, state, k, sections

    def width(self) -> int:
        return max(_LEAST, 2 * round(self.k / 2))

    def capacity(self) -> int:
        return 2 * self.sections * self.width()

    def compact(self, coin: int) -> np.ndarray:
        """Every other value of the unprotected part, to go up with twice the weight; the protected part stays."""
        values = np.sort(self.values)
        open_sections = min((~self.state & (self.state + 1)).bit_length(), self.sections)
        keep = self.capacity() // 2 + (self.sections - open_sections) * self.width()
        cut = (len(values) - keep) // 2 * 2
        self.values = values[cut:]
        self.state += 1
        while self.state >= 1 << (self.sections - 1) and 2 * round(self.k / 2**1.5) >= _LEAST:
            self.k, self.sections = self.k / 2**0.5, self.sections * 2
        return values[coin:cut:2]


class Sketch:
    """Relative-rank compactors by level; level h holds values of weight 2 ** h."""

    __slots__ = ("k", "levels", "n")

    def __init__(self, n: int, levels: list[Compactor], k: int) -> None:
        self.n, self.levels, self.k = n, levels, k

    @classmethod
    def of(cls, values: np.ndarray, coins: np.random.Generator, k: int = K) -> Sketch:
        return cls(len(values), [Compactor(values, k=k)], k).compress(coins)

    def compress(self, coins: np.random.Generator) -> Sketch:
        for h, level in enumerate(self.levels):  # grows while it runs
            while len(level.values) >= level.capacity():
                up = level.compact(int(coins.integers(2)))
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(up, k=self.k))
                else:
                    above = self.levels[h + 1]
                    above.values = np.concatenate([above.values, up])
        return self

    @classmethod
    def merge(cls, sketches: list[Sketch], coins: np.random.Generator) -> Sketch:
        if len(sketches) == 1:
            return sketches[0]
        levels = []
        for h in range(max(len(s.levels) for s in sketches)):
            same = [s.levels[h] for s in sketches if h < len(s.levels)]
            widest = max(same, key=lambda c: c.sections)
            state = 0
            for c in same:
                state |= c.state
            levels.append(Compactor(np.concatenate([c.values for c in same]), state, widest.k, widest.sections))
        return cls(sum(s.n for s in sketches), levels, sketches[0].k).compress(coins)

    def percentiles(self, percents: tuple[int, ...]) -> list[float]:
        """For each the least value whose estimated rank reaches ceil(p / 100 * n)."""
        values = np.concatenate([c.values for c in self.levels])
        weights = np.concatenate([np.full(len(c.values), 1 << h, np.int64) for h, c in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        # Counted from the top, where the values are exact.
        above = weights[order][::-1].cumsum()[::-1]
        asked = [self.n - -(-p * self.n // 100) + 1 for p in percents]
        return [float(values[order][max(0, np.searchsorted(-above, -a, side="right") - 1)]) for a in asked]

    def to_bytes(self) -> bytes:
        head = [self.n, self.k, len(self.levels)]
        for c in self.levels:
            head += [c.state, round(c.k * 1e6), c.sections, len(c.values)]
        return np.array(head, np.int64).tobytes() + np.concatenate([c.values for c in self.levels]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        n, base, count = np.frombuffer(data, np.int64, 3).tolist()
        heads = np.frombuffer(data, np.int64, 4 * count, 24).reshape(count, 4).tolist()
        values, levels, at = np.frombuffer(data, np.float64, offset=24 + 32 * count), [], 0
        for state, k, sections, size in heads:
            levels.append(Compactor(values[at : at + size], state, k / 1e6, sections))
            at += size
        return cls(n, levels, base)


def _runs(keys: pd.DataFrame) -> np.ndarray:
    """Where the rows of a new group begin; nulls equal nulls."""
    new = np.zeros(len(keys), bool)
    new[:1] = True
    for c in keys:
        x = keys[c]
        same = (x == x.shift()) | (x.isna() & x.shift().isna())
        new |= ~same.fillna(False).to_numpy(bool)
    return np.flatnonzero(new)


def _blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of `rows` or more, but for the last; no empty frame."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held += [batch] * bool(len(batch))
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _coins(seed: int, block: int = 0) -> np.random.Generator:
    """Coins of a task's own, so that the errors of partitions cancel; a task that runs again flips the same."""
    context = TaskContext.get()
    return np.random.default_rng([seed, block, context.partitionId() if context else 0])


def sketch_groups(df: DataFrame, by: list[str], value: str, k: int = K, block: int = 1_000_000, seed: int = 7) -> DataFrame:
    """One sketch a group: `by`, n, sketch (binary, to be stored and merged with others of the same groups later).

    df: the columns of `by` (nulls are a group of their own) and a number; null, NaN and negative numbers are bad values
    and are left out; a group with no other has no row. Every value goes into the sketch of its group in its own
    partition first, `block` rows at a time, and these small sketches are shuffled, so a group with a third of all rows is
    a sketch or few a task.
    Other columns are ignored. An empty table gives an empty table.
    """
    names = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(value).cast("double").alias("v")).filter((F.col("v") >= 0) & ~F.isnan("v"))
    fields = [T.StructField(n, rows.schema[n].dataType) for n in names]
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, part in enumerate(_blocks(batches, block)):
            coins = _coins(seed, at)
            keys = part.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
            found = [Sketch.of(x, coins, k) for x in np.split(part["v"].to_numpy()[order], starts[1:])]
            yield part[names].iloc[order[starts]].assign(n=[s.n for s in found], sketch=[s.to_bytes() for s in found])

    merged = merge_sketches(rows.mapInPandas(build, out), names, seed=seed + 1)
    return merged.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "n", "sketch")


def merge_sketches(sketches: DataFrame, by: list[str], fan_in: int = 64, seed: int = 11) -> DataFrame:
    """The sketches of each group as one. df: `by`, n, sketch; result: the same, one row a group. Nulls are a group.

    A task reads its groups in order and folds `fan_in` sketches at a time, so it never holds more than these.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coins = _coins(seed)
        key: tuple | None = None  # of the open group
        waiting: list[Sketch] = []
        done: list[tuple] = []

        def close() -> None:
            whole = Sketch.merge(waiting, coins)
            done.append((*key, whole.n, whole.to_bytes()))

        for batch in batches:
            starts, keys, blobs = _runs(batch[by]).tolist(), batch[by].itertuples(index=False, name=None), batch["sketch"].to_numpy()
            keys = list(keys)
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                if key is None or a or not all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(key, keys[a], strict=True)):
                    if key is not None:
                        close()
                    key, waiting = keys[a], []
                for x in blobs[a:b]:
                    waiting.append(Sketch.from_bytes(x))
                    if len(waiting) == fan_in:
                        waiting[:] = [Sketch.merge(waiting, coins)]
            yield pd.DataFrame(done, columns=[*by, "n", "sketch"])
            done.clear()
        if key is not None:
            close()
            yield pd.DataFrame(done, columns=[*by, "n", "sketch"])

    rows = sketches.select(*by, "n", "sketch")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(fold, rows.schema)


def read_percentiles(sketches: DataFrame, by: list[str], percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """`by`, n and a column p50, p90, ... for each of `percents`, from the sketches of sketch_groups or merge_sketches."""
    names = [f"p{p}" for p in percents]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def read(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Sketch.from_bytes(x).percentiles(percents) for x in blobs], columns=names, dtype="float64")

    return sketches.select(*by, "n", read("sketch").alias("q")).select(*by, "n", *[F.col(f"q.{n}").alias(n) for n in names])


def _usage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "llm_usage", "id", "scene", "created_at", "total_tokens", "loaded_at").withColumn("day", F.to_date("created_at"))
    return fold_events(rows, "id", "loaded_at", ["scene", "day", "total_tokens"])


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sql_audit", "id", "tenant_id", "created_at", "elapsed_ms", "loaded_at").withColumn("day", F.to_date("created_at"))
    return fold_events(rows, "id", "loaded_at", ["tenant_id", "day", "elapsed_ms"])


def proven(df: DataFrame, answers: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """The answers with their proof: `by`, n, and for each p: p{p}, rank{p}, error{p}; and within.

    rank is the rank of the answer among all values of its group (of equal values the one nearest to the asked rank,
    ceil(p * n / 100)); error is its distance from the asked rank as a share of the values from there up; within tells
    whether every answer keeps to ERROR or is but one value off. By an exact count over all rows of df, which has the
    columns of `by` and `value`; answers: what read_percentiles gives. Nulls are a group; groups without an answer have no row.

    Equal values are counted before anything is shuffled, and the different values of a group meet its answers in
    parts, so a group with a third of all rows is no hot spot.
    """
    keys = [f"b{i}" for i in range(len(by))]
    salt = F.pmod(F.xxhash64("y"), F.lit(_SALTS)).cast("int")
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("y")).filter((F.col("y") >= 0) & ~F.isnan("y"))
    counts = rows.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("m")).withColumn("salt", salt)
    asked = answers.select(*[F.col(c).alias(f"a{i}") for i, c in enumerate(by)], "n", *[f"p{p}" for p in percents]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own = [f"a{i}" for i in range(len(by))]
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, keys, strict=True)]
    upto = lambda cond: F.sum(F.when(cond, F.col("m")).otherwise(0))
    held = asked.join(counts, [*same, F.col("part") == F.col("salt")]).groupBy(*own, "n", *[f"p{p}" for p in percents]).agg(
        *[upto(F.col("y") < F.col(f"p{p}")).alias(f"less{p}") for p in percents], *[upto(F.col("y") <= F.col(f"p{p}")).alias(f"upto{p}") for p in percents]
    )
    out, within = [], F.lit(True)
    for p in percents:
        due = F.ceil(F.lit(p) * F.col("n") / 100)
        rank = F.greatest(F.col(f"less{p}") + 1, F.least(due, F.col(f"upto{p}")))
        off, above = F.abs(rank - due), F.col("n") - due + 1
        out += [F.col(f"p{p}"), rank.cast("long").alias(f"rank{p}"), F.round(off / above, 6).alias(f"error{p}")]
        within &= off <= F.greatest(F.lit(1.0), ERROR * above)
    return held.select(*[F.col(a).alias(c) for a, c in zip(own, by, strict=True)], "n", *out, within.alias("within"))


def _proven(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return proven(rows, read_percentiles(sketch_groups(rows, by, value), by), by, value)


def p4_scene_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _proven(_usage(spark, folder), ["scene", "day"], "total_tokens")


def p4_tenant_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    return _proven(_audit(spark, folder), ["tenant_id", "day"], "elapsed_ms")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Both halves of the problem, each answer with its proof: measure, group_value, day, n, p50, rank50, error50, ..., within."""
    columns = ["day", "n", *[f"{x}{p}" for p in PERCENTILES for x in ("p", "rank", "error")], "within"]
    halves = [
        p4_scene_tokens(spark, folder).select(F.lit("llm_usage.total_tokens").alias("measure"), F.col("scene").alias("group_value"), *columns),
        p4_tenant_elapsed(spark, folder).select(F.lit("sql_audit.elapsed_ms").alias("measure"), F.col("tenant_id").alias("group_value"), *columns),
    ]
    return halves[0].unionByName(halves[1])


def p4_scene_months(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches of the days, merged to months: nothing is read twice for it."""
    days = sketch_groups(_usage(spark, folder), ["scene", "day"], "total_tokens").withColumn("month", F.date_format("day", "yyyy-MM"))
    return read_percentiles(merge_sketches(days, ["scene", "month"]), ["scene", "month"])


def _merged_days(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Answers for the whole time from the sketches of the days, with their proof: groups large enough that sketches are not exact."""
    days = sketch_groups(rows, [by, "day"], value)
    return proven(rows, read_percentiles(merge_sketches(days, [by]), [by]), [by], value).select(by, "n", "within")


def p4_scene_months_error(spark: SparkSession, folder: str) -> DataFrame:
    rows = _usage(spark, folder).withColumn("month", F.date_format("day", "yyyy-MM"))
    return proven(rows, p4_scene_months(spark, folder), ["scene", "month"], "total_tokens").select("scene", "month", "n", "within")


def _exact(by: str, rows: str, value: str) -> str:
    ranked = f"SELECT {by}, {value} v, row_number() OVER w rn, count(*) OVER (PARTITION BY {by}) n FROM ({rows}) WHERE {value} >= 0 WINDOW w AS (PARTITION BY {by} ORDER BY {value})"
    reads = ", ".join(f"CAST(min(v) FILTER (rn >= ({p} * n + 99) // 100) AS DOUBLE) p{p}, ({p} * n + 99) // 100 rank{p}, CAST(0 AS DOUBLE) error{p}" for p in PERCENTILES)
    return f"SELECT {by}, n, {reads}, true AS within FROM ({ranked}) GROUP BY {by}, n"


_LAST = "SELECT *, CAST(created_at AS DATE) AS day, strftime(created_at, '%Y-%m') AS month FROM {} QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1"
# Equal where every group of a day is smaller than a compactor, as at sf0.01; larger ones are held to ERROR by the queries named error.
SQL = {
    "p4_percentiles": f"""SELECT 'llm_usage.total_tokens' measure, scene group_value, * EXCLUDE (scene) FROM ({_exact("scene, day", _LAST.format("llm_usage"), "total_tokens")})
UNION ALL SELECT 'sql_audit.elapsed_ms', tenant_id, * EXCLUDE (tenant_id) FROM ({_exact("tenant_id, day", _LAST.format("sql_audit"), "elapsed_ms")})""",
    "p4_scene_tokens": _exact("scene, day", _LAST.format("llm_usage"), "total_tokens"),
    "p4_tenant_elapsed": _exact("tenant_id, day", _LAST.format("sql_audit"), "elapsed_ms"),
    **{f"p4_{n}_error": f"SELECT {g}, count(*) n, true AS within FROM ({_LAST.format(t)}) WHERE {v} >= 0 GROUP BY {g}" for n, g, t, v in (("scene_total", "scene", "llm_usage", "total_tokens"), ("tenant_total", "tenant_id", "sql_audit", "elapsed_ms"))},
    "p4_scene_months_error": f"SELECT scene, month, count(*) n, true AS within FROM ({_LAST.format('llm_usage')}) WHERE total_tokens >= 0 GROUP BY scene, month",
}
QUERIES = {
    "p4_percentiles": p4_percentiles,
    "p4_scene_tokens": p4_scene_tokens,
    "p4_tenant_elapsed": p4_tenant_elapsed,
    "p4_scene_months": p4_scene_months,
    "p4_scene_months_error": p4_scene_months_error,
    "p4_scene_total_error": lambda s, d: _merged_days(_usage(s, d), "scene", "total_tokens"),
    "p4_tenant_total_error": lambda s, d: _merged_days(_audit(s, d), "tenant_id", "elapsed_ms"),
}
