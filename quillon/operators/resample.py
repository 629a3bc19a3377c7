"""Bootstrap intervals and paired tests, for every group of a table at once.

Both engines draw from a counter-based generator (``functions.seeds.mix32``): a
draw is a function of seed, replicate and row, so it is the same on any number
of executors, after a retry, and in SQL.

"poisson" takes samples of any size in one pass: a row weighs Poisson(1) in each
replicate.  A task keeps, for each group, one vector of weighted sums and one
of weights over all replicates; vectors are added up by pieces of replicates.
Nothing is numbered, ordered, exploded or joined.

"indexed" draws n rows with replacement, index i of replicate b being draw (b, i)
modulo n.  It needs the sample in order in every worker, so it raises above
MAX_SAMPLE values; tasks share the replicates.

The numpy engine runs numpy's own generator in one Arrow group per sample, as usual
implementations do, and is not comparable value by value.

Nulls are left out.  A group without values has null figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.seeds import mix32

N_BOOT = 10_000
#: Values that the indexed engine sends to every worker (8 bytes each); "poisson" takes samples of any size.
MAX_SAMPLE = 1_000_000
#: Replicates whose sums are added up together.
PIECE = 1000
#: Draws that a task makes at once, and groups whose vectors it holds before it hands them on.
BLOCK, HELD_GROUPS = 1 << 20, 64
#: Ends of the cumulative Poisson(1) probabilities 0, 1, ... 8 among the 65536 values of half a draw.
POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(9)]
_WEIGHTS = np.searchsorted(np.array(POISSON), np.arange(65536), side="right").astype(np.float64)


def _counters(b: np.ndarray, seed: int) -> np.ndarray:
    """One well mixed number per replicate."""
    return mix32((b.astype(np.uint64) + np.uint64(seed * 1_000_003)).astype(np.uint32))


def poisson_weights(first: np.ndarray, second: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Rows by replicates: Poisson(1) weights of rows with keys (first, second).  Two replicates share a draw's halves."""
    counters = _counters(np.arange((n_boot + 1) // 2), seed)
    drawn = mix32(mix32(first[:, None] ^ counters) + second[:, None])
    return _WEIGHTS[np.stack([drawn & np.uint32(0xFFFF), drawn >> np.uint32(16)], axis=2).reshape(len(first), -1)[:, :n_boot]]


def _row_keys(key: list[str]) -> list[Column]:
    digest = F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in key]).cast("binary"))
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "k1"), (9, "k2"))]


def _kinds(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in names]


def poisson_replicates(
    sample: DataFrame, key: list[str], values: str | list[str], n_boot: int = N_BOOT, seed: int = 7, by: list[str] | None = None
) -> DataFrame:
    """(by, b, m), or (by, name, b, m) for a list of values: the mean of each replicate, null where it drew nothing."""
    by, names = by or [], [values] if isinstance(values, str) else values
    rows = sample.select(*by, *_row_keys(key), *[F.col(v).cast("double").alias(f"v_{i}") for i, v in enumerate(names)])
    kinds = _kinds(sample, by)
    partial = rows.mapInArrow(
        lambda batches: _partial_sums(batches, by, names, n_boot, seed),
        ", ".join([*kinds, "name string", "piece int", "sums array<double>", "weights array<double>"]),
    )
    merged = partial.repartition(*by, "name", "piece").mapInArrow(
        lambda batches: _merged(batches, by), ", ".join([*kinds, "name string", "b long", "m double"])
    )
    return merged.drop("name") if isinstance(values, str) else merged


def _partial_sums(batches: Iterator[pa.RecordBatch], by: list[str], names: list[str], n_boot: int, seed: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    kinds: list[pa.DataType] = []

    def handed() -> Iterator[pa.RecordBatch]:
        for group, sums in held.items():
            for i, name in enumerate(names):
                if sums[i, 1].any():
                    cut = range(0, n_boot, PIECE)
                    parts = [[list(sums[i, j, k : k + PIECE]) for k in cut] for j in (0, 1)]
                    fixed = [pa.array([g] * len(cut), kind) for g, kind in zip(group, kinds)]
                    arrays = [*fixed, pa.array([name] * len(cut)), pa.array([k // PIECE for k in cut], pa.int32()), *map(pa.array, parts)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*by, "name", "piece", "sums", "weights"])
        held.clear()

    for batch in batches:
        kinds = kinds or [batch.schema.field(b).type for b in by]
        places: dict[tuple, list[int]] = {}
        for at, group in enumerate(zip(*(batch[b].to_pylist() for b in by)) if by else [()] * batch.num_rows):
            places.setdefault(group, []).append(at)
        first, second = (batch[k].to_numpy().astype(np.uint32) for k in ("k1", "k2"))
        x = np.stack([batch[f"v_{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
        for group, at in places.items():
            sums = held.setdefault(group, np.zeros((len(names), 2, n_boot)))
            step = max(1, BLOCK // n_boot)
            for k in range(0, len(at), step):
                own = np.array(at[k : k + step])
                drawn = poisson_weights(first[own], second[own], n_boot, seed)
                known = ~np.isnan(x[:, own])
                sums[:, 0] += np.where(known, x[:, own], 0.0) @ drawn
                sums[:, 1] += known.astype(float) @ drawn
        if len(held) > HELD_GROUPS:
            yield from handed()
    yield from handed()


def _merged(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds = kinds or [batch.schema.field(b).type for b in by]
        for at, group in enumerate(zip(*(batch[c].to_pylist() for c in (*by, "name", "piece")))):
            both = np.stack([batch[c][at].values.to_numpy() for c in ("sums", "weights")])
            held[group] = held[group] + both if group in held else both
    for (*group, name, piece), (sums, weights) in held.items():
        n = len(sums)
        means = pa.array(sums / np.where(weights > 0, weights, 1.0), mask=weights == 0)
        fixed = [pa.array([g] * n, kind) for g, kind in zip(group, kinds)]
        arrays = [*fixed, pa.array([name] * n), pa.array(np.arange(piece * PIECE, piece * PIECE + n)), means]
        yield pa.RecordBatch.from_arrays(arrays, names=[*by, "name", "b", "m"])


def replicates(
    sample: DataFrame, key: list[str], value: str, n_boot: int = N_BOOT, seed: int = 7, by: list[str] | None = None
) -> DataFrame:
    """(by, b, m): mean of each replicate of the non-null values, drawn with replacement in the order of key."""
    by, spark = by or [], sample.sparkSession
    values = sample.where(F.col(value).isNotNull())
    n = values.count()
    if n > MAX_SAMPLE:
        raise ValueError(f"{n} values are too many to send to every worker; use the engine \"poisson\"")
    at = values.select(*by, *key, F.col(value).cast("double").alias("x_value")).orderBy(*by, *key).toArrow()
    groups: dict[tuple, list[float]] = {}
    for row in zip(*(at[b].to_pylist() for b in by), at["x_value"].to_pylist()):
        groups.setdefault(row[:-1], []).append(row[-1])
    shared = spark.sparkContext.broadcast({g: np.array(x) for g, x in groups.items()})  # at most MAX_SAMPLE values
    kinds = [at.schema.field(b).type for b in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch["id"].to_numpy()
            counters = _counters(b, seed)
            for group, x in shared.value.items():
                means = [_indexed_mean(x, c) for c in counters]
                fixed = [pa.array([g] * len(b), kind) for g, kind in zip(group, kinds)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(b), pa.array(means, pa.float64())], names=[*by, "b", "m"])

    return spark.range(n_boot).mapInArrow(run, ", ".join([*_kinds(sample, by), "b long", "m double"]))


def _indexed_mean(x: np.ndarray, counter: np.uint32) -> float:
    n, total = len(x), 0.0
    other = mix32(np.array([counter ^ np.uint32(0x9E3779B9)], np.uint32))
    for k in range(0, n, BLOCK):
        i = np.arange(k, min(n, k + BLOCK), dtype=np.uint32)
        total += x[mix32(mix32(i ^ counter) + other) % np.uint32(n)].sum()
    return total / n


def _same(by: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables' columns side by side, by group; null groups match each other."""
    renamed = right.withColumnsRenamed({b: f"right_{b}" for b in by})
    on = [F.col(b).eqNullSafe(F.col(f"right_{b}")) for b in by]
    return left.join(renamed, on or F.lit(True), "left").drop(*[f"right_{b}" for b in by])


def interval(reps: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """(by, lo, hi): linear quantiles of the replicates."""
    return reps.groupBy(*(by or [])).agg(
        F.expr(f"percentile(m, {alpha / 2}D)").alias("lo"), F.expr(f"percentile(m, {1 - alpha / 2}D)").alias("hi")
    )


def picked_interval(reps: DataFrame, n_boot: int, alpha: float = 0.05) -> DataFrame:
    """Interval by picking sorted replicates, not interpolated."""
    at = [min(n_boot - 1, int(alpha / 2 * n_boot)), min(n_boot - 1, int((1 - alpha / 2) * n_boot))]
    v = F.array_sort(F.collect_list("m"))
    return reps.agg(F.get(v, F.lit(at[0])).alias("lo"), F.get(v, F.lit(at[1])).alias("hi"))


ENGINES = {"indexed": replicates, "poisson": poisson_replicates}


def engine_of(name: str):
    if name not in ENGINES:
        raise ValueError(f"unknown bootstrap engine: {name}")
    return ENGINES[name]


def bootstrap_ci(
    sample: DataFrame, key: list[str], value: str, n_boot: int = N_BOOT, alpha: float = 0.05, seed: int = 7, engine: str = "poisson",
    by: list[str] | None = None,
) -> DataFrame:
    """(by, mean, lo, hi, n), one row per group, one row in all without groups."""
    by = by or []
    plain = sample.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("n"))
    reps = engine_of(engine)(sample, key, value, n_boot, seed, by)
    return _same(by, plain, interval(reps, alpha, by)).select(*by, "mean", "lo", "hi", "n")


def summarize_rate(sample: DataFrame, key: list[str], value: str, n_boot: int = N_BOOT, by: list[str] | None = None) -> DataFrame:
    """(by, rate, ci95_lo, ci95_hi, ci95_halfwidth, n)."""
    found = bootstrap_ci(sample, key, value, n_boot, by=by)
    return found.select(
        *(by or []), F.col("mean").alias("rate"), F.col("lo").alias("ci95_lo"), F.col("hi").alias("ci95_hi"),
        ((F.col("hi") - F.col("lo")) / 2).alias("ci95_halfwidth"), "n",
    )


def paired_test(
    pairs: DataFrame, key: list[str], n_boot: int = N_BOOT, alpha: float = 0.05, seed: int = 7, engine: str = "poisson",
    by: list[str] | None = None,
) -> DataFrame:
    """(by, mean_diff, lo, hi, p_value, n_pairs) of columns a - b.

    The p-value counts centred replicates beyond the observed difference on
    both sides.  Without pairs the figures are null and n_pairs is 0.
    """
    by = by or []
    diff = pairs.withColumn("d", F.col("a").cast("double") - F.col("b").cast("double"))
    plain = diff.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.count("d").alias("n_pairs"))
    reps = engine_of(engine)(diff, key, "d", n_boot, seed, by)
    gathered = reps.groupBy(*by).agg(  # n_boot numbers a group
        F.expr(f"percentile(m, {alpha / 2}D)").alias("lo"), F.expr(f"percentile(m, {1 - alpha / 2}D)").alias("hi"),
        F.avg("m").alias("centre"), F.collect_list("m").alias("ms"),
    )
    edge = F.round(F.abs("mean_diff"), 12)
    share = lambda beyond: F.size(F.filter("ms", beyond)) / F.nullif(F.size("ms"), F.lit(0))
    up = share(lambda m: F.round(m - F.col("centre"), 12) >= edge)
    down = share(lambda m: F.round(m - F.col("centre"), 12) <= -edge)
    return _same(by, plain, gathered).select(
        *by, "mean_diff", "lo", "hi", F.when(F.col("lo").isNotNull(), F.least(2 * F.least(up, down), F.lit(1.0))).alias("p_value"), "n_pairs"
    )


def numpy_ci(sample: DataFrame, by: list[str], key: str, value: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """(by, mean, lo, hi, n) with numpy's generator, in chunks of replicates."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(key)[value].dropna().to_numpy(float)
        n = len(x)
        rng, means = np.random.default_rng(seed), []
        step = max(1, 2_000_000 // max(n, 1))
        for k in range(0, n_boot if n else 0, step):
            means.append(x[rng.integers(0, n, size=(min(step, n_boot - k), n))].mean(axis=1))
        lo, hi = np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2]) if n else (np.nan, np.nan)
        head = {b: [pdf[b].iloc[0]] for b in by}
        return pd.DataFrame({**head, "mean": [x.mean() if n else np.nan], "lo": [lo], "hi": [hi], "n": [n]})

    kinds = ", ".join(f"{b} {sample.schema[b].dataType.simpleString()}" for b in by)
    return sample.select(*by, key, value).groupBy(*by).applyInPandas(one, f"{kinds}, mean double, lo double, hi double, n long")
