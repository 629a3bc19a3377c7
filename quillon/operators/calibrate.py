"""Order statistics, conformal thresholds and their checks.

Thresholds are picked values of the sorted sample, not interpolated.  The pick
is distributed: values are counted, pivots are taken from a sketch of each group's
distinct values, counts are summed by the slices between pivots, and only the
slice that holds the rank goes on, to be sliced again or sorted.  Slices hold
about equally many distinct values wherever these lie, so an outlier or a hot value does
not make a large one.

Re-splits draw ranks, not rows: the calibration part of a split is a set of
ranks of the sorted pool, drawn by hash, of which only the value at the
threshold's rank is looked up.  The pool is counted once and never copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.seeds import mix32
from quillon.operators import prefix
from quillon.sources.sinks import saved

#: Slices a level, and distinct values of a slice that are sorted rather than sliced again; groups of up to FEW are sorted at once.
SLICES, SORTED, FEW = 64, 1 << 20, 4096


def levels_for(distinct: int) -> int:
    """Levels of slices that leave about SORTED values to sort, of a group of so many; none for few values."""
    levels = int(distinct > FEW)
    while levels and distinct / SLICES**levels > SORTED:
        levels += 1
    return levels


def _renamed(frame: DataFrame, by: list[str], prefix_: str) -> DataFrame:
    return frame.select(*[F.col(b).alias(prefix_ + b) for b in by], *[F.col(c) for c in frame.columns if c not in by])


def _same(by: list[str], prefix_: str) -> list[Column]:
    return [F.col(b).eqNullSafe(F.col(prefix_ + b)) for b in by] or [F.lit(True)]


def sliced(counted: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, x, ...) of distinct values with the number of their slice among those of their group."""
    shares = ", ".join(f"{k / SLICES!r}D" for k in range(1, SLICES))
    pivots = counted.groupBy(*by).agg(F.expr(f"percentile_approx(x, array({shares}), 2000)").alias("pivots"))
    pivots = _renamed(pivots, by, "p_")
    joined = counted.join(pivots if by else F.broadcast(pivots), _same(by, "p_"))
    place = F.size(F.filter("pivots", lambda p: p < F.col("x")))
    return joined.withColumn("slice", place).drop("pivots", *["p_" + b for b in by])


def ranked_values(
    df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], levels: int | None = None, weight: str | None = None
) -> DataFrame:
    """One row per group: n, and for each name the value at a 0-based rank, an expression of column n.

    A weight says how often a row's value counts.  The distinct values with their counts are saved, since every level reads them, and counted for the number of levels.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    counted = saved(counted)
    if levels is None:
        levels = levels_for(counted.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
    left, own, begin = counted, list(by), F.lit(0)
    if not levels:
        left = counted.withColumn("n", F.sum("c").over(Window.partitionBy(*by))).withColumn("begin", begin).withColumn("wanted", wanted)
    for level in range(levels):
        slot = f"slot_{level}"
        placed = sliced(left, own).withColumnRenamed("slice", slot)
        run = Window.partitionBy(*own).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)  # SLICES rows a group
        slices = placed.groupBy(*own, slot).agg(F.sum("c").alias("sc"), *([] if level == 0 else [F.first("begin").alias("begin"), F.first("n").alias("n")]))
        if level == 0:
            slices = slices.withColumn("n", F.sum("sc").over(Window.partitionBy(*own)))
        slices = slices.withColumn("upto", begin + F.sum("sc").over(run)).withColumn("begin", F.col("upto") - F.col("sc"))
        held = slices.withColumn("wanted", F.filter(wanted, lambda w: (w["rank"] >= F.col("begin")) & (w["rank"] < F.col("upto"))))
        held = held.where(F.size("wanted") > 0).select(*own, slot, "begin", "wanted", "n")
        own, begin = [*own, slot], F.col("begin")
        left = placed.select(*own, "x", "c").join(_renamed(held, own, "h_"), _same(own, "h_")).drop(*["h_" + c for c in own])
    inner = Window.partitionBy(*own).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = left.withColumn("last", F.col("begin") + F.sum("c").over(inner)).withColumn("w", F.explode("wanted"))
    found = near.where((F.col("w.rank") >= F.col("last") - F.col("c")) & (F.col("w.rank") < F.col("last")))
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("w.name") == k, F.col("x"))).alias(k) for k in ranks])


def conformal_rank(n: Column, alpha: float) -> Column:
    """clamp(ceil((n + 1) * (1 - alpha)) - 1, 0, n - 1) in double arithmetic."""
    k = F.ceil((n + 1).cast("double") * F.lit(1.0 - alpha)) - 1
    return F.greatest(F.least(k, n - 1), F.lit(0))


def threshold(sample: DataFrame, value: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """(by, n, tau) from calibration scores."""
    return ranked_values(sample, by or [], value, {"tau": conformal_rank(F.col("n"), alpha)})


def thresholds(sample: DataFrame, value: str, alphas: list[float]) -> DataFrame:
    """(alpha, n, tau) for several alphas from one pass over the calibration scores."""
    found = ranked_values(sample, [], value, {f"tau_{i}": conformal_rank(F.col("n"), a) for i, a in enumerate(alphas)})
    rows = F.inline(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col("n"), F.col(f"tau_{i}").alias("tau")) for i, a in enumerate(alphas)]))
    return found.select(rows)


def bound(alpha, n: Column) -> Column:
    """Coverage bound alpha + 1 / (n + 1)."""
    return F.lit(float(alpha)) + 1.0 / (n + 1)


def false_positives(test: DataFrame, value: str, tau: DataFrame, alpha: float) -> DataFrame:
    """Share of test scores at or above tau, against the bound.  tau is one row."""
    hit = F.avg((F.col(value) >= F.col("tau")).cast("int").cast("double"))
    rows = test.crossJoin(F.broadcast(tau)).groupBy("tau", "n").agg(hit.alias("fpr"), F.count("*").alias("n_test"))
    return rows.select(
        "tau", "fpr", bound(alpha, F.col("n")).alias("bound"), (F.col("fpr") <= bound(alpha, F.col("n"))).alias("within"),
        F.col("n").alias("n_cal"), "n_test",
    )


def head_split(df: DataFrame, order: str, n: int, m: int) -> DataFrame:
    """Adds split: the first n rows by a dense 0-based order column calibrate, the next m test."""
    split = F.when(F.col(order) < n, "cal").when(F.col(order) < n + m, "test")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def hash_key(seed: int, *parts: Column) -> Column:
    """A number below 2^32 from an md5 of seed and parts, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _counters(b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    counters = mix32((b.astype(np.uint64) + np.uint64(seed * 1_000_003)).astype(np.uint32))
    return counters, mix32(counters ^ np.uint32(0x9E3779B9))


def drawn_ranks(counter: np.uint32, other: np.uint32, k: int, n: int) -> np.ndarray:
    """The first k different numbers below n of one replicate's draws, in the order they came."""
    size = 2 * k + 64
    while True:
        j = np.arange(size, dtype=np.uint32)
        high = mix32(mix32(j ^ counter) + other)
        low = mix32(high ^ other)
        ranks = (((high & np.uint32(0x7FFFFFFF)).astype(np.int64) << 32) + low) % n
        first = np.sort(np.unique(ranks, return_index=True)[1])
        if len(first) >= k:
            return ranks[first[:k]]
        size *= 2


def split_ranks(counter: np.uint32, other: np.uint32, n_cal: int, n_test: int | None, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted ranks of the calibration part, and of the test part unless that is all the rest."""
    if n_test is None and n_cal > n // 2:  # what is left out is drawn instead
        out = np.ones(n, bool)
        out[drawn_ranks(counter, other, n - n_cal, n)] = False
        return np.flatnonzero(out), None
    drawn = drawn_ranks(counter, other, n_cal + (n_test or 0), n)
    return np.sort(drawn[:n_cal]), None if n_test is None else np.sort(drawn[n_cal:])


def resplit(
    pool: DataFrame, value: str, n_cal: int, alphas: list[float], n_splits: int, n_test: int | None = None, seed: int = 7
) -> DataFrame:
    """(b, alpha, tau, fpr): for each random split of a pool, tau of n_cal values and the share of n_test others, or of all the rest, at or above it.

    Workers draw ranks of whole splits, so n_cal + n_test numbers are held at a time.  n_splits x alphas ranks are looked up in the
    counted pool.  A pool that is too small raises; without a test part fpr is null.
    """
    spark = pool.sparkSession
    counted = pool.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    placed = prefix.running(counted, ["x"], "c", "upto", "sum").withColumn("begin", F.col("upto") - F.col("c"))
    n = placed.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    if n_cal < 1 or n < n_cal + (n_test or 0):
        raise ValueError(f"{n_cal + (n_test or 0)} values are needed for a split, the pool has {n}")
    at = {float(a): min(max(int(np.ceil((n_cal + 1) * (1.0 - a))) - 1, 0), n_cal - 1) for a in alphas}

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch["id"].to_numpy()
            found = [split_ranks(c, o, n_cal, n_test, n)[0][list(at.values())] for c, o in zip(*_counters(b, seed))]
            flat = [np.repeat(b, len(at)), np.tile(list(at), len(b)), np.concatenate(found) if found else []]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.float64()), pa.array(flat[2], pa.int64())], names=["b", "alpha", "rank"])

    wanted = spark.range(n_splits).mapInArrow(ranks, "b long, alpha double, rank long")
    sought = spark.sparkContext.broadcast(np.unique(wanted.select("rank").toArrow()["rank"].to_numpy()))  # n_splits x alphas numbers at most

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, upto = (batch[c].to_numpy() for c in ("begin", "upto"))
            lo, hi = np.searchsorted(sought.value, begin), np.searchsorted(sought.value, upto)
            rows = np.repeat(np.arange(batch.num_rows), hi - lo)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sought.value[lo[rows] + within]), pa.array(batch["x"].to_numpy()[rows]), pa.array(begin[rows])], names=["rank", "tau", "begin"]
            )

    found = placed.select("x", "begin", "upto").mapInArrow(looked_up, "rank long, tau double, begin long")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, own = [], (None, None)
            for b, begin in zip(batch["b"].to_pylist(), batch["begin"].to_pylist()):
                if own[0] != b:
                    c, o = _counters(np.array([b]), seed)
                    own = b, split_ranks(c[0], o[0], n_cal, n_test, n)
                cal, test = own[1]
                if test is not None:
                    out.append((len(test) - int(np.searchsorted(test, begin))) / len(test) if len(test) else None)
                else:
                    hit = (n - begin) - (n_cal - int(np.searchsorted(cal, begin)))
                    out.append(hit / (n - n_cal) if n > n_cal else None)
            yield pa.RecordBatch.from_arrays([batch["b"], batch["alpha"], batch["tau"], pa.array(out, pa.float64())], names=["b", "alpha", "tau", "fpr"])

    both = wanted.join(found, "rank").select("b", "alpha", "tau", "begin").sortWithinPartitions("b")
    return both.mapInArrow(shares, "b long, alpha double, tau double, fpr double")


def resplit_summary(fprs: DataFrame, n_cal: int) -> DataFrame:
    """(alpha, mean_fpr, lo, hi, bound, within, share_within, sd, n): means and quantiles over splits, against the coverage bound."""
    limit = F.col("alpha") + 1.0 / (n_cal + 1)
    rows = fprs.groupBy("alpha").agg(
        F.avg("fpr").alias("mean_fpr"), F.expr("percentile(fpr, 0.025D)").alias("lo"), F.expr("percentile(fpr, 0.975D)").alias("hi"),
        F.avg((F.col("fpr") <= limit).cast("double")).alias("share_within"), F.stddev_pop("fpr").alias("sd"), F.count("*").alias("n"),
    )
    return rows.withColumn("bound", limit).withColumn("within", F.col("mean_fpr") <= limit)


def concentration(fprs: DataFrame, n_cal: int, eps: float = 0.05) -> DataFrame:
    """(alpha, mean, sd, beta_sd, dkw_bound, excess, dkw_holds) of the share above the threshold over splits.

    excess is the share of splits further than eps + 2 / n_cal from alpha; the bound has 0.05 to spare for chance.
    """
    far = (F.abs(F.col("fpr") - F.col("alpha")) > eps + 2.0 / n_cal).cast("double")
    n = F.lit(float(n_cal))
    return fprs.groupBy("alpha").agg(F.avg("fpr").alias("mean"), F.stddev_pop("fpr").alias("sd"), F.avg(far).alias("excess")).select(
        "alpha", "mean", "sd", F.sqrt(F.col("alpha") * (1 - F.col("alpha")) / n).alias("beta_sd"), dkw_bound(n, eps).alias("dkw_bound"), "excess",
        (F.col("excess") <= dkw_bound(n, eps) + 0.05).alias("dkw_holds"),
    )


def roc(scores: DataFrame, taus: list[float]) -> DataFrame:
    """Confusion counts and rates of (score, positive) for each threshold; 0 where a denominator is 0."""
    spark = scores.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in taus], "tau double")
    hit, pos = F.col("score") >= F.col("tau"), F.col("positive") == 1
    out = scores.crossJoin(F.broadcast(grid)).groupBy("tau").agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = out.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "fpr": rate(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", rate(2 * p * r, p + r))


def vmf_kappa(r: Column, d: int) -> Column:
    """Concentration estimate from the mean resultant length, clamped to [0.01, 0.99]."""
    r = F.greatest(F.least(r, F.lit(0.99)), F.lit(0.01))
    return r * (d - r * r) / (1 - r * r)


def levy_bound(d: int, t: Column) -> Column:
    return F.exp(-d * t * t / 2)


def levy_check(unit: DataFrame, directions: DataFrame, dim: int, thresholds: list[float]) -> DataFrame:
    """(t, tail, bound, ratio, holds): share of inner products of unit vectors (u) and directions (v) above t, against the bound."""
    c = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")
    pairs = unit.crossJoin(F.broadcast(directions)).select(c.alias("c"), ts)  # directions: as many as the caller draws
    tail = pairs.groupBy("t").agg(F.avg((F.col("c") > F.col("t")).cast("double")).alias("tail"))
    limit = levy_bound(dim, F.col("t"))
    return tail.select("t", "tail", limit.alias("bound"), (F.col("tail") / limit).alias("ratio"), (F.col("tail") <= limit).alias("holds"))


def lipschitz_check(spans: DataFrame, risk, epsilons: list[float], lam: float, perturbations: int = 20) -> DataFrame:
    """(epsilon, worst, bound, ratio, holds): the largest change of risk over perturbations of each norm, against (1 + lam) * epsilon.

    spans hold span_id, image_id and embedding; risk(spans) adds column risk and keeps the others.  Noise is a function of span, perturbation
    and place, scaled to the norm; the moved vector is scaled to length 1 again.
    """
    turns = np.arange(perturbations)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, image, x in zip(*(batch[c].to_pylist() for c in ("span_id", "image_id", "embedding"))):
                x = np.array(x, np.float64)
                noise = np.sin(np.arange(len(x)) * 12.9898 + (of + 977 * turns)[:, None])
                noise /= np.sqrt((noise * noise).sum(axis=1, keepdims=True))
                for e in epsilons:
                    made = x + noise * e
                    made /= np.sqrt((made * made).sum(axis=1, keepdims=True))
                    names = [f"{of}/{e}/{t}" for t in turns]
                    fixed = [pa.array([v] * perturbations, kind) for v, kind in ((image, batch["image_id"].type), (of, batch["span_id"].type), (float(e), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(names), *fixed, pa.array(list(made))], names=["span_id", "image_id", "of", "epsilon", "embedding"])

    kinds = {c: spans.schema[c].dataType.simpleString() for c in ("image_id", "span_id")}
    rows = spans.select("span_id", "image_id", "embedding").mapInArrow(
        moved, f"span_id string, image_id {kinds['image_id']}, of {kinds['span_id']}, epsilon double, embedding array<double>"
    )
    base = risk(spans).select(F.col("span_id").alias("of"), F.col("risk").alias("before"))
    worst = risk(rows).join(base, "of").groupBy("epsilon").agg(F.max(F.abs(F.col("risk") - F.col("before"))).alias("worst"))
    limit = F.col("epsilon") * (1 + lam)
    return worst.select("epsilon", "worst", limit.alias("bound"), (F.col("worst") / limit).alias("ratio"), (F.col("worst") <= limit + 1e-6).alias("holds"))


def dkw_bound(n: Column, eps: float) -> Column:
    return 2 * F.exp(-2.0 * n * eps * eps)


def beta_sd(alpha: float, n: Column) -> Column:
    return F.sqrt(F.lit(alpha * (1 - alpha)) / n)
