"""Tables over runs: long summaries, pivots, ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import calibrate as C
from quillon.operators import metrics as M
from quillon.operators import resample as R

VARIANTS = ["base", "attacked", "defended_attack", "defended_control"]


def main_rows(records: DataFrame) -> DataFrame:
    """Unsafe and flag rate per run and variant, one row per run; null where nothing was measured."""
    rows = records.groupBy("run").pivot("variant", VARIANTS).agg(M.rate("is_unsafe").alias("unsafe"), M.rate("firewall_flagged").alias("flag"))
    return rows.select(
        "run", "base_unsafe", "attacked_unsafe", F.col("defended_attack_unsafe").alias("defended_unsafe"),
        F.col("defended_attack_flag").alias("attack_flag"), F.col("defended_control_flag").alias("control_flag"),
    )


def main_table(records: DataFrame, runs: DataFrame, n_boot: int = R.N_BOOT, seed: int = 7) -> DataFrame:
    """(run, state, target, n, and rate and interval of unsafe and of flags) for every row of runs(run).

    The target is the defended attack, and the attack of a run that has no rows of the former at all; a defended
    attack that was not measured keeps null figures.  n counts the verdicts, else the flags, else it is 0.
    """
    key = ["sample_id", "variant", "transform", "attack_position"]
    rows = records.where(F.col("variant").isin(VARIANTS[1:3]))
    targets = rows.groupBy("run").agg(F.max(F.struct((F.col("variant") == VARIANTS[2]).alias("first"), "variant")).alias("t")).select("run", F.col("t.variant").alias("variant"))
    kept = rows.join(targets, ["run", "variant"])  # a row a run
    reps = R.poisson_replicates(kept, key, ["is_unsafe", "firewall_flagged"], n_boot, seed, ["run"])
    ends = R.interval(reps, by=["run", "name"]).groupBy("run").pivot("name", ["is_unsafe", "firewall_flagged"]).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    plain = kept.groupBy("run", F.col("variant").alias("target")).agg(
        M.rate("is_unsafe").alias("unsafe"), M.rate("firewall_flagged").alias("flag"),
        F.coalesce(F.nullif(F.count("is_unsafe"), F.lit(0)), F.count("firewall_flagged")).alias("n"),
    )
    present = records.select("run").distinct().withColumn("state", F.lit("ok"))
    found = runs.select("run").join(present, "run", "left").join(plain, "run", "left").join(ends, "run", "left")
    return found.select(
        "run", F.coalesce("state", F.lit("missing")).alias("state"), "target", F.when(F.col("state").isNotNull(), F.coalesce("n", F.lit(0))).alias("n"),
        "unsafe", F.col("is_unsafe_lo").alias("unsafe_lo"), F.col("is_unsafe_hi").alias("unsafe_hi"),
        "flag", F.col("firewall_flagged_lo").alias("flag_lo"), F.col("firewall_flagged_hi").alias("flag_hi"),
    )


def paired_tests(records: DataFrame, tests: list[tuple[str, str]], within: list[str] | None = None, n_boot: int = R.N_BOOT) -> DataFrame:
    """(a, b, state, n_pairs, mean_diff, lo, hi, p_value): runs a and b row by row, and attack against defended attack within runs.

    Rows match on sample, variant, transform and position (null positions match); rows without a verdict take no part.
    The state is "missing" if a run has no records, "no overlap" if no rows match.
    """
    spark = records.sparkSession
    plan = [(a, b, None, None) for a, b in tests] + [(r, r, *VARIANTS[1:3]) for r in within or []]
    listed = spark.createDataFrame(plan, "a_run string, b_run string, a_variant string, b_variant string")
    key = ["sample_id", "transform", "attack_position"]
    own = records.where(F.col("is_unsafe").isNotNull())

    def side(name: str) -> DataFrame:
        other = f"{name}_variant"
        rows = own.join(F.broadcast(listed), F.col("run") == F.col(f"{name}_run"))  # the list that the caller wrote
        rows = rows.where(F.col(other).isNull() | (F.col(other) == F.col("variant")))
        same = F.when(F.col(other).isNull(), F.col("variant")).otherwise(F.lit(""))
        return rows.select("a_run", "b_run", "a_variant", *key, same.alias("of"), F.col("is_unsafe").alias(name)).withColumnsRenamed(
            {} if name == "a" else {c: f"r_{c}" for c in ("a_run", "b_run", "a_variant", *key, "of")}
        )

    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in ("a_run", "b_run", "a_variant", *key, "of")]
    pairs = side("a").join(side("b"), on).select("a_run", "b_run", F.coalesce("a_variant", F.lit("")).alias("kind"), *key, "of", "a", "b")
    results = R.paired_test(pairs, [*key[:2], "of"], n_boot, by=["a_run", "b_run", "kind"])
    present = records.select("run").distinct()
    wanted = listed.select("a_run", "b_run", F.coalesce("a_variant", F.lit("")).alias("kind"), "b_variant")
    has = wanted.join(present.select(F.col("run").alias("a_run"), F.lit(1).alias("a_has")), "a_run", "left").join(
        present.select(F.col("run").alias("b_run"), F.lit(1).alias("b_has")), "b_run", "left"
    )
    named = lambda run, variant: F.when(F.col("kind") == "", F.col(run)).otherwise(F.concat(F.col(run), F.lit(" "), variant))
    state = F.when(F.col("a_has").isNull() | F.col("b_has").isNull(), "missing").when(F.col("n_pairs").isNull(), "no overlap").otherwise("ok")
    return has.join(results, ["a_run", "b_run", "kind"], "left").select(
        named("a_run", F.col("kind")).alias("a"), named("b_run", F.col("b_variant")).alias("b"), state.alias("state"),
        F.when(state != "missing", F.coalesce("n_pairs", F.lit(0))).alias("n_pairs"), "mean_diff", "lo", "hi", "p_value",
    )


def cross_model(records: DataFrame, value: str = "is_unsafe") -> DataFrame:
    """One row per run, one column per variant."""
    return records.groupBy("run").pivot("variant", VARIANTS).agg(M.rate(value))


def utility(records: DataFrame) -> DataFrame:
    """Correctness of base and control, and the share that is retained."""
    wide = cross_model(records, "judged_correct")
    return wide.select("run", "base", "defended_control", F.try_divide("defended_control", "base").alias("retention"))


def ablation(runs: DataFrame, summaries: DataFrame, baseline: float) -> DataFrame:
    """Each run's summary with its difference to a baseline; runs without a summary stay, marked missing."""
    return runs.join(summaries, "run", "left").select(
        "run", "unsafe", "flag", (F.lit(baseline) - F.col("unsafe")).alias("delta"),
        F.when(F.col("unsafe").isNull(), "missing").otherwise("ok").alias("state"),
    )


def seeds(rows: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation over seeds."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def long(summary: DataFrame, dim: str) -> DataFrame:
    """(dim, key, metric, value) of a summary by one column."""
    values = [c for c in summary.columns if c != dim]
    return summary.select(F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        ["dim", "key"], values, "metric", "value"
    )


def conformal_report(settings: DataFrame, records: DataFrame, calibration: DataFrame, test: DataFrame, value: str, resplits: DataFrame, n_cal: int) -> DataFrame:
    """(view, name, alpha, tau, fpr, lo, hi, bound, within): three views of the share of clean images that are flagged.

    "transformed": the flag rate of the defended clean rows of each run in settings (run, alpha, tau, bound; a null bound is
    alpha + 1/101); runs without such rows or without tau are left out.  "single": one split into calibration and test scores, for each
    alpha of the settings.  "resplit": the mean over random splits with its interval.
    """
    alphas = sorted({r["alpha"] for r in settings.select("alpha").distinct().collect()})  # a list that the caller wrote
    rates = records.where(F.col("variant") == VARIANTS[3]).groupBy("run").agg(M.rate("firewall_flagged").alias("fpr"))
    limit = F.coalesce("bound", F.col("alpha") + 1.0 / 101)
    none = F.lit(None).cast("double")
    cols = ["view", "name", "alpha", "tau", "fpr", "lo", "hi", "bound", "within"]
    transformed = settings.join(rates, "run").where("fpr is not null and tau is not null").select(
        F.lit("transformed").alias("view"), F.col("run").alias("name"), "alpha", "tau", "fpr", none.alias("lo"), none.alias("hi"),
        limit.alias("bound"), (F.col("fpr") <= limit).alias("within"),
    )
    tau = C.thresholds(calibration, value, alphas)
    hit = F.avg((F.col(value) >= F.col("tau")).cast("double"))
    single = test.where(F.col(value).isNotNull()).crossJoin(F.broadcast(tau)).groupBy("alpha", "tau", "n").agg(hit.alias("fpr")).select(  # tau: a row an alpha
        F.lit("single").alias("view"), F.lit(None).cast("string").alias("name"), "alpha", "tau", "fpr", none.alias("lo"), none.alias("hi"),
        (F.col("alpha") + 1.0 / (F.col("n") + 1)).alias("bound"), (F.col("fpr") <= F.col("alpha") + 1.0 / (F.col("n") + 1)).alias("within"),
    )
    many = C.resplit_summary(resplits, n_cal).select(
        F.lit("resplit").alias("view"), F.lit(None).cast("string").alias("name"), "alpha", none.alias("tau"), F.col("mean_fpr").alias("fpr"), "lo", "hi",
        "bound", "within",
    )
    return transformed.select(cols).unionByName(single.select(cols)).unionByName(many.select(cols))


def _points(df: DataFrame, plot: str, key: str) -> DataFrame:
    """(plot, key, metric, value) of a table with one row per key."""
    return long(df, key).select(F.lit(plot).alias("plot"), "key", "metric", "value")


def plot_data(settings: DataFrame, records: DataFrame, resplits: DataFrame, n_cal: int, bins: int = 25) -> DataFrame:
    """(plot, key, metric, value): the numbers behind four figures.

    "alpha_dial" and "lambda_sweep": flag rates of clean and attacked rows and the unsafe rate of the defended attack of
    each run, by the settings (run, alpha, lam); both name a run by its setting, and by alpha and lambda where a lambda occurs twice.  "resplit":
    mean, interval, bound and a histogram of equal bins between the least and the greatest share.  "category":
    unsafe rates before and after, their difference and its place, smallest first; categories without both rates are left out.
    """
    flag = lambda v: M.rate("firewall_flagged", F.col("variant") == v)
    rates = records.groupBy("run").agg(
        flag(VARIANTS[3]).alias("clean_flag"), flag(VARIANTS[2]).alias("attack_flag"),
        M.rate("is_unsafe", F.col("variant") == VARIANTS[2]).alias("unsafe_defended"),
    )
    runs = settings.join(rates, "run")
    dial = runs.select("alpha", "clean_flag", "attack_flag", "unsafe_defended", (F.col("alpha") + 1.0 / (n_cal + 1)).alias("bound"))
    sweep = runs.select(F.concat(F.col("lam").cast("string"), F.lit(" at "), F.col("alpha").cast("string")).alias("lam"), "clean_flag", "attack_flag", "unsafe_defended")
    ends = resplits.groupBy("alpha").agg(F.min("fpr").alias("first"), F.max("fpr").alias("last"))
    share = F.coalesce(F.try_divide(F.col("fpr") - F.col("first"), F.col("last") - F.col("first")), F.lit(0.0))
    at = F.least(F.floor(share * bins), F.lit(bins - 1))
    counts = resplits.join(ends, "alpha").groupBy("alpha", at.alias("bin")).agg(F.count("*").cast("double").alias("value"))
    hist = counts.select(
        F.lit("resplit").alias("plot"), F.col("alpha").cast("string").alias("key"), F.format_string("bin_%02d", "bin").alias("metric"), "value"
    )
    summary = C.resplit_summary(resplits, n_cal).join(ends, "alpha").select("alpha", "mean_fpr", "lo", "hi", "bound", "first", "last")
    both = M.by_category(records).where("attacked_unsafe is not null and defended_unsafe is not null")
    falls = both.select("category", "attacked_unsafe", "defended_unsafe", (F.col("attacked_unsafe") - F.col("defended_unsafe")).alias("reduction"))
    place = F.row_number().over(Window.orderBy("reduction", "category"))  # a row a category
    return (
        _points(dial, "alpha_dial", "alpha").unionByName(_points(sweep, "lambda_sweep", "lam")).unionByName(_points(summary, "resplit", "alpha"))
        .unionByName(hist).unionByName(_points(falls.withColumn("place", place.cast("double")), "category", "category"))
    )


def bundle(parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(part, key, metric, value) of several tables, each given with its key column; truth values are 1 and 0."""
    out = None
    for name, (key, df) in parts.items():
        rows = long(df, key).select(F.lit(name).alias("part"), "key", "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
