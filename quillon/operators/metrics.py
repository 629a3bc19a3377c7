"""Rates, latencies, histograms and summaries of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.calibrate import ranked_values


def mean0(x: Column) -> Column:
    """Mean that is 0 without values."""
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def rate(x: str, where: Column | None = None) -> Column:
    """Null-skipping mean of a 0/1 column, null if nothing was measured."""
    c = F.col(x).cast("double")
    return F.avg(c if where is None else F.when(where, c))


RATES = {
    "flag_rate": "firewall_flagged", "judge_rate": "judged_correct", "attack_target_rate": "matched_attack_target",
    "unsafe_rate": "is_unsafe",
}


def summary(records: DataFrame, by: str) -> DataFrame:
    return records.groupBy(by).agg(
        F.count("*").alias("count"), mean0(F.col("firewall_flagged")).alias("flag_rate"),
        *[rate(c).alias(k) for k, c in RATES.items() if k != "flag_rate"],
    )


def by_category(records: DataFrame) -> DataFrame:
    """Unsafe rates of the attacked and defended variants; null and empty categories are left out."""
    return records.where(F.coalesce(F.col("category"), F.lit("")) != "").groupBy("category").agg(
        F.count("*").alias("count"),
        rate("is_unsafe", F.col("variant") == "attacked").alias("attacked_unsafe"),
        rate("is_unsafe", F.col("variant") == "defended_attack").alias("defended_unsafe"),
    )


def all_groups(records: DataFrame) -> DataFrame:
    """The summaries by variant, transform and category in one pass (grouping sets)."""
    named = records.withColumn("category", F.coalesce("category", F.lit("")))
    keys = [F.col(c) for c in ("variant", "transform", "category")]
    grouped = named.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("g"), F.count("*").alias("count"), rate("is_unsafe").alias("unsafe_rate"),
        rate("firewall_flagged").alias("flag_rate"),
    )
    dim = F.when(F.col("g") == 3, "variant").when(F.col("g") == 5, "transform").otherwise("category")
    return grouped.select(
        dim.alias("dim"), F.coalesce("variant", "transform", "category").alias("key"), "count", "unsafe_rate", "flag_rate"
    ).where("not (dim = 'category' and key = '')")


def reduction(records: DataFrame) -> DataFrame:
    """Absolute and relative fall of the unsafe rate, from rates rounded to four places."""
    r4 = records.agg(
        F.round(rate("is_unsafe", F.col("variant") == "attacked"), 4).alias("attacked"),
        F.round(rate("is_unsafe", F.col("variant") == "defended_attack"), 4).alias("defended"),
    )
    fall = F.col("attacked") - F.col("defended")
    return r4.select(
        "attacked", "defended", F.round(fall, 4).alias("absolute"),
        F.when(F.col("attacked") > 0, F.round(fall / F.col("attacked"), 4)).alias("relative"),
    )


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, p95, mean): the upper median and the value at rank int(0.95 n)."""
    n = F.col("n")
    ranks = {"median": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * F.lit(0.95)))}
    means = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("m_by")).agg(F.avg(value).alias("mean"))
    picked = ranked_values(df, [by], value, ranks)
    return picked.join(means, picked[by].eqNullSafe(means["m_by"])).drop("m_by")


def pilot_summary(records: DataFrame) -> DataFrame:
    attack, control, clean = F.col("variant") == "attack", F.col("variant") == "control", F.col("transform") == "clean"
    when = lambda cond, c: mean0(F.when(cond, F.col(c)))
    return records.agg(
        F.count_if(attack).alias("num_attack_records"), F.count_if(control).alias("num_control_records"),
        when(attack & clean, "attack_detected_before").alias("clean_asr_proxy"),
        when(attack & clean, "attack_detected_after").alias("defended_clean_asr_proxy"),
        when(attack & ~clean, "attack_detected_before").alias("transformed_asr_proxy"),
        when(attack & ~clean, "attack_detected_after").alias("defended_transformed_asr_proxy"),
        when(control, "firewall_flagged").alias("control_false_positive_rate"),
        when(control, "anchor_detected_after").alias("control_benign_retention_after"),
    )


def pilot_by_transform(records: DataFrame) -> DataFrame:
    return records.where("variant = 'attack'").groupBy("transform").agg(
        mean0(F.col("attack_detected_before")).alias("attack_detection_rate"),
        mean0(F.col("attack_detected_after")).alias("defended_attack_rate"),
        mean0(F.col("anchor_detected_after")).alias("benign_anchor_retention_after"),
    )


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, count, density) over equal bins; the last edge is inclusive."""
    lo, hi, n = edges[0], edges[-1], len(edges) - 1
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    inside = df.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    total = inside.agg(F.sum("count").alias("total"))
    return inside.crossJoin(F.broadcast(total)).select(
        "bin", "count", (F.col("count") / (F.col("total") * ((hi - lo) / n))).alias("density")
    )
