"""Extension: conformal thresholds over a stream of scores.

A stream keeps, for each group, how often each score came, which is Spark's own state and merges by adding.  Every batch hands the
counts that it changed to a sink that writes them under the batch's number: a batch that is replayed after a failure writes the same
folder again, so nothing is counted twice.  Thresholds are picked from the last counts, as over a table.

Scores are rounded, so the state is bounded by groups x steps of the scale.  Rows later than the watermark are dropped, as are
rows whose key came before within it; null scores are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import calibrate

DIGITS = 4


def counts(scores: DataFrame, group: str, score: str, key: str, ts: str = "ts", late: str = "10 minutes", digits: int = DIGITS) -> DataFrame:
    """(group, score, n) of a stream or a table."""
    known = scores.where(F.col(score).isNotNull())
    if known.isStreaming:
        known = known.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    else:
        known = known.dropDuplicates([key])
    return known.groupBy(F.col(group).alias("group"), F.round(score, digits).alias("score")).agg(F.count("*").alias("n"))


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the counts that changed, in a folder of the batch's number."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def last_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(group, score, n): of each score the count of the last batch that changed it."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return rows.groupBy("group", "score").agg(F.max_by("n", "batch").alias("n"))


def thresholds(found: DataFrame, alpha: float) -> DataFrame:
    """(group, n, tau) from counts of scores."""
    return calibrate.ranked_values(found, ["group"], "score", {"tau": calibrate.conformal_rank(F.col("n"), alpha)}, weight="n")


def follow(scores: DataFrame, group: str, score: str, key: str, folder: str, checkpoint: str, ts: str = "ts", late: str = "10 minutes"):
    """Starts a query that takes what is there, keeps the counts below folder and ends; started again, it goes on."""
    changed = counts(scores, group, score, key, ts, late)
    query = changed.writeStream.outputMode("update").foreachBatch(sink(folder)).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
