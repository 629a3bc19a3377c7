"""Reading of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Below so many bytes a table is not worth dealing out.
LEAST_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A plain scan, dealt out over the cores if its files split into fewer tasks than those.

    A table of few row groups would keep one core busy; tables with more
    splits than cores, as large ones have, are read as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < LEAST_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
