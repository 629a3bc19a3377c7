"""Writers for records and summaries; empty inputs are fine everywhere."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, as CSV cannot hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in df.columns])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is named, only a single JVM may use a local folder."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "scratch")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Transforms that previews are kept of.
PREVIEWED = ("clean", "jpeg", "crop")


def previews(images: DataFrame, limit: int = 4, transforms=PREVIEWED) -> DataFrame:
    """The images to look at, with a file name: of the first samples, for some transforms.

    images hold index, sample_id, variant, transform and whatever is to be kept.
    """
    name = F.concat(F.col("sample_id"), F.lit("_"), F.col("transform"), F.lit("_"), F.col("variant"), F.lit(".png"))
    return images.where((F.col("index") < limit) & F.col("transform").isin(*transforms)).withColumn("file_name", name)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def document(df: DataFrame, key: str) -> DataFrame:
    """A keyed summary as one JSON document."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), rest))))).alias("document"))


def markdown(df: DataFrame, order: str) -> DataFrame:
    """A small table as one markdown text, rows sorted by a column."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), cells.alias("line"))))
    return df.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("markdown"))
