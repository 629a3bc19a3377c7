"""Files of records, as one VARIANT a record: no inference pass, and any key of any record may have any type.

A path names a file or a folder of files, all of one ending: JSON lines (blank lines are skipped), JSON (a list, or an
object with a list under "data", whatever else it holds), or Parquet.  Records are numbered from 0 in the order of
file name and place, without gaps: places are known within a file or a block of it, and a table with one row per
block tells how many records come before, so no records are sorted or moved.

Defined cases: files without records are fine.  JSON that does not parse raises, as does a JSON document without a
list of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import prefix

_FILE, _BLOCK = "_metadata.file_path as file", "_metadata.file_block_start as block"


def _with_offset(rows: DataFrame, blocks: DataFrame, place: Column) -> DataFrame:
    """(index, record): rows with the number of records in the blocks before theirs added to their place in it.

    blocks has file, block and n, a row per block, whose n are summed up in order.
    """
    ends = prefix.running(blocks, ["file", "block"], "n", "upto", "sum")
    offsets = ends.select(F.col("file").alias("o_file"), F.col("block").alias("o_block"), (F.col("upto") - F.col("n")).alias("offset"))
    joined = rows.join(offsets, (F.col("file") == F.col("o_file")) & (F.col("block") == F.col("o_block")))
    return joined.select((F.col("offset") + place).cast("long").alias("index"), "record")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a block come in order to one task, so numbers that rise with the rows tell their place in it."""
    rows = spark.read.text(path).selectExpr(_FILE, _BLOCK, "value").where(F.col("value").rlike(r"\S")).withColumn("at", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    firsts = blocks.select(F.col("file").alias("f_file"), F.col("block").alias("f_block"), "first")
    own = rows.join(firsts, (F.col("file") == F.col("f_file")) & (F.col("block") == F.col("f_block")))
    return _with_offset(own.withColumn("record", F.parse_json("value")), blocks.select("file", "block", "n"), F.col("at") - F.col("first"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).selectExpr(_FILE, _BLOCK, "parse_json(value) as doc")
    listed = F.coalesce(F.expr("try_variant_get(doc, '$', 'array<variant>')"), F.expr("try_variant_get(doc, '$.data', 'array<variant>')"))
    wrong = F.raise_error(F.concat(F.lit("unsupported manifest format, no list of records: "), F.col("file")))
    found = docs.select("file", "block", F.when(listed.isNotNull(), listed).otherwise(wrong).alias("records"))
    blocks = found.select("file", "block", F.size("records").alias("n"))
    rows = found.select("file", "block", F.posexplode("records").alias("at", "record"))
    return _with_offset(rows, blocks, F.col("at"))


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    rows = table.selectExpr(_FILE, "0 as block", "_metadata.row_index as at", "to_variant_object(struct(*)) as record")
    blocks = table.selectExpr(_FILE).groupBy("file").agg(F.count("*").alias("n")).selectExpr("file", "0 as block", "n")
    return _with_offset(rows, blocks, F.col("at"))


READERS = {".jsonl": _lines, ".json": _documents, ".parquet": _parquet}


def records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(index, record): the records of a manifest, or its first ``limit`` ones."""
    reader = next((f for ending, f in READERS.items() if path.endswith(ending)), None)
    if reader is None:
        raise ValueError(f"unsupported manifest format: {path}")
    found = reader(spark, path)
    return found if limit is None else found.where(F.col("index") < limit)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The records as columns, each of the type that all its values have; a key of mixed types is a VARIANT."""
    found = records(spark, path)
    kind = found.agg(F.schema_of_variant_agg("record")).first()[0]
    if not kind.startswith("OBJECT<"):
        return found.select().limit(0)
    plain = kind.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING")
    return found.select(F.variant_get("record", "$", plain).alias("row")).select("row.*")
