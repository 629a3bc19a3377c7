"""Sharding by proportional stratified interleaving, law "rows".

Rows are shuffled within each source by a seeded hash of id, checksum and size and ranked; a row's
fractional rank is (rank + 1/2) / rows of its source.  Sorted by fractional
rank, every stretch of rows has the sources in the corpus' proportions, and
cutting it into equal stretches gives shards that all match the mixture, with
counts at most one apart.

No source is ever ranked in one task: rows fall into buckets by hash, or by
fractional rank; ranks within a bucket are added to the rows of the buckets
before it.  Only narrow columns are moved, never the text.

Defined cases: null sources are a source of their own, apart from any name; a
null text has size 1 and crc32 0, a long one is only measured; a null doc_id
hashes as the empty string, and texts under one id or none are told apart by checksum and size; repeated rows get places of their own, and ties of
the hash go by doc_id, checksum and size.  An empty table has no shards.  Only
doc_id, text and source are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.store import saved

SHARDS = 16
#: Rows wanted in a bucket, and the most buckets, whose counts are summed in one task.
BUCKET_ROWS = 100
MOST_BUCKETS = 65_536


def _ranked(rows: DataFrame, by: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Rows with their 0-based rank within ``by``, sorted by ``order``, which refines ``bucket``, and the rows ``of`` by.

    Only the counts of buckets, at most MOST_BUCKETS for each value of ``by``, are dealt by it alone.
    """
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *by, bucket, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("begin"), F.sum("c").over(whole).alias("of")
    )
    within = Window.partitionBy(*by, bucket).orderBy(*order)
    return (
        rows.withColumn(out, F.row_number().over(within) - 1)
        .join(starts, [*by, bucket])
        .withColumn(out, F.col(out) + F.col("begin"))
        .drop("begin", bucket)
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """One row per document: size, checksum, shard and slot."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    source = docs["source"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("\u0000")).alias("name"),  # sorts before other names; no_source tells it from such a name
    )
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), "text_crc32", "size")
    rows = saved(rows.withColumn("h", F.md5(key.cast("binary"))))
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    rows = rows.withColumn("hb", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 * buckets))
    rows = _ranked(rows, ["no_source", "name"], "hb", ["h", "doc_id", "text_crc32", "size"], "rank")
    rows = (
        rows.withColumn("place", (F.col("rank") + 0.5) / F.col("of"))
        .withColumn("fb", F.floor(F.col("place") * buckets))
        .withColumn("one", F.lit(0))
        .drop("of")
    )
    rows = _ranked(saved(rows), ["one"], "fb", ["place", "name", "h", "doc_id", "text_crc32", "size"], "pos")
    shard = F.expr(f"cast((pos * {shards}) div {max(1, n)} as int)")
    return rows.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"pos - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.when(~F.col("no_source"), F.col("name")).alias("source"),
    )
