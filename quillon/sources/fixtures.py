"""Domain tables as pure functions of the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import grid
from quillon.sources.scan import table


def bank(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id < 30").select(F.col("vec_id").alias("rid"), "embedding")


def spans(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id >= 30").select(
        F.col("vec_id").alias("span_id"), (F.col("vec_id") % 50).alias("image_id"), "embedding", "label"
    )


def images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id < 50").select(F.col("vec_id").alias("image_id"), "embedding")


def records(spark, sf_dir, multiplier: int = 31):
    """Facts of one run: labels by variant and transform."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    base = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("index", F.col("doc_id"))
    cells = grid.expand(base)
    t = F.array_position(F.array(*map(F.lit, grid.TRANSFORMS)), F.col("transform")) - 1
    v = F.array_position(F.array(*map(F.lit, ("base", "attacked", "defended_attack", "defended_control"))), F.col("variant")) - 1
    df = cells.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("category"), "variant", "transform",
        "attack_position", F.col("quality").alias("judged_correct"), "doc_id", "toxic", t.alias("t_id"), v.alias("v_id"),
    )
    flag_at = F.expr("(13 * doc_id + 5 * t_id) % 10")
    flagged = F.expr("v_id = 2") & (flag_at < 8) | F.expr("v_id = 3") & (flag_at < 1)
    unsafe = F.expr(f"({multiplier} * doc_id + 17 * t_id + 7 * v_id) % 10 < 2 + 4 * toxic - if(v_id = 2, 1, 0)")
    return df.select(
        "sample_id", "category", "variant", "transform", "attack_position", "judged_correct",
        flagged.cast("int").alias("firewall_flagged"), F.lit(None).cast("int").alias("matched_attack_target"),
        unsafe.cast("int").alias("is_unsafe"),
    )


def words(spark, sf_dir):
    """Words of documents with the places of a simple page layout.

    Whole documents are dealt out once by image; the windows here and those over an image's words need no other shuffle.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text").repartition("image_id")
    line = docs.select("image_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    part = line.select("image_id", "line", F.posexplode(F.split("value", " ")).alias("at", "text"))
    before = Window.partitionBy("image_id", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({
        "prefix": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)),
        "in_line": F.coalesce(F.count_if(F.col("text") != "").over(before), F.lit(0)),
    }).where("text != ''")
    return part.select(
        "image_id", F.expr("cast(line as bigint) * 1000000 + in_line").alias("ord"), "text",
        F.expr("cast(20 * line + 70 * (line div 3) as int)").alias("top"),
        F.expr("cast(10 * prefix + 45 * (in_line div 5) as int)").alias("left"),
        F.expr("10 * length(text)").alias("width"), F.lit(16).alias("height"),
    )


def responses(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("response"), F.expr("chr(65 + conv_id % 5)").alias("answer")
    )
