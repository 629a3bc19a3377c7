"""A run from its configuration to records and a summary on disk.

What models make (detections, responses, verdicts) comes in as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import grid
from quillon.operators import metrics as M
from quillon.sources import manifest, sinks
from quillon.sources.manifest import RunConfig
from quillon.sources.samples import samples as read_samples

CELL = ("sample_id", "variant", "transform")


def work(samples: DataFrame, config: RunConfig) -> DataFrame:
    """The cells of a run: samples up to the limit by variant and transform."""
    grid.check_transforms(config.transforms)
    return grid.expand(
        manifest.head(samples, "index", config.limit), config.transforms, config.evaluate_base, config.evaluate_attacked,
        config.evaluate_defended, config.evaluate_control_defended, config.attack_positions,
    )


def records(
    samples: DataFrame, config: RunConfig, responses: DataFrame, detections: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """One record for each cell.

    responses hold CELL and response, detections CELL and suspicious_terms (a cell without one is not flagged) and may hold flagged,
    which otherwise follows from the terms; verdicts CELL and raw; without verdicts, is_unsafe and harm_category are null.
    """
    cells = work(samples, config)
    given = responses.select(*CELL, "response")
    found = cells.join(given, list(CELL), "left")
    none = F.array().cast("array<string>")
    if detections is not None:
        said = F.col("flagged") if "flagged" in detections.columns else F.size("suspicious_terms") > 0
        found = found.join(detections.select(*CELL, "suspicious_terms", said.alias("flagged")), list(CELL), "left")
        is_defended = F.startswith("variant", F.lit("defended"))
        terms = F.coalesce(F.when(is_defended, F.col("suspicious_terms")), none)
        flagged = F.coalesce(is_defended & F.col("flagged"), F.lit(False)).cast("int")
    else:
        terms, flagged = none, F.lit(0)
    raw = F.lit(None).cast("string")
    if verdicts is not None:
        found, raw = found.join(verdicts.select(*CELL, "raw"), list(CELL), "left"), F.col("raw")
    unsafe, kind = X.judged_verdict(raw)
    attacked = F.col("variant").isin("attacked", "defended_attack")
    return found.select(
        "sample_id", "category", "variant", "transform", "attack_position", "prompt", "response", "answer",
        X.judge(F.col("response"), F.col("answer"), config.judge_mode, F.col("task_type")).alias("judged_correct"),
        flagged.alias("firewall_flagged"), terms.alias("suspicious_terms"),
        F.when(attacked, F.col("attack_target")).alias("target_label"),
        F.when(attacked, X.matches_target(F.col("response"), F.col("attack_target"))).alias("matched_attack_target"),
        unsafe.alias("is_unsafe"), kind.alias("harm_category"),
    )


def write(rows: DataFrame, config: RunConfig, by: str = "variant") -> DataFrame:
    """config.json, records.json, records.csv and summary.json below the output folder; returns the summary by variant."""
    folder = config.output_dir.rstrip("/")
    settings = rows.sparkSession.createDataFrame([(manifest.as_json(config),)], "value string")
    settings.coalesce(1).write.mode("overwrite").text(f"{folder}/config.json")
    sinks.write_json(rows, f"{folder}/records.json")
    sinks.write_csv(rows, f"{folder}/records.csv")
    summary = M.summary(rows.sparkSession.read.schema(rows.schema).json(f"{folder}/records.json"), by)
    sinks.document(summary, by).coalesce(1).write.mode("overwrite").text(f"{folder}/summary.json")
    return summary


def run(
    spark: SparkSession, config: RunConfig, responses: DataFrame, detections: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Reads the manifest, makes the records and writes them with their summary."""
    samples = read_samples(spark, config.manifest_path, config.image_root, config.limit)
    samples = samples.withColumn("attack_text", F.coalesce("attack_text", F.lit(config.default_attack_text)))
    return write(records(samples, config, responses, detections, verdicts), config)


def queue(spark: SparkSession, configs: dict[str, RunConfig], inputs) -> list[str]:
    """Runs the configurations, by name, that have no summary yet; returns the names that ran.

    inputs(config) gives the arguments of ``run`` after the configuration.  A queue that was cut off goes on where it was.
    """
    hadoop, conf, ran = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), []
    for name, config in configs.items():
        done = hadoop(f"{config.output_dir.rstrip('/')}/summary.json/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            run(spark, config, *inputs(config))
            ran.append(name)
    return ran
