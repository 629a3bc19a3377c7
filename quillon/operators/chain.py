"""A run that makes its own detections, stage by stage, and goes on where it was cut off.

Plug-ins render images, read words, encode, generate and judge; everything between them is a table.  Each stage keeps
one row per key below the output folder, appended in rounds, and a stage computes the keys that are not there yet: a run
that is started again after it was killed reads no image and asks no model twice, but for the round that was under way.

    cells -> words (of cells that are defended, of other views of them, of calibration images)
          -> threshold -> detections -> responses -> verdicts -> records and summary

Plug-ins get these columns: "render" sample_id, variant, transform, view, image_path, image_bytes, attack_text, attack_position and
mask (boxes to cover, null before detection); "ocr" what render made; "text_encoder" image_id and text; "image_encoder" what render
made; "generate" sample_id, variant, transform, prompt and what render made; "safety" prompt and response.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import calibrate, detect, plugins, run
from quillon.operators import spans as S
from quillon.sources.manifest import RunConfig
from quillon.sources.samples import samples as read_samples

#: A view is a transform of an image that is already transformed and overlaid; "" is the image itself.
KEY = ("sample_id", "variant", "transform", "view")
# The views that have to agree, how many of them, and what a semantic detection needs.
VIEWS, LEAST_VIEWS, LEAST_WORDS = ("resize", "jpeg", "crop"), 2, 2
CALIBRATION = "calibration"


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """What a stage has kept so far."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if there else None


def staged(rows: DataFrame, key: list[str], make: Callable[[DataFrame], DataFrame], path: str, rounds: int = 4) -> DataFrame:
    """make(rows) for every key, kept at path; only keys that are not there are computed, in so many appends.

    make must return one row per row, with the key.  Keys without nulls tell rows apart.
    """
    spark = rows.sparkSession
    for k in range(rounds):
        own = rows.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == k)
        done = kept(spark, path)
        todo = own if done is None else own.join(done.select(*key), key, "left_anti")
        if done is None or not todo.isEmpty():
            make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _image_id() -> Column:
    return F.concat_ws("/", *KEY)


def _words_of(rows: DataFrame) -> DataFrame:
    """(image_id, ord, text, left, top, width, height) of rows with words."""
    exploded = rows.select(_image_id().alias("image_id"), F.posexplode("words").alias("ord", "w"))
    return exploded.select("image_id", F.col("ord").cast("long").alias("ord"), "w.text", "w.left", "w.top", "w.width", "w.height")


def _read(rows: DataFrame) -> DataFrame:
    shown = plugins.apply("render", rows.withColumn("mask", F.lit(None).cast("array<struct<l:int,t:int,r:int,b:int>>")))
    return plugins.apply("ocr", shown).select(*KEY, "words")


def _encoded(rows: DataFrame) -> DataFrame:
    shown = plugins.apply("render", rows.withColumn("mask", F.lit(None).cast("array<struct<l:int,t:int,r:int,b:int>>")))
    return plugins.apply("image_encoder", shown).select(*KEY, _image_id().alias("image_id"), F.col("image_embedding").alias("embedding"))


def candidates(read: DataFrame) -> DataFrame:
    """(image_id, span_id, text, box) of spans of two words or more and of two and three consecutive spans."""
    lines = S.line_spans(_words_of(read))
    boxes = S.line_boxes(lines).select("image_id", "line_id", F.struct("l", "t", "r", "b").alias("box"))
    spans = S.span_text(lines, ["image_id", "line_id"]).join(boxes, ["image_id", "line_id"])
    made = S.windows(spans.select("image_id", F.col("line_id").alias("span_id"), F.struct("text", "box").alias("of")), (1, 2, 3), "of")
    text = F.array_join(F.transform("of", lambda s: s["text"]), " ")
    ends = lambda name: F.transform("of", lambda s: s["box"][name])
    box = F.struct(F.array_min(ends("l")).alias("l"), F.array_min(ends("t")).alias("t"), F.array_max(ends("r")).alias("r"), F.array_max(ends("b")).alias("b"))
    rows = made.select("image_id", F.col("cand_idx").alias("span_id"), text.alias("text"), box.alias("box"))
    return rows.where(F.size(F.split(F.trim("text"), r"\s+")) >= LEAST_WORDS)


def scored(read: DataFrame, images: DataFrame | None, bank: DataFrame, lam: float) -> DataFrame:
    """Candidates with their score: similarity to the bank, and with image embeddings the risk."""
    found = detect.score(plugins.apply("text_encoder", candidates(read)), bank, "arrow")
    if images is None:
        return found.withColumn("score", F.col("s_inst"))
    return detect.with_risk(found, images.select("image_id", "embedding"), lam).withColumn("score", F.col("risk"))


def _keyword(read: DataFrame, multiview: bool, tokens) -> DataFrame:
    """(image_id, suspicious_terms, mask) of the images themselves: terms that it shows or enough views agree on, and boxes of words."""
    own, words = read.where("view = ''"), _words_of(read.where("view = ''"))
    views = None
    if multiview:
        # words of a view belong to its image
        views = read.where("view != ''").select(F.concat(F.concat_ws("/", *KEY[:3]), F.lit("/")).alias("image_id"), "view", F.explode("words").alias("w"))
        views = views.select("image_id", "view", "w.text")
    hit = detect.keyword_firewall(words, views, tokens, LEAST_VIEWS)
    box = F.struct("left", "top", (F.col("left") + F.col("width")).alias("r"), (F.col("top") + F.col("height")).alias("b")).cast("struct<l:int,t:int,r:int,b:int>")
    covered = hit.groupBy("image_id").agg(F.collect_list(box).alias("mask"))
    terms = detect.agreed_terms(words, views, tokens, LEAST_VIEWS).groupBy("image_id").agg(F.array_sort(F.collect_set("term")).alias("suspicious_terms"))
    return own.select(_image_id().alias("image_id")).join(terms, "image_id", "left").join(covered, "image_id", "left")


def _semantic(found: DataFrame, tau: Column) -> DataFrame:
    hit = found.where(F.col("score") >= tau)
    return hit.groupBy("image_id").agg(F.array_sort(F.collect_set("text")).alias("suspicious_terms"), F.collect_list(F.col("box").cast("struct<l:int,t:int,r:int,b:int>")).alias("mask"))


def execute(spark: SparkSession, config: RunConfig, bank: DataFrame | None = None, rounds: int = 4, tokens=X.SUSPICIOUS_TOKENS) -> DataFrame:
    """Runs or goes on with a configuration; returns the summary by variant.

    bank (rid, embedding) is for the semantic and cmc defenses, tokens for the keyword defense.
    """
    folder = config.output_dir.rstrip("/")
    state = f"{folder}/stages"
    samples = read_samples(spark, config.manifest_path, config.image_root, config.limit)
    samples = samples.withColumn("attack_text", F.coalesce("attack_text", F.lit(config.default_attack_text)))
    cells = run.work(samples, config).withColumn("view", F.lit(""))
    is_defended = F.startswith("variant", F.lit("defended"))
    defended = cells.where(is_defended)
    terms = "suspicious_terms array<string>, mask array<struct<l:int,t:int,r:int,b:int>>"
    if config.defense_type == "none":
        detections = spark.createDataFrame([], f"image_id string, {terms}")
    else:
        by_model = config.defense_type in ("semantic", "cmc")
        to_read = defended
        if not by_model and config.use_multiview_firewall:
            to_read = to_read.unionByName(defended.withColumn("view", F.explode(F.array(*map(F.lit, VIEWS)))))
        calibrated = by_model and config.cmc_calibrate_fpr is not None
        if calibrated:
            clean = run.work(samples.where(F.col("index") < config.cmc_calibration_samples), replace(
                config, limit=None, transforms=("clean",), evaluate_base=True, evaluate_attacked=False, evaluate_defended=False, evaluate_control_defended=False))
            to_read = to_read.unionByName(clean.withColumn("variant", F.lit(CALIBRATION)).withColumn("view", F.lit("")))
        read = staged(to_read, list(KEY), _read, f"{state}/words", rounds)
        if not by_model:
            detections = staged(read.where("view = ''"), list(KEY), lambda todo: _detected_by_keyword(todo, read, config, tokens), f"{state}/detections", 1)
        else:
            if bank is None:
                raise ValueError(f"the defense {config.defense_type} needs a bank of reference vectors")
            bank = detect.bank_prefix(bank, config.reference_bank_size)
            images = staged(to_read, list(KEY), _encoded, f"{state}/images", rounds) if config.defense_type == "cmc" else None
            scores = lambda rows: rows.select(*KEY, _image_id().alias("image_id")).join(
                scored(rows, images, bank, config.cmc_lambda).groupBy("image_id").agg(F.collect_list(F.struct("text", "box", "score")).alias("found")), "image_id", "left")
            stored = staged(read, list(KEY), scores, f"{state}/scores", rounds)
            tau = F.lit(config.cmc_threshold if config.defense_type == "cmc" else config.semantic_threshold)
            if calibrated:
                most = stored.where(F.col("variant") == CALIBRATION).select(F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("max_risk"))
                one = calibrate.threshold(most, "max_risk", config.cmc_calibrate_fpr).first()  # one row
                tau = F.lit(one["tau"] if one else config.cmc_threshold)
                spark.createDataFrame([(config.cmc_calibrate_fpr, one["n"] if one else 0, one["tau"] if one else None)], "alpha double, n long, tau double").coalesce(1).write.mode("overwrite").json(f"{folder}/calibration.json")
            each = stored.where(F.col("variant") != CALIBRATION).select("image_id", F.explode("found").alias("s")).select("image_id", "s.text", "s.box", "s.score")
            detections = _semantic(each, tau)
    marked = cells.withColumn("image_id", _image_id()).join(detections.select("image_id", "suspicious_terms", "mask"), "image_id", "left")

    def answered(todo: DataFrame) -> DataFrame:
        return plugins.apply("generate", plugins.apply("render", todo)).select(*KEY, "response")

    responses = staged(marked, list(KEY), answered, f"{state}/responses", rounds)
    verdicts = None
    if config.safety_judge_path:
        pairs = cells.select(*KEY, "prompt").join(responses, list(KEY))
        judged = staged(pairs, list(KEY), lambda todo: plugins.apply("safety", todo).select(*KEY, "raw_verdict"), f"{state}/verdicts", rounds)
        verdicts = judged.withColumnRenamed("raw_verdict", "raw")
    found = marked.where(is_defended).select(*run.CELL, "suspicious_terms", F.coalesce(F.size("mask") > 0, F.lit(False)).alias("flagged"))
    return run.write(run.records(samples, config, responses, found, verdicts), config)


def _detected_by_keyword(todo: DataFrame, read: DataFrame, config: RunConfig, tokens) -> DataFrame:
    """Detections of images to do, from their words and, if asked for, those of their views."""
    wanted = todo.select(*KEY[:3])
    own = read.join(wanted, list(KEY[:3]), "left_semi")
    return todo.select(*KEY, _image_id().alias("image_id")).join(_keyword(own, config.use_multiview_firewall, tokens), "image_id", "left").select(*KEY, "image_id", "suspicious_terms", "mask")
