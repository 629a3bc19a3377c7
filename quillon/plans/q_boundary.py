"""Queries through the boundaries: image files, batched models, backends, artifacts, seeds.

The models here are plain functions, so that SQL can say the same.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.functions import seeds
from quillon.functions import text as X
from quillon.operators import calibrate, chain, plugins
from quillon.plans.base import WORDS, draw, norm, query
from quillon.sources import fixtures as FX
from quillon.sources import images, manifest, sinks, wordboxes


@query("op008_image_headers", "SELECT item_id, 'png' AS format, item_id + 1 AS width, 2 * item_id + 1 AS height FROM benchmark WHERE item_id % 7 NOT IN (3, 5)")
def _(spark, d):
    """Bytes of PNG headers; every seventh image is missing and every seventh broken, and both are skipped."""
    size = lambda x: F.lpad(F.hex(x), 8, "0")
    i = F.col("item_id")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size(i + 1), size(2 * i + 1)))
    rows = FX.table(spark, d, "benchmark").select("item_id", F.when(i % 7 == 5, F.lit("broken").cast("binary")).when(i % 7 != 3, png).alias("image_bytes"))
    return images.decoded(rows).select("item_id", "header.format", "header.width", "header.height")


@query("op008_jpeg_headers", """SELECT item_id, 'jpeg' AS format, CASE WHEN item_id % 7 <> 5 THEN item_id + 1 END AS width, CASE WHEN item_id % 7 <> 5 THEN 2 * item_id + 1 END AS height
  FROM benchmark WHERE item_id % 7 <> 3""")
def _(spark, d):
    """JPEG behind segments of many lengths, up to some 190 KB of them; every seventh ends before its frame, every seventh is missing."""
    size = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    i = F.col("item_id")
    segment = F.concat(F.lit("FFE1"), size(i * 977 % 64_000 + 2, 2), F.expr("repeat('FF', cast(item_id * 977 % 64000 as int))"))
    lead = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), F.array_join(F.array_repeat(segment, (i % 4).cast("int")), ""), F.lit("FFFF"))
    frame = F.concat(F.lit("FFC2001108"), size(2 * i + 1, 2), size(i + 1, 2), F.lit("03"))
    bytes_ = F.unhex(F.concat(lead, F.when(i % 7 != 5, frame).otherwise("")))
    rows = FX.table(spark, d, "benchmark").select("item_id", F.when(i % 7 != 3, bytes_).alias("image_bytes"), F.lit(None).cast("string").alias("image_path"))
    return images.headers(rows).where("header is not null").select("item_id", "header.format", "header.width", "header.height")


def _word_rows(spark, d):
    """Words of the pages with what OCR adds: lines that are no words, blank text, boxes that are empty or not numbers."""
    w = FX.words(spark, d)
    n = F.expr("image_id + ord")
    return w.select(
        "image_id", (F.col("ord") / 1_000_000).cast("int").alias("line"), (F.col("ord") % 1_000_000).alias("spot"), "left", "top", "height", n.alias("n"),
        F.when(n % 11 == 0, " ").otherwise(F.regexp_replace("text", "[\\t\\r]", "_")).alias("text"),
        F.when(n % 13 == 0, "0").when(n % 17 == 0, "wide").otherwise(F.col("width").cast("string")).alias("width"),
    )


_KEPT = f"""WITH {WORDS}, kept AS (SELECT *, image_id + ord AS n FROM words WHERE (image_id + ord) % 11 <> 0 AND (image_id + ord) % 13 <> 0 AND (image_id + ord) % 17 <> 0)"""
_BOXES_READ = "count(*) AS n_words, CAST(sum(left_) AS BIGINT) AS sum_left, CAST(sum(top) AS BIGINT) AS sum_top, CAST(sum(width) AS BIGINT) AS sum_width, CAST(sum(length(trim(text))) AS BIGINT) AS n_chars"


def _totals(rows):
    return rows.groupBy(F.col("page").cast("long").alias("image_id")).agg(
        F.count("*").alias("n_words"), F.sum(F.col("left").cast("long")).alias("sum_left"), F.sum(F.col("top").cast("long")).alias("sum_top"),
        F.sum(F.col("width").cast("long")).alias("sum_width"), F.sum(F.length("text").cast("long")).alias("n_chars"),
    )


@query("op036_tsv_files", f"{_KEPT} SELECT image_id, {_BOXES_READ} FROM kept WHERE n % 5 <> 0 GROUP BY image_id")
def _(spark, d):
    """TSV files of many pages, written here with a header each and read back."""
    r = _word_rows(spark, d)
    rows = r.select(
        F.when(F.col("n") % 5 == 0, "4").otherwise("5").alias("level"), F.col("image_id").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
        F.col("line").alias("line_num"), F.col("spot").alias("word_num"), "left", "top", "width", "height", F.lit(91.5).alias("conf"), "text",
    )
    path = f"{sinks.scratch_folder(spark)}/words.tsv"
    rows.write.option("header", True).option("sep", "\t").option("quote", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return _totals(wordboxes.read(spark, path, "tsv"))


@query("op036_hocr_files", f"{_KEPT} SELECT image_id, {_BOXES_READ} FROM kept GROUP BY image_id")
def _(spark, d):
    """hOCR, a document for each page with the page's number in front of its words."""
    r = _word_rows(spark, d).where("width != 'wide'")
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    right, bottom = F.col("left") + F.col("width").cast("int"), F.col("top") + F.col("height")
    box = F.concat_ws(" ", F.lit("bbox"), "left", "top", right, bottom)
    word = F.concat(F.lit("<span class='ocrx_word' title='"), box, F.lit("; x_wconf 91'>"), text, F.lit("</span>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "spot", word.alias("w")))), lambda x: x["w"]), "\n")
    pages = r.groupBy("image_id").agg(body.alias("body"))
    number = F.concat(F.lit("<span class='ocrx_word' title='bbox 0 0 1 1'>page "), F.col("image_id").cast("string"), F.lit("</span>"))
    path = f"{sinks.scratch_folder(spark)}/pages.hocr"
    pages.select(F.concat(F.lit("<html><div class='ocr_page'>"), number, "body", F.lit("</div></html>"))).write.text(path)
    rows = wordboxes.read(spark, path, "hocr")
    marks = rows.where("text like 'page %' and ord = 0").select(F.col("file").alias("m_file"), F.col("page").alias("m_page"), F.substring("text", 6, 20).cast("long").alias("number"))
    own = rows.where("not (text like 'page %' and ord = 0)").join(marks, (F.col("file") == F.col("m_file")) & (F.col("page") == F.col("m_page")))
    return _totals(own.drop("page").withColumnRenamed("number", "page"))


@query("op037_polygon_files", f"{_KEPT} SELECT image_id, {_BOXES_READ} FROM kept GROUP BY image_id")
def _(spark, d):
    """JSON lines of polygons, a record an image; the box around each polygon."""
    r = _word_rows(spark, d)
    x, y = F.col("left").cast("string"), F.col("top").cast("string")
    right = F.when(F.col("width") == "wide", F.lit('"x"')).otherwise((F.col("left") + F.col("width").try_cast("int")).cast("string"))
    bottom = (F.col("top") + F.col("height")).cast("string")
    points = F.concat(F.lit("[["), F.concat_ws("],[", *[F.concat_ws(",", a, b) for a, b in ((x, y), (right, y), (right, bottom), (x, bottom))]), F.lit("]]"))
    result = F.concat(F.lit("["), points, F.lit(","), F.substring_index(F.to_json(F.struct(F.col("text").alias("t"))), '{"t":', -1))
    closed = F.concat(F.expr("left(res, length(res) - 1)"), F.lit(",0.5]"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "spot", "word"))), lambda w: w["word"]), ",")
    rows = r.withColumn("res", result).withColumn("word", closed).groupBy("image_id").agg(listed.alias("words"))
    path = f"{sinks.scratch_folder(spark)}/words.jsonl"
    rows.select(F.concat(F.lit('{"image":"'), F.col("image_id").cast("string"), F.lit('.png","words":['), "words", F.lit("]}"))).write.text(path)
    found = wordboxes.read(spark, path, "polygons")
    return _totals(found.drop("page").withColumn("page", wordboxes.image_of(F.col("file"))))


def _encoder():
    return lambda texts: [[float(len(t or "")), float((t or "").count(" "))] for t in texts]


@query("op127_batched_encoder", "SELECT item_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS x, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS DOUBLE) AS y FROM benchmark")
def _(spark, d):
    rows = FX.table(spark, d, "benchmark").select("item_id", "text")
    encode = plugins.batched("text_encoder", _encoder, ["text"], "embedding", "array<double>", batch=16)
    return encode(rows).select("item_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


def _first_words():
    return lambda prompts: [(p or "")[:20] for p in prompts]


@query("op128_generate", "SELECT conv_id, turn, substr(coalesce(text, ''), 1, 20) AS response FROM conversations WHERE role = 'user'")
def _(spark, d):
    """A backend by the name that a configuration gives (OP-153)."""
    plugins.register_backend("first_words", plugins.batched("generate", _first_words, ["text"], "response", "string"))
    rows = FX.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return plugins.backend("first_words")(rows).select("conv_id", "turn", "response")


def _classifier():
    return lambda prompts, responses: [f"unsafe\nS{len(r) % 9}" if len(p) % 3 == 0 else "safe" for p, r in zip(prompts, responses)]


@query("op130_safety_batch", "SELECT conv_id, turn, CASE WHEN length(answer) % 3 = 0 THEN 1 ELSE 0 END AS is_unsafe, CASE WHEN length(answer) % 3 = 0 THEN 'S' || length(text) % 9 ELSE 'safe' END AS harm_category FROM (SELECT conv_id, turn, coalesce(text, '') AS text, repeat('x', CAST(conv_id % 7 AS INT)) AS answer FROM conversations WHERE role = 'assistant')")
def _(spark, d):
    rows = FX.responses(spark, d).select("conv_id", "turn", F.coalesce("response", F.lit("")).alias("response"), F.expr("repeat('x', cast(conv_id % 7 as int))").alias("prompt"))
    judged = plugins.batched("safety", _classifier, ["prompt", "response"], "raw_verdict", "string")(rows)
    flag, kind = X.judged_verdict(F.col("raw_verdict"))
    return judged.select("conv_id", "turn", flag.alias("is_unsafe"), kind.alias("harm_category"))


_TOKENS = ("license", "worthless", "pathetic")
_HAS_TOKEN = " OR ".join(f"contains({norm('text')}, '{t}')" for t in _TOKENS)


@query("op163_staged_run", f"""WITH d AS (SELECT CAST({_HAS_TOKEN} AS INT) AS hit FROM documents), v AS (SELECT unnest(['base', 'attacked', 'defended_attack', 'defended_control']) AS variant)
  SELECT variant, count(*) AS count, round(avg(CASE WHEN variant LIKE 'defended%' THEN hit ELSE 0 END), 6) AS flag_rate, round(avg(CASE WHEN variant LIKE 'defended%' THEN 1 - hit ELSE 1 END), 6) AS judge_rate FROM d, v GROUP BY variant""")
def _(spark, d):
    """A run over images that show the documents: words, keyword detections, answers and records, kept stage by stage."""
    folder = sinks.scratch_folder(spark)
    docs = FX.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    record = F.struct(F.col("sample_id").alias("id"), F.concat("sample_id", F.lit(".png")).alias("image"), F.lit("look").alias("prompt"), F.lit("A").alias("answer"), F.array(F.lit("A. x"), F.lit("B. y")).alias("choices"))
    docs.select(F.to_json(record)).write.text(f"{folder}/manifest.jsonl")
    box = lambda w, i: F.struct(w.alias("text"), (60 * i).alias("left"), F.lit(10).alias("top"), F.lit(50).alias("width"), F.lit(12).alias("height"))
    shown = docs.select("sample_id", F.transform(F.split("text", " "), box).alias("words"))
    plugins.register("render", lambda df: df.withColumn("image_bytes", F.lit(b"")))
    plugins.register("ocr", lambda df: df.join(shown, "sample_id"))
    plugins.register("generate", lambda df: df.withColumn("response", F.when(F.size("mask") > 0, "B").otherwise("A")))
    config = manifest.RunConfig.of({"manifest_path": f"{folder}/manifest.jsonl", "output_dir": f"{folder}/run", "transforms": ["clean"], "judge_mode": "mcq", "use_multiview_firewall": False})
    summary = chain.execute(spark, config, rounds=1, tokens=_TOKENS)
    return summary.select("variant", "count", F.round("flag_rate", 6).alias("flag_rate"), F.round("judge_rate", 6).alias("judge_rate"))


@query("op134_seeded_draws", f"SELECT doc_id, {draw(seeds.seed_for('sample'), 'doc_id')} AS draw FROM documents")
def _(spark, d):
    return FX.table(spark, d, "documents").select("doc_id", calibrate.hash_key(seeds.seed_for("sample"), F.col("doc_id")).alias("draw"))


@query("op157_artifact", "SELECT 'steps ' || count(*) AS final_text, round(min(value), 6) AS final_loss, '' AS intent FROM events")
def _(spark, d):
    best = FX.table(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("loss")).first()
    path = f"{sinks.scratch_folder(spark)}/artifact.json"
    made = spark.createDataFrame([(json.dumps({"final_text": f"steps {best.n}", "final_loss": best.loss, "history": [1, 2]}),)], "value string")
    made.coalesce(1).write.text(path)
    return manifest.read_artifact(spark, path)
