"""Word boxes that OCR programs left in files: TSV, hOCR and JSON with polygons.

Every reader gives (file, page, ord, text, left, top, width, height, conf).  Files are read by Spark's own readers, so they may
be in any store that Spark reads, TSV lines are split over tasks, and a filter on the file is applied
before files are opened.  ``recorded`` makes such files the plug-in of the stage "ocr".

Rows without text, or whose numbers do not parse, or with an empty box are left out, as are lines of TSV that are not words (level
5).  A TSV header other than HEADER raises.  Quotes are letters like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.affine import once
from quillon.sources import files

#: The columns of a TSV of words.
HEADER = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
_COLUMNS = ["file", "page", "ord", "text", "left", "top", "width", "height", "conf"]
#: Names of characters in hOCR, the ampersand last.
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _whole(df: DataFrame) -> DataFrame:
    return df.where("text != '' and width > 0 and height > 0 and ord is not null and left is not null and top is not null and conf is not null").select(_COLUMNS)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of TSV files; a file may hold several pages.  ord follows the numbers of block, paragraph, line and word."""
    lines = spark.read.text(path).selectExpr("_metadata.file_path as file", "value")
    cells = lines.select("file", F.split("value", "\t").alias("c")).where("size(c) > 1")
    named = {name: F.get("c", F.lit(i)) for i, name in enumerate(HEADER)}
    wrong = F.raise_error(F.concat(F.lit("unexpected columns of words in "), F.col("file"))).cast("boolean")
    is_header = F.array_contains("c", "left") & F.array_contains("c", "text")
    checked = cells.where(F.when(is_header, F.when(F.col("c") == F.array(*map(F.lit, HEADER)), False).otherwise(wrong)).otherwise(True))
    number = lambda name: F.trim(named[name]).try_cast("int")
    place = F.lit(0).cast("long")
    for name, size in (("block_num", 1), ("par_num", 10_000), ("line_num", 10_000), ("word_num", 1_000_000)):
        place = place * size + number(name)
    rows = checked.where(named["level"] == "5").select(
        "file", number("page_num").alias("page"), place.alias("ord"), F.trim(named["text"]).alias("text"),
        *[number(k).alias(k) for k in ("left", "top", "width", "height")], F.trim(named["conf"]).try_cast("double").alias("conf"),
    )
    return _whole(rows)


def _unescaped(text: Column) -> Column:
    plain = F.regexp_replace(text, "<[^>]*>", "")
    for name, character in _NAMED:
        plain = F.replace(plain, F.lit(name), F.lit(character))
    return F.trim(plain)


def read_hocr(spark: SparkSession, path: str) -> DataFrame:
    """Words (class ocrx_word) of hOCR files, whose pages are counted from 1; a file is read by one task."""
    docs = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "value")
    pages = docs.select("file", F.posexplode(F.split("value", "class=[\"']ocr_page[\"']")).alias("page", "body"))
    word = r"(?s)<span\b([^>]*\bclass=[\"']ocrx_word[\"'][^>]*)>(.*?)</span>"
    both = F.arrays_zip(F.regexp_extract_all("body", F.lit(word), 1).alias("head"), F.regexp_extract_all("body", F.lit(word), 2).alias("inner"))
    rows = pages.select("file", "page", F.posexplode(both).alias("ord", "w"))
    box = r"\bbbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)"
    l, t, r, b = (F.regexp_extract("w.head", box, k).try_cast("int") for k in (1, 2, 3, 4))
    conf = F.coalesce(F.regexp_extract("w.head", r"\bx_wconf (-?[\d.]+)", 1).try_cast("double"), F.lit(-1.0))
    return _whole(rows.select(
        "file", F.col("page").cast("int").alias("page"), F.col("ord").cast("long").alias("ord"), _unescaped(F.col("w.inner")).alias("text"),
        l.alias("left"), t.alias("top"), (r - l).alias("width"), (b - t).alias("height"), conf.alias("conf"),
    ))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Words of JSON records {"image": name, "words": [[polygon, text, confidence], ...]}, the box around each polygon.

    file is the image's name, page 1.  Results that are no list of three are left out.
    """
    rows = files.records(spark, path).select(
        F.expr("variant_get(record, '$.image', 'string')").alias("file"),
        F.posexplode(F.expr("try_variant_get(record, '$.words', 'array<variant>')")).alias("ord", "result"),
    )
    part = lambda k, kind: F.expr(f"try_variant_get(result, '$[{k}]', '{kind}')")
    ends = lambda axis: F.transform(part(0, "array<array<double>>"), lambda p: F.get(p, F.lit(axis)).cast("int"))
    boxed = rows.select("file", F.col("ord").cast("long").alias("ord"), F.trim(part(1, "string")).alias("text"), part(2, "double").alias("conf"), once(F.struct(ends(0).alias("x"), ends(1).alias("y"))).alias("p"))
    whole = boxed.where("forall(p.x, v -> v is not null) and forall(p.y, v -> v is not null)")
    l, r, t, b = F.array_min("p.x"), F.array_max("p.x"), F.array_min("p.y"), F.array_max("p.y")
    return _whole(whole.select("file", F.lit(1).alias("page"), "ord", "text", l.alias("left"), t.alias("top"), (r - l).alias("width"), (b - t).alias("height"), "conf"))


READERS = {"tsv": read_tsv, "hocr": read_hocr, "polygons": read_polygons}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format of words: {kind}")
    return READERS[kind](spark, path)


def image_of(file: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(file, r"([^/]*?)(\.[^./]*)?$", 1)


def recorded(path: str, kind: str) -> Callable[[DataFrame], DataFrame]:
    """A plug-in for the stage "ocr": adds words, an array in the order of the file, to samples by the name of their image.

    Images of which nothing was recorded have an empty array.  Several pages of a file are one image.
    """

    def add(samples: DataFrame) -> DataFrame:
        box = F.struct("page", "ord", "text", "left", "top", "width", "height", "conf")
        found = read(samples.sparkSession, path, kind).groupBy(image_of(F.col("file")).alias("of_image")).agg(F.array_sort(F.collect_list(box)).alias("words"))
        none = F.array().cast(found.schema["words"].dataType)
        joined = samples.join(found, image_of(F.col("image_path")) == F.col("of_image"), "left")
        return joined.withColumn("words", F.coalesce("words", none)).drop("of_image")

    return add
