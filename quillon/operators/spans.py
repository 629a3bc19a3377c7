"""Words to spans to regions to windows, and the choice of spans to mask.

Words are one row each: image_id, ord (emission order), text, left, top,
width, height.  Windows run within an image; an image's words are bounded, so
no partition grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import affine as A

#: Height of the bands in which boxes of an image are compared.
BAND, COLUMN = 64, 512


def reading():
    """Reading order within an image."""
    return Window.partitionBy("image_id").orderBy("top", "left", "ord")


def line_spans(words: DataFrame, max_gap_x: int = 40, line_ratio: float = 0.7) -> DataFrame:
    """Adds line_id: a word joins its predecessor's line span if near in both directions."""
    before = {c: F.lag(c).over(reading()) for c in ("top", "left", "width", "height")}
    same_line = F.abs(F.col("top") - before["top"]) < F.greatest("height", before["height"]) * F.lit(line_ratio)
    close = F.col("left") - (before["left"] + before["width"]) < max_gap_x
    starts = F.when(before["top"].isNull() | ~(same_line & close), 1).otherwise(0)
    return words.withColumn("starts", starts).withColumn("line_id", F.sum("starts").over(reading()) - 1).drop("starts")


def line_boxes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("image_id", "line_id").agg(
        F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"),
        F.max(F.col("top") + F.col("height")).alias("b"), F.count("*").alias("n_words"),
    )


def regions(lines: DataFrame, max_gap_y: int = 60) -> DataFrame:
    """(image_id, line_id, region_id): line spans folded into regions by the running extent."""
    boxes = line_boxes(lines).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("line_id", "l", "t", "r", "b"))).alias("lines")
    )
    # Spark copies a fold's state at every step: blocks of 64 lines are folded with what they add, then put together
    state = "named_struct('g', {0}.g, 'l', {0}.l, 'r', {0}.r, 'b', {0}.b, 'out', {1})"
    none = "cast(array() as array<int>)"
    block = f"""aggregate(block, {state.format('w', none)},
      (s, x) -> if(s.g >= 0 and x.t - s.b < {max_gap_y} and not (x.r < s.l or x.l > s.r),
        named_struct('g', s.g, 'l', cast(least(s.l, x.l) as int), 'r', cast(greatest(s.r, x.r) as int),
          'b', cast(greatest(s.b, x.b) as int), 'out', concat(s.out, array(s.g))),
        named_struct('g', s.g + 1, 'l', cast(x.l as int), 'r', cast(x.r as int), 'b', cast(x.b as int),
          'out', concat(s.out, array(s.g + 1)))),
      done -> {state.format('done', 'concat(w.out, done.out)')})"""
    fold = f"""aggregate(transform(sequence(0, (size(lines) - 1) div 64), i -> slice(lines, i * 64 + 1, 64)),
      named_struct('g', -1, 'l', 0, 'r', 0, 'b', 0, 'out', {none}), (w, block) -> {block}).out"""
    ids = boxes.select("image_id", "lines", F.expr(fold).alias("ids"))
    return ids.select("image_id", F.explode(F.arrays_zip("lines.line_id", "ids")).alias("x")).select(
        "image_id", F.col("x.line_id").alias("line_id"), F.col("x.ids").alias("region_id")
    )


def span_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """Words of a span joined by spaces in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("top", "left", "ord", "text")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def windows(spans: DataFrame, sizes=(1, 2, 3), carry: str | None = None) -> DataFrame:
    """Candidates of consecutive spans: (image_id, first, size, cand_idx, members).

    Spans are rows of (image_id, span_id).  Candidates are numbered singles
    first, then by size and position, as ties go to the earliest.  A carried
    column comes along as an array, one value per member.
    """
    order = Window.partitionBy("image_id").orderBy("span_id")
    own = F.struct(F.col("span_id").alias("id"), *([F.col(carry).alias("x")] if carry else []))
    at = spans.select("image_id", "span_id", own.alias("next0"))
    later = [F.lead("next0", k).over(order).alias(f"next{k}") for k in range(1, max(sizes))]
    at = at.select("image_id", "next0", (F.row_number().over(order) - 1).alias("first"), F.count("*").over(Window.partitionBy("image_id")).alias("n"), *later)
    # windows of size s start at n - s + 1 places; so many of each smaller size come before
    before, number = F.lit(0), {}
    for s in sorted(sizes):
        number[s] = before + F.col("first")
        before = before + F.greatest(F.col("n") - s + 1, F.lit(0))
    made = [
        F.when(
            F.col("first") + s <= F.col("n"),
            F.struct(F.lit(s).alias("size"), F.array(*[F.col(f"next{k}") for k in range(s)]).alias("m"), number[s].cast("int").alias("cand_idx")),
        )
        for s in sorted(sizes)
    ]
    out = at.select("image_id", "first", F.explode(F.array_compact(F.array(*made))).alias("c"))
    kept = [F.col("c.m.x").alias(carry)] if carry else []
    return out.select("image_id", "first", "c.size", F.col("c.m.id").alias("members"), "c.cand_idx", *kept)


def best_per_word(candidates: DataFrame) -> DataFrame:
    """(image_id, word, cand_idx, score): for each covered word the best candidate, the earliest on ties."""
    best = Window.partitionBy("image_id", "word").orderBy(F.desc("score"), "cand_idx")
    return (
        candidates.select("image_id", "cand_idx", "score", F.explode("members").alias("word"))
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .drop("rank")
    )


def chosen(candidates: DataFrame) -> DataFrame:
    """Distinct candidates that are best for some word."""
    return best_per_word(candidates).select("image_id", "cand_idx").distinct()


def masked_words(candidates: DataFrame) -> DataFrame:
    """All words of the chosen candidates; a word of two of them appears twice."""
    return candidates.join(chosen(candidates), ["image_id", "cand_idx"]).select(
        "image_id", "cand_idx", F.explode("members").alias("word")
    )


def consensus(primary: DataFrame, views: DataFrame, least_iou: float = 0.3, least_views: int = 1) -> DataFrame:
    """Primary boxes that enough views confirm: (image_id, box_id, n_views).

    Both sides hold image_id and box (l, t, r, b); views also hold view.  least_iou is above 0, so pairs that do not
    overlap are never compared.
    """
    from quillon.functions.vectors import iou

    # boxes that overlap share a cell of their image; a pair is met in the first cell of both alone
    def cells(box: str):
        return F.expr(
            f"""explode(flatten(transform(sequence(floor({box}.t / {BAND}), floor({box}.b / {BAND})),
            y -> transform(sequence(floor({box}.l / {COLUMN}), floor({box}.r / {COLUMN})), x -> struct(y, x)))))"""
        )

    mine = primary.select("image_id", "box_id", "box", cells("box").alias("cell"))
    other = views.select(F.col("image_id").alias("v_image"), "view", F.col("box").alias("v_box"), cells("box").alias("v_cell"))
    start = F.struct(F.floor(F.greatest("box.t", "v_box.t") / BAND).alias("y"), F.floor(F.greatest("box.l", "v_box.l") / COLUMN).alias("x"))
    near = mine.join(other, (F.col("image_id") == F.col("v_image")) & (F.col("cell") == F.col("v_cell"))).where(
        (F.col("cell") == start) & (iou(F.col("box"), F.col("v_box")) >= least_iou)
    )
    return near.groupBy("image_id", "box_id").agg(F.countDistinct("view").alias("n_views")).where(
        F.col("n_views") >= least_views
    )


def consensus_of_transforms(
    primary: DataFrame, found: DataFrame, least_iou: float = 0.3, least_views: int = 1
) -> DataFrame:
    """Primary boxes that boxes found in transformed views confirm: (image_id, box_id, n_views).

    found holds image_id, transforms (the names of a view's chain), width, height of the image, and box in the coordinates of the view, of
    which the part inside the image is mapped back; a view is a chain of transforms.
    """
    width, height = F.col("width"), F.col("height")
    seen = found.select("image_id", F.array_join("transforms", ">").alias("view"), "transforms", "width", "height", A.once(A.clipped(F.col("box"), width, height)).alias("box"))
    maps = seen.where("box is not null").withColumn("map", A.once(A.inverse(A.of_chain(F.col("transforms"), width, height))))
    back = maps.select("image_id", "view", A.once(A.mapped(F.col("map"), F.col("box"))).alias("box"))
    return consensus(primary, back, least_iou, least_views)
