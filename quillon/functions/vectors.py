"""Vector and box arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def inconsistency(cos: Column, floor: float = -0.1) -> Column:
    """Minus the cosine to the image, not below the floor."""
    return F.greatest(-cos, F.lit(floor))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def area(box: Column) -> Column:
    return F.greatest(box["r"] - box["l"], F.lit(0)) * F.greatest(box["b"] - box["t"], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (l, t, r, b); 0 if both are empty."""
    wide = F.greatest(F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.lit(0))
    high = F.greatest(F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), F.lit(0))
    both = wide * high
    union = area(a) + area(b) - both
    return F.when(union > 0, both.cast("double") / union).otherwise(0.0)


def padded(box: Column, pad: int = 8) -> Column:
    return F.struct(
        F.greatest(box["l"] - pad, F.lit(0)).alias("l"), F.greatest(box["t"] - pad, F.lit(0)).alias("t"),
        (box["r"] + pad).alias("r"), (box["b"] + pad).alias("b"),
    )


def polygon_box(points: Column) -> Column:
    """Box around an array of (x, y) arrays; null if it is degenerate."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    box = F.struct(
        F.array_min(xs).cast("int").alias("l"), F.array_min(ys).cast("int").alias("t"),
        F.array_max(xs).cast("int").alias("r"), F.array_max(ys).cast("int").alias("b"),
    )
    return F.when((box["r"] > box["l"]) & (box["b"] > box["t"]), box)


def through_crop(box: Column, width: Column, height: Column, ratio: float = 0.82) -> Column:
    """A box as seen after a centre crop that is scaled back to the full size."""
    dx, dy = width * (1 - ratio) / 2, height * (1 - ratio) / 2
    return F.struct(
        ((box["l"] - dx) / ratio).alias("l"), ((box["t"] - dy) / ratio).alias("t"),
        ((box["r"] - dx) / ratio).alias("r"), ((box["b"] - dy) / ratio).alias("b"),
    )


def overlay_origin(position: Column, width: Column, height: Column, box_w: Column, box_h: Column, margin: int = 16) -> Column:
    """(x, y) of an overlay box at one of the four positions."""
    right, bottom = width - box_w - margin, height - box_h - margin
    x = F.when(position.isin("bottom_right", "top_right"), right).when(position == "center", F.floor((width - box_w) / 2)).otherwise(margin)
    y = F.when(position == "bottom_right", bottom).when(position == "center", F.floor((height - box_h) / 2)).otherwise(margin)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
