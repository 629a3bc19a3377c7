"""Maps of image coordinates that scale and move each axis, as structs (sx, tx, sy, ty): x becomes sx * x + tx.

A transform of an image moves its boxes by such a map; chains are composed, and views are mapped back by the inverse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the transforms do to coordinates.
CROP_RATIO, BORDER, TITLE_BAR, TITLE_GAP = 0.82, 26, 40, 24
TRANSFORMS = ("clean", "resize", "jpeg", "crop", "rerender", "blur")


def affine(sx, tx, sy, ty) -> Column:
    parts = {"sx": sx, "tx": tx, "sy": sy, "ty": ty}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in parts.items()])


def identity() -> Column:
    return affine(1, 0, 1, 0)


def of_transform(name: Column, width: Column, height: Column) -> Column:
    """The map of a transform of an image of that size; null for an unknown name.

    Resizing there and back, compression and blur leave places as they are.  The crop keeps a centre of whole pixels and scales it to
    the full size; rerendering adds a border and a title bar and scales the canvas back.
    """
    kept_w, kept_h = F.floor(width * CROP_RATIO), F.floor(height * CROP_RATIO)
    left, top = F.floor((width - kept_w) / 2), F.floor((height - kept_h) / 2)
    crop = affine(width / kept_w, -left * width / kept_w, height / kept_h, -top * height / kept_h)
    wide, high = width / (width + 2 * BORDER), height / (height + 2 * BORDER + TITLE_BAR)
    rerender = affine(wide, BORDER * wide, high, (BORDER + TITLE_GAP) * high)
    return F.when(name.isin("clean", "resize", "jpeg", "blur"), identity()).when(name == "crop", crop).when(name == "rerender", rerender)


def composed(first: Column, then: Column) -> Column:
    """The map of one transform after another."""
    return affine(
        first["sx"] * then["sx"], first["tx"] * then["sx"] + then["tx"], first["sy"] * then["sy"], first["ty"] * then["sy"] + then["ty"]
    )


def of_chain(names: Column, width: Column, height: Column) -> Column:
    """The map of transforms one after another, an array of names; every one gives an image of the same size."""
    maps = F.transform(names, lambda n: of_transform(n, width, height))
    return F.aggregate(maps, identity(), lambda m, step: composed(m, step))


def inverse(m: Column) -> Column:
    return affine(1 / m["sx"], -m["tx"] / m["sx"], 1 / m["sy"], -m["ty"] / m["sy"])


def mapped(m: Column, box: Column) -> Column:
    """A box (l, t, r, b) as the map moves it."""
    return F.struct(
        (m["sx"] * box["l"] + m["tx"]).alias("l"), (m["sy"] * box["t"] + m["ty"]).alias("t"),
        (m["sx"] * box["r"] + m["tx"]).alias("r"), (m["sy"] * box["b"] + m["ty"]).alias("b"),
    )


def clipped(box: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the image; null if there is none."""
    inside = lambda x, most: F.greatest(F.least(x.cast("double"), most.cast("double")), F.lit(0.0))
    l, t, r, b = inside(box["l"], width), inside(box["t"], height), inside(box["r"], width), inside(box["b"], height)
    return F.when((r > l) & (b > t), F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def once(value: Column) -> Column:
    """The value as a generated column, which is computed once a row however often later columns name it."""
    return F.explode(F.array(value))
