"""Frames of pages: points and fractions, rotations, crops and resolutions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points an inch, whole parts of a page in compact boxes, and the size of a page that says none.
POINTS, PARTS, LETTER = 72.0, 10_000, (612.0, 792.0)


def of_edges(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def intersection(a, b) -> Column:
    """The box that two boxes (x1, y1, x2, y2) share; null if they only touch."""
    x1, y1, x2, y2 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    return F.when((x2 > x1) & (y2 > y1), of_edges(x1, y1, x2, y2))


def union(a, b) -> Column:
    return of_edges(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def to_parts(*edges: Column) -> Column:
    """Fractions as whole ten-thousandths, halves to even."""
    return F.array(*(F.bround(e * PARTS).cast("int") for e in edges))


def from_parts(parts: Column) -> Column:
    return F.transform(parts, lambda p: p / F.lit(float(PARTS)))


def from_points(x1, top, x2, bottom, width, height) -> Column:
    """Points to a box in fractions of the page; a page without size gives an empty box."""
    some = (width > 0) & (height > 0)
    part = lambda v, of: F.when(some, v / of).otherwise(0.0)
    return F.struct(part(x1, width).alias("x"), part(top, height).alias("y"), part(x2 - x1, width).alias("w"), part(bottom - top, height).alias("h"))


def upright(x0, y0, x1, y1) -> Column:
    """A rectangle with its corners in order; null if one is not a number."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = ~(bad(x0) | bad(y0) | bad(x1) | bad(y1))
    return F.when(sound, F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")))


def displayed(media: Column, crop: Column, rotation: Column, width: Column, height: Column) -> Column:
    """(w, h, dx, dy): the size of what a reader sees of a page, and where its lower left corner is in the frame of the whole page.

    media and crop are ``upright``; a crop that leaves nothing counts as none.
    """
    x0, y0, x1, y1 = F.greatest(media["x0"], crop["x0"]), F.greatest(media["y0"], crop["y0"]), F.least(media["x1"], crop["x1"]), F.least(media["y1"], crop["y1"])
    cut = F.coalesce((media["x1"] > media["x0"]) & (media["y1"] > media["y0"]) & (x1 > x0) & (y1 > y0), F.lit(False))
    left, low, right, high = x0 - media["x0"], y0 - media["y0"], media["x1"] - x1, media["y1"] - y1
    wide, tall = x1 - x0, y1 - y0
    frame = lambda w, h, dx, dy: F.struct(w.alias("w"), h.alias("h"), dx.alias("dx"), dy.alias("dy"))
    turned = F.when(rotation == 90, frame(tall, wide, low, right)).when(rotation == 180, frame(wide, tall, right, high)).when(rotation == 270, frame(tall, wide, high, left)).otherwise(frame(wide, tall, left, low))
    return F.when(cut, turned).otherwise(frame(width, height, F.lit(0.0), F.lit(0.0)))


def flipped(box, page_height, dx, dy) -> Column:
    """Edges measured upwards to (top, bottom, left, right) measured downwards from the corner of what is shown."""
    return F.struct((page_height - (box["y1"] - dy)).alias("top"), (page_height - (box["y0"] - dy)).alias("bottom"), (box["x0"] - dx).alias("left"), (box["x1"] - dx).alias("right"))


def turned_back(x, y, w, h, degrees) -> Column:
    """A box on a page that was turned for reading, on the page as it is."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    turn = F.pmod(degrees, F.lit(360))
    return F.when(turn == 90, box(y, 1 - x - w, h, w)).when(turn == 180, box(1 - x - w, 1 - y - h, w, h)).when(turn == 270, box(1 - y - h, x, h, w)).otherwise(box(x, y, w, h))


def pixels(points: Column, dpi: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(points * dpi / POINTS)).cast("bigint")


def resolution(width, height, dpi, widest, most_pixels) -> Column:
    """Dots an inch for a page: enough for its widest picture, within the budget of pixels."""
    wanted = F.greatest(dpi, F.ceil(widest * POINTS / width))
    budget = F.floor(POINTS * F.sqrt(most_pixels / (width * height)))
    return F.when((width > 0) & (height > 0), F.greatest(F.lit(1), F.least(wanted, budget))).otherwise(dpi).cast("int")


def fitted(width, height, dpi, most_pixels) -> Column:
    """The highest resolution of at most ``dpi`` whose picture, rounded up, is within the budget."""
    tried = F.sequence(F.lit(1), F.greatest(dpi.cast("int"), F.lit(1)))
    return F.coalesce(F.array_max(F.filter(tried, lambda d: pixels(width, d) * pixels(height, d) <= most_pixels)), F.lit(1))


def proportion(width, height) -> Column:
    """Width over height, that of a letter page where it is unknown."""
    return F.coalesce(F.when((width > 0) & (height > 0), width / height), F.lit(LETTER[0] / LETTER[1]))
