"""Box expressions. Boxes are (x, y, w, h) in fractions of a page, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """Edges (x1, y1, x2, y2) of the box in the columns prefix.x, prefix.y, prefix.w, prefix.h."""
    x, y, w, h = (F.col(f"{prefix}{k}") for k in "xywh")
    return x, y, x + w, y + h


def overlap(a, b) -> Column:
    """Area that two boxes share; touching boxes share none."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((width > 0) & (height > 0), width * height).otherwise(F.lit(0.0))


def area(a) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def overlap_ratio(a, b) -> Column:
    """Share of the first box inside the second; 0 for an empty box."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    both = overlap(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def shift(a, b) -> Column:
    """Distance of the centres."""
    return F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def remainder(a, b) -> Column:
    """What is left of the first box outside the second: up to four boxes (x1, y1, x2, y2)."""
    top, bottom = F.greatest(a[1], b[1]), F.least(a[3], b[3])

    def piece(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    pieces = F.array(
        piece(a[0], a[1], a[2], F.least(b[1], a[3])),
        piece(a[0], F.greatest(b[3], a[1]), a[2], a[3]),
        piece(a[0], top, F.least(b[0], a[2]), bottom),
        piece(F.greatest(b[2], a[0]), top, a[2], bottom),
    )
    kept = F.filter(pieces, lambda p: (p["x2"] > p["x1"]) & (p["y2"] > p["y1"]))
    return F.when(overlap(a, b) > 0, kept).otherwise(F.array(piece(*a)))
