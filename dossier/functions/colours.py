"""Colours as files spell them, reduced to red, green and blue from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How near two colours are the same, and how dark a fill hides what is under it.
TOLERANCE, DARK = 0.05, 70 / 255


def rgb(raw: Column, scaled: bool = True) -> Column:
    """Gray, RGB or CMYK components as a struct (r, g, b); null for anything else. ``scaled``: components above 1 mean 0 to 255."""
    v = F.when(F.array_max(raw) > 1, F.transform(raw, lambda c: c / 255.0)).otherwise(raw) if scaled else raw
    at = lambda k: F.element_at(v, k)
    triple = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    ink = lambda k: (1 - at(k)) * (1 - at(4))
    n = F.size(raw)
    return F.when(n == 1, triple(at(1), at(1), at(1))).when(n == 3, triple(at(1), F.try_element_at(v, F.lit(2)), F.try_element_at(v, F.lit(3)))).when(n == 4, triple(ink(1), ink(2), ink(3)))


def same(a: Column, b: Column) -> Column:
    """Whether two reduced colours are the same; an unknown one is the same as nothing."""
    near = (F.abs(a["r"] - b["r"]) <= TOLERANCE) & (F.abs(a["g"] - b["g"]) <= TOLERANCE) & (F.abs(a["b"] - b["b"]) <= TOLERANCE)
    return F.coalesce(near, F.lit(False))


def dark(colour: Column) -> Column:
    return F.coalesce(0.299 * colour["r"] + 0.587 * colour["g"] + 0.114 * colour["b"] <= DARK, F.lit(False))
