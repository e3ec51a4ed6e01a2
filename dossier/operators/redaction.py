"""Redactions from what a page's file says: glyphs, filled rectangles and the order in which they were painted.

Glyphs are (doc_id, page, gid, seq, text, x, y, w, h, colour, invisible), rectangles (doc_id, page, rid, seq, x, y, w, h, page_w, page_h, filled,
opacity, colour); places are fractions of the page, page_w and page_h points, colours reduced (``colours.rgb``), seq null where the order is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossier.functions import colours
from dossier.functions import geometry as g
from dossier.operators import spatial

PAGE = ["doc_id", "page"]
# Which rectangles can hide something, and what recovered text is worth a report.
OPAQUE, THIN, HEADER, COVERED, OVERPRINTED, KNOWN, INK = 0.99, 4.0, 43.0, 0.8, 0.5, 0.6, 0.002
JUNK = r"(?i)^(?:name\s+redacted|confidential|privileged|redacted)$"
DATE = r"^[0-3]?\d[/-][0-3]?\d[/-]\d{2,4}$"


def candidates(rects: DataFrame) -> DataFrame:
    """Filled, opaque rectangles that are no rules and not wholly in the page's top strip."""
    wide, tall = F.col("w") * F.col("page_w"), F.col("h") * F.col("page_h")
    return rects.where(F.col("filled") & (F.col("opacity") >= OPAQUE) & (wide > THIN) & (tall > THIN) & (F.col("y") * F.col("page_h") + tall > HEADER))


def covered(glyphs: DataFrame, rects: DataFrame) -> DataFrame:
    """Pairs of a glyph and a rectangle over it; columns of the rectangle are prefixed b_. A glyph without area counts by its centre."""
    other = spatial.banded(rects).select(*PAGE, "band", *(F.col(c).alias(f"b_{c}") for c in rects.columns if c not in PAGE))
    pairs = spatial.banded(glyphs).join(other, [*PAGE, "band"])
    own, cover = g.box(), g.box("b_")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = cx.between(cover[0], cover[2]) & cy.between(cover[1], cover[3])
    hit = F.when(g.area(own) > 0, g.overlap_ratio(own, cover) > COVERED).otherwise(inside)
    top = F.greatest(F.col("y"), F.col("b_y"))  # a pair counts in the band where its overlap begins
    return pairs.where(hit & (F.col("band") == F.greatest(F.lit(0), F.least(F.lit(spatial.BANDS - 1), F.floor(top * spatial.BANDS))))).drop("band")


def hidden(glyphs: DataFrame, rects: DataFrame) -> DataFrame:
    """Covered pairs of which the file says that the glyph can't be seen: painted before the rectangle, or in its colour."""
    before = F.coalesce(F.col("seq") < F.col("b_seq"), F.lit(False))
    return covered(glyphs, candidates(rects)).where(before | colours.same(F.col("colour"), F.col("b_colour")))


@F.pandas_udf(StringType())
def assembled(glyphs):
    """Glyphs (text, x, y, w, h) in reading order: lines by height, a space where a gap is wide."""
    import pandas as pd

    def one(run) -> str:
        run = sorted(run, key=lambda c: (c["y"], c["x"]))
        tall, wide = sorted(c["h"] for c in run), sorted(c["w"] for c in run if c["w"] > 0)
        slack, gap = max(tall[len(tall) // 2] / 2, 1e-6), wide[len(wide) // 2] / 4 if wide else float("inf")
        lines: list[list] = []
        for c in run:
            if not lines or abs(c["y"] - lines[-1][0]["y"]) > slack:
                lines.append([])
            lines[-1].append(c)
        texts = []
        for line in lines:
            line.sort(key=lambda c: c["x"])
            text, end = "", None
            for c in line:
                apart = end is not None and c["x"] - end > gap and not c["text"].isspace() and not text.endswith(" ")
                text, end = text + " " * apart + c["text"], c["x"] + c["w"]
            texts.append(text.strip())
        return "\n".join(t for t in texts if t)

    return pd.Series([one(run) if len(run) else "" for run in glyphs], dtype=object)


def is_real_text(text):
    """Whether a recovered text says something: more than one character, a word, and no word that stamps leave."""
    bare = F.trim(text)
    return (bare != "") & (F.length(F.replace(bare, F.substring(bare, 1, 1), F.lit(""))) > 0) & bare.rlike(r"[\p{L}\p{N}_]") & ~bare.rlike(JUNK)


def wiped(pairs: DataFrame) -> DataFrame:
    """(doc_id, page, rid, n, text) of the rectangles that hide glyphs; ``pairs`` come from ``hidden``. Gaps between words alone are no text."""
    glyph = F.struct("x", "y", "w", "h", "text")
    runs = pairs.groupBy(*PAGE, F.col("b_rid").alias("rid")).agg(F.sum((F.trim("text") != "").cast("int")).alias("n"), F.sort_array(F.collect_list(glyph)).alias("run"))
    return runs.where("n > 0").withColumn("text", assembled("run")).drop("run")


def findings(wiped_rects: DataFrame) -> DataFrame:
    """(doc_id, page, rid, text) worth a report. A page whose every text is a bare date is a form and has none."""
    real = wiped_rects.where(is_real_text(F.col("text")))
    forms = F.bool_and(F.trim("text").rlike(DATE)).over(Window.partitionBy(*PAGE))
    return real.withColumn("form", forms).where("not form").select(*PAGE, "rid", "text")


def overlapping(boxes: DataFrame, known: DataFrame, share: float = KNOWN) -> DataFrame:
    """Boxes (rid) of which more than ``share`` lies inside one of the known ones."""
    met = spatial.meeting(boxes, known, key="rid", box_key="rid")
    return met.where(g.overlap_ratio(g.box(), g.box("b_")) > share).select(*PAGE, "rid").distinct()


def ledger(rects: DataFrame, wiped_rects: DataFrame, raster: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, rid, kind, x, y, w, h): rectangles that wiped out text or are dark, and blocks of the picture that none of them explains."""
    shapes = candidates(rects).join(wiped_rects.select(*PAGE, "rid", F.lit(True).alias("wiped")), [*PAGE, "rid"], "left")
    kept = shapes.where(F.coalesce("wiped", F.lit(False)) | colours.dark(F.col("colour"))).select(*PAGE, "rid", F.lit("vector").alias("kind"), "x", "y", "w", "h")
    if raster is None:
        return kept
    new = raster.join(overlapping(raster, kept), [*PAGE, "rid"], "left_anti")
    return kept.unionByName(new.select(*PAGE, "rid", F.lit("raster").alias("kind"), "x", "y", "w", "h"))


def overprinted(glyphs: DataFrame) -> DataFrame:
    """Invisible glyphs with more than half of them under a visible one: text that a stamp was painted over."""
    shown = glyphs.where(~F.col("invisible") & (F.trim("text") != ""))
    met = spatial.meeting(glyphs.where(F.col("invisible") & (F.trim("text") != "")), shown, key="gid", box_key="gid")
    return met.where(g.overlap_ratio(g.box(), g.box("b_")) > OVERPRINTED).select(*PAGE, "gid").distinct()


def unseen_words(words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Words (pos, ink) that are made of invisible glyphs alone and stand on blank paper. ``ink``: share of dark pixels under the word, null without a picture."""
    centre = glyphs.where(F.trim("text") != "").select(*PAGE, "gid", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"), "invisible")
    other = spatial.banded(words).select(*PAGE, "band", "pos", "ink", *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "w", "h")))
    pairs = spatial.banded(centre).join(other, [*PAGE, "band"])
    cover = g.box("b_")
    inside = pairs.where(F.col("x").between(cover[0], cover[2]) & F.col("y").between(cover[1], cover[3]))
    return inside.groupBy(*PAGE, "pos").agg(F.bool_and("invisible").alias("unseen"), F.first("ink").alias("ink")).where(F.col("unseen") & (F.col("ink") < INK)).select(*PAGE, "pos")
