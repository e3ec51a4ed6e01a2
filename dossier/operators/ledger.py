"""The ledger of what was withheld: pages and boxes that are drawn, their order and places, and numbers by code.

Marks are (doc_id, page, rid, x, y, w, h, codes), pages (doc_id, page, aspect, ratio, codes). Drawing lists are bounded by fixed limits and
say what they leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
# The field that is drawn, its gaps, and how many pages and boxes it takes.
WIDTH, WIDEST, NARROWEST, GAP, BAND_GAP, LABEL, PACK_GAP = 1000.0, 200.0, 26.0, 6.0, 32.0, 24.0, 1.6
MOST_PAGES, MOST_BOXES = 1200, 8000


def clamped(boxes: DataFrame) -> DataFrame:
    """Boxes trimmed to the page; those with nothing left go."""
    edge = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = boxes.withColumns({"_x2": edge(F.col("x") + F.col("w")), "_y2": edge(F.col("y") + F.col("h")), "x": edge(F.col("x")), "y": edge(F.col("y"))})
    return out.withColumns({"w": F.col("_x2") - F.col("x"), "h": F.col("_y2") - F.col("y")}).where("w > 0 and h > 0").drop("_x2", "_y2")


def cells(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Marks with code, inherited, aspect and share. A mark has its own first code, or the only one of its page, which is then inherited."""
    known = pages.select(*PAGE, F.when(F.col("aspect").between(0.2, 5.0), F.col("aspect")).otherwise(1.294).alias("aspect"), F.when(F.size("codes") == 1, F.col("codes")[0]).alias("only"))
    out = clamped(marks).join(known, PAGE)
    own = F.when(F.size("codes") > 0, F.col("codes")[0])
    return out.withColumns({"code": F.coalesce(own, "only", F.lit("")), "inherited": own.isNull() & F.col("only").isNotNull(), "share": F.col("w") * F.col("h")}).drop("codes", "only")


def selected(drawn: DataFrame, most_pages: int = MOST_PAGES, most_boxes: int = MOST_BOXES) -> DataFrame:
    """The marks that are drawn: of the pages with most withheld, the largest marks. Ties go by place."""
    page_share = drawn.groupBy(*PAGE).agg(F.sum("share").alias("page_share"))
    top = page_share.orderBy(F.desc(F.round("page_share", 12)), *PAGE).limit(most_pages)
    return drawn.join(F.broadcast(top.select(*PAGE)), PAGE, "left_semi").orderBy(F.desc(F.round("share", 12)), *PAGE, "y", "x").limit(most_boxes)


def left_out(drawn: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: pages and marks that are not drawn, and the share of the area that is."""
    count = lambda df, p: df.agg(F.count_distinct(*PAGE).alias(f"{p}_pages"), F.count("*").alias(f"{p}_marks"), F.coalesce(F.sum("share"), F.lit(0.0)).alias(f"{p}_area"))
    both = count(drawn, "all").crossJoin(count(chosen, "drawn"))  # one row beside one row
    return both.select((F.col("all_pages") - F.col("drawn_pages")).alias("n_pages_left"), (F.col("all_marks") - F.col("drawn_marks")).alias("n_marks_left"), F.when(F.col("all_area") > 0, F.col("drawn_area") / F.col("all_area")).otherwise(1.0).alias("area_share"))


def scaled(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, aspect)`` with cols, slot_w, slot_h and each page's w and h: equal areas, in a grid as wide as the field."""
    size = pages.agg(F.count("*").alias("n"), F.median("aspect").alias("usual"), F.min("aspect").alias("widest"), F.max("aspect").alias("tallest"))
    fewest, most = -(-(WIDTH + GAP) // (WIDEST + GAP)), max(1, (WIDTH + GAP) // (NARROWEST + GAP))
    size = size.withColumn("cols", F.least(F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.greatest("n", F.lit(1)) * 1.6)), F.lit(fewest)), F.lit(most)))
    size = size.withColumn("slot_w", (WIDTH - (F.col("cols") - 1) * GAP) / F.col("cols"))
    size = size.withColumn("area", F.col("slot_w") * F.col("slot_w") * F.greatest("widest", F.col("usual") / 1.35)).withColumn("slot_h", F.least(F.sqrt(F.col("area") * F.col("tallest")), F.col("slot_w") * F.col("usual") * 2.2))
    out = pages.crossJoin(F.broadcast(size.select("cols", "slot_w", "slot_h", "area", "usual")))  # one row
    out = out.withColumns({"w": F.sqrt(F.col("area") / F.col("aspect")), "h": F.sqrt(F.col("area") * F.col("aspect"))})
    fit = F.least(F.lit(1.0), F.col("slot_w") / F.col("w"), F.col("slot_h") / F.col("h"))
    out = out.withColumn("odd", fit < 0.999)
    return out.withColumns({"w": F.when(F.col("odd"), F.col("w") * fit).otherwise(F.col("w")), "h": F.when(F.col("odd"), F.col("h") * fit).otherwise(F.col("h"))})


def laid_out(pages: DataFrame) -> DataFrame:
    """``scaled`` pages with x and y: banded by document, from left to right in rows, feet on one line."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    placed = pages.withColumn("at", at)
    bands = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("cols").alias("c"), F.first("slot_h").alias("sh"))
    rows = F.ceil(F.col("n") / F.col("c"))
    bands = bands.withColumn("height", LABEL + rows * F.col("sh") + (rows - 1) * GAP + BAND_GAP)
    above = F.coalesce(F.sum("height").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # the documents of at most MOST_PAGES drawn pages
    top = bands.select("doc_id", (above + LABEL).alias("top"))
    column, row = F.col("at") % F.col("cols"), F.floor(F.col("at") / F.col("cols"))
    x = column * (F.col("slot_w") + GAP) + (F.col("slot_w") - F.col("w")) / 2
    y = F.col("top") + row * (F.col("slot_h") + GAP) + (F.col("slot_h") - F.col("h"))
    return placed.join(F.broadcast(top), "doc_id").withColumns({"x": x, "y": y}).drop("at", "top")


def packed(groups: DataFrame) -> DataFrame:
    """(band, rid, x, y): marks of each band (band, place, rid, w, h) packed into rows of the field's width, in order of place. One band is one group of at most MOST_BOXES."""

    def run(frame):
        x = y = tall = 0.0
        xs, ys = [], []
        frame = frame.sort_values("place")
        for w, h in zip(frame.w, frame.h, strict=True):
            if x and x + w > WIDTH:
                x, y, tall = 0.0, y + tall + PACK_GAP, 0.0
            xs.append(x)
            ys.append(y)
            x, tall = x + w + PACK_GAP, max(tall, h)
        return frame.assign(x=xs, y=ys)[["band", "rid", "x", "y"]]

    return groups.groupBy("band").applyInPandas(run, f"band string, rid {groups.schema['rid'].dataType.simpleString()}, x double, y double")


def by_size(drawn: DataFrame) -> DataFrame:
    """Marks with their place, the largest first, then by document, page and height."""
    return drawn.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("share", 12)), *PAGE, "y", "rid")))  # the drawn marks, MOST_BOXES at most


def by_code(drawn: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(code, n, inherited, total, median, largest, place): codes by what they came to, then in the vocabulary's order."""
    rows = drawn.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.col("inherited").cast("int")).alias("inherited"), F.sum("share").alias("total"), F.median("share").alias("median"), F.max("share").alias("largest"))
    order = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("code"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("total", 9)), F.when(order > 0, order).otherwise(len(vocabulary) + 1), "code")))


def blind_spots(pages: DataFrame, marks: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of what leaves no rectangle: missing control numbers, pages withheld in full, marks without a code, dark pages, pages without a picture."""
    count = lambda test: F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("int")), F.lit(0))
    of_pages = pages.agg(count(F.col("ratio") >= 0.9).alias("n_full"), count(F.col("dark")).alias("n_dark"), count(~F.col("rendered")).alias("n_unrendered"))
    of_marks = marks.agg(count(F.col("code") == "").alias("n_uncoded"))
    of_gaps = gaps.agg(F.count("*").alias("n_gaps"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_missing"))
    return of_pages.crossJoin(of_marks).crossJoin(of_gaps)  # one row each
