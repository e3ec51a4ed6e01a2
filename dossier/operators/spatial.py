"""Spatial joins of tokens with covering boxes, and areas of unions.

Boxes meet under an equality key: the page and horizontal bands of it. A box is listed in every band
that it touches, so the join is a hash join on (page, band) with an exact test behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.geometry import box, overlap_ratio

BANDS = 16
PAGE = ["doc_id", "page"]


def banded(boxes: DataFrame) -> DataFrame:
    first, last = (F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor(e * BANDS))) for e in (F.col("y"), F.col("y") + F.col("h")))
    return boxes.withColumn("band", F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def meeting(words: DataFrame, boxes: DataFrame, key: str = "pos", box_key: str = "rid") -> DataFrame:
    """Each word with each box of its page that it overlaps, once; columns of the box are prefixed b_."""
    other = banded(boxes).select(*PAGE, "band", *[F.col(c).alias(f"b_{c}") for c in (box_key, "x", "y", "w", "h")])
    pairs = banded(words).join(other, [*PAGE, "band"])
    own, cover = box(), box("b_")
    pairs = pairs.where((own[0] < cover[2]) & (cover[0] < own[2]) & (own[1] < cover[3]) & (cover[1] < own[3]))
    top = F.greatest(F.col("y"), F.col("b_y"))  # the pair counts in the band where its overlap begins
    return pairs.where(F.col("band") == F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor(top * BANDS)))).drop("band")


def visible(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words that no box touches: what may be shown."""
    return words.join(meeting(words, boxes).select(*PAGE, "pos").distinct(), [*PAGE, "pos"], "left_anti")


def covered(words: DataFrame, boxes: DataFrame, share: float = 0.8) -> DataFrame:
    """Pairs of a box and a word of which more than ``share`` lies inside it."""
    return meeting(words, boxes).where(overlap_ratio(box(), box("b_")) > share)


def in_regions(words: DataFrame, regions: DataFrame, share: float = 0.6) -> DataFrame:
    """Words whose overlaps with all regions add up to ``share`` of them."""
    inside = meeting(words, regions).groupBy(*PAGE, "pos").agg(F.sum(overlap_ratio(box(), box("b_"))).alias("inside"))
    return inside.where(F.col("inside") >= share)


def union_cells(boxes: DataFrame, columns: int = 800, rows: int = 1035) -> DataFrame:
    """(doc_id, page, cells): cells of a page grid that any box covers, edges rounded outward.

    A page's boxes are one row; they are painted on a grid in Arrow batches, which takes an array step a box instead of many rows.
    """
    grid = lambda e, n, up: F.greatest(F.lit(0), F.least(F.lit(n), (F.ceil if up else F.floor)(F.round(e * n, 9)))).cast("int")
    edges = boxes.select(*PAGE, grid(F.col("x"), columns, False).alias("x1"), grid(F.col("x") + F.col("w"), columns, True).alias("x2"), grid(F.col("y"), rows, False).alias("y1"), grid(F.col("y") + F.col("h"), rows, True).alias("y2"))
    pages = edges.where("x2 > x1 and y2 > y1").groupBy(*PAGE).agg(F.flatten(F.collect_list(F.array("x1", "x2", "y1", "y2"))).alias("edges"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        page = np.zeros((rows, columns), bool)
        for batch in batches:
            listed = batch.column(2)
            values, at = listed.flatten().to_numpy(), np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy())))
            cells = []
            for k in range(batch.num_rows):
                own = values[at[k] : at[k + 1]].reshape(-1, 4)
                for x1, x2, y1, y2 in own.tolist():
                    page[y1:y2, x1:x2] = True
                used = page[own[:, 2].min() : own[:, 3].max()]
                cells.append(int(np.count_nonzero(used)))
                used[:] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int64())], [*PAGE, "cells"])

    kinds = [boxes.schema[c].dataType.simpleString() for c in PAGE]
    return pages.mapInArrow(run, f"doc_id {kinds[0]}, page {kinds[1]}, cells bigint")


def layout(words: DataFrame, across: int = 8, down: int = 12) -> DataFrame:
    """(doc_id, page, cell, share): how much of each cell of a coarse grid the words cover, at most 1."""
    cell = lambda e, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(e * n))).cast("int")
    spread = words.withColumn("cx", F.explode(F.sequence(cell(F.col("x"), across), cell(F.col("x") + F.col("w"), across))))
    spread = spread.withColumn("cy", F.explode(F.sequence(cell(F.col("y"), down), cell(F.col("y") + F.col("h"), down))))
    width = F.least(F.col("x") + F.col("w"), (F.col("cx") + 1) / F.lit(float(across))) - F.greatest(F.col("x"), F.col("cx") / F.lit(float(across)))
    height = F.least(F.col("y") + F.col("h"), (F.col("cy") + 1) / F.lit(float(down))) - F.greatest(F.col("y"), F.col("cy") / F.lit(float(down)))
    part = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)) * across * down
    return spread.groupBy(*PAGE, (F.col("cy") * across + F.col("cx")).alias("cell")).agg(F.least(F.lit(1.0), F.sum(part)).alias("share")).where("share > 0")
