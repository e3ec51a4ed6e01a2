"""What a user runs: a collection read, checked, written as tables, searched, and compared with another release.

Every step is a DataFrame plan; tables are written as Parquet below the output folder, one folder each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import phrases, scripts
from dossier.functions.text import natural_key
from dossier.operators import codes, compare, diffs, jobs, quality, redaction, search, site, spatial, stamps
from dossier.operators.lineage import written
from dossier.sources import files, pdf

PAGE = ["doc_id", "page"]


class SafetyStop(RuntimeError):
    """Pages have text under a box, or could not be checked, and the settings say to stop."""


def read(spark: SparkSession, folder: str, settings: dict) -> dict[str, DataFrame]:
    """Tables of a folder of PDFs: files, skipped, pages, glyphs, rects and words. A file that can't be read is a page with an error."""
    usable, skipped = files.discover(spark, folder, settings["include"], settings["exclude"])
    usable = written(usable)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    read_pages = written(pdf.pages(content.join(usable.where("kind = 'pdf'").select("path"), "path", "left_semi")))
    glyphs, rects = written(pdf.glyphs(read_pages)), written(pdf.rectangles(read_pages))
    return {"files": usable, "skipped": skipped, "pages": read_pages, "glyphs": glyphs, "rects": rects, "words": written(pdf.words(glyphs))}


def analysed(tables: dict[str, DataFrame], settings: dict, stopwords: DataFrame) -> dict[str, DataFrame]:
    """Redactions, leaks, published words, verdicts, languages, codes and control numbers of read tables."""
    words, glyphs, rects = tables["words"], tables["glyphs"], tables["rects"]
    wiped = written(redaction.wiped(redaction.hidden(glyphs, rects)))
    leaks = redaction.findings(wiped)
    boxes = written(redaction.ledger(rects, wiped))
    covering = redaction.candidates(rects).join(wiped.select(*PAGE, "rid"), [*PAGE, "rid"], "left_semi")
    shown = written(scripts.characters(spatial.visible(words, covering)))
    tokens = shown.withColumn("place", F.struct(*PAGE))
    languages = quality.languages(tokens.select(F.col("place").alias("doc_id"), "text"), stopwords).select("doc_id.*", "language", "confidence")
    lines = shown.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias("text"))
    series = written(stamps.detected(shown)) if not shown.isEmpty() else None
    pages = tables["pages"].where("page is not null").select(F.col("path").alias("doc_id"), "page", "width", "height", F.col("error").isNull().alias("analysed"))
    found = wiped.groupBy(*PAGE).agg(F.count("*").alias("n_wiped"))
    ratio = spatial.union_cells(shown.select(*PAGE, "x", "y", "w", "h").unionByName(boxes.select(*PAGE, "x", "y", "w", "h"))).withColumnRenamed("cells", "ink")
    dark = spatial.union_cells(boxes)
    pages = pages.join(found, PAGE, "left").join(ratio, PAGE, "left").join(dark, PAGE, "left").join(languages, PAGE, "left")
    pages = pages.withColumns({"hidden": F.coalesce("n_wiped", F.lit(0)), "ratio": F.coalesce(F.try_divide("cells", "ink"), F.lit(0.0)), "dark": F.lit(False), "n_boxes": F.coalesce("cells", F.lit(0)), "verdict": F.when(F.coalesce("ink", F.lit(0)) == 0, "blank").otherwise("good")})
    pages = pages.withColumn("state", phrases.page_state(F.col("dark"), F.col("ratio"), F.col("n_boxes"), F.col("verdict"))).drop("n_wiped", "cells", "ink")
    out = {"pages": pages, "redactions": boxes, "leaks": leaks, "words": shown, "codes": codes.codes(lines, None, settings["jurisdiction"]), "postings": search.postings(shown), "payloads": site.payloads(shown)}
    return out | ({"series": series, "stamps": stamps.attached(series)} if series is not None else {})


def check(tables: dict[str, DataFrame], stop: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row with counts, shapes of what was found): raises ``SafetyStop`` if pages leak or were not checked and ``stop`` is set."""
    gate = jobs.gate(tables["pages"], stop)
    row = gate.first()
    shapes = tables["leaks"].select(*PAGE, F.regexp_replace("text", r"[\p{L}\p{N}]", "#").alias("shape"))
    if not row["passes"]:
        raise SafetyStop(f"{row['n_leaking']} pages with text under boxes, {row['n_unchecked']} pages not checked")
    return gate, shapes


def build(spark: SparkSession, folder: str, out: str, settings: dict, stopwords: DataFrame) -> dict[str, str]:
    """Reads, checks and writes a collection; (table, path) of what was written. Nothing is written where the check stops."""
    raw = read(spark, folder, settings)
    tables = analysed(raw, settings, stopwords)
    tables["pages"] = written(tables["pages"])
    check(tables, settings["safety"]["hidden_text"] == "stop")
    tables["files"] = raw["files"].withColumn("order", natural_key(F.col("name")))
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def index_language(pages: DataFrame, chosen: str = "", interface: str = "en") -> str:
    """The language of the search index: the one set, else that of most pages, else the interface's."""
    top = pages.where("language is not null and language <> 'und'").groupBy("language").count().orderBy(F.desc("count"), "language").first()
    return chosen or (top["language"] if top else "") or interface or "en"


def document_scores(old: DataFrame, new: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, score) of documents (doc_id, name, text) of two releases: by text, and by name as a tiebreak; one name is a match of 0.45 at least.

    Only pairs that share a part of their sketches, or a name, can score; no others are made.
    """
    sketch = lambda df: df.select(F.col("doc_id").alias("id"), F.lower("name").alias("name"), compare.whole_sketch()("text").alias("all")).select("id", "name", F.slice("all", 1, compare.SKETCH).alias("sketch"), (F.size("all") <= compare.SKETCH).alias("complete"))
    a, b = written(sketch(old)), written(sketch(new))
    pairs = compare.likely(a, b, least / 2).unionByName(a.join(b.withColumnRenamed("id", "b"), "name").select(F.col("id").alias("a"), "b")).distinct()
    for side, df in (("a", a), ("b", b)):
        pairs = pairs.join(df.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("name", "sketch", "complete"))), side)
    scored = compare.jaccard(pairs).withColumn("likeness", alike_names("a_name", "b_name"))
    score = 0.78 * F.col("jaccard") + 0.22 * F.col("likeness")
    return scored.select("a", "b", F.when(F.col("a_name") == F.col("b_name"), F.greatest(score, F.lit(0.45))).otherwise(score).alias("score"))


def compared(old: dict[str, DataFrame], new: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Alignment, changes and findings of paired documents (a, b): tables alignment, verdicts, changes, regions, findings and noise.

    Pages that are paired surely enough are compared under one key: the old document and the old page.
    """
    named = written(pairs.select("a", "b", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair")))

    def side(tables: dict[str, DataFrame], key: str, name: str) -> DataFrame:
        prints = compare.page_prints(tables["words"]).join(named.select(F.col(key).alias("doc_id"), "pair"), "doc_id")
        return prints.withColumns({"side": F.lit(name), "n": F.col("page") - 1}).drop("doc_id", "page")

    pages = written(side(old, "a", "old").unionByName(side(new, "b", "new")))
    scores = written(compare.margins(compare.scored_pages(pages)))
    settled = written(compare.settled(compare.aligned(scores), scores))
    sizes = pages.groupBy("pair").agg(F.sum((F.col("side") == "old").cast("bigint")).alias("n_old"), F.sum((F.col("side") == "new").cast("bigint")).alias("n_new"))
    verdicts = written(compare.verdicts(settled, scores, sizes))
    usable = settled.where("confidence in ('certain', 'high', 'medium')").join(verdicts.where("refusal is null").select("pair"), "pair", "left_semi").join(named, "pair")
    link = written(usable.select("a", "b", (F.col("i") + 1).cast("int").alias("old_page"), (F.col("j") + 1).cast("int").alias("new_page")))
    before = lambda df: df.join(link.select(F.col("a").alias("doc_id"), F.col("old_page").alias("page")), PAGE, "left_semi")
    after = lambda df: df.withColumnRenamed("doc_id", "b").withColumnRenamed("page", "new_page").join(link, ["b", "new_page"]).withColumnsRenamed({"a": "doc_id", "old_page": "page"}).drop("b", "new_page")
    w0, w1 = written(before(old["words"])), written(after(new["words"]))
    changes = written(diffs.box_changes(before(old["redactions"]), after(new["redactions"])))
    where = written(diffs.regions(changes))
    sides = written(diffs.beside(diffs.paired(w0, w1), where))
    return {"alignment": settled, "verdicts": verdicts, "changes": changes, "roll_up": diffs.roll_up(changes), "regions": where, "findings": diffs.findings(sides), "noise": diffs.noise(sides)}


def alike_names(a: str, b: str):
    """Ratio of matching blocks of two names."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def ratio(x, y):
        import difflib

        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)
