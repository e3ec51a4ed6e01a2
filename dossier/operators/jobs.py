"""Work on a collection page by page: jobs, batches, the choice of a text, gates, and kept results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.phrases import about_safety

# How much one rendering process takes, and words of notes that only describe bad luck.
MOST_PAGES, MOST_MEGAPIXELS = 32, 400.0
TRANSIENT = ("timed out", "timeout", "could not start", "out of memory", "killed", "temporarily")


def page_jobs(files: DataFrame) -> DataFrame:
    """(file, page) of ``files(file, kind, n_tree, n_scan)``: as many pages as the more generous count says, one for an image."""
    n = F.when(F.col("kind") == "image", 1).otherwise(F.greatest(F.coalesce("n_tree", F.lit(0)), F.coalesce("n_scan", F.lit(0))))
    return files.withColumn("n", n).where("n > 0").select("file", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"))


def batches(pages: DataFrame, most_pages: int = MOST_PAGES, most_megapixels: float = MOST_MEGAPIXELS) -> DataFrame:
    """(file, first, last, dpi) of ``pages(file, page, dpi, megapixels)``: runs of pages that one process renders.

    A run ends at a gap, at another resolution, and where it would be too long or too large. Runs without the size limits come from windows;
    only the carry within such a run is a fold over its pages.
    """
    order = Window.partitionBy("file").orderBy("page")
    new = F.coalesce((F.col("page") != F.lag("page").over(order) + 1) | (F.col("dpi") != F.lag("dpi").over(order)), F.lit(True))
    runs = pages.withColumn("run", F.sum(new.cast("int")).over(order)).groupBy("file", "run").agg(F.first("dpi").alias("dpi"), F.array_sort(F.collect_list(F.struct("page", "megapixels"))).alias("ps"))
    kind = "array<struct<first: int, last: int, n: int, mp: double>>"
    part = lambda f, l, n, mp: F.struct(f.cast("int").alias("first"), l.cast("int").alias("last"), n.cast("int").alias("n"), mp.cast("double").alias("mp"))  # noqa: E731, E741

    def step(done, p):
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce((last["n"] < most_pages) & (last["mp"] + p["megapixels"] <= most_megapixels), F.lit(False))
        longer = part(last["first"], p["page"], last["n"] + 1, last["mp"] + p["megapixels"])
        return F.when(fits, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.array_append(done, part(p["page"], p["page"], F.lit(1), p["megapixels"])))

    return runs.select("file", "dpi", F.explode(F.aggregate("ps", F.array().cast(kind), step)).alias("b")).select("file", F.col("b.first"), F.col("b.last"), "dpi")


def page_geometries(info):
    """Sizes of pages as a PDF tool prints them: array of (page, width, height, turn); a single size stands for all pages."""
    line = r"Page\s+(\d+)\s+size:\s+([0-9.]+) x ([0-9.]+) pts"
    part = lambda k: F.regexp_extract_all(info, F.lit(line), F.lit(k))
    turn = F.regexp_extract_all(info, F.lit(r"Page\s+\d+\s+rot:\s+(\d+)"), F.lit(1))
    rows = F.transform(part(1), lambda p, i: F.struct(p.cast("int").alias("page"), F.get(part(2), i).cast("double").alias("width"), F.get(part(3), i).cast("double").alias("height"), F.coalesce(F.get(turn, i).cast("int"), F.lit(0)).alias("turn")))
    one = lambda k: F.nullif(F.regexp_extract(info, r"Page size:\s+([0-9.]+) x ([0-9.]+) pts", k), F.lit("")).cast("double")
    n = F.greatest(F.coalesce(F.regexp_extract(info, r"Pages:\s+(\d+)", 1).try_cast("int"), F.lit(1)), F.lit(1))
    same = F.transform(F.sequence(F.lit(1), n), lambda p: F.struct(p.cast("int").alias("page"), one(1).alias("width"), one(2).alias("height"), F.coalesce(F.regexp_extract(info, r"Page rot:\s+(\d+)", 1).try_cast("int"), F.lit(0)).alias("turn")))
    return F.when(F.size(part(1)) > 0, rows).when(one(1).isNotNull(), same)


def recognised_words(rows: DataFrame, least: int = 0) -> DataFrame:
    """(doc_id, page, pos, text, conf, line) of a recogniser's rows (doc_id, page, k, level, block, par, line, conf, text): its words, with lines numbered as they first occur."""
    words = rows.where((F.col("level") == 5) & (F.col("conf") >= max(0, least)) & (F.trim("text") != ""))
    first = F.min("k").over(Window.partitionBy("doc_id", "page", "block", "par", "line"))
    page = Window.partitionBy("doc_id", "page")
    numbered = words.withColumn("first", first).withColumns({"pos": F.row_number().over(page.orderBy("k")) - 1, "row": F.dense_rank().over(page.orderBy("first")) - 1})
    return numbered.select("doc_id", "page", "pos", "text", F.bround("conf").cast("int").alias("conf"), F.col("row").alias("line"))


def chosen_source(mode, embedded, trusted, has_image):
    """Where a page's text is taken from: embedded, ocr, empty or error, by the mode (auto, always, never)."""
    return F.when((mode == "never") & embedded, "embedded").when(mode == "never", "empty").when((mode == "auto") & embedded & trusted, "embedded").when(has_image, "ocr").when(embedded, "embedded").otherwise("error")


def language_note(detected, declared):
    """A note where the language found is none of those declared."""
    return F.when((detected != "und") & (F.size(declared) > 0) & ~F.array_contains(declared, detected), F.concat(F.lit("reads as "), detected, F.lit(", which is not declared")))


def script_note(judgeable, n_words):
    return F.when((n_words > 0) & ~judgeable, "no word list covers this page's script")


def refusal(hidden, analysed, error, annotated, notes):
    """Why a page's result must not be kept, or null: text under a box, no check, an error, annotations of the whole document, or bad luck."""
    luck = F.exists(notes, lambda n: F.lower(n).rlike("|".join(TRANSIENT)))
    return F.when(hidden > 0, "text under a box").when(~analysed, "not checked").when(error.isNotNull(), "error").when(annotated, "annotated").when(luck, "bad luck")


def gate(pages: DataFrame, stop: bool = True) -> DataFrame:
    """One row on pages (hidden, analysed): pages with hidden text, unchecked pages, and whether publishing may go on."""
    count = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    out = pages.agg(count(F.col("hidden") > 0).alias("n_leaking"), count(~F.col("analysed")).alias("n_unchecked"))
    return out.withColumn("passes", F.lit(not stop) | ((F.col("n_leaking") == 0) & (F.col("n_unchecked") == 0)))


def noted(notes: DataFrame, most: int = 12) -> DataFrame:
    """(note, n_pages, safety) of notes (doc_id, page, note): those about safety all, of the others the ``most`` most frequent, which is the feature."""
    rows = notes.groupBy("note").agg(F.count_distinct("doc_id", "page").alias("n_pages")).withColumn("safety", about_safety(F.col("note")))
    place = F.row_number().over(Window.partitionBy("safety").orderBy(F.desc("n_pages"), "note"))
    return rows.withColumn("k", place).where(F.col("safety") | (F.col("k") <= most)).drop("k")


def memo_keys(jobs: DataFrame, fields: list[str], version: str, environment: dict[str, str]) -> DataFrame:
    """Jobs with key and shard: the digest of everything their result depends on, and its first two digits."""
    inputs = F.struct(F.lit(version).alias("format"), *(F.col(f) for f in sorted(fields)), *(F.lit(v).alias(f"env_{k}") for k, v in sorted(environment.items())))
    return jobs.withColumn("key", F.sha2(F.to_json(inputs), 256)).withColumn("shard", F.substring("key", 1, 2))


def moved(before: dict[str, str], now: dict[str, str]) -> str:
    """Which parts of the environment differ from those that kept results were made in."""
    return "; ".join(f"{k} moved from {before[k]} to {now[k]}" for k in sorted(now) if k in before and before[k] != now[k])


def memo_stats(entries: DataFrame) -> DataFrame:
    """One row on kept results (key, bytes, used): entries, bytes, the oldest and the newest."""
    return entries.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("used").alias("oldest"), F.max("used").alias("newest"))


def restored(jobs: DataFrame, memo: DataFrame) -> DataFrame:
    """Jobs with their kept result, where the entry is sound: its own key and the digest of its content agree."""
    sound = memo.where((F.col("key") == F.col("own_key")) & (F.sha2("result", 256) == F.col("sha")))
    return jobs.join(sound.select("key", "result"), "key", "left")
