"""What a published collection consists of, as tables: pages with their payloads, lines and links, inventories, search rows and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import frames

PAGE = ["doc_id", "page"]
#: Folders whose pages are about one document.
DATA_FOLDERS = ("d", "files", "media", "data", "_search")


def payloads(words: DataFrame) -> DataFrame:
    """(doc_id, page, payload): four whole parts a token, flat, and the count, as JSON."""
    own = frames.to_parts(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", own.alias("b")))).alias("t"))
    return pages.select(*PAGE, F.to_json(F.struct(F.flatten(F.transform("t", lambda t: t["b"])).alias("b"), F.size("t").alias("n"))).alias("payload"))


def in_script(json):
    """JSON that can stand in a script element."""
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(sign), F.lit(code))
    return json


def display_lines(words: DataFrame, redactions: DataFrame) -> DataFrame:
    """(doc_id, page, line, items): each line's words and gaps from left to right, as structs (x, kind, text, pos, doubtful, width).

    A gap goes into the line that its centre is in, the one it overlaps most; gaps in no line make a last line of their own. Words are
    doubtful below a confidence of 60, -1 being unknown.
    """
    item = lambda x, kind, text, pos, doubtful, width: F.struct(x.alias("x"), F.lit(kind).alias("kind"), text.alias("text"), pos.cast("int").alias("pos"), doubtful.alias("doubtful"), width.cast("int").alias("width"))
    none = lambda kind: F.lit(None).cast(kind)
    shown = words.select(*PAGE, "line", item(F.col("x"), "word", F.col("text"), F.col("pos"), F.col("conf").between(0, 59), none("int")).alias("item"))
    lines = words.groupBy(*PAGE, "line").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    width = F.greatest(F.lit(3), F.least(F.lit(100), F.bround(F.col("w") * 100)))
    gaps = redactions.select(*PAGE, "rid", "x", "y", "h", width.alias("width"), F.when(F.size("codes") > 0, F.col("codes")[0]).otherwise("").alias("code"))
    centre = F.col("y") + F.col("h") / 2
    near = gaps.join(lines, PAGE).where(centre.between(F.col("top"), F.col("bottom"))).withColumn("shared", F.least("bottom", F.col("y") + F.col("h")) - F.greatest("top", "y")).where("shared > 0")
    best = near.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "rid").orderBy(F.desc(F.round("shared", 9)), "line"))).where("k = 1").select(*PAGE, "rid", "line")
    last = lines.groupBy(*PAGE).agg((F.max("line") + 1).alias("last"))
    placed = gaps.join(best, [*PAGE, "rid"], "left").join(last, PAGE, "left").withColumn("line", F.coalesce("line", "last", F.lit(0)))
    bars = placed.select(*PAGE, "line", item(F.col("x"), "gap", F.col("code"), F.col("rid"), none("boolean"), F.col("width")).alias("item"))
    return shown.unionByName(bars).groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list("item")).alias("items"))


def packed_stamps(pages: DataFrame) -> DataFrame:
    """(doc_id, prefix, stamps) of ``pages(doc_id, page, stamp)``: what all stamps begin with is written once, if every page has one and it is longer than a sign."""
    docs = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("stamp", F.lit("")).alias("s")))), lambda p: p["s"]).alias("b"))
    docs = docs.where(F.exists("b", lambda s: s != ""))
    longest = F.array_max(F.transform("b", lambda s: F.length(s)))
    same = F.filter(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda n: F.forall("b", lambda s: (F.length(s) >= n) & (F.substr(s, F.lit(1), n) == F.substr(F.col("b")[0], F.lit(1), n))))
    n = F.coalesce(F.array_max(same), F.lit(0))
    docs = docs.withColumn("n", F.when(n >= 2, n).otherwise(0))
    cut = F.transform("b", lambda s: F.substr(s, F.col("n") + 1, F.length(s)))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.substr(F.col("b")[0], F.lit(1), F.col("n"))).alias("prefix"), F.when(F.col("n") > 0, cut).otherwise(F.col("b")).alias("stamps"))


def documents(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_redacted, n_unreadable, any_hidden, digest) of pages (doc_id, page, n_boxes, verdict, hidden, sha)."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum((F.col("n_boxes") > 0).cast("int")).alias("n_redacted"), F.sum(F.col("verdict").isin("suspect", "unreadable").cast("int")).alias("n_unreadable"), F.bool_or("hidden").alias("any_hidden"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), ""), 256).alias("digest"),
    )


def neighbours(pages: DataFrame) -> DataFrame:
    """Pages with the ones before and after them."""
    order = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumns({"previous": F.lag("page").over(order), "next": F.lead("page").over(order)})


def inventory(files: DataFrame) -> DataFrame:
    """One row for all files (path, size): count, bytes, and bytes of originals."""
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.startswith("path", F.lit("files/")), F.col("size"))), F.lit(0)).alias("original_bytes"))


def folder_versions(files: DataFrame, *about: str) -> DataFrame:
    """(folder, version): 16 digits that change with any path, size or content (sha) in a folder, and with what else is given.

    Files are combined by sums of their digests' halves, so no task holds a folder's list.
    """
    entry = F.sha2(F.concat_ws("\0", "path", F.col("size").cast("string"), "sha"), 256)
    half = lambda at: F.sum(F.conv(F.substring(entry, at, 12), 16, 10).cast("decimal(38,0)"))
    sums = files.groupBy("folder").agg(F.count("*").alias("n"), half(1).alias("a"), half(13).alias("b"))
    return sums.select("folder", F.substring(F.sha2(F.concat_ws(":", *map(F.lit, about), F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16).alias("version"))


def standing_pages(files: DataFrame, first: list[str], depth: int = 3, most: int = 24) -> DataFrame:
    """(path, place): pages that are about no single document, known ones first; 24 at most, which is the feature."""
    parts = F.split("path", "/")
    own = files.where(F.endswith("path", F.lit("index.html")) & (F.element_at(parts, -1) == "index.html") & ~parts[0].isin(*DATA_FOLDERS) & (F.size(parts) <= depth)).select("path").distinct()
    known = F.array_position(F.array(*map(F.lit, first)), F.col("path"))
    order = F.when(known > 0, known).otherwise(len(first) + 1)
    return own.withColumn("order", order).orderBy("order", "path").limit(most).withColumn("place", F.row_number().over(Window.orderBy("order", "path"))).drop("order")


def precached(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted paths that are there, and those that are missing."""
    have = files.select("path")
    return wanted.join(have, "path", "left_semi"), wanted.join(have, "path", "left_anti")


def codepoints(pages: DataFrame) -> DataFrame:
    """(cp): distinct characters that are shown of HTML texts; each page gives its own ones once."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"<[^>]*>", "")
    return pages.select(F.explode(F.array_distinct(F.split(bare, ""))).alias("c")).where("c <> ''").select(F.ascii("c").alias("cp")).distinct()


def fonts_for(points: DataFrame, faces: DataFrame, italic: bool) -> DataFrame:
    """(file): fonts (file, style, low, high) of which any shown character is in a range; slanted ones only if any text is."""
    may = faces if italic else faces.where("style = 'normal'")
    block = lambda c: F.floor(c / 256)
    listed = may.withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high")))))
    return listed.join(points.withColumn("block", block(F.col("cp"))), "block").where("cp between low and high").select("file").distinct()


def merged_boxes(hits: DataFrame) -> DataFrame:
    """(doc_id, page, boxes): boxes of hits (doc_id, page, pos, x, y, w, h) in order; what continues the one before on its line is one box with it."""
    box = F.struct("pos", "x", "y", "w", "h")
    kind = "array<struct<x: double, y: double, w: double, h: double>>"
    shape = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))

    def step(done, b):
        last = F.try_element_at(done, F.lit(-1))
        on = F.coalesce((F.abs(b["y"] - last["y"]) < last["h"] * 0.6) & (b["x"] >= last["x"]) & (b["x"] - (last["x"] + last["w"]) < 0.02), F.lit(False))
        right = F.greatest(last["x"] + last["w"], b["x"] + b["w"])
        wider = shape(last["x"], F.least(last["y"], b["y"]), right - last["x"], F.greatest(last["h"], b["h"]))
        return F.when(on, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), wider)).otherwise(F.array_append(done, shape(b["x"], b["y"], b["w"], b["h"])))

    rows = hits.groupBy(*PAGE).agg(F.array_sort(F.collect_list(box)).alias("b"))
    return rows.select(*PAGE, F.aggregate("b", F.array().cast(kind), step).alias("boxes"))


def positions(link):
    """Token numbers that a link carries behind w=."""
    return F.filter(F.transform(F.split(F.regexp_extract(link, r"(?:^|[#&])w=([0-9,]+)", 1), ","), lambda n: n.try_cast("int")), lambda n: n.isNotNull())


def page_of_url(url):
    """(slug, page) that a page's address names."""
    part = lambda k: F.nullif(F.regexp_extract(url, r"(?:^|/)d/([^/]+)/p/(\d+)(?:/|$)", k), F.lit(""))
    return F.struct(part(1).alias("slug"), part(2).cast("int").alias("page"))


def passages(items: DataFrame) -> DataFrame:
    """(doc_id, page, positions, quote) of selected items (doc_id, page, k, kind, text, pos): what is withheld is said in the quote."""
    said = F.when(F.col("kind") == "gap", F.when(F.col("text") != "", F.concat(F.lit("[withheld: "), "text", F.lit("]"))).otherwise("[withheld]")).otherwise(F.trim(F.regexp_replace("text", r"\s+", " ")))
    runs = items.withColumn("said", said).where("said <> ''").groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "word", F.col("pos")))).alias("positions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda s: s["said"]), " ").alias("quote"))
    return runs.where(F.size("positions") > 0)


def results(hits: DataFrame, most: int = 20) -> DataFrame:
    """(rank, doc_id, page, n_hits, link, n_more) of search hits (doc_id, page, n_hits, positions): the best pages, with how many more there are."""
    order = Window.orderBy(F.desc("n_hits"), *PAGE)
    top = hits.orderBy(F.desc("n_hits"), *PAGE).limit(most).withColumn("rank", F.row_number().over(order))
    total = hits.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))
    link = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("/p/"), F.col("page").cast("string"), F.lit("/#w="), F.array_join(F.slice("positions", 1, 12), ","))
    return top.crossJoin(F.broadcast(total)).select("rank", *PAGE, "n_hits", link.alias("link"), "n_more")  # one row of totals


def palette(docs: DataFrame, stamps: DataFrame, gaps: DataFrame, codes: DataFrame) -> DataFrame:
    """(kind, label, target): everything that can be jumped to: documents, series, gaps and codes."""
    rows = [(docs, "document", "title", "doc_id"), (stamps, "series", "prefix", "doc_id"), (gaps, "gap", "label", "doc_id"), (codes, "code", "code", "code")]
    out = None
    for df, kind, label, target in rows:
        part = df.select(F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"), F.col(target).cast("string").alias("target"))
        out = part if out is None else out.unionByName(part)
    return out
