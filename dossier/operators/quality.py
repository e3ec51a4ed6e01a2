"""Language, stopword and readability statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.functions.stopwords import by_word


def stopword_counts(tokens: DataFrame, stopwords: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, lang, hits, n): for each language with any, how many of the ``n`` alphabetic tokens are its stopwords.

    ``stopwords`` (lang, word) is a bounded vocabulary and is broadcast. Tokens are read once: they are counted by the set of languages they
    belong to, which leaves a few rows a document.
    """
    word = text.normalized(F.col("text"))
    alpha = tokens.select(*by, word.alias("word")).where(F.col("word").rlike(r"\p{L}"))
    counted = alpha.join(F.broadcast(by_word(stopwords)), "word", "left").groupBy(*by, "langs").agg(F.count("*").alias("c"))
    total = counted.withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return total.select(*by, "n", "c", F.explode_outer("langs").alias("lang")).groupBy(*by, "lang").agg(F.sum("c").alias("hits"), F.first("n").alias("n"))


def stopword_ratios(tokens: DataFrame, stopwords: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, lang, ratio, n): share of alphabetic tokens that are stopwords, for each language with any."""
    return stopword_counts(tokens, stopwords, by).where("lang is not null").select(*by, "lang", (F.col("hits") / F.col("n")).alias("ratio"), "n")


def declared_ratio(tokens: DataFrame, stopwords: DataFrame, declared: list[str], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, ratio): the best of all languages' ratios and, if several are declared, that of their lists together."""
    together = stopwords.where(F.col("lang").isin(*declared)).select(F.lit("+").alias("lang"), "word").distinct()
    lists = stopwords.unionByName(together) if len(declared) > 1 else stopwords
    return stopword_ratios(tokens, lists, by).groupBy(*by).agg(F.max("ratio").alias("ratio"))


def languages(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(doc_id, language, confidence): the language with the highest ratio, ties to the lower code; und without any hit."""
    order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("ratio"), "lang")
    ratio = F.when(F.col("lang").isNotNull(), F.col("hits") / F.col("n"))
    ranked = stopword_counts(tokens, stopwords).withColumn("ratio", ratio).withColumn("k", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("ratio").over(order), F.lit(0.0)))
    margin = (F.col("ratio") - F.col("next")) / F.col("ratio")
    sure = F.least(F.lit(1.0), F.col("ratio") / 0.2) * (0.35 + 0.65 * margin) * F.least(F.lit(1.0), F.col("n") / 40.0)
    return ranked.where("k = 1").select("doc_id", F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


def page_verdicts(words: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Verdict for each page from five signals; two make it suspect. Words are read once and counted by their stopword languages, lengths and confidence.

    A page is first reduced to one row for each language set, so both medians and the best language come from a few rows a page.
    """
    page = ["doc_id", "page"]
    word = text.normalized(F.col("text"))
    rows = words.select(*page, "conf", text.is_garbage(F.col("text")).cast("int").alias("bad"), F.when(word.rlike(r"\p{L}"), word).alias("word"))
    rows = rows.join(F.broadcast(by_word(stopwords)), "word", "left").withColumn("size", F.length("word"))
    parts = rows.groupBy(*page, "langs").agg(
        F.count("*").alias("n"), F.count("word").alias("alpha"), F.sum((F.col("conf") < 60).cast("int")).alias("low"), F.sum("bad").alias("bad"), F.sum("size").alias("length"), F.collect_list("conf").alias("confs"), F.collect_list("size").alias("sizes")
    )
    total = lambda c: F.sum(c).alias(c)
    pages = parts.groupBy(*page).agg(total("n"), total("alpha"), total("low"), total("bad"), total("length"), F.flatten(F.collect_list("confs")).alias("confs"), F.flatten(F.collect_list("sizes")).alias("sizes"), F.collect_list(F.struct("langs", "alpha")).alias("sets"))

    def middle(values):
        ordered, n = F.array_sort(values), F.size(values)
        return F.when(n > 0, (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2)

    held = F.array_distinct(F.flatten(F.transform("sets", lambda s: F.coalesce(s["langs"], F.array().cast("array<string>")))))
    hits = F.transform(held, lambda lang: F.aggregate("sets", F.lit(0).cast("bigint"), lambda t, s: t + F.when(F.coalesce(F.array_contains(s["langs"], lang), F.lit(False)), s["alpha"]).otherwise(0)))
    pages = pages.withColumns({"mid": middle(F.col("confs")), "mid_len": middle(F.col("sizes")), "top": F.coalesce(F.array_max(hits), F.lit(0)), "mean_len": F.try_divide("length", "alpha")})
    enough = F.col("alpha") >= 20
    signals = [
        enough & (F.col("top") / F.col("alpha") < 0.1),
        F.col("mid") < 70,
        F.col("low") / F.col("n") > 0.3,
        (F.col("n") >= 20) & (F.col("bad") / F.col("n") > 0.08),
        enough & ((F.col("mean_len") < 4.15) | (F.col("mean_len") > 6.25) | (F.col("mid_len") < 3) | (F.col("mid_len") > 6)),
    ]
    count = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return pages.withColumn("n_signals", count).select(*page, F.col("n").alias("n_words"), "n_signals", F.when(F.col("n_signals") >= 2, "suspect").otherwise("good").alias("verdict"))


def final_verdict(n_raw, has_image, had_glyphs, ink, pictorial, n_signals):
    """A page's verdict from its counted words, its image and the signals against it: blank, pictorial, unreadable, suspect or good."""
    empty = F.when(~has_image, F.when(had_glyphs, "unreadable").otherwise("blank")).when(ink < 0.005, "blank").when(pictorial, "pictorial").otherwise("unreadable")
    return F.when(n_raw == 0, empty).when((n_signals >= 2) & (n_raw < 5) & F.coalesce(pictorial, F.lit(False)), "pictorial").when(n_signals >= 2, "suspect").otherwise("good")


def embedded_text_broken(docs: DataFrame) -> DataFrame:
    """Signs that a text layer can't be trusted."""
    n = F.length("text")
    private = F.length(F.regexp_replace("text", "[^\\x{FFFD}\\x{E000}-\\x{F8FF}]", ""))
    spaces = F.length(F.regexp_replace("text", "[^ \\n\\t]", ""))
    return docs.select("doc_id", n.alias("n_chars"), (private > 0.1 * n).alias("private_use"), ((n > 40) & (spaces < 0.05 * n)).alias("few_spaces"))
