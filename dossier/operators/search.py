"""Positional inverted index, phrase and prefix search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import normalized


def postings(words: DataFrame) -> DataFrame:
    """(term, doc_id, page, positions): terms are normalised tokens."""
    return words.select(normalized(F.col("text")).alias("term"), "doc_id", "page", "pos").where("term <> ''").groupBy("term", "doc_id", "page").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def search(index: DataFrame, terms: list[str], most: int = 12) -> DataFrame:
    """(doc_id, page, n_hits, positions): pages with all terms, with at most ``most`` positions each."""
    hit = index.where(F.col("term").isin(*terms)).groupBy("doc_id", "page").agg(F.count("*").alias("n_terms"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("p"))
    return hit.where(F.col("n_terms") == len(set(terms))).select("doc_id", "page", F.size("p").alias("n_hits"), F.slice("p", 1, most).alias("positions"))


def found(words: DataFrame, terms: list[str], most: int | None = None) -> DataFrame:
    """The same as ``search`` without a kept index: only the words that are sought are grouped."""
    hits = words.select(normalized(F.col("text")).alias("term"), "doc_id", "page", "pos").where(F.col("term").isin(*terms))
    pages = hits.groupBy("doc_id", "page").agg(F.size(F.collect_set("term")).alias("n_terms"), F.array_sort(F.collect_list("pos")).alias("p"))
    return pages.where(F.col("n_terms") == len(set(terms))).select("doc_id", "page", F.size("p").alias("n_hits"), (F.slice("p", 1, most) if most else F.col("p")).alias("positions"))


def phrase(words: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, page, pos): where the terms follow each other."""
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    rows = words.select("doc_id", "page", "pos", normalized(F.col("text")).alias("t"))
    for k in range(1, len(terms)):
        rows = rows.withColumn(f"t{k}", F.lead("t", k).over(order))
    for k, term in enumerate(terms):
        rows = rows.where(F.col(f"t{k}" if k else "t") == term)
    return rows.select("doc_id", "page", "pos")


def tier(name, query: str):
    """How well a name matches: 0 prefix, 1 initials from the start, 2 word start, 3 inside, 4 initials further on, 5 subsequence; null none."""
    low, q = F.lower(name), query.lower()
    initials = F.regexp_replace(low, r"([a-z0-9])[a-z0-9]*[^a-z0-9]*", "$1")
    letters = ".*".join(f"[{c}]" for c in q)
    return F.when(F.startswith(low, F.lit(q)), 0).when(F.startswith(initials, F.lit(q)), 1).when(low.rlike(rf"(^|[^a-z0-9]){q}"), 2).when(F.contains(low, F.lit(q)), 3).when(F.contains(initials, F.lit(q)), 4).when(low.rlike(letters), 5)
