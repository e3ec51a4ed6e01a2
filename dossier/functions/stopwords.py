"""Frequent words by language: a parameter of every operator that needs them.

Any table (lang, word) can be given. The default counts them in the collection itself, by language as far as
the documents say which one they are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import normalized

#: Words a language.
MOST = 60


def counted(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(lang, word): the ``most`` words that a language's documents (text, lang) hold most often, ties by the word. One pass over the texts."""
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = docs.where("lang is not null").select("lang", F.explode(parts).alias("t")).select("lang", normalized(F.col("t")).alias("word")).where(F.col("word").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return rows.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("k", place).where(F.col("k") <= most).select("lang", "word")


def by_word(stopwords: DataFrame) -> DataFrame:
    """(word, langs): one row a word, so that a token meets it once."""
    return stopwords.groupBy("word").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


#: The same for DuckDB, behind ``tokens``; NORM is the normalised token.
COUNTED_SQL = """stopwords as (select lang, word from (select lang, word, row_number() over (partition by lang order by count(*) desc, word) as k
  from (select doc_id, {norm} as word from tokens where regexp_matches({norm}, '\\p{{L}}')) join documents using (doc_id) where lang is not null group by lang, word) where k <= """ + str(MOST) + ")"
