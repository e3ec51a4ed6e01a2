"""From raw documents to packed training sequences.

Five stages, each run over all that the one before kept: rows of low quality go; of each class of near duplicates one
document stays; repeated passages are cut out of the texts; sources are mixed to their target weights; what is left is packed into
sequences. Every stage is written and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import checked_broadcast, cut, shared_folder, table
from dossier.llm.mixing import mixed_documents
from dossier.llm.near_dedup import near_duplicates
from dossier.llm.packing import pack_documents
from dossier.llm.quality import score_quality
from dossier.llm.queries import tokenizer_path
from dossier.llm.substring_dedup import without_repeats

#: Bytes from which a repeated string is cut out of the texts: fewer than a passage of 51 words has. op6's length is its own.
PASSAGE = 200


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is listed. Ids are broadcast while their count allows it, so that texts aren't shuffled for it."""
    ids = checked_broadcast(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones.

    Null and empty texts are scored as such, like all others. Rows that share an id are judged together: they stay if one of them is good. An empty table stays empty.
    """
    good = score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(F.col("doc_id").alias("_id")).distinct()
    return _only(docs, good)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id.

    Texts without words are in no class and stay. Rows that share an id are one document, of which the row with the least text stays; so
    does one row of all that have no id.
    """
    kept = cut(near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")))
    rows, ids = kept.agg(F.count("*"), F.count_distinct(F.struct("_id"))).first()
    left = _only(docs, kept.distinct())
    if rows == ids:
        return left
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("_text"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return left.select(whole, F.col("doc_id").alias("_id"), F.col("text").alias("_text")).withColumn("_nth", nth).where("_nth = 1").select("_row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE`` bytes that occur again; documents go of which nothing is left but had a text before.

    Null, empty and blank texts stay as they are. Rows that repeat an id and a text lose all of it and go.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(whole, F.col("doc_id"), F.col("text"), F.coalesce(F.trim("text") == "", F.lit(True)).alias("_blank"))
    left = without_repeats(rows, length=PASSAGE).where(F.col("_blank") | (F.trim("text") != ""))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words cost nothing and stay once. A null source is a source of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024; a null or empty text is its end token. Repeated rows are packed as often as they stand."""
    return pack_documents(docs, tokenizer=tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Boosted trees and exact token packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _gone(spark: SparkSession, path: str) -> None:
    """Deletes a stage's table once the next one is written."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of the stages before are deleted; the last one, which the result reads, stays in the shared folder."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _gone(spark, last)
        last = path
    return docs
