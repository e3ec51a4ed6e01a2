"""Directory scan: type by content, duplicates by digest, natural order, unique slugs."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import natural_key, slug

# First bytes of the file types that are read.
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("424D", "image"))
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".tsv")


def kind_of(content, name, length):
    """pdf, image, text or unsupported, by first bytes and only then by name."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.when(length == 0, "unsupported")
    for prefix, k in MAGIC:
        kind = kind.when(F.startswith(head, F.lit(prefix)), k)
    riff = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    late_pdf = F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("255044462D"))
    plain = F.expr("is_valid_utf8(cast(content as string))") & ~F.hex(F.substring(content, 1, 4096)).rlike("^(..)*00")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return kind.when(riff, "image").when(late_pdf, "pdf").when(suffix.isin(*TEXT_SUFFIXES) & plain, "text").otherwise("unsupported")


def matches(column, patterns: list[str]):
    """Whether a name or path matches any of the glob patterns, whatever the case."""
    return column.rlike("(?i)" + "|".join(f"(?:{fnmatch.translate(p)})" for p in patterns)) if patterns else F.lit(False)


def deduplicated(files: DataFrame) -> DataFrame:
    """(name, sha256, ...) with ``rank`` in natural order, ``duplicate_of`` the first file of equal bytes, and ``aliases``."""
    same = Window.partitionBy("sha256").orderBy(natural_key(F.col("name")), "name")
    first = F.first("name").over(same)
    return files.withColumn("copy", F.row_number().over(same)).withColumn("duplicate_of", F.when(F.col("copy") > 1, first))


def with_unique_slugs(files: DataFrame) -> DataFrame:
    """``slug`` for each file; later files of one base slug get -2, -3 and so on, in natural order."""
    base = files.withColumn("base", slug(F.regexp_replace("name", r"\.[^.]*$", "")))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(natural_key(F.col("name")), "name"))
    return base.withColumn("nth", nth).withColumn("slug", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("nth").cast("string")))).drop("nth", "base")


def discover(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable, skipped) files below ``root``; contents are hashed on the executors and not kept. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind_of(F.col("content"), name, F.col("length")).alias("kind"))
    excluded = matches(F.col("name"), exclude or []) | matches(F.col("path"), exclude or [])
    included = matches(F.col("name"), include) | matches(F.col("path"), include) if include else F.lit(True)
    marked = deduplicated(files.withColumn("reason", F.when(excluded, "excluded").when(~included, "not included").when(F.col("kind") == "unsupported", "unsupported type").when(F.col("kind") == "text", "operator note")))
    usable = with_unique_slugs(marked.where("reason is null and duplicate_of is null"))
    return usable, marked.where("reason is not null or duplicate_of is not null").withColumn("reason", F.coalesce("reason", F.concat(F.lit("same bytes as "), "duplicate_of")))
