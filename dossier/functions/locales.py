"""What differs between languages: plural categories, numbers, dates, directions, and catalogues of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The plural rule of each language, the languages written from the right, and each rule's categories.
RULE = {**dict.fromkeys(("en", "de", "nl", "it"), "one_i"), "es": "one_n", **dict.fromkeys(("fr", "pt"), "one_zero"), **dict.fromkeys(("ru", "uk"), "east_slavic"), "pl": "polish", "ar": "arabic", "he": "hebrew", **dict.fromkeys(("zh", "ja", "ko", "vi", "th", "other"), "other")}
RIGHT_TO_LEFT = ("ar", "fa", "he", "ur", "yi")
FORMS = {"one_i": "one other", "one_n": "one other", "one_zero": "one other", "east_slavic": "one few many other", "polish": "one few many other", "arabic": "zero one two few many other", "hebrew": "one two other", "other": "other"}


def operands(number: Column) -> tuple[Column, Column, Column]:
    """i, v and n of a decimal text: whole part, digits behind the mark as written, value."""
    text = F.regexp_replace(number, "^-", "")
    return F.split_part(text, F.lit("."), F.lit(1)).cast("bigint"), F.length(F.split_part(text, F.lit("."), F.lit(2))), text.cast("double")


def plural(rule: str, number: Column) -> Column:
    """Plural category of a number, given as its decimal text, under a rule of ``RULE``."""
    i, v, n = operands(number)
    ten, hundred = i % 10, i % 100
    whole = v == 0
    few = ten.between(2, 4) & ~hundred.between(12, 14)
    if rule == "one_i":
        return F.when((i == 1) & whole, "one").otherwise("other")
    if rule == "one_n":
        return F.when(n == 1, "one").otherwise("other")
    if rule == "one_zero":
        return F.when(i <= 1, "one").otherwise("other")
    if rule == "east_slavic":
        return F.when(~whole, "other").when((ten == 1) & (hundred != 11), "one").when(few, "few").otherwise("many")
    if rule == "polish":
        return F.when(~whole, "other").when(i == 1, "one").when(few, "few").otherwise("many")
    if rule == "arabic":
        return F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(~whole, "other").when(hundred.between(3, 10), "few").when(hundred >= 11, "many").otherwise("other")
    if rule == "hebrew":
        return F.when(~whole, "other").when(i == 1, "one").when(i == 2, "two").otherwise("other")
    if rule == "other":
        return F.when(number.isNotNull(), "other")
    raise ValueError(f"unknown plural rule {rule!r}")


def ambiguous(spark, rule: str, limit: int = 200) -> DataFrame:
    """(category): categories that more than one number up to the limit has, so that its message must show the number."""
    numbers = spark.range(limit + 1).select(plural(rule, F.col("id").cast("string")).alias("category"))
    return numbers.groupBy("category").agg(F.count("*").alias("n")).where("n > 1").select("category")


def number(value: Column, digits: int = 0, group: str = ",", mark: str = ".", least: int = 1) -> Column:
    """A number as a language writes it; with ``least`` 2, four digits before the mark stay together."""
    text = F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))
    whole, rest = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    digits_of = F.length(F.regexp_replace(whole, "-", ""))
    grouped = F.when(digits_of >= 3 + least, F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", group)).otherwise(whole)
    return F.concat(grouped, F.lit(mark), rest) if digits else grouped


def date(iso: Column, months: list[str], order: str = "d m y") -> Column:
    """An ISO date in words: day, month of the list and year, in the order given; other texts pass as they are."""
    part = lambda k: F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})", k)
    month = F.try_element_at(F.array(*map(F.lit, months)), F.coalesce(part(2).try_cast("int"), F.lit(13)))
    of = {"d": F.regexp_replace(part(3), "^0", ""), "m": month, "y": part(1)}
    return F.when(month.isNotNull(), F.concat_ws(" ", *(of[k] for k in order.split()))).otherwise(iso)


def locale(code: Column) -> Column:
    """A language code as folders are named: en, pt-BR; null for nothing."""
    parts = F.split(F.replace(F.trim(code), F.lit("_"), F.lit("-")), "-")
    low = F.lower(parts[0])
    return F.nullif(F.when(F.size(parts) > 1, F.concat_ws("-", low, F.upper(parts[1]))).otherwise(low), F.lit(""))


def direction(code: Column) -> Column:
    return F.when(F.lower(F.substring(code, 1, 2)).isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr")


def placeholders(message: Column) -> Column:
    """Names in braces of a message, each once, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1))))


def translated(message: Column, values: dict[str, Column]) -> Column:
    """A message with its placeholders filled; others stay."""
    for name, value in values.items():
        message = F.replace(message, F.lit("{" + name + "}"), value.cast("string"))
    return message


def checked(catalogue: DataFrame, source: DataFrame, forms: list[str]) -> DataFrame:
    """(key, form, problem): what a catalogue (key, form, message) lacks, has too much or says with other placeholders than its source.

    form is null for messages without a plural; a plural message needs all of ``forms``.
    """
    plural_keys = source.where("form is not null").select("key").distinct()
    wanted = source.where("form is null").select("key", "form").unionByName(plural_keys.withColumn("form", F.explode(F.array(*map(F.lit, forms)))))
    keys = lambda df: df.select("key", F.coalesce("form", F.lit("")).alias("form"))
    missing = keys(wanted).join(keys(catalogue), ["key", "form"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = keys(catalogue).join(keys(wanted), ["key", "form"], "left_anti").withColumn("problem", F.lit("extra"))
    names = source.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(placeholders(F.col("message")))))).alias("names"))
    drift = catalogue.join(names, "key").where(F.size(F.array_except(placeholders(F.col("message")), "names")) > 0)
    return missing.unionByName(extra).unionByName(keys(drift).withColumn("problem", F.lit("unknown placeholder")))
