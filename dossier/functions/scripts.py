"""Scripts of texts, and names and codes of languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks of each script, blocks without a stopword list, and vowels.
RANGES = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x590, 0x6FF), (0x750, 0x77F)),
    "han": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)),
}
KANA_HANGUL = ((0x3040, 0x30FF), (0xAC00, 0xD7AF))
VOWELS = {"latin": "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "cyrillic": "аеёиоуыэюяіїєўӑәөүұ", "greek": "αεηιουωάέήίόύώϊϋΐΰ"}
# Codes by which recognisers call languages, and the languages' names.
RECOGNISER = {
    "eng": "en", "rus": "ru", "ukr": "uk", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "pol": "pl", "nld": "nl", "dut": "nl", "chi": "zh",
}
NAMES = {"en": "English", "ru": "Russian", "uk": "Ukrainian", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "it": "Italian", "pl": "Polish", "nl": "Dutch", "zh": "Chinese"}
SHARE, COVERED = 0.85, 0.5


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def letters(text: Column, ranges=None) -> Column:
    """How many letters of a text are in these blocks, or at all."""
    return F.length(F.regexp_replace(text, f"[^\\p{{L}}]{f'|[^{_class(ranges)}]' if ranges else ''}", ""))


def script(text: Column) -> Column:
    """The script that most letters are in, if that is 85 % of them; else mixed. A text without letters counts as Latin."""
    total = letters(text)
    out = F.when(total == 0, "latin")
    for name, ranges in RANGES.items():
        out = out.when(letters(text, ranges) >= SHARE * total, name)
    return out.otherwise("mixed")


def stopwords_apply(text: Column) -> Column:
    """Whether half of the letters are in scripts that have stopword lists; kana and hangul have none."""
    total = letters(text)
    have = sum((letters(text, r) for name, r in RANGES.items() if name in ("latin", "cyrillic", "han")), F.lit(0)) - letters(text, KANA_HANGUL)
    return (total > 0) & (have >= COVERED * total)


def is_garbage(token: Column) -> Column:
    """Whether recognition made this token up, by the rules of its own script: too long, a smear, too many marks, or too few or many vowels."""
    count = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    marks = F.length(F.regexp_replace(token, r"[^\p{P}\p{S}\p{C}]", ""))
    own = script(token)
    odd = F.lit(False)
    for name, vowels in VOWELS.items():
        share = F.try_divide(F.length(F.regexp_replace(F.lower(token), f"[^{vowels}]", "")), count)
        odd = F.when(own == name, F.coalesce((share < 0.1) | (share > 0.9), F.lit(False))).otherwise(odd)
    return (F.length(token) == 0) | (F.length(token) > 20) | token.rlike(r"(.)\1{3}") | (marks > 2) | ((count >= 4) & odd)


def language_code(code: Column) -> Column:
    """Two-letter code of a language given as en, eng, en-GB, en_US or chi_sim; null for an unknown one."""
    low = F.lower(F.trim(code))
    base = F.split_part(F.replace(low, F.lit("-"), F.lit("_")), F.lit("_"), F.lit(1))
    known = F.create_map(*(F.lit(x) for pair in (RECOGNISER | {k: k for k in NAMES}).items() for x in pair))
    return F.element_at(known, base)


def language_codes(codes: Column) -> Column:
    """Known codes of a list, in its order, each once."""
    return F.array_distinct(F.filter(F.transform(codes, language_code), lambda c: c.isNotNull()))


def language_name(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair)), code)


def characters(words, at: str = "text"):
    """Words (text, x, w, ...) with one row for each character of words in han script, boxes in proportion; other words stay."""
    parts = F.when((script(F.col(at)) == "han") & (F.length(at) > 1), F.filter(F.split(at, ""), lambda c: c != "")).otherwise(F.array(F.col(at)))
    out = words.withColumn("_parts", parts).withColumn("_n", F.size("_parts"))
    out = out.select(*(c for c in out.columns if c not in ("_parts", at)), F.posexplode("_parts").alias("part", "_text"))
    step = F.col("w") / F.col("_n")
    return out.withColumns({"x": F.col("x") + step * F.col("part"), "w": step, at: F.col("_text")}).drop("_text", "_n")
