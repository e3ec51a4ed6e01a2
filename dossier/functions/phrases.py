"""Short texts about pages, sizes and shares, and small tests on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that say nothing, words of notes about safety, and sizes from which a search index is slow or refused.
GENERIC = ("untitled", "document", "document1", "scan", "scanned document", "microsoft word", "untitled document", "title")
SAFETY = ("hidden", "redaction check", "under a black box", "leak", "not checked", "unconfirmed", "invisible", "painted under", "draw order")
SUPPORTED, REFUSED, INDEX_BYTES, BYTES_A_PAGE = 20_000, 50_000, 97_151, 5.5
SUFFIX = {"pdf": ".pdf", "png": ".png", "jpeg": ".jpg", "gif": ".gif", "tiff": ".tif", "bmp": ".bmp", "webp": ".webp"}


def truncated(text: Column, most: int = 56) -> Column:
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.rtrim(F.substring(bare, 1, most - 1)), F.lit("…")))


def code_slug(code: Column) -> Column:
    """b(7)(C) as b7c; none for nothing."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(code), r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit("none"))


def short_number(value: Column) -> Column:
    """Two decimals at most, without zeros at the end."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value.cast("double")), "0+$", ""), r"\.$", "")
    return F.when((value <= 0) & (value > -0.005), "0").otherwise(text)


def printable(name: Column) -> Column:
    """Bytes as text, with a question mark for what is none."""
    return F.regexp_replace(F.make_valid_utf8(name), "�", "?")


def title(claimed: Column, stem: Column) -> Column:
    """A document's own title if it says something, else its file's name."""
    own, name = F.trim(F.coalesce(claimed, F.lit(""))), F.trim(F.translate(stem, "_-", "  "))
    low = F.lower(own)
    serial = (F.length(own) - F.length(F.replace(own, F.lit("-"))) >= 4) & ~F.contains(own, F.lit(" "))
    useless = (F.length(own) < 3) | low.isin(*GENERIC) | low.rlike(r"\.(?:doc|docx|pdf|rtf)$") | F.startswith(low, F.lit("microsoft word")) | serial
    return F.when(useless, name).otherwise(own)


def about_safety(note: Column) -> Column:
    low = F.lower(note)
    found = F.lit(False)
    for words in SAFETY:
        found = found | F.contains(low, F.lit(words))
    return found


def share(value: Column) -> Column:
    """A share of one page as a table has it."""
    percent = lambda digits: F.concat(F.format_string(f"%.{digits}f", F.round(value * 100, digits)), F.lit("%"))
    return F.when(value <= 0, "0%").when(value < 0.001, "<0.1%").when(value < 0.1, percent(1)).otherwise(percent(0))


def share_band(value: Column) -> Column:
    return F.when(value <= 0, "none").when(value < 0.001, "tiny").when(value < 0.01, "small").otherwise("large")


def extent_band(total: Column) -> Column:
    """How much paper shares add up to: pages, a page, a share in one or no decimal, or hardly any."""
    return F.when(total >= 1.95, "pages").when(total >= 0.95, "page").when(total >= 0.01, "share").when(total >= 0.001, "small share").otherwise("tiny")


def page_state(dark: Column, ratio: Column, n_boxes: Column, verdict: Column) -> Column:
    return F.when(dark, "dark").when(ratio >= 0.9, "full").when(n_boxes > 0, "part").when(verdict == "blank", "void").otherwise("plain")


def published_suffix(kind: Column) -> Column:
    """The extension under which a file of a recognised type is published, whatever it is called."""
    known = F.create_map(*(F.lit(x) for pair in SUFFIX.items() for x in pair))
    return F.coalesce(F.element_at(known, kind), F.lit(".bin"))


def first_search_bytes(pages: Column) -> Column:
    return (INDEX_BYTES + F.bround(pages * BYTES_A_PAGE)).cast("bigint")


def scale_warning(pages: Column) -> Column:
    return F.when(pages > REFUSED, "refused").when(pages > SUPPORTED, "slow")
